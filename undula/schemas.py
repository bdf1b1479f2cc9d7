"""Row layouts, as DDL.  Frames and series carry production work; pixels is the relational form."""


FRAMES = "video_id string, t int, h int, w int, c int, data array<double>"
BANDS = "video_id string, level int, t int, h int, w int, c int, data array<double>"
SERIES = "video_id string, level int, tile int, t int, data array<double>"
PIXELS = "video_id string, t int, y int, x int, ch int, v double"
METRICS = "frame int, psnr double, ssim double, max_diff double, mean_diff double"
