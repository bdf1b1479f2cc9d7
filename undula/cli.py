"""python -m undula.cli magnify IN OUT --mode laplacian --alpha 15 ...; python -m undula.cli psnr A B OUT"""

from __future__ import annotations

import argparse
import time
from dataclasses import fields, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import DIALECTS, PRESETS, MagnifyConfig
from .operators import clips, metrics
from .plans.magnify import magnify
from .ship import ship
from .sources import frames as fr
from .timing import StageTimers


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    run = sub.add_parser("magnify")
    run.add_argument("source")
    run.add_argument("target")
    run.add_argument("--dialect", choices=sorted(DIALECTS), default="cpp")
    run.add_argument("--preset", choices=sorted(PRESETS))
    for f in fields(MagnifyConfig):
        kind = type(f.default)
        run.add_argument(f"--{f.name}", type=(lambda v: v.lower() in ("1", "true", "yes")) if kind is bool else float if f.default is None else kind)
    run.add_argument("--video", action="store_true", help="a folder of video files instead of images")
    run.add_argument("--timing", action="store_true", help="print the time that each stage took in the tasks")
    run.add_argument("--warm_up", type=int, default=0, help="runs that aren't measured")
    run.add_argument("--runs", type=int, default=1)
    report = sub.add_parser("psnr")
    report.add_argument("--cut", action="store_true", help="leave out frames that only one side has, instead of failing")
    for name in ("first", "second", "target"):
        report.add_argument(name)
    return out


def config_of(args: argparse.Namespace) -> MagnifyConfig:
    base = PRESETS[args.preset] if args.preset else DIALECTS[args.dialect]
    return replace(base, **{f.name: getattr(args, f.name) for f in fields(MagnifyConfig) if getattr(args, f.name) is not None})


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = ship(SparkSession.builder.appName("undula").getOrCreate())
    if args.command == "magnify":
        clip = fr.read_frames(spark, args.source, values="byte")
        config = config_of(args)
        timers = StageTimers(spark) if args.timing else None
        out = magnify(clip, config, timers)
        took = []
        for k in range(args.warm_up + args.runs):
            began = time.time()
            if args.target.lower().endswith(".avi"):  # one clip, one file
                fr.write_avi(out, args.target, config.fps or clip.select(fr.effective_fps(F.col("fps"))).first()[0])
            elif args.video:  # every clip with its own rate
                rates = clips.rated(clip, config.fps).groupBy("video_id").agg(F.first("fps").alias("fps"))
                fr.write_clips(out.join(rates, "video_id"), args.target)
                fr.join_clips(spark, args.target)
            else:
                fr.write_images(out, args.target)
            if k >= args.warm_up:
                took.append((time.time() - began,))
        if timers:
            for name, (seconds, calls, rows) in timers.found().items():
                print(f"{name}: {seconds:.3f} task seconds, {rows} rows in {calls} batches or groups")
        if args.runs > 1 or args.warm_up:
            s = metrics.bench_stats(spark.createDataFrame(took, "seconds double"), "seconds").first()
            print(f"{args.runs} runs: mean {s.mean_v:.3f} s, sd {s.sd_v:.3f} s, CV {s.cv_pct:.1f} %, from {s.min_v:.3f} to {s.max_v:.3f} s")
    else:
        a, b = (fr.read_frames(spark, p) for p in (args.first, args.second))
        if all(len(x.select("video_id").distinct().limit(2).collect()) == 1 for x in (a, b)):  # one clip each, whatever their names
            a, b = a.withColumn("video_id", F.lit(".")), b.withColumn("video_id", F.lit("."))
        fr.write_report(metrics.frame_quality(metrics.compared(a, b, args.cut)).select("video_id", "t", "psnr"), args.target)


if __name__ == "__main__":
    main()
