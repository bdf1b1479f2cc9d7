"""Configuration of a magnification job, with presets for the known dialects."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class MagnifyConfig:
    """What to amplify and how.  Options that dialects disagree on are explicit fields."""

    mode: str = "gaussian"  # gaussian: frequency domain; laplacian: recursive
    levels: int = 4
    alpha: float = 50.0
    lambda_cutoff: float = 16.0
    low_hz: float = 0.8333
    high_hz: float = 1.0
    fps: float | None = None  # for all clips; else each clip's own, or 30
    attenuation: float = 1.0
    border: str = "reflect101"  # or reflect (edge repeating)
    size_rule: str = "ceil"  # or floor
    repair: bool = False  # up-sample by doubling sides only, and bring the result to the frame's size
    residual: bool = True  # keep the coarsest level in a Laplacian pyramid
    added_levels: str = "inner_residual"  # inner_residual: 1..n-1; inner: 1..n-2; outer: 0..n-2
    mask: str = "symmetric"  # or onesided: positive bins [low, high) only
    inverse: str = "exact"  # or constants: seven-digit inverse colour matrix
    rounding: str = "rint"  # or truncate
    first_frame: str = "raw"  # what the recursive filter gives at the first frame: raw or zero
    coefficients: str = "butterworth"  # or halved: the known defect of one dialect
    padding: str = "none"  # or optimal: zero-pad the series to a 2-3-5-smooth length
    optimize: bool = True

    def __post_init__(self):
        if self.mode not in ("gaussian", "laplacian"):
            raise ValueError(f"mode {self.mode!r}")
        if self.levels < (1 if self.mode == "laplacian" else 0) or self.levels > 10:
            raise ValueError("levels must be from 1 (0 for gaussian) to 10")
        if self.alpha < 0:
            raise ValueError("alpha must not be negative")
        if self.fps is not None and self.fps <= 0:
            raise ValueError("fps must be positive")
        if not 0 < self.low_hz < self.high_hz:
            raise ValueError("0 < low_hz < high_hz is needed")
        if self.mode == "laplacian" and self.fps is not None and self.high_hz >= self.fps / 2:
            raise ValueError("high_hz must be under half of fps")


CPP = MagnifyConfig()
PYTHON = replace(CPP, alpha=100.0, lambda_cutoff=1000.0, low_hz=0.833, residual=False, added_levels="inner", mask="onesided", rounding="truncate")
CUDA = replace(CPP, border="reflect", inverse="constants", added_levels="outer", coefficients="halved")
DIALECTS = {"cpp": CPP, "python": PYTHON, "cuda": CUDA}

HEART_RATE = replace(CPP, alpha=50.0, low_hz=0.8333, high_hz=1.0, levels=4)
BREATHING = replace(CPP, alpha=30.0, low_hz=0.17, high_hz=0.5, levels=5)
BABY = replace(CPP, mode="laplacian", alpha=15.0, low_hz=0.4, high_hz=3.0, attenuation=0.1)
PRESETS = {"heart_rate": HEART_RATE, "breathing": BREATHING, "face": HEART_RATE, "baby": BABY}
