"""Settings of a consensus run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PolishConfig:
    """window_length: tile size; quality_threshold: least mean base quality of a layer; error_threshold: most error of an
    overlap; trim: cut the ends of low coverage; match, mismatch, gap: alignment scores; fragment: correct reads
    instead of polishing contigs; include_unpolished: also return targets that nothing changed."""

    window_length: int = 500
    quality_threshold: float = 10.0
    error_threshold: float = 0.3
    trim: bool = True
    match: int = 3
    mismatch: int = -5
    gap: int = -4
    fragment: bool = False
    include_unpolished: bool = False

    def __post_init__(self):
        if self.window_length <= 0:
            raise ValueError("window length must be above zero")
        for name in ("match", "mismatch", "gap"):
            if not -128 <= getattr(self, name) <= 127:
                raise ValueError(f"{name} must be within -128 and 127")
