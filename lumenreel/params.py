"""Thresholds of the operators, each with its default."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Energy:
    """Fixed values that map raw levels to energy and pick peaks."""

    audio_floor: float = -55.0
    audio_ceil: float = -14.0
    motion_floor: float = 0.5
    motion_ceil: float = 36.0
    high: float = 0.52
    low: float = 0.24
    top_share: float = 0.30
    peak_min: float = 0.50
    peak_gap: int = 3
    peak_max: int = 1
    version: int = 2


@dataclass(frozen=True)
class Tagging:
    """Selection of tags from clip-by-tag scores."""

    floor: float = 0.15
    strong: float = 0.24
    k_tag: float = 1.4
    clip_margin: float = 0.03
    max_coverage: float = 0.5
    top: int = 3
    threshold: float = 0.13
    margin: float = 0.01


@dataclass(frozen=True)
class Sessions:
    """Gaps in seconds: appearances split over appearance_gap; reel ranges merge up to merge_gap."""

    appearance_gap: float = 10.0
    merge_gap: float = 1.5
    pad: float = 0.75
    min_length: float = 1.0


@dataclass(frozen=True)
class Clustering:
    min_cluster_size: int = 5
    min_samples: int = 2
    epsilon: float = 0.68
    match_threshold: float = 0.68


@dataclass(frozen=True)
class Timeline:
    #: Standard frame rates: (nominal rate, numerator and denominator of a frame's duration). Fixed values, slowest first.
    rates: tuple[tuple[float, int, int], ...] = (
        (23.976, 1001, 24000), (24.0, 1, 24), (25.0, 1, 25), (29.97, 1001, 30000), (30.0, 1, 30),
        (50.0, 1, 50), (59.94, 1001, 60000), (60.0, 1, 60), (119.88, 1001, 120000), (120.0, 1, 120),
    )
    frame_epsilon: float = 0.001
    marker_cap: int = 900
    peak_label: str = "Energy peak"


@dataclass(frozen=True)
class Media:
    """File endings and sizes, as fixed values."""

    video: tuple[str, ...] = field(default=(".mp4", ".mov", ".m4v", ".mkv", ".avi", ".webm", ".flv", ".wmv", ".mpg", ".mpeg", ".mts", ".m2ts", ".mxf", ".ts", ".3gp", ".mqv"))
    writable: tuple[str, ...] = field(default=(".mp4", ".mov", ".m4v", ".3gp", ".3g2", ".mqv", ".lrv"))
    camera_raw: tuple[str, ...] = field(default=(".r3d", ".braw", ".ari", ".arri", ".crm", ".cine"))
    longest_side: int = 960
    fallback_size: tuple[int, int] = (1920, 1080)
    fallback_rate: float = 29.97
