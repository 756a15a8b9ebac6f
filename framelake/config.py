"""Parameters of grouping and ranking, each named once."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class GroupingConfig:
    """Defaults are the fixed values of the specification."""

    burst_window_s: int = 15
    semantic_window_min: int = 3
    max_phash: int = 14
    semantic_min_matches: int = 2
    semantic_min_iou: float = 0.4
    orb_min_matches: int = 30
    orb_max_hamming: int = 45
    max_color_distance: float = 0.50
    #: Photos this many seconds apart, or more, are never compared.
    horizon_s: int = 660
    #: What an empty colour mask (all-zero histogram) does: "veto" keeps the photo alone, "skip_veto" ignores colour.
    empty_hist: str = "veto"


@dataclass(frozen=True)
class RankConfig:
    iso_knee: int = 800
    iso_slope: float = 0.00015
    min_group_max: float = 0.01
    main_face_share: float = 0.25


#: Suffixes of photos, and those of raw files among them (fixed values).
PHOTO_SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff", "webp", "heic", "heif", "dng", "arw", "nef", "cr2", "cr3", "raf", "rw2", "orf")
RAW_SUFFIXES = ("dng", "arw", "nef", "cr2", "cr3", "raf", "rw2", "orf")
IMPORT_CAPS = (50, 100, 200, 500, 1000)
