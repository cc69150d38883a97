"""Thresholds of the raster analysis, as one frozen value that is passed along."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    # fixed values: sizes are pixels of the processed image
    extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png")
    mime_types: tuple[str, ...] = ("image/jpeg", "image/jpg", "image/png")
    max_bytes: int = 15 * 1024 * 1024
    min_side: int = 64
    max_side: int = 1024
    water_threshold: float = 0.45
    seed_support: float = 0.85
    seed_share: float = 0.02
    scene_clusters: int = 6
    scene_samples: int = 20_000
    scene_primary_share: float = 0.20
    scene_lightness: float = 0.6
    scene_hue_gap: float = 13.0
    scene_lighter: float = 18.0
    scene_blue: float = -8.0
    scene_softness: float = 3.0
    water_min_area: int = 400
    hole_max_area: int = 300
    verify_share: float = 0.02
    verify_support: float = 0.22
    canopy_threshold: float = 0.35
    canopy_min_area: int = 150
    buffer_size: int = 37
    water_open: int = 3
    water_close: int = 7
    candidate_kernel: int = 5
    canopy_kernel: int = 7
    candidate_min_area: int = 1500
    min_clearance: float = 6.0
    max_zones: int = 3
    area_full_share: float = 0.06
    clearance_full: float = 70.0
    isolated_min_area: int = 800
    separation_full: float = 120.0
    supply_inner: float = 18.0
    supply_outer: float = 60.0
    supply_min_area: int = 250
    supply_reported: int = 8
    #: Of clearances, water distances, separations and anchors: "exact" (Euclidean) or "chamfer5"
    #: (steps of a 5 x 5 mask); circles and drop points are exact always.
    metric: str = "exact"
    min_radius: int = 12
    max_radius: int = 180
    safety_margin: int = 4
    drop_step: int = 28
    drop_clearance: int = 10
    drop_max: int = 8
    confidence: float = 0.25
    nms_iou: float = 0.7
    max_detections: int = 300
    detector_input: int = 640
    detector_enabled: bool = True
    #: Of the classes that are reported, those to look for; all of them if empty.
    detector_classes: tuple[str, ...] = ()


def flag(text: str | None, default: bool) -> bool:
    """A switch as people write it: unset is the default; 0, false, no, off and nothing are off."""
    return default if text is None else text.strip().lower() not in ("0", "false", "no", "off", "")


def listed(text: str | None) -> tuple[str, ...]:
    """The entries between commas, without the space around them and without empty ones."""
    return tuple(x for part in (text or "").split(",") if (x := part.strip()))


def from_env(env: Mapping[str, str], base: Config = Config()) -> Config:
    """``base`` as the environment has it: DETECTOR_INPUT (between 320 and 1280, a multiple of 32,
    rounded down; what is no number changes nothing), DETECTOR_ENABLED (a switch),
    DETECTOR_CLASSES (a list, all classes without it) and DISTANCE_METRIC."""
    try:
        size = int(env.get("DETECTOR_INPUT", "").strip())
    except ValueError:
        size = base.detector_input
    return replace(
        base, detector_input=max(320, min(1280, size)) // 32 * 32, detector_enabled=flag(env.get("DETECTOR_ENABLED"), base.detector_enabled),
        detector_classes=listed(env.get("DETECTOR_CLASSES")) or base.detector_classes, metric=env.get("DISTANCE_METRIC", "").strip().lower() or base.metric,
    )


def mini() -> Config:
    """The same analysis for rasters of about 64 x 48 pixels."""
    return replace(
        Config(), water_min_area=12, hole_max_area=6, canopy_min_area=8, buffer_size=3, water_close=3, candidate_kernel=3, canopy_kernel=3,
        candidate_min_area=20, min_clearance=2.0, clearance_full=12.0, isolated_min_area=15, separation_full=20.0, supply_inner=2.0, supply_outer=6.0,
        supply_min_area=8, min_radius=2, max_radius=12, safety_margin=1, drop_step=4, drop_clearance=2,
    )
