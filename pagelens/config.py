"""Settings of the pipelines around the engine; every field can come from the environment.

Sources disagree on detector thresholds, so none is a truth: pass what a run used.
"""

from __future__ import annotations

import dataclasses
import os


@dataclasses.dataclass(frozen=True)
class Detection:
    confidence: float = 0.26
    image_size: int = 1280
    most: int = 200
    nms_iou: float = 0.60
    dedup_iou: float = 0.90
    per_class: bool = False
    pad_x: float = 0.0
    pad_y: float = 0.0


@dataclasses.dataclass(frozen=True)
class Limits:
    regions: int = 60
    page_chars: int = 9000
    crop_chars: int = 260
    answer_chars: int = 500
    page_side: int = 4000


@dataclasses.dataclass(frozen=True)
class Scoring:
    dialect: str = "v1"
    iou: float = 0.5
    box_format: str = "xyxy"


def from_environment(kind, prefix: str = "PAGELENS_"):
    """An instance of ``kind`` with the fields set by ``PREFIX_FIELD`` variables."""
    given = {}
    for f in dataclasses.fields(kind):
        raw = os.environ.get(prefix + f.name.upper())
        if raw is not None:
            default = f.default
            given[f.name] = raw.lower() in ("1", "true", "yes") if isinstance(default, bool) else type(default)(raw)
    return kind(**given)
