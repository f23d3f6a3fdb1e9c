"""Parameters of the segmentation, with defaults."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession


def _cos(degrees: float) -> float:
    return math.cos(math.radians(degrees))


@dataclass(frozen=True)
class SegmentationParameters:
    """Distances in metres; angles as cosines; ``per_rotation`` 0 infers the points of a turn from the scan."""

    per_rotation: int = 0
    points_per_segment: int = 8
    min_in_segment: int = 5
    max_invalid_in_segment: int = 5
    max_gap: int = 2
    max_bend: float = 0.05
    max_range: float = 9.0
    max_across_cells: float = 0.1
    min_cos_same_in_ring: float = _cos(20)
    max_across_rings: float = 0.4
    max_cos_normal: float = _cos(65)
    min_cos_same_cross_ring: float = _cos(15)
    max_error_grow: float = 0.05
    min_cos_tilt: float = 0.5
    max_error_refine: float = 0.05
    min_per_ring_multiple: int = 1
    max_segments: int = 250
    min_segments: int = 4
    min_rings: int = 3
    max_gap_refine: int = 5
    max_plane_size: float = 1.8
    max_rms: float = 0.02
    min_second_rms_multiple: float = 0.1
    max_planes: int = 16
    max_clusters: int = 50

    def __post_init__(self) -> None:
        if self.per_rotation < 0 or (self.per_rotation and self.per_rotation % self.points_per_segment):
            raise ValueError("per_rotation must be a positive multiple of points_per_segment, or 0")

    @classmethod
    def table(cls, spark: SparkSession) -> DataFrame:
        """Name, type and default of every parameter."""
        return spark.createDataFrame([(f.name, str(f.type), float(f.default)) for f in fields(cls)], "name string, type string, value double")
