"""Shared schema and the parameters of a profiling run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: One row per meter and instant. ``tslocal`` is whole epoch seconds, local time.
READINGS = T.StructType(
    [
        T.StructField("building_num", T.IntegerType()),
        T.StructField("tslocal", T.LongType()),
        T.StructField("usagekw", T.DoubleType()),
    ]
)

#: Fixed value: marks "this meter was not clustered again in that round".
NOT_CLUSTERED = -9999


@dataclass(frozen=True)
class ProfileConfig:
    """Parameters of a run; the defaults describe one day of one-minute readings."""

    interval_seconds: int = 60
    expected_readings: int = 1440
    window_seconds: int = 300
    min_denominator: float = 1e-10
    require_common_span: bool = False
    taper: float = 0.0
    k: int = 10
    rounds: int = 3
    max_iter: int = 100
    min_frac_reassigned: float = 0.001
    closest: int = 5
    seed: int = 42
