"""Spectral features of the normalised signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.spectrum import pgram


def periodogram(
    series: DataFrame,
    values: str = "usagekw_sum_5min_norm_arr",
    point_ids: str = "win_id_arr",
    taper: float = 0.0,
) -> DataFrame:
    """Add ``pgram_norm_arr`` (floor(N/2) values) and the ids of its points.

    The ids are the first half of the series' own ids, so they start where those start,
    although the first value belongs to frequency 1/N.
    """
    half = F.expr(f"slice({point_ids}, 1, cast(size({point_ids}) div 2 AS int))")
    return series.withColumns(
        {"pgram_pt_id_arr": half, "pgram_norm_arr": pgram(F.col(values), taper)}
    )
