"""Centroid tables, distances, and one table over all rounds.

Tables of centroids have k rows per round, so they are broadcast; k belongs to the
model and does not grow with the data.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.vectors import filled, l2, pad_to
from wattloom.operators.cluster import Round, centroid_table, round_suffixes
from wattloom.schema import NOT_CLUSTERED

_PROFILE = [
    "bgid",
    "building_num",
    "usagekw_sum_5min_mean",
    "usagekw_sum_5min_norm_denom",
    "win_id_arr",
    "usagekw_sum_5min_arr",
    "usagekw_sum_5min_norm_arr",
    "pgram_pt_id_arr",
    "pgram_norm_arr",
    "pgram_pt_id_arr_padded",
    "pgram_norm_arr_padded",
]


def unnest_centroids(model: DataFrame) -> DataFrame:
    """A model table ``(k, centroids)`` as one row per value; both indices count from 1."""
    width = F.size(F.get("centroids", F.lit(0)))
    flat = model.select("k", width.alias("width"), F.posexplode(F.flatten("centroids")))
    return flat.select(
        "k",
        F.expr("cast(pos div width + 1 AS int)").alias("array_id"),
        (F.col("pos") + 1).alias("index_id"),
        F.col("col").alias("centroid_points"),
    )


def centroid_rows(model: DataFrame) -> DataFrame:
    """A model table as one row per centroid. The id is the position, so equal centroids
    keep separate ids."""
    return model.select("k", F.posexplode("centroids").alias("cluster_id", "centroid_array")).select(
        "k", "centroid_array", "cluster_id"
    )


def distance_to_centroid(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Add the padded centroid of every point's own cluster and the distance to it."""
    joined = assigned.join(F.broadcast(centroids), ["k", "cluster_id"])
    return joined.select(
        *assigned.columns,
        pad_to(F.col("centroid_array"), F.size("pgram_norm_arr_padded")).alias("km_centroid_padded"),
        l2(F.col("centroid_array"), F.col("pgram_norm_arr").cast("array<double>")).alias("l2dist"),
    )


def merge_rounds(rounds: Sequence[DataFrame]) -> DataFrame:
    """Join the results of ``distance_to_centroid`` of all rounds by ``bgid``.

    Later rounds get the suffixes ``_r2``, ``_r3``, ... Only ids and distances of a later
    round are joined by meter; its centroids are a row per cluster, the longest one, come
    back by broadcast and are cut to the meter's padded length. For assembled runs ``attach_rounds`` gives the same table without a
    join on ``bgid``.
    """
    kept = ["k", "cluster_id", "l2dist"]
    first = rounds[0]
    profile = [c for c in _PROFILE if c in first.columns]
    suffixes = round_suffixes(len(rounds))
    merged = first.select(*profile, *kept, F.col("km_centroid_padded"))
    for suffix, later in zip(suffixes[1:], rounds[1:]):
        renamed = later.select("bgid", *[F.col(c).alias(f"{c}{suffix}") for c in kept])
        merged = merged.join(renamed, "bgid", "full")
    for suffix, later in zip(suffixes[1:], rounds[1:]):
        centroid = f"km_centroid_padded{suffix}"
        longest = F.max_by("km_centroid_padded", F.size("km_centroid_padded")).alias(centroid)
        per_cluster = later.groupBy(F.col("cluster_id").alias(f"cluster_id{suffix}")).agg(longest)  # k rows
        merged = merged.join(F.broadcast(per_cluster), f"cluster_id{suffix}", "left")
        merged = merged.withColumn(centroid, F.slice(centroid, 1, F.size("pgram_norm_arr_padded")))
    columns = [f"{c}{s}" for s in suffixes for c in [*kept, "km_centroid_padded"]]
    return merged.select(*profile, *columns)


def attach_rounds(assigned: DataFrame, model: list[Round]) -> DataFrame:
    """The table of ``merge_rounds`` from the result of ``assign_rounds``.

    Cluster ids are there already; the padded centroids come from k broadcast rows per round.
    """
    spark = assigned.sparkSession
    padded_length = F.size("win_id_arr")
    suffixes = round_suffixes(len(model))
    table = assigned.withColumn("pgram_pt_id_arr_padded", F.col("win_id_arr")).withColumn(
        "pgram_norm_arr_padded", pad_to(F.col("pgram_norm_arr"), padded_length)
    )
    for suffix, stage in zip(suffixes, model):
        rows = centroid_rows(centroid_table(spark, stage.k, stage.centroids)).select(
            F.col("cluster_id").alias(f"cluster_id{suffix}"),
            F.col("centroid_array").alias(f"centroid{suffix}"),
        )
        table = table.join(F.broadcast(rows), f"cluster_id{suffix}", "left")
    per_round = []
    for suffix in suffixes:
        per_round += [
            f"k{suffix}",
            f"cluster_id{suffix}",
            f"l2dist{suffix}",
            pad_to(F.col(f"centroid{suffix}"), padded_length).alias(f"km_centroid_padded{suffix}"),
        ]
    return table.select(*[c for c in _PROFILE if c in table.columns], *per_round)


def number_paths(merged: DataFrame, most: int = 100_000) -> DataFrame:
    """``cluster_id_all`` and the ids of every distinct path through the rounds, missing ones -9999.

    One job finds the paths, at most rounds x k in a run of ``hierarchical_kmeans``; more than ``most`` are
    refused. The result is a small table of its own: reading it runs nothing again.
    """
    later = _later_suffixes(merged)
    ids = ["cluster_id", *[f"cluster_id{s}" for s in later]]
    found = [tuple(x) for x in merged.select(*ids).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} paths through the rounds")
    found.sort(key=lambda path: [(x is None, x) if x is not None else (True, 0) for x in path])
    rows = [(n, *[NOT_CLUSTERED if x is None else x for x in path]) for n, path in enumerate(found)]
    names = ", ".join(f"{_key(c)} int" for c in ids)
    return merged.sparkSession.createDataFrame(rows, f"cluster_id_all long, {names}")


def overall_cluster_id(merged: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Number the distinct paths through the rounds 0, 1, ... and fill what was not clustered.

    ``l2dist_all`` is the distance in the deepest round a meter took part in. Missing ids
    become -9999, missing centroids arrays of -9999. There are at most rounds x k paths in a
    run of ``hierarchical_kmeans``; they are grouped before they are numbered and broadcast. With the
    result of ``number_paths``, they are not looked for again.
    """
    later = _later_suffixes(merged)
    ids = ["cluster_id", *[f"cluster_id{s}" for s in later]]
    keys = [_key(c) for c in ids]
    numbered = paths
    if paths is None:
        order = Window.orderBy(*[F.col(c).asc_nulls_last() for c in ids])
        numbered = merged.select(*ids).distinct().select(
            (F.row_number().over(order) - 1).cast("long").alias("cluster_id_all"), *_filled_ids(later)
        )
    deepest = F.coalesce(*[F.col(f"l2dist{s}") for s in reversed(later)], F.col("l2dist"))
    profile = [c for c in _PROFILE if c in merged.columns and c not in ("pgram_pt_id_arr", "pgram_norm_arr")]
    rounds = ["k", "cluster_id", "l2dist", "km_centroid_padded"]
    for suffix in later:
        missing = filled(NOT_CLUSTERED, F.size("pgram_norm_arr_padded"))
        rounds += [
            f"k{suffix}",
            f"cluster_id{suffix}_nonull",
            f"l2dist{suffix}",
            F.coalesce(f"km_centroid_padded{suffix}", missing).alias(
                f"km_centroid_padded{suffix}_nonull"
            ),
        ]
    joined = merged.select("*", *_filled_ids(later)[1:]).join(F.broadcast(numbered), keys)
    return joined.select(
        "bgid",
        "cluster_id_all",
        *[c for c in profile if c != "bgid"],
        deepest.alias("l2dist_all"),
        *rounds,
    )


def placed_columns(overall: DataFrame) -> list[str]:
    """The columns of ``overall_cluster_id`` that place a meter: ids and distances, no arrays."""
    ids = [f"cluster_id{s}_nonull" for s in _later_suffixes(overall)]
    return ["bgid", "cluster_id_all", "cluster_id", *ids, "l2dist", "l2dist_all"]


def unnest_profiles(overall: DataFrame) -> DataFrame:
    """Long form: one row per meter and position with signal, spectrum and centroids."""
    later = _later_suffixes(overall)
    columns = [
        ("win_id_arr", "win_id"),
        ("usagekw_sum_5min_arr", "usagekw_sum_5min"),
        ("usagekw_sum_5min_norm_arr", "usagekw_sum_5min_norm"),
        ("pgram_pt_id_arr_padded", "pgram_pt_id_padded"),
        ("pgram_norm_arr_padded", "pgram_norm_padded"),
        ("km_centroid_padded", "km_centroid_padded_unnest"),
    ]
    columns += [
        (f"km_centroid_padded{s}_nonull", f"km_centroid_padded_unnest{s}_nonull") for s in later
    ]
    held = [(a, name) for a, name in columns if a in overall.columns]
    return unnest_together(overall, dict(held))


def unnest_together(df: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """Explode several arrays in lockstep; ``arrays`` maps each to the name of its values.

    Values take the arrays' places among the columns. Shorter arrays, empty and NULL ones too, are
    filled with NULL; a row whose arrays are all empty stays as one row. A column that is not
    there is an error.
    """
    present = list(arrays)
    if missing := [a for a in arrays if a not in df.columns]:
        raise ValueError(f"no columns {missing} to unnest")
    # A zip with a NULL array is NULL.
    held = [F.coalesce(a, F.array().cast(df.schema[a].dataType)).alias(arrays[a]) for a in present]
    scalars = [c for c in df.columns if c not in present]
    long = df.select(*scalars, F.inline_outer(F.arrays_zip(*held)).alias(*[arrays[a] for a in present]))
    return long.select(*[arrays.get(c, c) for c in df.columns])


def _later_suffixes(df: DataFrame) -> list[str]:
    """``_r2``, ``_r3``, ... of the rounds that ``df`` has columns of."""
    found = {m[1] for c in df.columns if (m := re.fullmatch(r"(?:k|cluster_id)_r(\d+)(?:_nonull)?", c))}
    return [f"_r{number}" for number in sorted(found, key=int)]


def _key(column: str) -> str:
    return column if column == "cluster_id" else f"{column}_nonull"


def _filled_ids(later: Sequence[str]) -> list:
    return [
        F.col("cluster_id"),
        *[
            F.coalesce(f"cluster_id{s}", F.lit(NOT_CLUSTERED)).alias(f"cluster_id{s}_nonull")
            for s in later
        ],
    ]
