"""Tables for a dashboard: layout of the meters, centroids, closest profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.hashing import hash_uniform
from wattloom.operators.assemble import _later_suffixes, unnest_profiles, unnest_together
from wattloom.schema import NOT_CLUSTERED


def polar_layout(overall: DataFrame, seed: int = 42, max_over: str = "l2dist") -> DataFrame:
    """Place every meter at its distance from the centroid under a repeatable random angle.

    Relative coordinates divide by the cluster's maximum of ``max_over``: the distance of
    round 1 by default, so the ratio may exceed 1 for meters clustered again; ``l2dist_all``
    keeps it within 1. Maxima are aggregated (a cluster may hold most meters) and joined
    back as one row per cluster.
    """
    farthest = overall.groupBy("cluster_id_all").agg(F.max(max_over).alias("l2dist_max"))
    ids = [f"cluster_id{s}_nonull" for s in _later_suffixes(overall)]
    placed = (
        overall.select("bgid", "cluster_id_all", "cluster_id", *ids, "l2dist_all")
        .join(F.broadcast(farthest), "cluster_id_all")
        .withColumn("theta", hash_uniform(seed, F.col("bgid")) * 2 * F.pi())
    )
    distance, ratio = F.col("l2dist_all"), F.col("l2dist_all") / F.col("l2dist_max")
    cos, sin = F.cos("theta"), F.sin("theta")
    scaled = F.col("l2dist_max") != 0
    return placed.select(
        "bgid",
        "cluster_id_all",
        "cluster_id",
        *ids,
        "l2dist_all",
        "l2dist_max",
        "theta",
        (distance * cos).alias("l2dist_xcoord"),
        (distance * sin).alias("l2dist_ycoord"),
        F.when(scaled, ratio * cos).otherwise(0.0).alias("l2dist_rel_xcoord"),
        F.when(scaled, ratio * sin).otherwise(0.0).alias("l2dist_rel_ycoord"),
    )


def cluster_centroids(overall: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """One row per overall cluster with its centroids, and the deepest one of them.

    Centroids are the same for all meters of a cluster, so they are read off its meter with
    the lowest id; the arrays are neither grouped nor shuffled. ``bgid`` must be unique. ``placed`` is a written
    table of the same meters without arrays: the lowest ids come from it.
    """
    later = _later_suffixes(overall)
    ids = [f"cluster_id{s}_nonull" for s in later]
    centroids = [f"km_centroid_padded{s}_nonull" for s in later]
    deepest = F.col("km_centroid_padded")
    for cluster_id, centroid in zip(ids, centroids):
        deepest = F.when(F.col(cluster_id) != NOT_CLUSTERED, F.col(centroid)).otherwise(deepest)
    member = (overall if placed is None else placed).groupBy("cluster_id_all").agg(F.min("bgid").alias("bgid"))
    one_each = overall.join(F.broadcast(member), ["cluster_id_all", "bgid"], "left_semi")
    kept = one_each.select(
        "cluster_id_all", "cluster_id", *ids, "pgram_pt_id_arr_padded", "km_centroid_padded", *centroids
    )
    return kept.select("*", deepest.alias("km_centroid_padded_allrounds"))


def unnest_cluster_centroids(centroids: DataFrame) -> DataFrame:
    """Long form of ``cluster_centroids``."""
    columns = {
        "pgram_pt_id_arr_padded": "pgram_pt_id_padded",
        "km_centroid_padded": "km_centroid_padded_unnest",
    }
    for name in centroids.columns:
        if name.startswith("km_centroid_padded_"):
            columns[name] = name.replace("km_centroid_padded", "km_centroid_padded_unnest")
    return unnest_together(centroids, columns)


def closest_profiles(overall: DataFrame, n: int = 5, placed: DataFrame | None = None) -> DataFrame:
    """Long form of the ``n`` meters closest to the centroid of each cluster.

    Distances that agree to 12 digits are ties and go to the lower ``bgid``: meters with equal
    spectra differ in the last bits. The rank limit cuts every partition to ``n`` rows per
    cluster before the shuffle, and only the chosen meters are unnested. ``placed`` is as in
    ``cluster_centroids``: ranks come from it.
    """
    by_distance = Window.partitionBy("cluster_id_all").orderBy(F.round("l2dist_all", 12), "bgid")
    chosen = (
        (overall if placed is None else placed)
        .select("bgid", "cluster_id_all", "l2dist_all")
        .withColumn("rid_closest", F.row_number().over(by_distance))
        .where(F.col("rid_closest") <= n)
        .select("bgid", "cluster_id_all")
    )
    return unnest_profiles(
        overall.join(F.broadcast(chosen), ["bgid", "cluster_id_all"], "left_semi")
    )
