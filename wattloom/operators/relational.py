"""The periodogram as joins and grouped sums, for series that are too long for an array in one task.

A series of N = n1 * n2 values is transformed in two stages. Position t = n2 * t1 + t2 and frequency
k = k1 + n1 * k2 give t * k / N = t1 * k1 / n1 + t2 * k / N up to whole numbers, so the sums over t1 are taken
first, for every t2 and k1, and then those over t2. That is N * (n1 + n2) products instead of N * N; n1 is the
largest divisor of N up to its root. A prime N has none but 1. Angles are reduced in whole numbers before
they become floats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spectrum_points(
    points: DataFrame, key: str = "bgid", position: str = "pos", value: str = "value", taper: float = 0.0
) -> DataFrame:
    """``key, pt_id, power``: floor(N/2) rows for every series of ``points``, a row per value.

    ``pt_id`` counts from 0, which is frequency 1/N, as in ``features.periodogram``. Positions of a series are 0 to
    N - 1, each once, and values finite, or else it is an error; a series of one value has no rows. DataFrame functions only;
    no task holds a series.
    """
    if not 0.0 <= taper <= 0.5:
        raise ValueError("taper must lie between 0 and 0.5")
    rows = points.select(
        F.col(key).alias("key"), F.col(position).cast("long").alias("t"), F.col(value).cast("double").alias("x")
    )
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    sizes = rows.groupBy("key").agg(
        F.count("*").alias("n"),
        F.min("t").alias("low"),
        F.max("t").alias("high"),
        F.sum("t").alias("total"),
        F.sum(F.col("t") * F.col("t")).alias("squares"),
        F.count_if(finite).alias("usable"),
    )
    last = F.col("n") - 1
    # Distinct positions have these sums; with repeated ones they would differ.
    in_order = (
        (F.col("low") == 0)
        & (F.col("high") == last)
        & (F.col("total") * 2 == F.col("n") * last)
        & (F.col("squares") * 6 == last * F.col("n") * (2 * F.col("n") - 1))
    )
    fault = F.when(F.col("usable") < F.col("n"), F.lit("a series has missing or non-finite values")).when(
        ~F.coalesce(in_order, F.lit(False)), F.lit("the positions of a series are not 0 to N - 1")
    )
    divisor = F.expr("array_max(filter(sequence(1L, cast(floor(sqrt(n)) AS bigint)), d -> n % d = 0))")
    checked = sizes.select("key", F.when(fault.isNotNull(), F.raise_error(fault).cast("long")).otherwise(F.col("n")).alias("n"))
    sized = checked.where("n > 1").withColumn("n1", divisor).withColumn("n2", F.expr("n div n1"))
    weighed = rows.join(sized, "key").withColumn("x", F.col("x") * _bell(taper))
    first = weighed.select(
        "key", "n", "n1", "n2", "x", F.expr("t div n2").alias("t1"), F.expr("t % n2").alias("t2"),
        F.explode(F.sequence(F.lit(0), F.col("n1") - 1)).alias("k1"),
    )
    angle = F.lit(2.0) * F.pi() * (F.expr("t1 * k1 % n1") / F.col("n1"))
    inner = first.groupBy("key", "n", "n1", "n2", "t2", "k1").agg(
        F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(-F.col("x") * F.sin(angle)).alias("im")
    )
    outer = inner.where("k1 <= n div 2").select(
        "key", "n", "t2", "re", "im",
        F.explode(F.expr("transform(sequence(0L, (n div 2 - k1) div n1), k2 -> k1 + n1 * k2)")).alias("k"),
    )
    turn = F.lit(2.0) * F.pi() * (F.expr("t2 * k % n") / F.col("n"))
    real = F.col("re") * F.cos(turn) + F.col("im") * F.sin(turn)
    imaginary = F.col("im") * F.cos(turn) - F.col("re") * F.sin(turn)
    summed = outer.where("k > 0").groupBy("key", "n", "k").agg(F.sum(real).alias("re"), F.sum(imaginary).alias("im"))
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("n") * F.lit(1.0 - 5.0 / 8.0 * 2.0 * taper))
    return summed.select(F.col("key").alias(key), (F.col("k") - 1).cast("int").alias("pt_id"), power.alias("power"))


def _bell(taper: float):
    """Weight of position ``t`` of ``n`` under a split cosine bell."""
    width = F.floor(F.col("n") * F.lit(taper))
    place = F.least(F.col("t"), F.col("n") - 1 - F.col("t"))
    rise = 0.5 * (1.0 - F.cos(F.pi() * (2 * place + 1) / (2 * width)))
    return F.when(place < width, rise).otherwise(1.0)
