"""A third of all rows under one key, without adaptive splitting."""

import pytest
from pyspark.sql import functions as F

from wattloom.llm import secrets, simhash, warc
from wattloom.llm.common import free_name, join_hot
from wattloom.storage import materialise


@pytest.fixture
def plain_shuffles(spark, no_broadcast):
    """Sixteen partitions, joins by shuffle, and no adaptive splitting of large partitions."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_join_hot_is_a_left_join_in_even_tasks(spark, plain_shuffles):
    key = F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 AND id % 2 = 0 THEN NULL WHEN id % 7 = 0 THEN 'cold' ELSE 'k' || id % 500 END")
    rows = materialise(spark.range(60_000, numPartitions=16).select("id", key.alias("k")), "rows")
    values = [("hot", 1), *((f"k{n}", n) for n in range(0, 500, 2))]  # nothing for 'cold'
    table = materialise(spark.createDataFrame(values, "k string, v int"), "table")
    joined = join_hot(rows, table, "k", heaviest=5)
    assert joined.columns == ["id", "k", "v"]
    assert largest_share(joined) < 0.12 < largest_share(rows.join(table, "k", "left"))
    assert sorted(joined.collect(), key=str) == sorted(rows.join(table, "k", "left").select("id", "k", "v").collect(), key=str)
    assert join_hot(rows.limit(0), table, "k").count() == 0
    assert join_hot(rows, table.limit(0), "k").where("v IS NOT NULL").count() == 0


def test_free_name(spark):
    assert free_name(spark.createDataFrame([], "a int, _a int"), "a") == "__a"


@pytest.mark.parametrize("common", ["", "x" * 300])
def test_equal_payloads_do_not_meet(spark, plain_shuffles, common):
    html = F.when(F.col("id") % 3 == 0, F.lit(common)).otherwise(F.concat(F.lit("page " * 30), F.col("id").cast("string")))
    pages = materialise(spark.range(20_000, numPartitions=16).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), html.alias("html")), "pages")
    typed = warc.record_types(pages)
    assert largest_share(typed) < 0.12
    assert typed.where("first_id IS NOT NULL").count() == (0 if not common else 6667)


def docs_with_copies(spark, common):
    text = F.when(F.col("id") % 3 == 0, F.lit(common)).otherwise(F.concat_ws(" ", F.lit("words and"), F.md5(F.col("id").cast("string")), F.md5((F.col("id") + 1).cast("string"))))
    return materialise(spark.range(6_000, numPartitions=16).select(F.col("id").alias("doc_id"), text.alias("text")), "docs")


def test_equal_fingerprints_do_not_meet(spark, plain_shuffles):
    groups = simhash.near_duplicate_groups(docs_with_copies(spark, "the same five words here"))
    assert largest_share(groups) < 0.12
    assert groups.where("component_id = 0").count() >= 2000


@pytest.mark.parametrize("common", ["", "password: abcdefgh12"])
def test_equal_blobs_do_not_meet(spark, plain_shuffles, folder, common):
    docs = docs_with_copies(spark, common)
    found = secrets.secrets_by_path(docs, folder)
    assert largest_share(found) < 0.12
    assert found.where("size(found) > 0 AND doc_id % 3 = 0").count() == (2000 if common else 0)
    assert largest_share(secrets.redact(docs, folder + "-2")) < 0.12
