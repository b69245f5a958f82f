"""A gap check that is kept up to date: its state is a table, and a load touches only the slots it has readings of.

The state has a row per meter, slot of time (a day, for readings a minute apart), block and remainder,
with a mask of the instants met (``quality.slot_masks``). A load computes the rows of its own readings,
puts them together with the rows of the same slots, and writes these slots anew under the load's
number. A manifest says which load holds each slot. It is written last: a load that fails before leaves the
state as it was. Earlier readings are never read again; repeated and late ones are counted as if all had come
at once. Loads are made one after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattloom.operators.quality import merge_masks, slot_masks, summary_of_masks
from wattloom.storage import materialise, run_of

_MANIFEST = "slot long, load long"


def load_gaps(readings: DataFrame, folder: str, interval_seconds: int = 60) -> int:
    """Add ``readings`` to the state in ``folder``; the number of the load.

    The driver holds the manifest: a number for each slot of time, whatever the number of meters.
    """
    spark = readings.sparkSession
    load, held = _manifest(spark, folder)
    load += 1
    with run_of(spark):
        fresh = materialise(slot_masks(readings, interval_seconds), "masks")
        touched = [x.slot for x in fresh.select("slot").distinct().collect()]
        old = _masks(spark, folder, {s: held[s] for s in touched if s in held}, fresh.schema)
        merged = merge_masks(old.unionByName(fresh))
        merged.write.mode("overwrite").partitionBy("slot").parquet(f"{folder}/masks/load={load}")
    rows = list((held | dict.fromkeys(touched, load)).items())
    manifest = spark.createDataFrame(rows, _MANIFEST).coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest/{load:08d}")
    return load


def gap_masks(spark: SparkSession, folder: str) -> DataFrame:
    """The state after the last load."""
    schema = slot_masks(spark.createDataFrame([], "building_num int, tslocal long, usagekw double")).schema
    return _masks(spark, folder, _manifest(spark, folder)[1], schema)


def gap_summary(spark: SparkSession, folder: str, interval_seconds: int = 60) -> DataFrame:
    """``quality.meter_summary`` of all readings loaded so far. The summary of any function in ``quality``."""
    return summary_of_masks(gap_masks(spark, folder), interval_seconds)


def _masks(spark: SparkSession, folder: str, held: dict[int | None, int], schema) -> DataFrame:
    """The rows of the given slots, each from the load that holds it; no other folder is read."""
    if not held:
        return spark.createDataFrame([], schema)
    default = "__HIVE_DEFAULT_PARTITION__"
    paths = [f"{folder}/masks/load={load}/slot={default if slot is None else slot}" for slot, load in held.items()]
    fields = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in schema)
    reader = spark.read.schema(f"{fields}, load long").option("basePath", f"{folder}/masks")
    return reader.parquet(*paths).select(*schema.fieldNames())


def _manifest(spark: SparkSession, folder: str) -> tuple[int, dict[int | None, int]]:
    """Number of the last load whose manifest is whole, and the load of every slot."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    done = files.Path(f"{folder}/manifest/*/_SUCCESS")
    system = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    loads = [int(x.getPath().getParent().getName()) for x in system.globStatus(done) or []]
    if not loads:
        return 0, {}
    rows = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest/{max(loads):08d}").collect()
    return max(loads), {x.slot: x["load"] for x in rows}
