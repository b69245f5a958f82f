"""Reading and writing meter readings as headerless CSV.

Lines are parsed by one generator behind a text scan. Spark's CSV scan would parse only the columns that
are asked for, and skip a line at the first value that a pushed filter rejects, so what is wrong
with the rest of a line would go unnoticed; nothing can be pushed or pruned through a generator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.schema import READINGS
from wattloom.storage import materialise

#: Digits right before the extension: ``Home_prefix_7.csv`` -> 7, ``..._07.csv`` -> 7.
METER_IN_FILE_NAME = r"(\d+)\.csv$"

_LINE = "building_num int, tslocal long, usagekw double"
_METER_LINE = "tslocal double, usagekw double"


class BadLines(ValueError):
    """Lines that are no readings: how many there are, and the first ones by file and text."""

    def __init__(self, count: int, first: list[tuple[str, str]]):
        self.count, self.first = count, first
        said = "; ".join(f"{file}: {line!r}" for file, line in first)
        super().__init__(f"{count} lines are no readings, among them {said}")


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """Load ``building_num,tslocal,usagekw`` CSV; one bad row fails the load, also where only
    some of the columns, some of the rows or a count are asked for."""
    return _lines(spark, path).select(_parsed(_LINE, "FAILFAST"))


def stage_readings(spark: SparkSession, path: str) -> DataFrame:
    """Every line of ``building_num,tslocal,usagekw`` CSV, parsed once and written as a table: the readings' columns
    with ``bad_line`` and ``file``. A line that is no reading has its text in ``bad_line`` and no values."""
    rows = _lines(spark, path).select("file", _parsed(f"{_LINE}, bad_line string", "PERMISSIVE"))
    names = READINGS.fieldNames()
    good = F.col("bad_line").isNull()
    kept = [F.when(good, F.col(c)).alias(c) for c in names]
    return materialise(rows.select(*kept, "bad_line", F.when(~good, F.col("file")).alias("file")), "staged")


def bad_lines(staged: DataFrame) -> DataFrame:
    """``file, line, copies`` of the lines of ``stage_readings`` that are no readings."""
    bad = staged.where("bad_line IS NOT NULL")
    return bad.groupBy("file", F.col("bad_line").alias("line")).agg(F.count("*").alias("copies"))


def checked_readings(staged: DataFrame, shown: int = 5) -> DataFrame:
    """The readings of a staged load; ``BadLines`` if a line is none. Reads two columns to find out."""
    found = bad_lines(staged)
    count = staged.where("bad_line IS NOT NULL").count()
    if count:
        first = found.orderBy("file", "line").limit(shown).collect()
        raise BadLines(count, [(x.file, x.line) for x in first])
    return staged.select(*READINGS.fieldNames())


def ingest_meter_files(
    spark: SparkSession,
    folder: str,
    meter_pattern: str = METER_IN_FILE_NAME,
    recursive: bool = False,
) -> DataFrame:
    """Stack a folder of per-meter ``tslocal,usagekw`` files into one set of readings.

    The meter id is the first group of ``meter_pattern`` in the file's path; a path
    without one fails the load. Times written as floats are cut to whole seconds.
    """
    return _meter_files(spark, folder, recursive).select(
        F.regexp_extract("file", meter_pattern, 1).cast("int").alias("building_num"),
        F.col("tslocal").cast("long").alias("tslocal"),
        "usagekw",
    )


def rows_per_file(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Number of rows in every per-meter file; one bad row fails the count."""
    files = _meter_files(spark, folder, recursive)
    return files.groupBy(F.col("file").alias("file_path")).agg(F.count("*").alias("n_rows"))


def _lines(spark: SparkSession, path: str, recursive: bool = False, glob: str = "*") -> DataFrame:
    """``value, file`` of every line that is not blank."""
    reader = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob)
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.where(F.trim("value") != "")


def _parsed(schema: str, mode: str) -> Column:
    """The columns of ``schema`` from a line. A generator: it runs for each line, whatever is asked for."""
    options = {"mode": mode, "columnNameOfCorruptRecord": "bad_line"}
    return F.inline(F.array(F.from_csv("value", schema, options)))


def _meter_files(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    return _lines(spark, folder, recursive, "*.csv").select("file", _parsed(_METER_LINE, "FAILFAST"))


def write_readings_csv(readings: DataFrame, path: str) -> None:
    """Write a folder of headerless CSV parts; put one behind the other, they are one CSV."""
    writer = readings.select(*READINGS.fieldNames()).write.mode("overwrite")
    writer.option("header", False).option("quote", "|").csv(path)


def write_single_csv(readings: DataFrame, path: str, rows_per_part: int = 10_000_000) -> int:
    """Write one headerless CSV file at ``path``, ordered by meter, time and usage; the number of its parts.

    Parts are ranges of that order, each sorted and written by a task of its own; then the file system
    puts them one behind the other (``concat``: on HDFS that moves no data), so no task and no driver
    holds more than a part. A file system that can't is refused before anything is written.
    """
    spark = readings.sparkSession
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = files.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getUri().getScheme() == "file":
        system = system.getRawFileSystem()  # without the checksum files beside it
    elif not system.hasPathCapability(target, "fs.capability.paths.concat"):
        raise ValueError(f"the file system of {path} can't put files together; use write_readings_csv")
    parts = max(1, -(-readings.count() // rows_per_part))
    folder = f"{path}-parts-{uuid.uuid4().hex}"
    order = ["building_num", "tslocal", "usagekw"]
    ranged = readings.select(*READINGS.fieldNames()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    try:
        ranged.write.option("header", False).option("quote", "|").csv(folder)
        found = system.globStatus(files.Path(f"{folder}/part-*.csv"))
        names = sorted(x.getPath().toString() for x in found if x.getLen())  # in the order of the parts
        system.delete(target, False)
        system.mkdirs(target.getParent())
        system.create(target).close()
        if names:
            sources = spark.sparkContext._gateway.new_array(files.Path, len(names))
            for n, name in enumerate(names):
                sources[n] = files.Path(name)
            system.concat(target, sources)
    finally:
        system.delete(files.Path(folder), True)
    return len(names)


def sample_readings(readings: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` readings by meter and time; usage breaks ties of repeated instants."""
    return readings.orderBy("building_num", "tslocal", "usagekw").limit(n)
