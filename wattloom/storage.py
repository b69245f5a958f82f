"""Where intermediate tables go.

Stage results that are read many times (features, members of a re-clustered
group) are written as Parquet into the folder named by ``spark.checkpoint.dir``.
A written table survives lost executors, cuts the lineage, and is still pruned
by column when read back.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session may fall back to /tmp."""
    context = spark.sparkContext
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="wattloom-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier call has returned."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _open_runs(spark):
        paths.append(path)
    return path


_RUNS: dict[int, list[list[str]]] = {}


def _open_runs(spark: SparkSession) -> list[list[str]]:
    """Paths given in the runs of this session that have not ended; the innermost run comes last."""
    return _RUNS.setdefault(id(spark), [])


@contextmanager
def run_of(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, what was written under the paths of ``fresh_path`` inside the block.

    Frames that read those tables can't be used afterwards: write the results elsewhere first. Runs of
    other sessions, and what was written before the block, stay.
    """
    runs, mine = _open_runs(spark), []
    runs.append(mine)
    try:
        yield
    finally:
        runs[:] = [paths for paths in runs if paths is not mine]
        for path in mine:
            remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a path of ``fresh_path``, if there is anything."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so that later passes start from the table."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
