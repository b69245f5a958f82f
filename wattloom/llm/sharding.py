"""Sharding over fixed virtual slots.

A record is hashed into one of ``slots`` virtual slots, which never changes. Bytes are summed per
slot, and a small table maps slots to shards. The table is versioned: version 0 deals the slots
round robin, ``rebalance`` edits the newest version by moving as few slots as needed, and every
version is stored. Law: ``bytes``, sizes of shards are near equal.

Only DataFrame expressions on the way; what is gathered in one row has ``slots`` entries.

Edge cases: a null text has size 1 and checksum null; a null id is hashed like any other value;
repeated rows are counted before the shuffle and then spread by the number of their copy, so
neither one id nor one text fills a slot; an empty table gives an empty result; rows with one slot
are placed by id, checksum, size and number of copy; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.storage import materialise

_MAP = "version int, virtual_slot int, shard int, bytes long, rows long"


def hash_records(docs: DataFrame, slots: int) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of every row."""
    records = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
    )
    counted = records.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    single = counted.select("doc_id", "size", "text_crc32", copy)
    place = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "copy"), F.lit(slots))
    return single.withColumn("virtual_slot", place.cast("int"))


def slot_sizes(records: DataFrame, slots: int) -> DataFrame:
    """Bytes and rows of every slot, of empty ones too."""
    spark = records.sparkSession
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    joined = every.join(sums, "virtual_slot", "left")
    return joined.fillna(0, ["bytes", "rows"]).select("virtual_slot", "bytes", "rows")


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 0: slots in turn, whatever they hold."""
    return sizes.select(
        F.lit(0).alias("version"),
        "virtual_slot",
        (F.col("virtual_slot") % shards).cast("int").alias("shard"),
        "bytes",
        "rows",
    )


def rebalance(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version, for new sizes or another number of shards.

    A slot stays where it is as long as its shard, filled from the largest slot down, stays below
    the mean; the others go, largest first, to the shard with the fewest bytes at that time.
    """
    known = current.select("version", "virtual_slot", F.col("shard").alias("old"))
    joined = sizes.join(known, "virtual_slot")
    largest_first = [F.desc("bytes"), F.asc("virtual_slot")]
    filled = F.sum("bytes").over(Window.partitionBy("old").orderBy(*largest_first))
    mean = F.sum("bytes").over(Window.partitionBy()) / shards
    kept = joined.withColumn("stays", (filled <= mean) & (F.col("old") < shards))
    entry = F.struct((-F.col("bytes")).alias("key"), "virtual_slot", "old", "stays", "bytes", "rows")
    one = kept.groupBy("version").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    state = f"""
        aggregate(filter(entries, x -> NOT x.stays),
          named_struct(
            'loads', transform(sequence(0, {shards} - 1), s ->
                aggregate(filter(entries, x -> x.stays AND x.old = s), 0L, (n, x) -> n + x.bytes)),
            'given', CAST(array() AS array<struct<virtual_slot: int, shard: int, bytes: bigint, rows: bigint>>)),
          (a, x) -> named_struct(
            'loads', transform(a.loads, (n, i) ->
                IF(i = array_position(a.loads, array_min(a.loads)) - 1, n + x.bytes, n)),
            'given', array_append(a.given, named_struct('virtual_slot', x.virtual_slot,
                'shard', CAST(array_position(a.loads, array_min(a.loads)) - 1 AS INT),
                'bytes', x.bytes, 'rows', x.rows))))"""
    stay = """transform(filter(entries, x -> x.stays), x -> named_struct(
        'virtual_slot', x.virtual_slot, 'shard', x.old, 'bytes', x.bytes, 'rows', x.rows))"""
    given = one.select("version", F.expr(state).alias("a"), F.expr(stay).alias("stay"))
    rows = given.select("version", F.explode(F.concat("stay", "a.given")).alias("slot"))
    return rows.select((F.col("version") + 1).alias("version"), "slot.*")


def store_map(slot_map: DataFrame, folder: str) -> DataFrame:
    """Add a version to the stored map and read it back."""
    slot_map.coalesce(1).write.partitionBy("version").mode("append").parquet(folder)
    return load_map(slot_map.sparkSession, folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, by default the newest."""
    stored = spark.read.schema(_MAP).parquet(folder)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version).select(*[x.split()[0] for x in _MAP.split(", ")])


def place_records(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard of every record and its place there, without gaps from 0."""
    in_shard = Window.partitionBy("shard").orderBy("virtual_slot")  # at most a row per slot
    first = F.sum("rows").over(in_shard) - F.col("rows")
    based = slot_map.select("version", "virtual_slot", "shard", first.alias("first"))
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")
    ranked = records.withColumn("place", F.row_number().over(in_slot) - 1)
    joined = ranked.join(F.broadcast(based), "virtual_slot")  # at most a row per slot
    return joined.withColumn("slot", F.col("first") + F.col("place"))


def shard_documents(docs: DataFrame, folder: str, shards: int = 16, slots: int = 4096) -> DataFrame:
    """Hash, sum, store the first map and its rebalanced version, place every record."""
    records = materialise(hash_records(docs, slots), "sharded-records")
    sizes = materialise(slot_sizes(records, slots), "slot-sizes")
    dealt = store_map(first_map(sizes, shards), folder)
    newest = store_map(rebalance(dealt, sizes, shards), folder)
    return place_records(records, newest).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", "virtual_slot", "version"
    )
