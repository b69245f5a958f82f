"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256. The ledger has a row per scanned pair of blob
and rule version, with the spans found; a scan reads only the blobs for which a pair is missing, and
each blob once however many documents share it. Findings are joined back to all documents that hold
the blob; the paths of earlier scans stay on record, so findings of old versions stay reachable.

Edge cases: a null text is the empty blob; repeated rows share a blob and each get a row; a null id
gets a row; an empty table adds nothing; ties of spans go by start, then by the order of the rules;
spans are code points with an exclusive end; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import file_system, free_name, join_hot, map_batches
from wattloom.storage import materialise

_LEDGER = "blob binary, rule string, spans array<struct<start: int, end: int>>"
_PATHS = "doc_id long, blob binary, scan string"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` count if ``group`` has ``least`` characters; only texts with a needle
    (in lower case if ``any_case``) are searched."""

    kind: str
    pattern: str
    group: int
    least: int
    needles: tuple[bytes, ...] = ()
    any_case: bool = False

    @property
    def version(self) -> str:
        said = f"{self.pattern}|{self.group}|{self.least}"
        return f"{self.kind}@{hashlib.sha256(said.encode()).hexdigest()[:16]}"


#: Patterns of the base rules, in the order of ties, then the ledger's own rule.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
        (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"),
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, (b"AKIA",)),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
PEM_RULE = Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, (b"PRIVATE KEY-----",))
RULES = (*BASE_RULES, PEM_RULE)

_HEX = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))


def _may_match(rule: Rule, raw: bytes, lowered: bytes) -> bool:
    if rule.kind == "hex":
        return b"\1" * rule.least in raw.translate(_HEX)
    return not rule.needles or any(x in (lowered if rule.any_case else raw) for x in rule.needles)


def find_spans(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap; those that are too short are dropped afterwards."""
    found = re.compile(rule.pattern, re.ASCII).finditer(text)
    return [x.span() for x in found if x.end(rule.group) - x.start(rule.group) >= rule.least]


def scan_text(text: str, rules: tuple[Rule, ...]) -> list[list[tuple[int, int]]]:
    raw = text.encode()
    lowered = raw.lower()
    return [find_spans(text, x) if _may_match(x, raw, lowered) else [] for x in rules]


def _blobs(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    address = F.unhex(F.sha2(text, 256)).alias("blob")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), address, text.alias("text"))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, f"{folder}/ledger", _LEDGER)


def read_paths(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, f"{folder}/paths", _PATHS)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the ledger; an empty one before the first scan."""
    system, name = file_system(path)
    there = system.get_file_info(name).type.name == "Directory"
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def unseen(docs: DataFrame, folder: str, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, text, missing``: each blob once that lacks a rule version of ``rules``.

    Copies collapse before the shuffle (partial aggregates keep one row per blob and task).
    """
    versions = [x.version for x in rules]
    ledger = read_ledger(docs.sparkSession, folder).where(F.col("rule").isin(versions))
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    blobs = _blobs(docs).groupBy("blob").agg(F.first("text").alias("text"))
    wanted = F.array(*map(F.lit, versions))
    missing = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    joined = blobs.join(seen, "blob", "left").select("blob", "text", missing.alias("missing"))
    return joined.where(F.size("missing") > 0)


def scan(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> str:
    """Scan what the ledger has not seen, and record the paths of ``docs``; the name of the scan."""
    by_version = {x.version: x for x in rules}

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        columns = [batch.column(n).to_pylist() for n in ("blob", "text", "missing")]
        for blob, text, missing in zip(*columns):
            wanted = [by_version[x] for x in missing]
            for rule, spans in zip(wanted, scan_text(text, tuple(wanted))):
                rows.append((blob, rule.version, [{"start": a, "end": b} for a, b in spans]))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = [pa.binary(), pa.string(), span]
        arrays = [pa.array([x[n] for x in rows], kind) for n, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["blob", "rule", "spans"])

    found = map_batches(unseen(docs, folder, rules), look, _LEDGER)
    found.write.mode("append").option("compression", "zstd").parquet(f"{folder}/ledger")
    name = uuid.uuid4().hex
    paths = _blobs(docs).select("doc_id", "blob", F.lit(name).alias("scan"))
    paths.write.mode("append").option("compression", "zstd").parquet(f"{folder}/paths")
    return name


def findings(spark: SparkSession, folder: str, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, found``: all spans of a blob as ``start, rank, end, kind``, by start and then rank."""
    order = F.create_map(*[F.lit(y) for n, x in enumerate(rules) for y in (x.version, n)])
    kinds = F.create_map(*[F.lit(y) for x in rules for y in (x.version, x.kind)])
    ledger = read_ledger(spark, folder).where(F.col("rule").isin([x.version for x in rules]))
    rows = ledger.where(F.size("spans") > 0).dropDuplicates(["blob", "rule"])
    entries = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"),
            F.element_at(order, F.col("rule")).alias("rank"),
            s["end"].alias("end"),
            F.element_at(kinds, F.col("rule")).alias("kind"),
        ),
    )
    grouped = rows.select("blob", entries.alias("entries")).groupBy("blob")
    return grouped.agg(F.array_sort(F.flatten(F.collect_list("entries"))).alias("found"))


def secrets_by_path(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, blob, found`` of every row of ``docs``, after scanning what is new in it."""
    name = scan(docs, folder, rules)
    spark = docs.sparkSession
    paths = read_paths(spark, folder).where(F.col("scan") == name).drop("scan")
    return join_hot(paths, materialise(findings(spark, folder, rules), "findings"), "blob")


def redact(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """Rows of ``docs``, all columns, with every span replaced by ``mark``; overlapping spans are one.
    ``n_chars``, where present, is the length of the new text."""
    scan(docs, folder, rules)
    known = materialise(findings(docs.sparkSession, folder, rules), "findings")
    address = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob")
    joined = join_hot(docs.select(F.struct("*").alias("row"), address), known, "blob")
    spans = free_name(docs, "found")
    bounds = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    rows, names = joined.select("row.*", bounds.alias(spans)), docs.columns

    def blank(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.column(spans).to_pylist()
        touched = [n for n, x in enumerate(found) if x]
        out = {name: batch.column(name) for name in names}
        if touched:
            texts, sizes = out["text"].to_pylist(), out["n_chars"].to_pylist() if "n_chars" in out else None
            for n in touched:
                texts[n] = _without_spans(texts[n], [(x["start"], x["end"]) for x in found[n]], mark)
                if sizes:
                    sizes[n] = len(texts[n])
            out["text"] = pa.array(texts, out["text"].type)
            if sizes:
                out["n_chars"] = pa.array(sizes, out["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return map_batches(rows, blank, docs.schema)


def _without_spans(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with a mark for every run of overlapping spans, which are in order."""
    parts, at = [], 0
    for start, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def secret_digest(by_path: DataFrame) -> DataFrame:
    """Counts of the base kinds, hash of the base spans, and all spans as text."""
    base = F.filter("found", lambda s: s["rank"] < len(BASE_RULES))

    def joined(spans):
        said = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.coalesce(F.array_join(said, ","), F.lit(""))

    def count(kind: str):
        return F.coalesce(F.size(F.filter("found", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")

    return by_path.select(
        "doc_id",
        *[F.when(F.col("found").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined("found").alias("spans"),
    )
