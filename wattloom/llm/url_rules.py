"""Verdicts on URLs: host rules first, then association rules mined from labelled URLs.

A URL is a basket of tokens: every host label and path segment (the last four labels and the first two
segments by their place, the others as standing further in), the file's suffix, every query key, and
whether there is a query or a fragment. Frequent sets are grown as in FP-growth, by conditional
baskets, from the baskets of labelled URLs, up to ``max_tokens`` tokens. Rules ``tokens -> label`` are pruned by
support and confidence, and a rule is dropped if a part of its tokens already gives the same
label with at least its confidence. An inverted index from token to rules counts, for
every URL, how many tokens of each rule it has; a rule matches when all are there.

A token says what it is, and numbers in path segments are one token. Tokens that stand in exactly the
same labelled baskets are mined as one: no rule needs two of them, and in a rule any of them may stand
for the others. With ``m`` such classes a basket, at most ``m / min_support`` are frequent and ``m ** max_tokens / min_support``
sets of them, however many URLs there are and however long. That is what the driver holds and sends out.

Edge cases: a null URL and one without ``://`` have an empty host and path and no tokens but ``none``; repeated rows are
judged each and count each; a null id is kept; no labelled URL gives no mined rule, and what no rule
matches is allowed; equally good rules go by support, then by fewer tokens, then by name; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.storage import materialise

#: Host rules of the query, fixed values: verdict, host, path.
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_LABELS, _SEGMENTS, _KEYS = 4, 2, 2
#: Host labels and their number, segments and their number, suffix, keys, query, fragment: the tokens of a URL
#: with no more labels, segments and keys than that. Each different one beyond them is a token more.
MOST_TOKENS = _LABELS + 1 + _SEGMENTS + 1 + 1 + _KEYS + 1 + 1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class MinedRule:
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float


def _behind_scheme(url: Column) -> Column:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_behind_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_behind_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = HOST_RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits the host, or a domain above it, and
    whose path begins the URL's path; NULL if none does. Equal lengths go by name."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    cases = []
    for verdict, domain, start in ordered:
        inside = (host == domain) | F.endswith(host, F.lit(f".{domain}"))
        said = F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))
        cases.append(F.when(inside & F.startswith(path, F.lit(start)), said))
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<rule: string, verdict: string>")


def url_tokens(url: Column) -> Column:
    """The basket of a URL: different tokens, sorted. Numbers of labels and segments from 9 on are one token."""
    host, path = host_of(url), path_of(url)
    behind = _behind_scheme(url)
    labels = F.reverse(F.split(host, r"\."))
    named = F.transform(
        F.slice(labels, 1, _LABELS), lambda x, n: F.concat(F.lit("host"), n.cast("string"), F.lit("="), x)
    )
    depth = F.concat(F.lit("labels="), F.least(F.size(labels), F.lit(9)).cast("string"))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    stem = F.transform(segments, lambda x: F.regexp_replace(x, r"\.[A-Za-z0-9]{1,8}\z", ""))
    shape = F.transform(stem, lambda x: F.when(x.rlike(r"^[0-9]+\z"), F.lit("#")).otherwise(x))
    placed = F.transform(
        F.slice(shape, 1, _SEGMENTS), lambda x, n: F.concat(F.lit("path"), n.cast("string"), F.lit("="), x)
    )
    further = F.concat(
        F.transform(F.slice(labels, _LABELS + 1, F.size(labels)), lambda x: F.concat(F.lit("within host="), x)),
        F.transform(F.slice(shape, _SEGMENTS + 1, F.size(shape)), lambda x: F.concat(F.lit("within path="), x)),
    )
    length = F.concat(F.lit("segments="), F.least(F.size(segments), F.lit(9)).cast("string"))
    suffix = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    query = F.regexp_extract(behind, r"^[^?#]*\?([^#]*)", 1)
    keys = F.array_distinct(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1)))
    keys = F.filter(keys, lambda x: x != "")
    rest = F.array_compact(
        F.array(
            F.when(suffix != "", F.concat(F.lit("suffix="), suffix)),
            F.when(behind.rlike(r"^[^?#]*\?"), F.lit("query")),
            F.when(F.contains(behind, F.lit("#")), F.lit("fragment")),
        )
    )
    asked = F.transform(keys, lambda x: F.concat(F.lit("key="), x))
    every = F.concat(named, F.array(depth), placed, F.array(length), further, asked, rest)
    return F.when(host == "", F.array(F.lit("none"))).otherwise(F.array_sort(F.array_distinct(every)))


def _only(tokens: Column, wanted: Collection[str]) -> Column:
    """The tokens that are among ``wanted``, in their order."""

    @F.arrow_udf("array<string>")
    def keep(baskets: pa.Array) -> pa.Array:
        found = [[x for x in basket or () if x in wanted] for basket in baskets.to_pylist()]
        return pa.array(found, pa.list_(pa.string()))

    return keep(tokens)


def _alike(baskets: DataFrame) -> dict[str, str]:
    """For every token, the smallest one that stands in the same of the different ``baskets``.

    Sets of baskets are told apart by their size and 128 bits of hashes.
    """
    hashes = [F.bit_xor(F.xxhash64("tokens", "verdict", F.lit(n))).alias(f"hash{n}") for n in range(2)]
    places = baskets.withColumn("token", F.explode("tokens")).groupBy("token").agg(F.count("*").alias("n"), *hashes)
    smallest: dict[tuple, str] = {}
    return {x.token: smallest.setdefault(tuple(x)[1:], x.token) for x in sorted(places.collect(), key=lambda x: x.token)}


def mine_rules(
    labelled: DataFrame,
    min_support: float = 0.01,
    min_confidence: float = 0.8,
    max_tokens: int = 3,
) -> tuple[list[MinedRule], dict[str, str]]:
    """Rules from ``tokens array<string>, verdict string``, best first, and the tokens that stand for others.

    A rule has at most ``max_tokens`` tokens; its support is the share of labelled URLs with all of
    its tokens and its verdict. The second result names for every frequent token the smallest one of
    the same labelled URLs. Rules are made of those; the others may stand in their place.
    """
    given = labelled.where("verdict IS NOT NULL")
    total = given.count()
    least = max(1, math.ceil(min_support * total))
    ordered = given.select(F.array_sort(F.array_distinct("tokens")).alias("tokens"), "verdict")
    counted = ordered.withColumn("token", F.explode("tokens")).groupBy("token", "verdict").count()
    frequent = {x.token for x in counted.where(F.col("count") >= least).select("token").distinct().collect()}
    if not frequent:
        return [], {}
    kept = ordered.select(_only(F.col("tokens"), frequent).alias("tokens"), "verdict").groupBy("tokens", "verdict")
    baskets = materialise(kept.agg(F.count("*").alias("n")), "baskets")
    alike = _alike(baskets)
    grown = baskets.select(
        F.array().cast("array<string>").alias("tokens"),
        _only(F.col("tokens"), set(alike.values())).alias("rest"),
        "verdict",
        "n",
    )
    rules = []
    for _ in range(max_tokens):
        # The rest of a basket behind the last token of a set: each set is met once.
        longer = grown.select("tokens", "rest", "verdict", "n", F.posexplode("rest").alias("at", "token")).select(
            F.array_append("tokens", F.col("token")).alias("tokens"),
            F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"),
            "verdict",
            "n",
        )
        sets = longer.groupBy("tokens", "verdict").agg(F.sum("n").alias("n"))
        every = F.sum("n").over(Window.partitionBy("tokens"))
        sets = materialise(sets.withColumn("every", every).where(F.col("n") >= least), "token-sets")
        found = sets.where(F.col("n") / F.col("every") >= min_confidence).collect()
        rules += [MinedRule(tuple(x.tokens), x.verdict, x.n / x.every, x.n / total) for x in found]
        grown = longer.join(sets.select("tokens").distinct(), "tokens", "left_semi")
        grown = grown.groupBy("tokens", "rest", "verdict").agg(F.sum("n").alias("n"))
    return _without_redundant(rules), alike


def _without_redundant(rules: list[MinedRule]) -> list[MinedRule]:
    """Best first; a rule goes if some of its tokens give its verdict with at least its confidence."""
    best = sorted(rules, key=lambda r: (-r.confidence, -r.support, len(r.tokens), r.tokens, r.verdict))
    known: dict[tuple, float] = {(r.tokens, r.verdict): r.confidence for r in rules}

    def parts(tokens: tuple[str, ...]):
        for mask in range(1, 2 ** len(tokens) - 1):
            yield tuple(t for n, t in enumerate(tokens) if mask >> n & 1)

    return [r for r in best if all(known.get((p, r.verdict), -1.0) < r.confidence for p in parts(r.tokens))]


class RuleIndex:
    """Inverted index: token to the rules that have it."""

    def __init__(self, rules: Sequence[MinedRule]):
        self.rules = rules
        self.wanted = [len(r.tokens) for r in rules]
        self.postings: dict[str, list[int]] = {}
        for number, rule in enumerate(rules):
            for token in rule.tokens:
                self.postings.setdefault(token, []).append(number)

    def matching(self, tokens: Iterable[str]) -> list[int]:
        """Numbers of the rules all of whose tokens are among ``tokens``."""
        met: dict[int, int] = {}
        for token in tokens:
            for number in self.postings.get(token, ()):
                met[number] = met.get(number, 0) + 1
        return [n for n, count in met.items() if count == self.wanted[n]]

    def best(self, tokens: Iterable[str]) -> int | None:
        """Number of the best rule all of whose tokens are among ``tokens``."""
        return min(self.matching(tokens), default=None)

    def best_by_names(self, tokens: Sequence[str], alike: dict[str, str]) -> tuple[MinedRule, list[str]] | None:
        """The best rule for sorted ``tokens``, any of which may stand for its ``alike``, and the tokens it met."""
        names: dict[str, str] = {}
        for token in tokens:
            names.setdefault(alike.get(token, token), token)
        found = self.matching(names)
        if not found:
            return None
        first = self.rules[min(found)]
        rank = (first.confidence, first.support, len(first.tokens))
        equal = [r for r in map(self.rules.__getitem__, found) if (r.confidence, r.support, len(r.tokens)) == rank]
        named = [(sorted(map(names.__getitem__, r.tokens)), r.verdict, r) for r in equal]
        said, _, rule = min(named, key=lambda x: x[:2])
        return rule, said


def _by_rules(tokens: Column, rules: Sequence[MinedRule], alike: dict[str, str], remember: int = 65_536) -> Column:
    """``struct(verdict, mined, confidence)`` of the best mined rule; NULLs if none matches."""
    names = ["verdict", "mined", "confidence"]

    @F.arrow_udf("struct<verdict: string, mined: string, confidence: double>")
    def judge(baskets: pa.Array) -> pa.Array:
        index, seen, found = RuleIndex(rules), {}, []
        for basket in baskets.to_pylist():
            key = tuple(x for x in basket or () if x in alike)  # what no rule can have decides nothing
            said = seen.get(key)
            if said is None:
                best = index.best_by_names(key, alike)
                said = (None, None, None) if best is None else (best[0].verdict, " & ".join(best[1]), best[0].confidence)
                if len(seen) >= remember:
                    seen.clear()
                if len(key) <= MOST_TOKENS:
                    seen[key] = said
            found.append(said)
        columns = [pa.array([x[n] for x in found], kind) for n, kind in enumerate((pa.string(), pa.string(), pa.float64()))]
        return pa.StructArray.from_arrays(columns, names=names)

    return judge(tokens)


def judge_urls(
    pages: DataFrame,
    host_rules: Sequence[tuple[str, str, str]] = HOST_RULES,
    labelled: DataFrame | None = None,
    min_support: float = 0.01,
    min_confidence: float = 0.8,
    max_tokens: int = 3,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined, confidence`` of every row of ``page_id, url``.

    ``labelled`` has ``url, verdict`` (allow or block); without it, the URLs that a host rule
    decides are the labelled ones. ``mined`` names the association rule that decided and
    ``confidence`` its confidence; both are NULL where a host rule or the default (allow) did.
    """
    url = F.col("url").cast("string")
    judged = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")).select(
        "*", longest_rule(F.col("host"), F.col("path"), host_rules).alias("fixed")
    )
    known = judged.select("url", "fixed.verdict") if labelled is None else labelled.select("url", "verdict")
    baskets = known.where("verdict IS NOT NULL").select(url_tokens(F.col("url")).alias("tokens"), "verdict")
    rules, alike = mine_rules(baskets, min_support, min_confidence, max_tokens)
    open_to_rules = F.col("fixed").isNull()
    matched = judged.withColumn("found", _by_rules(F.when(open_to_rules, url_tokens(F.col("url"))), rules, alike))
    return matched.select(
        "page_id",
        "host",
        "path",
        F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", "found.verdict", F.lit("allow")).alias("verdict"),
        F.col("found.mined").alias("mined"),
        F.col("found.confidence").alias("confidence"),
    )
