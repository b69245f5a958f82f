import itertools
import math
import re
import time

import pytest
from pyspark.sql import functions as F

from wattloom.llm import queries, url_rules

PAGES = "page_id long, url string"


def parts(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def fixed(host, path):
    fits = []
    for verdict, domain, start in url_rules.HOST_RULES:
        if (host == domain or host.endswith("." + domain)) and path.startswith(start):
            fits.append((len(domain + start), domain + start, verdict))
    return max(fits)[1:] if fits else (None, None)


def mined(labelled, min_support=0.01, min_confidence=0.8, most=3):
    """Rules by counting every combination of tokens."""
    count, with_verdict = {}, {}
    for tokens, verdict in labelled:
        for size in range(1, most + 1):
            for part in itertools.combinations(tokens, size):
                count[part] = count.get(part, 0) + 1
                with_verdict[part, verdict] = with_verdict.get((part, verdict), 0) + 1
    least = math.ceil(min_support * len(labelled))
    rules = {k: n / count[k[0]] for k, n in with_verdict.items() if n >= least and n / count[k[0]] >= min_confidence}
    return [
        (-c, -with_verdict[k], len(k[0]), k[0], k[1])
        for k, c in rules.items()
        if not any(
            rules.get((p, k[1]), 0) >= c for size in range(1, len(k[0])) for p in itertools.combinations(k[0], size)
        )
    ]


def expected(rows, tokens):
    judged = [(i, *parts(u), *fixed(*parts(u)), t) for (i, u), t in zip(rows, tokens)]
    rules = mined([(t, said) for *_, said, t in judged if said])
    out = []
    for i, host, path, rule, said, t in judged:
        best = min((r for r in rules if set(r[3]) <= set(t)), default=None) if said is None else None
        out.append((i, host, path, rule, said or (best[4] if best else "allow"), best and " & ".join(best[3])))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(x)[:6] for x in df.collect()), key=repr)


def test_query_is_what_counting_gives(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = pages.select("page_id", "url", url_rules.url_tokens(F.col("url")).alias("t")).collect()
    want = expected([(x.page_id, x.url) for x in rows], [x.t for x in rows])
    assert got(queries.op11_url_rules(spark, sf)) == want
    assert {x[4] for x in want} == {"allow", "block"} and any(x[5] for x in want)


ODD = [
    (1, None),
    (2, ""),
    (3, "no scheme/en/"),
    (4, "http://"),
    (5, "http://com"),
    (6, "HTTP://Com/"),
    (7, "http://a.WWW.Example.com/en/x"),
    (8, "http://example.com/en"),
    (9, "http://example.com/en/?q=1#f"),
    (10, "http://notexample.com/en/"),
    (11, "ftp://x.net/es/a://b.com/"),
    (12, "http://x.net?/fr/"),
    (13, "http://x.net/FR/"),
    (None, "http://x.org/en/1.html"),
    (14, "http://x.org/en/1.html"),
    (14, "http://x.org/en/1.html"),
    (15, "http://xÄ.org/ü?b=1&a=2&c&&=3"),
    (16, "http://" + "a." * 9000 + "org/" + "p/" * 9000 + "?" + "k&" * 9000),
    (17, "http://x.org/\n/#"),
]


def test_odd_urls(spark, clashing):
    pages = spark.createDataFrame(ODD, PAGES)
    wide = clashing(pages).select("*", *[F.lit("y").alias(n) for n in ("host", "rule", "tokens", "fixed", "found", "verdict")])
    tokens = [x.t for x in pages.select(url_rules.url_tokens(F.col("url")).alias("t")).collect()]
    assert all(len(t) <= url_rules.MOST_TOKENS and len(set(t)) == len(t) for t in tokens)
    assert got(url_rules.judge_urls(wide)) == expected(ODD, tokens)


@pytest.mark.parametrize("rows", [[], [(1, "http://x.org/")], [(1, None), (2, None)]])
def test_nothing_to_learn_from(spark, rows):
    found = url_rules.judge_urls(spark.createDataFrame(rows, PAGES))
    assert [x.verdict for x in found.collect()] == ["allow"] * len(rows)


def test_rules_from_given_labels_hold_on_other_urls(spark):
    """A combination decides, neither token alone: shops are fine, and so is /win, but not a shop's /win."""
    made = [
        (n, f"http://{kind}{n % 7}.{place}.org/{path}/{n}", "block" if (place, path) == ("shop", "win") else "allow")
        for n, (kind, place, path) in enumerate(itertools.product("abc", ["shop", "news", "wiki"] * 6, ["win", "de", "fr"] * 4))
    ]
    learned, held_out = made[::2], made[1::2]
    labelled = spark.createDataFrame([x[1:] for x in learned], "url string, verdict string")
    pages = spark.createDataFrame([x[:2] for x in held_out], PAGES)
    found = {x.page_id: x for x in url_rules.judge_urls(pages, (), labelled).collect()}
    assert all(found[n].verdict == verdict for n, _, verdict in held_out)
    assert found[next(n for n, _, v in held_out if v == "block")].mined == "host1=shop & path0=win"


def test_one_url_as_a_third_of_all_rows(spark):
    rows = [(n, "http://m.x.example.net/es/1/2/a.html?k=1#t") for n in range(30_000)]
    rows += [(n, f"http://h{n % 50}.org/{'de' if n % 3 else 'fr'}/{n}") for n in range(30_000, 90_000)]
    began = time.time()
    found = url_rules.judge_urls(spark.createDataFrame(rows, PAGES).repartition(16))
    assert found.where("rule = 'net/es/' AND verdict = 'block'").count() == 30_000
    assert time.time() - began < 120


def test_index_is_inverted():
    rule = url_rules.MinedRule
    rules = [rule(("a", "b"), "block", 1.0, 0.5), rule(("a",), "allow", 0.9, 0.5)]
    index = url_rules.RuleIndex(rules)
    assert index.postings == {"a": [0, 1], "b": [0]}
    assert [index.best(x) for x in (["a", "b", "c"], ["a", "c"], ["b"], [])] == [0, 1, None, None]


def test_labels_segments_and_keys_behind_the_first_ones_decide(spark):
    """Only the sixth label from the right, the fourth segment or the fourth key tells the two kinds apart."""
    shapes = ["http://{x}.e.d.c.b.org/p/q", "http://h.org/p/q/r/{x}/{n}", "http://h.org/p?a=1&b&c=3&{x}=4"]
    for shape in shapes:
        made = [(n, shape.format(x="zbad" if n % 3 else "zgood", n=n), "block" if n % 3 else "allow") for n in range(60)]
        labelled = spark.createDataFrame([x[1:] for x in made[:40]], "url string, verdict string")
        pages = spark.createDataFrame([x[:2] for x in made[40:]], PAGES)
        found = {x.page_id: x.verdict for x in url_rules.judge_urls(pages, (), labelled).collect()}
        assert found == {n: verdict for n, _, verdict in made[40:]}, shape


def test_long_urls_are_what_counting_gives(spark):
    """More tokens than have places, some in the same URLs and so mined as one, against counting them all."""
    rows = [
        (n, f"http://{'a.' * (n % 7)}x{n % 2}.w.v.u.{'com' if n % 4 else 'net'}/{'es/' if n % 3 else 'de/'}s/{n % 2}a/{n % 5}b?{'&'.join('klmno'[: n % 6])}")
        for n in range(120)
    ]
    rows += [(200 + n, f"http://x{n % 2}.w.v.u.org/de/s/{n % 2}a/{n % 5}b?n&{'klmno'[n % 5]}") for n in range(40)]
    pages = spark.createDataFrame(rows, PAGES)
    tokens = [x.t for x in pages.select(url_rules.url_tokens(F.col("url")).alias("t")).collect()]
    want = expected(rows, tokens)
    assert max(map(len, tokens)) > url_rules.MOST_TOKENS and any(x[5] for x in want)
    assert got(url_rules.judge_urls(pages, url_rules.HOST_RULES)) == want


def test_very_long_urls_that_are_frequent(spark):
    """Two thousand labels, segments and keys in two of three labelled URLs: mined as one, any of them decides."""
    many = [f"t{n}" for n in range(2000)]
    long = f"http://{'.'.join(many)}.org/{'/'.join(many)}?{'&'.join(many)}"
    labelled = [(long, "block")] * 20 + [("http://a.org/", "allow")] * 10
    pages = [(1, long), (2, "http://x.y.t77.z.z.z.org/"), (3, "http://b.org/p?t1234=1"), (4, "http://a.org/")]
    found = url_rules.judge_urls(
        spark.createDataFrame(pages, PAGES), (), spark.createDataFrame(labelled, "url string, verdict string")
    )
    said = {x.page_id: (x.verdict, x.mined) for x in found.collect()}
    assert said[1][0] == "block" and said[2] == ("block", "within host=t77")
    assert said[3] == ("block", "key=t1234") and said[4][0] == "allow"
