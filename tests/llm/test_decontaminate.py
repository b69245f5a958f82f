import pytest

from tests.llm import brute
from wattloom.llm import decontaminate as d
from wattloom.llm import queries

ITEM = " ".join(f"item{n}" for n in range(20))


def digest(rows):
    return sorted(str((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated)) for x in rows)


def expected(rows, items):
    return sorted(map(str, brute.contamination(rows, items)))


def test_query(spark, sf):
    read = lambda t, c: [tuple(x) for x in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()]
    rows, items = read("documents", ["doc_id", "text"]), read("benchmark", ["item_id", "text"])
    got = queries.op4_decontamination(spark, sf).collect()
    # The brute force is slow: every document with a hit, and a part of the others.
    hit = {x.doc_id for x in got if x.n_hit}
    some = [x for x in rows if x[0] in hit or x[0] % 10 == 0]
    assert digest([x for x in got if x.doc_id in {i for i, _ in some}]) == expected(some, items)
    assert len(got) == len(rows) and hit


ITEMS = [
    (1, ITEM),
    (2, "two words"),
    (3, None),
    (4, " ., "),
    (None, "an item without id"),
    (5, "two words"),
    (6, "a a a a a a a a a a a a a a a"),
    (10, "Ünder é"),
]
ROWS = [
    (1, "before " + ITEM.upper() + " after"),
    (2, ITEM[: ITEM.index(" item12")]),
    (3, "x " * 500 + ITEM.replace(" ", ", ")),
    (4, None),
    (5, ""),
    (6, "two, words; two words and an item without id"),
    (7, "a " * 40),
    (7, "a " * 40),
    (None, "two words"),
    (8, "item0 " + ITEM + " item3 item4"),
    (9, "ünder é Ünder é"),
    (11, "w " * 60_000 + "two words"),
]


@pytest.mark.parametrize("block_words", [4_000_000, 30])
def test_odd_rows_in_one_block_or_many(spark, make_docs, clashing, block_words):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = clashing(make_docs(ROWS))
    windows = d.benchmark_windows(bench, block_words=block_words)
    assert (windows.blocks > 1) == (block_words == 30)
    assert digest(d.verdicts(d.contamination(docs, windows)).collect()) == expected(ROWS, ITEMS)


def test_nothing(spark, make_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert digest(d.decontaminate(make_docs(ROWS), bench).collect()) == expected(ROWS, [])
    full = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.decontaminate(make_docs([]), full).count() == 0


@pytest.mark.parametrize("block_words", [4_000_000, 30])
def test_clean_documents_keep_their_columns(spark, make_docs, clashing, block_words):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    names = ["row", "own", "own_hash", "id", "hash", "text_hash", "starts", "ends", "windows", "items"]
    docs = clashing(make_docs(ROWS))
    docs = docs.selectExpr("*", *[f"'y' AS {n}" for n in names if n not in docs.columns])
    kept = d.clean_documents(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns
    clean = [(i, t) for (i, t), x in zip(ROWS, brute.contamination(ROWS, ITEMS)) if not x[-1]]
    assert sorted(map(str, ((x.doc_id, x.text) for x in kept.collect()))) == sorted(map(str, clean))


def test_the_rarest_shingle_is_the_anchor(spark, make_docs):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = make_docs([(n, " ".join(f"item{k}" for k in range(15))) for n in range(5)])
    (index,) = d.block_indexes(docs, d.benchmark_windows(bench, window=20))
    [(number, distance)] = [x for found in index.anchors.values() for x in found]
    assert number == 0 and distance > 10


def test_blocks_are_dropped_one_by_one(spark, make_docs, monkeypatch):
    """No more than one index is sent out at a time, and a window that very many items share is no row."""
    bench = spark.createDataFrame([*ITEMS, *((100 + n, "a very common passage") for n in range(3000))], "item_id long, text string")
    docs = make_docs([*ROWS, *((1000 + n, f"{n} a very common passage {n}") for n in range(50))])
    alive, most, context = set(), [], spark.sparkContext
    send = context.broadcast

    class Handle:
        def __init__(self, value):
            self.real = send(value)
            alive.add(self)
            most.append(len(alive))

        def __reduce__(self):
            return self.real.__reduce__()

        def destroy(self):
            alive.discard(self)
            self.real.destroy()

    monkeypatch.setattr(context, "broadcast", Handle)
    windows = d.benchmark_windows(bench, block_words=30)
    assert windows.blocks > 3
    assert windows.items.groupBy("window").count().agg({"count": "max"}).first()[0] == 3000
    found = {x.doc_id: x for x in d.contamination(docs, windows).collect()}
    assert max(most) == 1 and not alive
    assert len(found[1007]["items"]) == 3000 and found[1007].starts == [1]
