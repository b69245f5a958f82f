"""Encoder, packing and token files against the tokenizers library itself."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.brute import crc_of_ids
from tests.llm.conftest import vocabulary
from wattloom.llm import packing, queries, token_store
from wattloom.llm.encoder import PieceEncoder

FILES = {"byte_bpe_50k.json": (True, 0), "word_bpe_49k.json": (False, 2)}
_ODD = st.text(alphabet="aZé. ,\n\t'sK1  ́漢\x1c<|>", max_size=40)


def plain(name, texts):
    library = Tokenizer.from_file(vocabulary(name))
    end = FILES[name][1]
    return [[*x.ids, end] for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


_ENCODERS = {n: PieceEncoder(vocabulary(n), spaces, limit=50) for n, (spaces, _) in FILES.items()}


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=200, deadline=None)
@given(texts=st.lists(_ODD, max_size=4))
def test_pieces_give_the_ids_of_the_whole_text(name, texts):
    got = _ENCODERS[name].encode(texts, FILES[name][1])
    assert [x.tolist() for x in got] == plain(name, texts)


@pytest.mark.parametrize("name", FILES)
def test_special_tokens_in_a_text_are_what_the_library_makes_of_them(name):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>", "a <|endoftext b", "<|<|endoftext|>|>", "plain"]
    got = _ENCODERS[name].encode(texts, FILES[name][1])
    assert [x.tolist() for x in got] == plain(name, texts)
    if name.startswith("byte"):
        assert got[1].tolist() == [64, 220, 50256, 275, 0]


@pytest.mark.parametrize("name", FILES)
def test_frequent_pieces_stay_when_others_are_forgotten(name):
    encoder = PieceEncoder(vocabulary(name), FILES[name][0], limit=20)
    texts = [f"the common words and w{n}x w{n}x " * 2 for n in range(300)]
    for at in range(0, 300, 10):
        got = encoder.encode(texts[at : at + 10], 7)
        assert [x.tolist()[:-1] for x in got] == [x[:-1] for x in plain(name, texts[at : at + 10])]
    prefix = " " if FILES[name][0] else ""
    assert len(encoder.known.rows) <= 20 and {prefix + x for x in ("common", "words", "and")} <= set(encoder.known.rows)


def check_plan(rows, plan, window=4096):
    """Every id in exactly one piece, windows without gaps or overflow."""
    want = defaultdict(list)
    for (doc, _), ids in zip(rows, plain("word_bpe_49k.json", [t for _, t in rows])):
        want[doc].append(ids)
    got = defaultdict(list)
    for x in plan:
        got[x.doc_id].append(x)
    assert set(got) == set(want)
    for doc, texts in want.items():
        pieces = sorted((crc_of_ids(t[a : a + window]), a, len(t[a : a + window]), len(t)) for t in texts for a in range(0, len(t), window))
        assert sorted((x.ids_crc32, x.start, x.length, x.doc_tokens) for x in got[doc]) == pieces
    windows = defaultdict(list)
    for x in plan:
        windows[x.sequence_id].append((x.offset, x.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return windows


def test_packing_of_odd_rows(make_docs, odd_rows, clashing):
    _, plan = packing.pack_documents(clashing(make_docs(odd_rows)), vocabulary("word_bpe_49k.json"))
    check_plan(odd_rows, plan.collect())


def test_packing_of_nothing(make_docs):
    assert packing.pack_documents(make_docs([]), vocabulary("word_bpe_49k.json"))[1].count() == 0


def test_packing_query_is_whole_and_tight(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    plan = queries.op2_best_fit_packing(spark, sf).collect()
    windows = check_plan([(x.doc_id, x.text) for x in docs], plan)
    tokens = sum(x.length for x in plan)
    assert len(windows) <= -(-tokens // 4096) + 2


def test_sequences_hold_their_pieces(make_docs):
    rows = [(n, f"text number {n} " * (n * 7 % 300)) for n in range(60)]
    tokens, plan = packing.pack_documents(make_docs(rows), vocabulary("word_bpe_49k.json"))
    wanted = dict(zip([i for i, _ in rows], plain("word_bpe_49k.json", [t for _, t in rows])))
    full = {x.sequence_id: x for x in packing.packed_sequences(tokens, plan, pad_id=9).collect()}
    for x in plan.collect():
        ids = np.frombuffer(full[x.sequence_id].ids, "<u4")
        assert len(ids) == 4096
        assert ids[x.offset : x.offset + x.length].tolist() == wanted[x.doc_id][x.start : x.start + x.length]
        assert (ids[full[x.sequence_id].n_tokens :] == 9).all()


def test_sequences_of_repeated_rows_and_lengths_that_are_powers_of_two(make_docs):
    rows = [(1, "same text"), (1, "same text"), (None, "same text"), (None, None)]
    tokens, plan = packing.pack_documents(make_docs(rows), vocabulary("word_bpe_49k.json"), window=16)
    ids = [x for one in plain("word_bpe_49k.json", [t for _, t in rows]) for x in one]
    found = packing.packed_sequences(tokens, plan, window=16, pad_id=9).collect()
    assert sum(x.n_tokens for x in found) == len(ids)
    assert sorted(i for x in found for i in np.frombuffer(x.ids, "<u4")[: x.n_tokens]) == sorted(ids)
    for size in (1, 2, 3, 4, 16):
        one = make_docs([(n, None) for n in range(size)])
        tokens, plan = packing.pack_documents(one, vocabulary("word_bpe_49k.json"), window=16)
        (found,) = packing.packed_sequences(tokens, plan, window=16, pad_id=9).collect()
        assert len(found.ids) == 4 * (16 if size == 3 else size)


def test_written_sequences_are_those_of_the_plan(make_docs, odd_rows, clashing, folder):
    rows = odd_rows + [(100 + n, f"text number {n} " * (n * 7 % 40)) for n in range(200)]
    tokens, plan = packing.pack_documents(clashing(make_docs(rows)), vocabulary("word_bpe_49k.json"), window=64)
    plan = packing.pack(tokens, 64, group_windows=20)
    found = packing.write_sequences(tokens, folder, 64, group_windows=20, pad_id=9)
    wanted = packing.packed_sequences(tokens, plan, 64, pad_id=9)
    assert sorted(map(tuple, found.select(wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    pieces = packing.placed_pieces(found)
    assert pieces.dtypes == plan.dtypes
    assert sorted(map(str, pieces.collect())) == sorted(map(str, plan.collect()))
    check_plan(rows, pieces.collect(), 64)
    nothing = packing.write_sequences(tokens.limit(0), folder + "-0", 64)
    assert nothing.count() == packing.placed_pieces(nothing).count() == 0


def test_packing_query_writes_its_sequences(spark, sf, monkeypatch):
    paths = []
    write = packing.write_sequences
    monkeypatch.setattr(packing, "write_sequences", lambda t, path: paths.append(path) or write(t, path))
    got = queries.op2_best_fit_packing(spark, sf).collect()
    full = {x.sequence_id: x for x in spark.read.parquet(paths[0]).collect()}
    assert {x.sequence_id for x in got} == set(full)
    for x in got:
        ids = np.frombuffer(full[x.sequence_id].ids, "<u4")[x.offset : x.offset + x.length]
        assert len(ids) == x.length and crc_of_ids(ids.tolist()) == x.ids_crc32


@settings(max_examples=100, deadline=None)
@given(lengths=st.lists(st.integers(1, 32), max_size=60))
def test_the_tree_finds_the_tightest_window(lengths):
    lengths = sorted(lengths, reverse=True)
    places, opened = packing.best_fit(lengths, 32, packing.OpenWindows(32), 0)
    room = []
    for length, (window, offset) in zip(lengths, places):
        fits = [r for r in room if r >= length]
        if fits:
            assert room[window] == min(fits)
        else:
            assert window == len(room)
            room.append(32)
        assert offset == 32 - room[window]
        room[window] -= length
    assert opened == len(room)


def check_store(rows, got):
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    ids = plain("byte_bpe_50k.json", [t for _, t in ordered])
    assert len(got) == len(rows)
    want = sorted((str(i), crc_of_ids(x), len(x)) for (i, _), x in zip(ordered, ids))
    assert sorted((str(x.doc_id), x.ids_crc32, x.n_tokens) for x in got) == want
    at, last = 0, None
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at
        assert last is None or (x.doc_id or -1) >= last
        at, last = at + x.n_tokens, -1 if x.doc_id is None else x.doc_id


def stored(docs, folder, **options):
    from pyspark.sql import functions as F

    found = token_store.token_store(docs, folder, vocabulary("byte_bpe_50k.json"), **options)
    return found.withColumn("ids_crc32", F.crc32("ids")).collect()


@pytest.mark.parametrize("sample_docs", [0, 3, 1000])
def test_token_files_of_odd_rows(make_docs, odd_rows, clashing, folder, sample_docs):
    docs = clashing(make_docs(odd_rows))
    check_store(odd_rows, stored(docs, folder, files=3, sample_docs=sample_docs))


def test_token_files_of_nothing(make_docs, folder):
    assert stored(make_docs([]), folder) == []


def test_token_files_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check_store([(x.doc_id, x.text) for x in docs], queries.op9_token_files(spark, sf).collect())


def test_the_sample_is_bounded_and_ranked_by_hashes(spark, make_docs):
    docs = make_docs([(n % 50, f"text {n % 70} " + "long " * (n % 9) * 10) for n in range(500)] + [(1, "same")] * 100)
    texts = docs.select("doc_id", "text").repartition(7)
    got = token_store._sample(texts, 40, 300)
    assert len(got) == 40 and max(map(len, got)) <= 300
    assert got == token_store._sample(texts.repartition(3), 40, 300)
    assert len(token_store._sample(texts, 10_000, 1 << 20)) == 600
    assert token_store._sample(texts.limit(0), 40, 300) == []


def test_one_document_is_read_by_the_index(spark, make_docs, folder):
    rows = [(n, f"document number {n}") for n in range(40)]
    stored(make_docs(rows), folder, files=3)
    got = token_store.find_document(spark, folder, 17)
    assert [x.tolist() for x in got] == plain("byte_bpe_50k.json", ["document number 17"])
    assert token_store.find_document(spark, folder, 99) == []


def test_another_dictionary_is_refused(spark, make_docs, folder):
    stored(make_docs([(1, "a text"), (2, "another text")]), folder, files=1)
    path = spark.read.parquet(f"{folder}/manifest").first().path
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.TokenFile(path, b"something else")


def test_white_space_that_makes_a_cut_uncertain_is_always_looked_for():
    import re

    import pyarrow as pa
    import pyarrow.compute as pc

    from wattloom.llm import encoder

    spaces = [chr(n) for n in range(0x110000) if chr(n).isspace()]
    texts = [f"a{x} {y}b" for x in spaces for y in spaces]
    assert all(re.search(r"\s \s", x) for x in texts)
    assert all(pc.match_substring_regex(pa.array(texts), encoder._MAYBE_UNCERTAIN).to_pylist())


def test_reading_a_frame_copies_that_frame_alone(make_docs, folder):
    """A block of the file is cut once per frame: the rest of it behind a frame is never copied."""
    rows = [(n, f"document number {n} " * 3) for n in range(3000)]
    stored(make_docs(rows), folder, files=1)

    class Block(bytes):
        cut = 0

        def __getitem__(self, place):
            found = Block(super().__getitem__(place))
            Block.cut += len(found)
            return found

    (row,) = make_docs([]).sparkSession.read.parquet(f"{folder}/manifest").collect()
    file = token_store.TokenFile(row.path, token_store.read_dictionary(row.dictionary))
    source = file.source
    file.source = type("Source", (), {"read_at": lambda _, size, at: Block(source.read_at(size, at))})()
    frames = sum(len(x) for _, found in file.runs(1 << 20) for x in found)
    assert Block.cut == frames == int(file.index["size"].sum())


def test_the_library_gets_few_texts_at_a_time(monkeypatch):
    """Its answers take many times the memory of the ids; all of a run's at once took an executor's memory."""
    for name, (spaces, end) in FILES.items():
        encoder = PieceEncoder(vocabulary(name), spaces)
        given = []

        class Watched:
            def encode_batch_fast(self, texts, add_special_tokens, library=encoder.tokenizer):
                given.append(len(texts))
                return library.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

        encoder.tokenizer = Watched()
        texts = [f"two  spaces   here {n} <|endoftext|>" for n in range(300)] + [" ".join(f"w{n}x{m}" for m in range(90)) for n in range(300)]
        assert [x.tolist() for x in encoder.encode(texts, end)] == plain(name, texts)
        assert len(given) > 10 and max(given) <= 64


def test_a_task_encodes_in_one_thread(spark):
    import os

    from wattloom.llm.encoder import encoder

    path = vocabulary("word_bpe_49k.json")
    before = os.environ.get("TOKENIZERS_PARALLELISM")

    def look(batches):
        import pyarrow as pa

        for _ in batches:
            encoder(path, False, 1234).encode([f"some text {n}" for n in range(200)], 2)
            yield pa.RecordBatch.from_pydict({"said": [os.environ.get("TOKENIZERS_PARALLELISM", "")]})

    assert [x.said for x in spark.range(1).mapInArrow(look, "said string").collect()] == [before or "false"]
    encoder(path, False, 1234)
    assert os.environ.get("TOKENIZERS_PARALLELISM") == before


@pytest.mark.parametrize("name", FILES)
def test_words_of_letters_alone_get_from_the_model_what_the_library_gives(name):
    spaces, end = FILES[name]
    encoder = PieceEncoder(vocabulary(name), spaces)
    assert encoder.model is not None
    letters = [chr(n) for n in range(256) if chr(n).isalpha()]
    texts = ["x " + " ".join(a + b for b in letters) for a in letters] + ["x Ab ABC It's dön't ÀÉß ſt naïvé a1 été. Ünï, \xa0q \xady"]
    assert [x.tolist() for x in encoder.encode(texts, end)] == plain(name, texts)
