from pathlib import Path

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (id, text) pairs, with the other columns of the table."""

    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (None, "a row without an id, and with words"),
        (5, "equal text of two rows"),
        (6, "equal text of two rows"),
        (7, "a repeated row"),
        (7, "a repeated row"),
        (7, "another text with the same id"),
        (8, "word " * 30_000),
        (9, "Ünïcode ſtays  K – 漢字 \U0001f600 end"),
    ]


@pytest.fixture
def folder(tmp_path):
    return f"file://{Path(tmp_path)}/shared"


@pytest.fixture
def clashing(spark):
    """Adds columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    def add(df):
        names = ["fp", "ids", "size", "copy", "label", "n_words", "blob", "start", "length", "spans", "words", "payload"]
        return df.select("*", *[F.lit("x").alias(n) for n in names])

    return add


def vocabulary(name):
    return public_tokenizers.path(name)
