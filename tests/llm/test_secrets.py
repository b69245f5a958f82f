from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from wattloom.llm import queries, secrets

KEY = "AKIA" + "B" * 12


def digest(rows):
    return sorted(str((x.doc_id, x.n_assign, x.n_access, x.n_hex, x.base_sha256)) for x in rows)


def expected(rows):
    return sorted(str((i, *brute.secrets(t)[0])) for i, t in rows)


def test_query(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op6_secret_ledger(spark, sf).collect()
    assert digest(got) == expected(rows)
    assert any(x.n_assign for x in got)


SECRETS = [
    (20, f'é漢 token = "{"a1" * 20}" and {KEY}X PASSWORD:hunter2hunter2'),
    (21, f"toKen=short token=longenough1 {'f' * 31} {'e' * 32}g secret:'{'0' * 64}'"),
    (22, f'é漢 token = "{"a1" * 20}" and {KEY}X PASSWORD:hunter2hunter2'),
    (23, "ſecret=longenough1 toKen=longenough2 api_key: longenough3 apikey:=x"),
    (24, "-----BEGIN RSA PRIVATE KEY----- " + KEY[:15]),
    (25, ("password=" + "x" * 10 + " ") * 3000),
]


def test_odd_rows(make_docs, odd_rows, clashing, folder):
    rows = odd_rows + SECRETS
    got = secrets.secret_digest(secrets.secrets_by_path(clashing(make_docs(rows)), folder)).collect()
    assert digest(got) == expected(rows)
    [pem] = [x.spans for x in got if x.doc_id == 24]
    assert pem == "pem:0:31"


def test_nothing(make_docs, folder):
    assert secrets.secret_digest(secrets.secrets_by_path(make_docs([]), folder)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="tokenTOKEN=: \"'aA1é", max_size=40) | st.from_regex(r"(token|api_?key|AKIA[A-Z]{0,14}|[0-9a-f]{0,40}| [:=] ?)*", fullmatch=True))
def test_spans_equal_the_plain_patterns(text):
    found = secrets.scan_text(text, secrets.BASE_RULES)
    kinds = [r.kind for r in secrets.BASE_RULES]
    got = sorted((k, *s) for k, spans in zip(kinds, found) for s in spans)
    assert got == sorted(brute.secrets(text)[1])


def test_only_unseen_pairs_are_scanned(spark, make_docs, folder):
    base, first = secrets.BASE_RULES, make_docs(SECRETS)
    secrets.scan(first, folder, base)
    assert secrets.read_ledger(spark, folder).count() == 5 * len(base)  # two rows share a blob
    assert secrets.unseen(first, folder, base).count() == 0
    more = make_docs([*SECRETS, (30, "secret=abcdefgh1"), (20, "the second version of a row")])
    assert secrets.unseen(more, folder, base).count() == 2
    secrets.scan(more, folder, base)
    assert secrets.read_ledger(spark, folder).count() == 7 * len(base)
    missing = secrets.unseen(more, folder, secrets.RULES).select("missing").collect()
    assert len(missing) == 7 and all(x.missing == [secrets.PEM_RULE.version] for x in missing)
    got = secrets.secrets_by_path(more, folder, secrets.RULES)
    assert digest(secrets.secret_digest(got).collect()) == expected([*SECRETS, (30, "secret=abcdefgh1"), (20, "x")])
    assert secrets.read_ledger(spark, folder).count() == 7 * len(secrets.RULES)
    old = secrets.read_paths(spark, folder).where("doc_id = 20").select("blob").distinct().count()
    assert old == 2  # the path of the first version is still on record


def test_redaction(make_docs, folder):
    docs = make_docs([*SECRETS, (31, None), (32, "clean text")])
    cleaned = secrets.redact(docs, folder)
    assert cleaned.schema == docs.schema or cleaned.columns == docs.columns
    got = {x.doc_id: (x.text, x.n_chars) for x in cleaned.collect()}
    assert got[20] == ("é漢 [SECRET]\" and [SECRET] [SECRET]", len("é漢 [SECRET]\" and [SECRET] [SECRET]"))
    assert got[31] == (None, None) and got[32] == ("clean text", 10)
    assert got[24][0].startswith("[SECRET] ")
    for text, size in got.values():
        assert text is None or not brute.secrets(text)[1] and size == len(text)


def test_redaction_with_clashing_names_and_many_secrets(spark, make_docs, clashing, folder):
    many = "".join(f"token: abcdefgh{n:05d} and password=zzzzzzzz{n:05d};" for n in range(20_000))
    rows = [(1, many), (2, None), (3, ""), (4, "clean \U0001f600 text"), (5, "\U0001f600 secret: password=abcdefgh1 x"), (5, "clean")]
    docs = clashing(make_docs(rows)).selectExpr("*", "'y' AS found", "'y' AS _found", "'y' AS _blob", "'y' AS row")
    kept = secrets.redact(docs, folder)
    assert kept.schema == docs.schema
    got = {(x.doc_id, x.text): x for x in kept.collect()}
    assert len(got) == 6 and {(2, None), (3, ""), (4, "clean \U0001f600 text"), (5, "clean")} <= set(got)
    texts = sorted((i, t) for i, t in got if t and "[SECRET]" in t)
    assert texts[0] == (1, "[SECRET] and [SECRET];" * 20_000)
    assert [i for i, _ in texts] == [1, 5] and texts[1][1].startswith("\U0001f600 ") and texts[1][1].endswith(" x")
    assert all(x.n_chars == len(t) for (_, t), x in got.items() if t is not None)
    assert all(x.found == x._found == x._blob == x.row == "y" for x in got.values())
