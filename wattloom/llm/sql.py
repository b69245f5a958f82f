"""The same questions as DuckDB SQL, where SQL can express them.

Not here: slots and shards (no CRC-32 in that SQL), token ids (op2, op9), XXH64 (op5), a fitted model
(op8), and the pipeline; those are tested by brute force.
"""

from __future__ import annotations

from wattloom.llm.licenses import PHRASES, TEMPLATES
from wattloom.llm.secrets import PEM_RULE
from wattloom.llm.url_rules import HOST_RULES

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all(coalesce({lower}, ''), '{_WORD}')"


_WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100
                 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id
  FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f"""

_CONTAMINATION = f"""
WITH items AS (SELECT item_id, {_words("text")} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[pos + 1 : pos + size], ' ') AS gram
  FROM (SELECT item_id, words, least(13, len(words)) AS size,
               unnest(range(greatest(1, len(words) - 12))) AS pos
        FROM items WHERE len(words) > 0)),
docs AS (
  SELECT row_number() OVER () AS row, doc_id, {_words("text")} AS words FROM documents),
grams AS (
  SELECT row, pos, size, array_to_string(words[pos + 1 : pos + size], ' ') AS gram
  FROM (SELECT row, words, size, unnest(range(len(words) - size + 1)) AS pos
        FROM docs CROSS JOIN (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)),
found AS (SELECT row, pos, g.size, item_id FROM grams g JOIN windows w USING (gram) WHERE g.size = w.size),
hit AS (
  SELECT row, count(DISTINCT word) AS n_hit
  FROM (SELECT row, unnest(range(pos, pos + size)) AS word FROM found) GROUP BY row),
named AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, coalesce(CAST(item_id AS VARCHAR), 'null') AS item FROM found) GROUP BY row)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hit USING (row) LEFT JOIN named USING (row)"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), f"{_either('api')}_?{_either('key')}"])
_VALUE = "[A-Za-z0-9+/_.=-]+"
_ASSIGN = rf"""(?:{_NAMES})["'']?\x20*[:=]\x20*["'']?"""


def _spans(kind: str, rank: int, pattern: str, counted: str, least: int) -> str:
    """Places of matches: what stands between and in the matches before adds up."""
    return f"""
SELECT row, '{kind}' AS kind, {rank} AS rank, pos, pos + size AS stop
FROM (SELECT row, matched[n] AS found, length(matched[n]) AS size,
             list_sum(list_transform(between[:n], lambda x: length(x)))
             + coalesce(list_sum(list_transform(matched[:n - 1], lambda x: length(x))), 0) AS pos
      FROM (SELECT *, unnest(range(1, len(matched) + 1)) AS n
            FROM (SELECT row, regexp_extract_all(text, '{pattern}') AS matched,
                         regexp_split_to_array(text, '{pattern}') AS between FROM docs)))
WHERE length({counted}) >= {least}"""


_SECRETS = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
spans AS (
{_spans("assign", 0, f"{_ASSIGN}{_VALUE}", f"regexp_extract(found, '^{_ASSIGN}({_VALUE})$', 1)", 8)}
UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", "found", 16)}
UNION ALL {_spans("hex", 2, "[0-9a-f]+", "found", 32)}
UNION ALL {_spans("pem", 3, PEM_RULE.pattern, "found", 1)}),
named AS (SELECT *, kind || ':' || CAST(pos AS BIGINT) || ':' || CAST(stop AS BIGINT) AS said FROM spans),
grouped AS (
  SELECT row, count_if(rank = 0) AS n_assign, count_if(rank = 1) AS n_access, count_if(rank = 2) AS n_hex,
         string_agg(said, ',' ORDER BY pos, rank) FILTER (WHERE rank < 3) AS base,
         string_agg(said, ',' ORDER BY pos, rank) AS spans
  FROM named GROUP BY row)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign,
       CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN grouped USING (row)"""

_PHRASES = " UNION ALL ".join(
    f"SELECT {p.split()} AS phrase, '{label}' AS label" for p, label in PHRASES.items()
)
_TEMPLATES = " UNION ALL ".join(
    f"SELECT list_distinct({_words(repr(text))}) AS wanted, len({_words(repr(text))}) AS size, '{label}' AS label"
    for label, text in TEMPLATES.items()
)

_LICENSES = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, text, {_words("text")} AS words FROM documents),
phrases AS ({_PHRASES}),
templates AS ({_TEMPLATES}),
places AS (
  SELECT row, label, pos
  FROM (SELECT row, words, phrase, label, unnest(range(len(words))) AS pos FROM docs CROSS JOIN phrases)
  WHERE words[pos + 1 : pos + len(phrase)] = phrase),
base AS (
  SELECT row, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY row),
starts AS (
  SELECT row, words, label, wanted, size, unnest(range(len(words))) AS pos FROM docs CROSS JOIN templates),
met AS (
  SELECT row, label, max(share) AS share
  FROM (SELECT row, label, len(list_intersect(wanted, words[pos + 1 : pos + size])) / len(wanted) AS share
        FROM starts WHERE list_contains(wanted, words[pos + 1]))
  WHERE share >= 0.8e0 GROUP BY row, label),
every AS (
  SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT row, label FROM places UNION ALL SELECT row, label FROM met) GROUP BY row),
best AS (SELECT row, max(share) AS score FROM met GROUP BY row)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score
FROM docs LEFT JOIN base USING (row) LEFT JOIN every USING (row) LEFT JOIN best USING (row)"""

_TOP_K = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
       vec_id, score
FROM scored QUALIFY rank <= 20"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host_cases(value: str) -> str:
    """The longest rule first, as ``rule`` or as ``verdict``."""
    cases = []
    for verdict, domain, start in sorted(HOST_RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        said = domain + start if value == "rule" else verdict
        fits = f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{start}')"
        cases.append(f"WHEN {fits} THEN '{said}'")
    return f"CASE {' '.join(cases)} END"


_URL_RULES = rf"""
WITH u AS (
  SELECT row_number() OVER () AS row, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS behind
  FROM pages),
h AS (
  SELECT row, page_id, behind, translate(regexp_extract(behind, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(behind, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
p AS (
  SELECT *, {_host_cases("rule")} AS rule, {_host_cases("verdict")} AS said,
         list_reverse(string_split(host, '.')) AS labels,
         list_filter(string_split(path, '/'), lambda x: x <> '') AS segments,
         regexp_extract(path, '\.([A-Za-z0-9]{{1,8}})\z', 1) AS suffix,
         list_sort(list_filter(list_distinct(list_transform(
           string_split(regexp_extract(behind, '^[^?#]*\?([^#]*)', 1), '&'),
           lambda x: regexp_extract(x, '^([^=]*)', 1))), lambda x: x <> '')) AS keys
  FROM h),
q AS (
  SELECT *, CASE WHEN host = '' THEN ['none'] ELSE list_sort(list_distinct(
    list_transform(labels[1:4], lambda x, i: 'host' || (i - 1) || '=' || x)
    || ['labels=' || least(len(labels), 9)]
    || list_transform(list_transform(segments[1:2], lambda x: regexp_replace(x, '\.[A-Za-z0-9]{{1,8}}\z', '')),
                      lambda x, i: 'path' || (i - 1) || '=' || CASE WHEN regexp_matches(x, '^[0-9]+\z') THEN '#' ELSE x END)
    || ['segments=' || least(len(segments), 9)]
    || list_transform(keys[1:2], lambda x: 'key=' || x)
    || CASE WHEN suffix <> '' THEN ['suffix=' || suffix] ELSE [] END
    || CASE WHEN regexp_matches(behind, '^[^?#]*\?') THEN ['query'] ELSE [] END
    || CASE WHEN contains(behind, '#') THEN ['fragment'] ELSE [] END)) END AS tokens
  FROM p),
t AS (SELECT row, said, unnest(tokens) AS token FROM q WHERE said IS NOT NULL),
parts AS (
  SELECT said, [token] AS tokens FROM t
  UNION ALL SELECT a.said, [a.token, b.token] FROM t a JOIN t b ON a.row = b.row AND a.token < b.token
  UNION ALL SELECT a.said, [a.token, b.token, c.token]
            FROM t a JOIN t b ON a.row = b.row AND a.token < b.token JOIN t c ON a.row = c.row AND b.token < c.token),
counted AS (
  SELECT tokens, said, n, n / sum(n) OVER (PARTITION BY tokens) AS confidence
  FROM (SELECT tokens, said, count(*) AS n FROM parts GROUP BY tokens, said)),
mined AS (
  SELECT * FROM counted
  WHERE confidence >= 0.8e0 AND n >= (SELECT ceil(0.01e0 * count(*)) FROM q WHERE said IS NOT NULL)),
pruned AS (
  SELECT * FROM mined r
  WHERE NOT EXISTS (SELECT 1 FROM mined o WHERE o.said = r.said AND len(o.tokens) < len(r.tokens)
                    AND list_has_all(r.tokens, o.tokens) AND o.confidence >= r.confidence)),
best AS (
  SELECT q.row, r.said, array_to_string(r.tokens, ' & ') AS mined, r.confidence
  FROM q JOIN pruned r ON list_has_all(q.tokens, r.tokens)
  WHERE q.said IS NULL
  QUALIFY row_number() OVER (PARTITION BY q.row ORDER BY r.confidence DESC, r.n DESC, len(r.tokens), r.tokens) = 1)
SELECT page_id, host, path, rule, coalesce(q.said, best.said, 'allow') AS verdict, mined, confidence
FROM q LEFT JOIN best USING (row)"""

_CRC = """
crc_table AS (
  SELECT list(c ORDER BY i) AS crcs
  FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i) AS c
        FROM (SELECT unnest(range(256)) AS i)))"""


def _crc32(text: str) -> str:
    """Checksum of a text's UTF-8 bytes, byte by byte with the table ``crcs``."""
    digit = "strpos('0123456789ABCDEF', substr(h, {}, 1)) - 1"
    byte = f"CAST(16 * ({digit.format('2 * i + 1')}) + {digit.format('2 * i + 2')} AS BIGINT)"
    step = "lambda c, b: xor(crcs[xor(c, b) % 256 + 1], c // 256)"
    bytes_ = f"list_transform(range(length(h) // 2), lambda i: {byte})"
    return f"(SELECT xor(list_reduce({bytes_}, {step}, 4294967295), 4294967295) FROM (SELECT hex(encode({text})) AS h))"


_RESAMPLING = f"""
WITH {_CRC},
docs AS (SELECT row_number() OVER () AS row, doc_id, {_words("text")} AS words FROM documents),
every AS (SELECT row, unnest(words) AS word FROM docs),
wanted AS (SELECT unnest({_words("text")}) AS word FROM benchmark),
known AS (
  SELECT word, {_crc32("word")} % 10000 AS bucket
  FROM (SELECT word FROM every UNION SELECT word FROM wanted), crc_table),
corpus AS (SELECT bucket, count(*) AS s FROM every JOIN known USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM wanted JOIN known USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM every) AS ss, (SELECT count(*) FROM wanted) AS tt),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (ss + 10000) AS DOUBLE)
                                      / CAST((s + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM corpus LEFT JOIN target USING (bucket), sums),
weights AS (SELECT row, sum(gain) AS weight FROM every JOIN known USING (word) JOIN gains USING (bucket) GROUP BY row),
drawn AS (
  SELECT row, doc_id, len(words) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         list_reduce(list_transform(range(8), lambda i: CAST(strpos('0123456789abcdef', substr(
           sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), i + 1, 1)) - 1 AS BIGINT)),
           lambda a, b: 16 * a + b) AS h
  FROM docs LEFT JOIN weights USING (row)),
scored AS (
  SELECT row, doc_id, n_features, weight,
         weight + CAST(floor(-1000e0 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM drawn),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (row)"""


def _clustering(k: int = 16, rounds: int = 3, seed: int = 1, width: int = 64, scale: int = 64) -> str:
    distance = "list_sum(list_transform(list_zip(x.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"""
WITH x AS (
  SELECT row_number() OVER () AS row, vec_id,
         list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM (SELECT * FROM embeddings
        WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS number, v AS c
  FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, v FROM x) QUALIFY number < {k})"""
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""
a{n} AS (
  SELECT x.row, min_by(number, ({distance}, number)) AS number, min({distance}) AS distance
  FROM x CROSS JOIN c{n} c GROUP BY x.row)"""
        )
        if n < rounds:
            parts.append(
                f"""
m{n} AS (
  SELECT number, pos, CAST(sum(value) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT number, unnest(v) AS value, unnest(range({width})) AS pos FROM a{n} JOIN x USING (row))
  GROUP BY number, pos),
c{n + 1} AS (
  SELECT c.number, coalesce(moved, c.c) AS c
  FROM c{n} c LEFT JOIN (
    SELECT number, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS moved FROM m{n} GROUP BY number) USING (number))"""
            )
    return (
        ",".join(parts)
        + f"""
SELECT vec_id, CAST(number AS INT) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY number) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} JOIN x USING (row) JOIN c{rounds} c USING (number)"""
    )


ORACLES: dict[str, str] = {
    "op3_warc_reader": _WARC,
    "op4_decontamination": _CONTAMINATION,
    "op6_secret_ledger": _SECRETS,
    "op7_license_join": _LICENSES,
    "op10_impact_top_k": _TOP_K,
    "op11_url_rules": _URL_RULES,
    "op12_importance_resampling": _RESAMPLING,
    "op13_centroid_clustering": _clustering(),
}
