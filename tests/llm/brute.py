"""Plain restatements of what the operators promise, without Spark and without their code."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(UPPER)


def words(text):
    return WORD.findall(lower(text))


def crc_of_ids(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def contamination(docs, items, window=13):
    out = []
    windows = []
    for item, text in items:
        found = words(text)
        for at in range(max(1, len(found) - window + 1)) if found else ():
            windows.append((item, found[at : at + window]))
    for doc, text in docs:
        found, hit, ids = words(text), set(), set()
        for item, wanted in windows:
            for at in range(len(found) - len(wanted) + 1):
                if found[at : at + len(wanted)] == wanted:
                    hit.update(range(at, at + len(wanted)))
                    ids.add(str(item) if item is not None else "null")
        said = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        dirty = len(hit) > 0 and 20 * len(hit) >= len(found)
        out.append((doc, len(found), len(hit), len(ids), said, dirty))
    return out


def simhash(text, shingle=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not found:
        return 0
    parts = [" ".join(found[n : n + shingle]) for n in range(max(1, len(found) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    """Smallest id reachable for each of ``(id, fingerprint)``."""
    label = {fp: n for n, (_, fp) in enumerate(prints)}
    distinct = list(label)
    parent = {fp: fp for fp in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(distinct):
        for b in distinct[n + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(b)] = root(a)
    least = {}
    for doc, fp in prints:
        if doc is not None:
            least[root(fp)] = min(doc, least.get(root(fp), doc))
    return [(doc, fp, least.get(root(fp))) for doc, fp in prints]


ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secrets(text):
    text = text or ""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    found.sort(key=lambda x: (x[1], order.index(x[0])))
    counts = [sum(x[0] == k for x in found) for k in order]
    said = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return (*counts, hashlib.sha256(said.encode()).hexdigest()), found


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def phrases(text):
    found = words(text)
    hits = [
        (at, label)
        for phrase, label in PHRASES.items()
        for at in range(len(found))
        if found[at : at + len(phrase.split())] == phrase.split()
    ]
    places = [at for at, _ in hits]
    labels = ",".join(sorted({label for _, label in hits}))
    return len(found), len(hits), min(places, default=None), max(places, default=None), labels
