"""Token ids by the tokenizers library, each distinct piece of text encoded once per batch.

Both tokenizers split a text before they merge anything, and a single space between two
non-space characters is always such a split. So the texts of a batch are cut there by Arrow, which also
numbers the distinct pieces; these are encoded once by the library, and the ids of a text are the
ids of its pieces in order. Texts in which the cut is not certain (white space on both sides of a
space), and those that hold the string of a special token, go to the library whole.

Words are remembered over batches, at most ``limit`` of them. When there are more, those
met least are forgotten and the counts of the others halved, so frequent words stay.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from wattloom.llm.common import per_process

_UNCERTAIN = re.compile(r"\s \s")
#: Holds for every text in which ``_UNCERTAIN`` is found, and is found faster by Arrow: any character from U+0080 on is taken.
_MAYBE_UNCERTAIN = r"[\t-\r\x1c-\x20\x{80}-\x{10ffff}] [\t-\r\x1c-\x20\x{80}-\x{10ffff}]"
#: A special token of both vocabularies: the library cuts a text there before anything else.
_CUT = "<|endoftext|>"
#: A control character: to both libraries a word of its own.
_MARK = "\x01"
_JOINED = 32
#: Texts given to the library at a time: its answers take many times the memory of the ids in them.
_AT_ONCE = 64
#: A word and a comma or full stop. Lower-cased, U+0130 is two characters, and the second is no letter.
_TAILED = r"^ ?[^\PL\x{130}]+[.,]$"
#: Text that a worker cuts into pieces at a time. Longer runs repeat less work, shorter ones need less memory.
RUN_BYTES = 5 << 20
#: Words of these letters alone are one word to both libraries, which leave them as they are: each letter is one
#: character in every normal form. In the second, A-Z and the like are lower-cased before.
_LETTERS = re.compile(r" [A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_SMALL_LETTERS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")
#: Words that stand in one text when only the model is asked.
_SIDE_BY_SIDE = 512
#: What the byte-level vocabularies write for the bytes of these letters and for the space.
_BYTES = {n: n + 162 if 127 <= n <= 160 else n for n in range(256)} | {32: 288, 173: 323}
_WORDS_FIRST = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: How byte-level vocabularies write a space.
_SPACE = "\u0120"


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``start, start + 1, ...`` of all runs, one run after the other."""
    ends = np.cumsum(sizes)
    places = np.repeat(starts - (ends - sizes), sizes)
    places += np.arange(len(places))
    return places


class _Known:
    """Ids of the pieces that are remembered: a run of ids for each, and how often it was met."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.starts, self.sizes, self.met = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, np.uint32)

    def add(self, pieces: list[str], flat: np.ndarray, sizes: np.ndarray, met: np.ndarray) -> None:
        first = len(self.rows)
        self.rows.update(zip(pieces, range(first, first + len(pieces))))
        ends = len(self.flat) + np.cumsum(sizes)
        self.starts = np.concatenate([self.starts, ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])
        self.met = np.concatenate([self.met, met])

    def keep(self, count: int) -> None:
        """Forget all but the ``count`` pieces that were met most."""
        if len(self.rows) <= count:
            return
        chosen = np.sort(np.argpartition(-self.met, count)[:count])
        pieces = list(self.rows)
        self.flat = self.flat[expand(self.starts[chosen], self.sizes[chosen])]
        self.sizes, self.met = self.sizes[chosen], self.met[chosen] // 2
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.rows = {pieces[n]: row for row, n in enumerate(chosen.tolist())}


class PieceEncoder:
    """``spaces``: the piece after a space keeps it (byte-level vocabularies); otherwise white space
    is dropped. At most ``limit`` pieces are remembered."""

    def __init__(self, path: str, spaces: bool, limit: int = 300_000):
        from tokenizers import Tokenizer

        if TaskContext.get() is not None:  # a task has one core; the library would start a thread for each of the machine
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.cut_id = self.tokenizer.token_to_id(_CUT)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.spaces, self.limit = spaces, limit
        self.known = _Known()
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark_id = mark[0] if len(mark) == 1 else None
        normalizer = self.tokenizer.normalizer
        self.lower = normalizer is not None and normalizer.normalize_str("AZ") == "az"
        self.tails = {x: y[0] for x in ".," if len(y := self.tokenizer.encode(x, add_special_tokens=False).ids) == 1}
        self.model, self.ends = self._model_alone()
        self.opening = np.zeros(self.vocabulary, bool)
        if spaces:
            self.opening[[n for x, n in self.tokenizer.get_vocab().items() if x.startswith(_SPACE)]] = True
        elif self.mark_id is not None:
            self.opening[self.mark_id] = True

    def _model_alone(self):
        """The model without what stands before it, and which ids end a word; None where that may not do for ``_LETTERS``."""
        from tokenizers import Tokenizer, pre_tokenizers

        before = [None if x is None else json.loads(x.__getstate__()) for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        bytes_ = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
        if self.spaces:
            known = [None, bytes_ | {"use_regex": True}]
        else:
            said = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
            split = {"type": "Split", "pattern": {"Regex": _WORDS_FIRST}, "behavior": "Removed", "invert": True}
            known = [
                {"type": "Sequence", "normalizers": [{"type": "NFC"}, said, {"type": "Lowercase"}]},
                {"type": "Sequence", "pretokenizers": [split, bytes_ | {"use_regex": False}]},
            ]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if before != known or (suffix is None) != self.spaces:
            return None, None
        alone = Tokenizer(self.tokenizer.model)
        alone.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        ends = np.zeros(self.vocabulary, bool)
        if suffix:
            ends[[n for x, n in self.tokenizer.get_vocab().items() if x.endswith(suffix)]] = True
        return alone, ends

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """Ids of every text, with ``end_id`` behind them."""
        return [ids for _, found in self.runs(pa.array(texts, pa.string()), end_id) for ids in found]

    def runs(self, texts: pa.Array, end_id: int, limit: int = RUN_BYTES) -> Iterator[tuple[int, list[np.ndarray]]]:
        """First place and ids of runs of texts, of about ``limit`` bytes each; no text is NULL."""
        first, held = 0, 0
        for n, size in enumerate(pc.binary_length(texts).to_pylist()):
            held += size
            if held >= limit or n + 1 == len(texts):
                yield first, self._some(texts.slice(first, n + 1 - first), end_id)
                first, held = n + 1, 0

    def _ids_of(self, texts: list[str], tokenizer=None) -> Iterator[list[int]]:
        tokenizer = tokenizer or self.tokenizer
        for at in range(0, len(texts), _AT_ONCE):
            for found in tokenizer.encode_batch_fast(texts[at : at + _AT_ONCE], add_special_tokens=False):
                yield found.ids

    def _to_library(self, text: str, maybe: bool) -> bool:
        if not text or maybe and _UNCERTAIN.search(text):
            return True
        return any(x in text for x in self.special)

    def _some(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        maybe = pc.match_substring_regex(texts, _MAYBE_UNCERTAIN).to_pylist() if self.spaces else repeat(False)
        direct = [self._to_library(x.as_py(), y) for x, y in zip(texts, maybe)]
        whole = [x.as_py() for x, y in zip(texts, direct) if y]
        by_library = (np.array([*ids, end_id], np.uint32) for ids in self._ids_of(whole))
        cut = texts.filter(pa.array([not x for x in direct]))
        by_pieces = self._by_pieces(cut, end_id) if len(cut) else iter(())
        return [next(by_library if y else by_pieces) for y in direct]

    def _by_pieces(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        if not self.spaces:
            texts = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        numbered = lists.flatten().dictionary_encode()
        del lists
        piece = numbered.indices.to_numpy(zero_copy_only=False).copy()
        pieces = numbered.dictionary
        del numbered
        if self.spaces:
            # Only the first piece of a text has no space before it.
            opening, place = np.unique(piece[bounds[:-1]], return_inverse=True)
            piece[bounds[:-1]] = len(pieces) + place
            spaced = pc.binary_join_element_wise(pa.scalar(""), pieces, pa.scalar(" "))
            pieces = pa.concat_arrays([spaced, pieces.take(pa.array(opening))])
        starts, sizes, flat = self._runs(pieces, np.bincount(piece, minlength=len(pieces)))
        del pieces
        end = np.array([end_id], np.uint32)
        for at in range(0, len(texts), _AT_ONCE):
            places = bounds[at : at + _AT_ONCE + 1]
            rows = piece[places[0] : places[-1]]
            run = sizes[rows]
            ids = flat[expand(starts[rows], run)]
            ends = np.concatenate([[0], np.cumsum(run)])[places - places[0]].tolist()
            for a, b in zip(ends, ends[1:]):
                yield np.concatenate([ids[a:b], end])

    def _runs(self, pieces: pa.Array, met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and ids of every piece's run.

        A word with a comma or full stop behind it is the ids of the word and one more; A-Z are lower-cased
        where the library does so too. So only words are looked up, encoded and remembered.
        """
        if self.lower:
            pieces = pc.ascii_lower(pieces)
        tailed = pc.match_substring_regex(pieces, _TAILED)
        marks = pc.if_else(tailed, pc.utf8_slice_codeunits(pieces, -1), pa.scalar("")).dictionary_encode()
        ids = np.array([self.tails.get(x, -1) for x in marks.dictionary.to_pylist()], np.int64)
        tail = ids[marks.indices.to_numpy(zero_copy_only=False)] if len(ids) else np.zeros(0, np.int64)
        cut = pa.array(tail >= 0)
        words = pc.if_else(cut, pc.utf8_slice_codeunits(pieces, 0, -1), pieces).dictionary_encode()
        place = words.indices.to_numpy(zero_copy_only=False)
        first, size, flat = self._words(words.dictionary.to_pylist(), np.bincount(place, met).astype(np.int64))
        first, size = first[place], size[place]
        total = size + (tail >= 0)
        starts = np.cumsum(total) - total
        out = np.zeros(int(total.sum()), np.uint32)
        behind = (starts + size)[tail >= 0]
        of_words = np.ones(len(out), bool)
        of_words[behind] = False
        out[of_words] = flat[expand(first, size)]
        out[behind] = tail[tail >= 0]
        return starts, total, out

    def _words(self, words: list[str], met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and size of the ids of every word; those that no text has are left empty."""
        known = self.known
        row = np.fromiter(map(known.rows.get, words, repeat(-1)), np.int64, len(words))
        old, new = row >= 0, np.flatnonzero((row < 0) & (met > 0))
        known.met[row[old]] += met[old]
        fresh = [words[n] for n in new.tolist()]
        flat, begin, run = self._encoded(fresh)
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[old], sizes[old] = known.starts[row[old]], known.sizes[row[old]]
        starts[new], sizes[new] = len(known.flat) + begin, run
        every = np.concatenate([known.flat, flat])
        known.add(fresh, flat[expand(begin, run)], run, met[new])
        if len(known.rows) > self.limit:
            known.keep(3 * self.limit // 4)
        return starts, sizes, every

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, and where each one's ids start and how many they are.

        Words of ``_LETTERS`` alone go to the model at once. Other pieces that neither begin nor end with white
        space stand side by side, as in a text. The rest are set apart by a special token.
        """
        letters, plain, apart = [], [], []
        fits = (_LETTERS if self.spaces else _SMALL_LETTERS).fullmatch if self.model else lambda _: None
        for n, x in enumerate(pieces):
            (letters if fits(x) else plain if self._plain(x) else apart).append(n)
        ways = ((self._by_model, letters), (self._side_by_side, plain), (self._apart, apart))
        parts = [way([pieces[n] for n in chosen]) for way, chosen in ways]
        sizes, starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        ordered = np.concatenate([x[1] for x in parts])
        order = np.array(letters + plain + apart, np.int64)
        sizes[order], starts[order] = ordered, np.cumsum(ordered) - ordered
        return np.concatenate([x[0] for x in parts]), starts, sizes

    def _plain(self, piece: str) -> bool:
        if not self.spaces:
            return piece != "" and piece.strip() == piece and _MARK not in piece
        return len(piece) > 1 and piece[0] == " " and piece.strip() == piece[1:]

    def _by_model(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of ``_LETTERS``, written as the model has them."""
        flats, sizes = [], []
        groups = [words[at : at + _SIDE_BY_SIDE] for at in range(0, len(words), _SIDE_BY_SIDE)]
        said = ("\n".join(x).encode().decode("latin-1").translate(_BYTES) for x in groups)
        for group, found in zip(groups, self._ids_of(list(said), self.model)):
            ids = np.array(found, np.uint32)
            if self.spaces:
                run = np.diff(np.flatnonzero(self.opening[ids]), append=len(ids))
            else:
                run = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(run) != len(group):
                raise ValueError("words and ids differ")
            flats.append(ids)
            sizes.append(run)
        return _joined(flats, sizes)

    def _side_by_side(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A piece starts at the id that begins with a space or, in vocabularies without spaces, behind a mark."""
        if not self.spaces and self.mark_id is None:
            return self._apart(pieces)
        groups = [pieces[at : at + _JOINED] for at in range(0, len(pieces), _JOINED)]
        said = ["".join(x) if self.spaces else "".join(f"{_MARK} {y} " for y in x) for x in groups]
        flats, sizes = [], []
        for group, found in zip(groups, self._ids_of(said)):
            ids = np.array(found, np.uint32)
            begins = np.flatnonzero(self.opening[ids])
            if len(begins) != len(group) or begins[0]:
                flat, run = self._apart(group)
            elif self.spaces:
                flat, run = ids, np.diff(begins, append=len(ids))
            else:
                flat, run = ids[~self.opening[ids]], np.diff(begins, append=len(ids)) - 1
            flats.append(flat)
            sizes.append(run)
        return _joined(flats, sizes)

    def _apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        groups = [_CUT.join(pieces[at : at + _JOINED]) for at in range(0, len(pieces), _JOINED)]
        flats, sizes = [], []
        for found in self._ids_of(groups):
            ids = np.array([*found, self.cut_id], np.uint32)
            cuts = np.flatnonzero(ids == self.cut_id)
            flats.append(ids[ids != self.cut_id])
            sizes.append(np.diff(cuts, prepend=-1) - 1)
        return _joined(flats, sizes)


def _joined(flats: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.uint32), *flats]), np.concatenate([np.zeros(0, np.int64), *sizes])


def encoder(path: str, spaces: bool, limit: int = 300_000) -> PieceEncoder:
    return per_process(("encoder", path, spaces, limit), lambda: PieceEncoder(path, spaces, limit))
