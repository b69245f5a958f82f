"""License notices in texts: base phrases, and windows that contain a template.

The templates are sets of words; the blocks of a text are its windows with as many words as the
template, wherever they start and whatever lines they span, so that words strewn over a long
line are no notice. A window meets a template when it holds at least ``threshold`` of its words. That is a
set-similarity join with filters that lose nothing: words are ordered by their frequency over all documents; a
template of ``m`` words that needs ``c`` common ones has a prefix of its ``m - c + 1`` rarest words,
of which a window must hold one, its rarest; from that word on in the order, the words in reach of it must still
hold ``c`` of the template's (positional filter); a window must hold ``c`` of them at all (length filter). What is
left is counted exactly. Only windows around the occurrences of prefix words are looked at.

Edge cases: a null or empty text has no words, no places and score 0; repeated rows each get a row;
ties between templates give all their labels; a phrase may overlap another; of overlapping windows
the best counts, the first one on ties; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import map_batches, raw_texts, word_list

#: Base phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Notices by label, as their licenses suggest them.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification,"
    " are permitted provided that the following conditions are met",
    "cc-by-notice": "Licensed under CC BY 4.0",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
    " software and associated documentation files",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "reserved-notice": "All rights reserved",
    # Whole notices.
    "apache-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in"
    " compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    " Unless required by applicable law or agreed to in writing, software distributed under the License is"
    " distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See"
    " the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright"
    " notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the"
    " above copyright notice, this list of conditions and the following disclaimer in the documentation and/or"
    " other materials provided with the distribution.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
    " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)"
    " any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
    " without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General"
    " Public License for more details. You should have received a copy of the GNU General Public License along with"
    " this program. If not, see https://www.gnu.org/licenses/.",
    "isc-license": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
    " hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING"
    " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "mit-license": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    " associated documentation files (the Software), to deal in the Software without restriction, including without"
    " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
    " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions"
    " of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING"
    " BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL"
    " was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

_COLUMNS = "doc_id long, n_words long, places array<struct<label: string, word: long>>, found array<struct<label: string, word: long, containment: double>>"


def needed(size: int, threshold: float) -> int:
    """The least number of common words of a template with ``size`` words."""
    return next(n for n in range(size + 1) if n / size >= threshold)


@dataclass
class TemplateIndex:
    """Templates by the words of their prefixes."""

    order: dict[bytes, int]
    threshold: float
    sets: list[tuple[str, list[bytes], int]] = field(default_factory=list)
    prefix: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)

    def add(self, label: str, text: str) -> None:
        every = word_list(text.encode())
        words = sorted(set(every), key=self.order.__getitem__)
        self.lengths.append(len(every))
        common = needed(len(words), self.threshold)
        for place, word in enumerate(words[: len(words) - common + 1]):
            self.prefix.setdefault(word, []).append((len(self.sets), place))
        self.sets.append((label, words, common))

    def near(self, words: list[bytes], starts: list[int]) -> dict[int, list[list[int]]]:
        """Stretches of the text, by template, that hold all windows whose rarest word stands at one of ``starts``."""
        found: dict[int, list[list[int]]] = {}
        for at in starts:
            for number, place in self.prefix.get(words[at], ()):
                _, wanted, common = self.sets[number]
                reach = self.lengths[number] - 1
                first, end = max(0, at - reach), min(at + reach + 1, len(words))
                if len(set(wanted[place:]).intersection(words[first:end])) < common:
                    continue
                runs = found.setdefault(number, [])
                if runs and first <= runs[-1][1]:
                    runs[-1][1] = end
                else:
                    runs.append([first, end])
        return found

    def matches(self, words: list[bytes], starts: list[int]) -> list[tuple[str, int, float]]:
        """Label, first place and containment of windows that meet a template: the best of those that overlap.

        ``starts`` are the places of all prefix words.
        """
        out = []
        for number, runs in self.near(words, starts).items():
            label, wanted, common = self.sets[number]
            known = frozenset(wanted)
            for start, end in runs:
                places = [n for n in range(start, end) if words[n] in known]
                if len(places) < common:
                    continue
                best = None  # count, first and last place
                for count, first, last in _windows(words, places, self.lengths[number]):
                    if count < common:
                        continue
                    if best and first > best[2]:
                        out.append((label, best[1], best[0] / len(wanted)))
                        best = None
                    if best is None or count > best[0]:
                        best = count, first, last
                if best:
                    out.append((label, best[1], best[0] / len(wanted)))
        return out


def _windows(words: list[bytes], places: list[int], length: int):
    """Distinct words, first and last place of the windows of ``length`` words that start at each of
    ``places``; no other window holds more of the words that stand there."""
    inside: dict[bytes, int] = {}
    upto = 0
    for first in places:
        while upto < len(places) and places[upto] < first + length:
            word = words[places[upto]]
            inside[word] = inside.get(word, 0) + 1
            upto += 1
        yield len(inside), first, places[upto - 1]
        inside[words[first]] -= 1
        if not inside[words[first]]:
            del inside[words[first]]


def word_frequencies(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """Number of documents that hold each of ``words`` (a bounded list), over all documents."""

    def count(batches):
        counts = dict.fromkeys(words, 0)
        for batch in batches:
            for raw in raw_texts(batch, "text"):
                for word in words.intersection(word_list(raw)):
                    counts[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    partial = docs.select("text").mapInArrow(count, "word binary, n long")
    sums = partial.groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row per word of the templates
    return dict.fromkeys(words, 0) | {bytes(x.word): x.n for x in sums}


def build_index(docs: DataFrame, templates: dict[str, str], threshold: float) -> TemplateIndex:
    words = {w for text in templates.values() for w in word_list(text.encode())}
    counts = word_frequencies(docs, words)
    order = {w: n for n, w in enumerate(sorted(words, key=lambda w: (counts[w], w)))}
    index = TemplateIndex(order, threshold)
    for label, text in sorted(templates.items()):
        index.add(label, text)
    return index


def phrase_places(words: list[bytes], starts: list[int], phrases: dict) -> list[tuple[str, int]]:
    """Labels and places of the phrases whose first word stands at one of ``starts``."""
    return [
        (label, at)
        for at in starts
        for phrase, label in phrases.get(words[at], ())
        if words[at : at + len(phrase)] == phrase
    ]


def license_matches(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
    threshold: float = 0.8,
) -> DataFrame:
    """``doc_id, n_words, places, found``: phrases with the number of their first word, and the windows
    that meet a template with its containment; a window is named by its first word of the template."""
    index = build_index(docs, templates, threshold)
    by_first: dict[bytes, list] = {}
    for phrase, label in phrases.items():
        words = word_list(phrase.encode())
        by_first.setdefault(words[0], []).append((words, label))
    triggers = frozenset(by_first) | frozenset(index.prefix)

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, places, found = [], [], []
        for raw in raw_texts(batch, "text"):
            words = word_list(raw)
            sizes.append(len(words))
            starts = [n for n, w in enumerate(words) if w in triggers]
            hits = phrase_places(words, starts, by_first)
            places.append([{"label": label, "word": at} for label, at in hits])
            rare = [n for n in starts if words[n] in index.prefix]
            met = index.matches(words, rare)
            found.append([{"label": label, "word": n, "containment": share} for label, n, share in met])
        place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        match = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("containment", pa.float64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(places, place), pa.array(found, match)],
            ["doc_id", "n_words", "places", "found"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, look, _COLUMNS)


def license_digest(matches: DataFrame) -> DataFrame:
    """Counts, first and last place, labels, and the highest containment (0 if no window meets one)."""
    base = F.array_sort(F.array_distinct("places.label"))
    every = F.array_sort(F.array_distinct(F.concat("places.label", "found.label")))
    return matches.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce(F.array_max("found.containment"), F.lit(0.0)).alias("score"),
    )
