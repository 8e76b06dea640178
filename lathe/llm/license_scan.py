"""License scan: a generalised suffix automaton of licence tokens.

All phrases and template texts go, word by word, into one suffix automaton, whose states stand
for the word sequences inside them. Texts stream through it word by word: the state and the
length of the longest match that ends at each word are the matching statistics. A phrase is
found where the match reaches its whole length. Long matches that stand in the same order in
one template as in the text are chained into spans; a span that covers enough of its template
names the template's label.

A text's words are turned into numbers by a table of the known words; most neighbouring words
are no word pair of any template, and there a match has at most one word, so only runs of
known pairs (and words that are a phrase by themselves) are streamed.

The templates are a fixed list (or a parameter) and go to the executors as they are; texts are
not shuffled. Time is linear in the texts, and memory is a slice of rows.

Edge cases: a null or empty text has no words, no labels and score 0.0; repeated rows come
back each; phrases may overlap and all places count; a text of any length is scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.scratch import small_batches
from lathe.llm.tokens import LOWER, NON_WORD, Texts, buffer_of, slices, split, window_names

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Passages of public licence texts and common notices, by label.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "rights-reserved": ["All rights reserved."],
}

#: Words that a match needs to count towards a span (all, in a shorter template), words of
#: text that may lie between two matches of a span, and the share to be covered.
LONG = 4
GAP = 12
COVERED = 0.8


def _words(texts: pa.Array) -> Texts:
    buf, offsets = buffer_of(texts)
    return split(LOWER[buf], offsets, NON_WORD)


class Automaton:
    """Generalised suffix automaton over sequences of numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.places: list[set[tuple[int, int]]] = [set()]  # (sequence, index of the last number)

    def _new(self, size: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(link)
        self.places.append(set())
        return len(self.size) - 1

    def _clone(self, p: int, symbol: int, q: int) -> int:
        copy = self._new(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        q = self.next[last].get(symbol)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, symbol, q)
        new, p = self._new(self.size[last] + 1, {}, 0), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, symbol, q)
        return new

    def add(self, number: int, sequence: list[int]) -> None:
        last = 0
        for i, symbol in enumerate(sequence):
            last = self._extend(last, symbol)
            self.places[last].add((number, i))

    def finish(self) -> None:
        """Give each state the places of all states whose sequences end with its own."""
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            if self.link[state] > 0:
                self.places[self.link[state]] |= self.places[state]

    def stream(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each symbol."""
        state = length = 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            else:
                state = length = 0
            yield state, length


class Scanner:
    """Phrases and templates in one automaton."""

    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, list[str]], long: int = LONG, gap: int = GAP, covered: float = COVERED) -> None:
        self.long, self.gap, self.covered = long, gap, covered
        self.labels = [label for label in phrases.values()] + [label for label, texts in templates.items() for _ in texts]
        texts = [*phrases, *(t for group in templates.values() for t in group)]
        words = _words(pa.array(texts, pa.large_string()))
        names = words.names()
        self.known = np.unique(names)
        numbers = np.searchsorted(self.known, names)
        sequences = [numbers[a:b].tolist() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.sizes = [len(s) for s in sequences]
        self.phrases = range(len(phrases))
        self.automaton = Automaton()
        for i, s in enumerate(sequences):
            self.automaton.add(i, s)
        self.automaton.finish()
        pairs = [window_names(names[a:b], 2) for a, b in zip(words.first[:-1], words.first[1:], strict=True) if b > a + 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.singles = {s[0] for s in sequences if len(s) == 1}

    @cached_property
    def _bits(self) -> np.ndarray:
        bits = np.zeros(1 << 16, dtype=bool)
        bits[self.pairs >> np.uint64(48)] = True
        return bits

    def _runs(self, words: Texts, names: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words that can hold matches of two words or more, or a one-word phrase."""
        n = len(names)
        two = window_names(names, 2)
        joined = self._bits[two >> np.uint64(48)]
        at = np.flatnonzero(joined)
        if len(at) and len(self.pairs):
            joined[at] = self.pairs[np.minimum(np.searchsorted(self.pairs, two[at]), len(self.pairs) - 1)] == two[at]
        ends = words.first[1:-1]
        joined[ends[(ends > 0) & (ends < n)] - 1] = False
        inside = np.zeros(n, dtype=bool)
        inside[:-1] |= joined
        inside[1:] |= joined
        if self.singles:
            inside |= np.isin(names, self.known[list(self.singles)])
        # a break between two words that are inside but not joined
        start = inside.copy()
        start[1:] &= ~(inside[:-1] & joined)
        starts = np.flatnonzero(start)
        stop = inside.copy()
        stop[:-1] &= ~(inside[1:] & joined)
        yield from zip(starts.tolist(), (np.flatnonzero(stop) + 1).tolist(), strict=True)

    def scan(self, words: Texts) -> list[tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]]:
        """For each text: places of phrases (first word, phrase), and covered template spans
        (first word, end, template, share of the template)."""
        texts = len(words.first) - 1
        out: list[tuple[list, list]] = [([], []) for _ in range(texts)]
        names = words.names()
        if not len(names):
            return out
        auto, sizes = self.automaton, self.sizes
        held: dict[int, list[tuple[int, int, list[tuple[int, int]]]]] = {}
        for lo, hi in self._runs(words, names):
            text = int(np.searchsorted(words.first, lo, side="right")) - 1
            base = int(words.first[text])
            place = np.minimum(np.searchsorted(self.known, names[lo:hi]), len(self.known) - 1)
            symbols = np.where(self.known[place] == names[lo:hi], place, -1).tolist()
            steps = list(auto.stream(symbols))
            for i, (state, length) in enumerate(steps):
                end = lo + i + 1 - base
                at = state
                while at > 0:  # all phrases that end here, longest first
                    for number, last in auto.places[at]:
                        size = sizes[number]
                        if number in self.phrases and last + 1 == size and auto.size[auto.link[at]] < size <= min(length, auto.size[at]):
                            out[text][0].append((end - size, number))
                    at = auto.link[at]
                grows = i + 1 < len(steps) and steps[i + 1][1] == length + 1
                if not grows and length:
                    held.setdefault(text, []).append((end, length, sorted(auto.places[state])))
        for text, matches in held.items():
            out[text][0].sort()
            out[text][1].extend(self._chain(matches))
        return out

    def _chain(self, matches: list[tuple[int, int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, float]]:
        """Spans of templates: matches in the order of text and template, little text between."""
        open_: dict[int, list[tuple[int, int, int, int]]] = {}
        done = []
        for end, length, places in matches:
            for number, last in places:
                size = self.sizes[number]
                if number in self.phrases or length < min(self.long, size):
                    continue
                start, head = end - length, last + 1 - length
                chains = open_.setdefault(number, [])
                best = (length, start, end, last + 1)  # covered words, first word, end, next in template
                for covered, first, till, upto in chains:
                    if till <= start <= till + self.gap and upto <= head and covered + length > best[0]:
                        best = (covered + length, first, end, last + 1)
                chains[:] = [c for c in chains if c[2] + self.gap >= start]
                chains.append(best)
                if best[0] >= self.covered * size:
                    done.append((best[1], best[2], number, best[0] / size))
        spans: dict[tuple[int, int], tuple[int, int, int, float]] = {}
        for span in done:  # the most covered of those that begin at one word
            key = (span[0], span[2])
            spans[key] = max(spans.get(key, span), span, key=lambda s: (s[3], -s[1]))
        return sorted(spans.values())


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, list[str]] = TEMPLATES) -> DataFrame:
    """For each row: ``doc_id``, ``n_words``, ``places`` (array of first word and label of each
    phrase found) and ``spans`` (array of first word, end, label, share of the template)."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    phrases, templates = dict(phrases), {k: list(v) for k, v in templates.items()}
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for piece in slices(batches, "text"):
            words = _words(piece.column(1))
            found = scanner.scan(words)
            places = [[{"word": w, "label": scanner.labels[p]} for w, p in a] for a, _ in found]
            spans = [[{"start": s, "end": e, "label": scanner.labels[t], "share": c} for s, e, t, c in b] for _, b in found]
            yield pa.record_batch([piece.column(0), pa.array(np.diff(words.first), pa.int64()), pa.array(places, pa.list_(place)), pa.array(spans, pa.list_(span))], names=["doc_id", "n_words", "places", "spans"])

    return rows.mapInArrow(run, "doc_id long, n_words long, places array<struct<word: long, label: string>>, spans array<struct<start: long, end: long, label: string, share: double>>")


def summary(found: DataFrame) -> DataFrame:
    """Counts and labels of each scanned row; ``score`` is the largest share of a template
    that a span covers, 1.0 where a phrase stands, else 0.0."""
    labels = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.col("places.word")).alias("first_word"),
        F.array_max(F.col("places.word")).alias("last_word"),
        labels(F.col("places.label")).alias("base_labels"),
        labels(F.concat("places.label", "spans.label")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("spans.share")), F.lit(0.0))).alias("score"),
    )
