"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A document leaks an item of ``m`` words if one of its windows of ``m`` words is within
``floor(edits * m)`` word edits (insert, delete, replace) of the item; with
``short_texts``, so does a document of fewer than ``m`` words whose whole text is. Words are runs of letters and digits, lower-cased.

1. Windows that cannot be that close are passed over: an edit spoils two word pairs at most,
   so a close window has at least m - 1 - 2e pairs (or m - e words, where that is none) of the
   items of its size. Only where so many stand close together are there windows to look at;
   the count loses nothing.
2. The rest are embedded by the CGK random walk: at each of 3m steps the walk writes the word
   it stands on and then stays or moves on by a random bit of (step, word). Texts at a small
   edit distance become strings at a small Hamming distance. A text that is shorter than the item
   is padded with what a walk writes after its text's end.
3. ``repeats`` independent walks each sample ``bits`` steps; a window and an item of its size
   that agree on all sampled steps of a walk are a candidate pair.
4. A banded dynamic program over the words of each candidate pair gives the exact distance.

The benchmark is the stated query set: it goes to the executors in blocks of ``BLOCK_BYTES``
at most, one scan of the documents for each block. Documents are not shuffled; a document's
windows live in its own slice of rows.

Edge cases: null or empty texts leak nothing; items without words are not looked for; ids may
be null or repeated and come back as they are (repeated rows, repeated rows of results); of
an item's windows in a document the closest is reported, of ties the first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.scratch import small_batches
from lathe.llm.tokens import LOWER, NON_WORD, SLICE_BYTES, Texts, buffer_of, mixed, slices, split, window_names

EDITS = 0.2
BITS = 2
REPEATS = 24
#: Bytes of item texts that are sent to the executors at a time.
BLOCK_BYTES = 8_000_000
_PAD = np.uint64(0x5851F42D4C957F2D)
_SCHEMA = "doc_id long, item_id long, first_word long, n_words long, edits long"


def _words(texts: pa.Array) -> Texts:
    buf, offsets = buffer_of(texts)
    return split(LOWER[buf], offsets, NON_WORD)


def walks(windows: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """What the CGK walks of all repeats write at their ``steps`` (a row, ascending, for each
    repeat); by repeat, window (a row of word names) and step. All walk abreast."""
    n, m = windows.shape
    flat = np.concatenate([windows, np.full((n, 1), _PAD)], axis=1).ravel()
    at = np.broadcast_to(np.arange(n) * (m + 1), (len(steps), n))
    top = np.arange(n)[None, :] * (m + 1) + m
    own = np.arange(len(steps), dtype=np.uint64)[:, None] * np.uint64(0x100000001B3)
    out = np.empty((len(steps), n, steps.shape[1]), dtype=np.uint64)
    for j in range(int(steps.max()) + 1):
        symbol = flat[at]
        repeat, k = np.nonzero(steps == j)
        out[repeat, :, k] = symbol[repeat]
        move = mixed(symbol + own + np.uint64((j * 0x9E3779B97F4A7C15 + 1) % 2**64)) >> np.uint64(63)
        at = np.minimum(at + move.astype(np.int64), top)
    return out


def sampled(windows: np.ndarray, repeats: int, bits: int) -> np.ndarray:
    """LSH keys of windows, a row for each repeat: the sampled steps of its walk as one name."""
    m = windows.shape[1]
    rng = [np.random.default_rng((r, m)) for r in range(repeats)]
    steps = np.stack([np.sort(g.choice(2 * m, min(bits, 2 * m), replace=False)) for g in rng])
    seen = walks(windows, steps)
    key = np.broadcast_to(np.arange(1, repeats + 1, dtype=np.uint64)[:, None], (repeats, len(windows)))
    for k in range(seen.shape[2]):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + seen[:, :, k])
    return key


def edit_distances(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Word edit distances of the rows of two arrays of as many rows; over ``limit``: limit + 1."""
    (n, m), long = a.shape, b.shape[1]
    width, far = 2 * limit + 1, limit + 1
    if abs(long - m) > limit:
        return np.full(n, far, dtype=np.int32)
    # band[:, d]: distance of a[:i] and b[:i + d - limit]
    band = np.full((n, width), far, dtype=np.int32)
    for d in range(limit, width):
        band[:, d] = d - limit
    for i in range(1, m + 1):
        new = np.full((n, width), far, dtype=np.int32)
        for d in range(width):
            j = i + d - limit
            if not 0 <= j <= long:
                continue
            best = np.full(n, i, dtype=np.int32) if j == 0 else band[:, d] + (a[:, i - 1] != b[:, j - 1])
            if d + 1 < width:
                best = np.minimum(best, band[:, d + 1] + 1)
            if d and j:
                best = np.minimum(best, new[:, d - 1] + 1)
            new[:, d] = np.minimum(best, far)
        band = new
    return band[:, limit + long - m]


class Items:
    """A block of benchmark items, prepared for search."""

    def __init__(self, ids: list[int | None], texts: list[str | None], edits: float, bits: int, repeats: int, short_texts: bool = False) -> None:
        words = _words(pa.array(texts, pa.large_string()))
        names, first = words.names(), words.first
        self.ids, self.edits, self.bits, self.repeats, self.short_texts = ids, edits, bits, repeats, short_texts
        by_size: dict[int, list[int]] = defaultdict(list)
        for i, n in enumerate(np.diff(first).tolist()):
            if n:
                by_size[n].append(i)
        pairs = window_names(names, 2)
        inside = np.ones(len(names), dtype=bool)
        inside[first[1:][first[1:] > 0] - 1] = False
        self.words, self.pairs = _Known(names), _Known(pairs[inside[: len(pairs)]])
        self.groups = []
        for m, rows in sorted(by_size.items()):
            grams = np.stack([names[first[i] : first[i] + m] for i in rows])
            limit = int(edits * m)
            by_pairs = m - 1 - 2 * limit >= 1
            if by_pairs:
                own = np.isin(self.pairs.names, np.concatenate([window_names(g, 2) for g in grams]))
            else:
                own = np.isin(self.words.names, grams.ravel())
            tables = [_Table(keys) for keys in sampled(grams, repeats, bits)]
            self.groups.append((m, limit, by_pairs, own, np.array(rows), grams, tables))

    def search(self, words: Texts) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, edits) of all leaks."""
        n = len(words.starts)
        if not n or not self.groups:
            return []
        names, first = words.names(), words.first
        sizes = np.diff(first)
        hits = {True: self.pairs.find(window_names(names, 2)), False: self.words.find(names)}
        out = []
        for m, limit, by_pairs, own, rows, grams, tables in self.groups:
            at, place = hits[by_pairs]
            at = _dense(at[own[place]], m - 1 if by_pairs else m, m - 1 - 2 * limit if by_pairs else m - limit)
            at = at[(at >= 0) & (at + m <= n)]
            at = at[at + m <= first[np.searchsorted(first, at, side="right")]]
            for lo in range(0, len(at), 5_000):
                out += self._near(names, at[lo : lo + 5_000], m, m, limit, rows, grams, tables)
            if not self.short_texts:
                continue
            # texts too short for a window, as a whole
            short = np.flatnonzero((sizes < m) & (sizes >= max(1, m - limit)))
            if len(short):
                at, place = hits[by_pairs]
                at = at[own[place]]
                held = np.searchsorted(at, first[1:][short]) - np.searchsorted(at, first[:-1][short])
                short = short[held >= (m - 1 - 2 * limit if by_pairs else m - limit)]
            for size in np.unique(sizes[short]).tolist():
                at = first[:-1][short[sizes[short] == size]]
                for lo in range(0, len(at), 5_000):
                    out += self._near(names, at[lo : lo + 5_000], size, m, limit, rows, grams, tables)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for start, item, size, edits in out:
            text = int(np.searchsorted(first, start, side="right")) - 1
            found = (edits, start - int(first[text]), size)
            best[text, item] = min(best.get((text, item), found), found)
        return [(t, i, start, size, edits) for (t, i), (edits, start, size) in best.items()]

    def _near(self, names, at, size, m, limit, rows, grams, tables) -> list[tuple[int, int, int, int]]:
        """Items of m words that the windows of ``size`` words (m at most) come close to."""
        windows = names[at[:, None] + np.arange(size)]
        padded = np.pad(windows, ((0, 0), (0, m - size)), constant_values=_PAD)
        met = [table.pairs(keys) for table, keys in zip(tables, sampled(padded, self.repeats, self.bits), strict=True)]
        met = np.unique(np.concatenate(met), axis=0)
        out = []
        for lo in range(0, len(met), 50_000):
            w, k = met[lo : lo + 50_000].T
            edits = edit_distances(windows[w], grams[k], limit)
            close = edits <= limit
            out += zip(at[w[close]].tolist(), rows[k[close]].tolist(), [size] * int(close.sum()), edits[close].tolist(), strict=True)
        return out


class _Known:
    """A set of names; a small table of bits turns most others away."""

    def __init__(self, names: np.ndarray) -> None:
        self.names = np.unique(names)
        self.shift = np.uint64(64 - max(16, min(24, len(self.names).bit_length() + 5)))
        self.bits = np.zeros(1 << int(64 - self.shift), dtype=bool)
        self.bits[self.names >> self.shift] = True

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where names of the set stand, and which ones they are."""
        at = np.flatnonzero(self.bits[names >> self.shift])
        place = np.minimum(np.searchsorted(self.names, names[at]), max(len(self.names) - 1, 0))
        hit = self.names[place] == names[at] if len(self.names) else np.zeros(len(at), dtype=bool)
        return at[hit], place[hit]


def _dense(at: np.ndarray, span: int, least: int) -> np.ndarray:
    """All starts of spans with at least ``least`` (one or more) of the positions ``at``."""
    if len(at) < least:
        return np.zeros(0, np.int64)
    lo, hi = at[least - 1 :] - (span - 1), at[: len(at) - least + 1]
    lo, hi = lo[lo <= hi], hi[lo <= hi]
    if not len(lo):
        return np.zeros(0, np.int64)
    # ranges lo..hi ascend in both ends: cut off what the range before has
    lo = np.maximum(lo, np.concatenate([[lo[0]], hi[:-1] + 1]))
    count = np.maximum(hi - lo + 1, 0)
    return np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class _Table:
    """Keys of items, to find the pairs (window, item) with equal keys."""

    def __init__(self, keys: np.ndarray) -> None:
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        count = hi - lo
        window = np.repeat(np.arange(len(keys)), count)
        item = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return np.stack([window, self.order[item]], axis=1)


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list]]:
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for row in benchmark.select(F.col(item_id).cast("long"), F.col(text).cast("string")).toLocalIterator():
        if row[1]:
            ids.append(row[0])
            texts.append(row[1])
            size += 4 * len(row[1])
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def leaks(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", edits: float = EDITS, bits: int = BITS, repeats: int = REPEATS, short_texts: bool = False) -> DataFrame:
    """One row for each document and item that it leaks: ``doc_id``, ``item_id``,
    ``first_word`` and ``n_words`` of the closest window, ``edits`` (its distance).

    ``edits``: share of an item's words that may be edited; ``bits``, ``repeats``: steps
    sampled of a walk and number of walks (more walks: more recall; more steps: fewer
    candidates); ``short_texts``: whether whole texts of fewer words than an item has are
    compared with it, too (off: windows of the item's size only).
    """
    small_batches(documents.sparkSession)
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = []
    for ids, texts in _blocks(benchmark, item_id, item_text):
        sent = spark.sparkContext.broadcast((ids, texts))  # BLOCK_BYTES at most

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(*sent.value, edits, bits, repeats, short_texts)
            for piece in slices(batches, "text", 4 * SLICE_BYTES):
                hits = items.search(_words(piece.column(1)))
                docs = piece.column(0).to_pylist()
                cols = list(zip(*[(docs[t], items.ids[i], start, m, e) for t, i, start, m, e in hits], strict=True)) or [[]] * 5
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "first_word", "n_words", "edits"])

        found.append(rows.mapInArrow(run, _SCHEMA))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _SCHEMA)


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` (doc_id, text, ...) that leak no item.

    A leaking row goes with all rows of its doc_id; a null doc_id is never taken for a leak.
    """
    bad = leaks(documents, benchmark, **options).select("doc_id").distinct()
    return documents.join(bad, "doc_id", "left_anti").select(*documents.columns)
