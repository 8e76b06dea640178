"""Substring deduplication by recompression.

Word sequences are parsed in rounds. A round first names runs of an equal symbol, then splits
the alphabet into two classes (a bit of each name's hash, new in each round) and replaces
every pair (left class, right class) by one symbol. Whether two neighbours merge depends on
these two alone, so equal passages get the same interior symbols wherever they stand; only
symbols near the ends of a passage may differ. A name is a hash of what it spans, so each
executor gives equal content the same global name and no dictionary grows in one place.

After two rounds (symbols of up to four words) any 13-word window has, within its first
eight words, a symbol start on which all copies of the window agree, or a run of one word.
Hence the work:

1. Texts are packed into chunks of about ``CHUNK_BYTES``, written once to the shared folder.
2. Each chunk sends the name of the words that follow each symbol start (6 of 13), once
   each, to buckets by name; the answer is one bit a name: another chunk has it too.
3. Only windows over a shared symbol are looked at further: each chunk sends their 96-bit
   names, once each with the smallest doc_id in the chunk; the answer is one bit: another
   chunk has it in a smaller document. With the order inside the chunk this decides every
   window exactly, up to a collision of 96-bit names.

A name shared by a third of all documents is one entry a chunk, so no bucket grows hot, and
buckets and chunks grow in number, not in size.

Edge cases: a null or empty text has no words and an empty kept text; rows with the same
doc_id do not remove words from each other; a null doc_id counts as larger than any other,
and gets back null; every input row gives one output row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.scratch import small_batches, written
from lathe.llm.tokens import SPACES, Texts, buffer_of, fits, mixed, slices, split, window_names

WINDOW = 13
#: Size of a chunk's texts, and the number of text bytes for which there is one bucket.
CHUNK_BYTES = 1_500_000
BUCKET_BYTES = 4_000_000
#: Words that a window may begin with before a symbol start that all its copies share.
_SLACK = 7
_NO_ID = np.iinfo(np.int64).max


def recompress(names: np.ndarray, first: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Symbol starts after ``rounds`` of run and pair naming, and the symbols' names.

    ``names``: of the words; ``first``: index of each text's first word. Every word in a run
    of equal words also counts as a start, with the run's name.
    """
    n = len(names)
    if not n:
        return np.zeros(0, np.int64), names
    head = np.zeros(n, dtype=bool)
    head[first[:-1][first[:-1] < n]] = True
    same = np.zeros(n, dtype=bool)
    same[1:] = (names[1:] == names[:-1]) & ~head[1:]
    in_run = same.copy()
    in_run[:-1] |= same[1:]
    starts = np.flatnonzero(~same)
    lengths = np.diff(np.append(starts, n)).astype(np.uint64)
    symbols = np.where(lengths > 1, mixed(names[starts] + lengths * np.uint64(0xA24BAED4963EE407)), names[starts])
    for r in range(rounds):
        right = (mixed(symbols + np.uint64(0x632BE59BD9B4E019 * (r + 1) % 2**64)) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(symbols), dtype=bool)  # with the symbol before
        joins[1:] = ~right[:-1] & right[1:] & ~head[starts[1:]]
        follows = np.zeros(len(symbols), dtype=bool)
        follows[:-1] = joins[1:]
        paired = symbols.copy()
        at = np.flatnonzero(follows)
        paired[at] = mixed(symbols[at] * np.uint64(0x9FB21C651E98DF25) + symbols[at + 1] + np.uint64(r + 1))
        starts, symbols = starts[~joins], paired[~joins]
    extra = np.flatnonzero(in_run)
    extra = extra[~np.isin(extra, starts)]
    order = np.argsort(np.concatenate([starts, extra]), kind="stable")
    return np.concatenate([starts, extra])[order], np.concatenate([symbols, names[extra]])[order]


def _pack(ids: np.ndarray, texts: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([pa.array(ids, pa.int64(), mask=ids == _NO_ID), texts], names=["id", "text"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class _Chunk:
    """The texts of a chunk with their words, names, symbol starts and candidate windows."""

    def __init__(self, blob: bytes, window: int) -> None:
        batch = pa.ipc.open_stream(blob).read_all().combine_chunks()
        self.window, self.ids = window, batch.column(0).fill_null(_NO_ID).to_numpy()
        self.null = batch.column(0).is_null().to_numpy()
        texts = batch.column(1).combine_chunks()
        self.words: Texts = split(*buffer_of(texts), SPACES)
        self.names = self.words.names()
        self.doc = self.ids[self.words.owner] if len(self.names) else np.zeros(0, np.int64)
        self.start_ok = fits(self.words.first, window, len(self.names))

    def anchors(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names of the words after symbol starts, whether two documents of the
        chunk have them, the starts, and each start's place among the distinct names."""
        span = self.window - _SLACK
        at, _ = recompress(self.names, self.words.first)
        at = at[fits(self.words.first, span, len(self.names))[at]] if len(at) else at
        key = window_names(self.names, span)[at] if len(at) else np.zeros(0, np.uint64)
        key = key >> np.uint64(64 - 32 - buckets.bit_length() + 1)  # bucket and 32 more bits
        distinct, place = np.unique(key, return_inverse=True)
        low, high = _low_high(place, self.doc[at] if len(at) else key.astype(np.int64), len(distinct))
        return distinct, low != high, at, place

    def windows(self, shared: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows over a shared symbol: distinct names (two columns), smallest document of
        each, the windows' starts, and each one's place among the distinct names."""
        n, span = len(self.names), self.window - _SLACK
        if not n or n < self.window:
            none = np.zeros(0, np.int64)
            return np.zeros((0, 2), np.uint64), none, none, none
        cover = np.zeros(n + 1, dtype=np.int32)
        hits = at[shared[place]]
        np.add.at(cover, np.maximum(hits - (self.window - span), 0), 1)
        np.add.at(cover, hits + 1, -1)
        starts = np.flatnonzero((np.cumsum(cover[:-1]) > 0) & self.start_ok)
        a = window_names(self.names, self.window)[starts]
        b = window_names(self.words.names(1), self.window, 1)[starts] >> np.uint64(32)
        order = np.lexsort((b, a))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        kept = order[new]
        low, _ = _low_high(place, self.doc[starts], len(kept))
        return np.stack([a[kept], b[kept]], axis=1), low, starts, place

    def removed(self, elsewhere: np.ndarray, low: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Flags of the words under a window that a smaller document has."""
        n = len(self.names)
        gone = starts[elsewhere[place] | (self.doc[starts] > low[place])]
        cover = np.zeros(n + 1, dtype=np.int32)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + self.window, -1)
        return np.cumsum(cover[:-1]) > 0


def _low_high(place: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(n, _NO_ID), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, place, doc)
    np.maximum.at(high, place, doc)
    return low, high


def _planes(x: np.ndarray) -> bytes:
    """64-bit integers by byte planes: small differences compress well."""
    return pa.compress(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unplanes(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(np.int64).ravel()


def _bucket_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def _cuts(bucket: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket, np.arange(buckets + 1))


_SENT = "bucket long, chunk long, n long, names binary, docs binary"
_ANSWER = "chunk long, kind int, bucket long, n long, bits binary"


def _chunked(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, k = TaskContext.get(), 0
        part = context.partitionId() if context else 0

        def row(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal k
            table = pa.Table.from_batches(rows).combine_chunks()
            ids = table.column(0).fill_null(_NO_ID).to_numpy()
            texts = table.column(1).fill_null("").combine_chunks()
            k += 1
            return pa.record_batch([pa.array([(part << 32) + k]), pa.array([int(buffer_of(texts)[1][-1])]), pa.array([_pack(ids, texts)], pa.binary())], names=["chunk", "n_bytes", "blob"])

        held: list[pa.RecordBatch] = []
        size = 0
        for piece in slices(batches, "text", CHUNK_BYTES // 4):
            held.append(piece)
            size += int(buffer_of(piece.column(1))[1][-1]) + 16 * piece.num_rows
            if size >= CHUNK_BYTES:
                yield row(held)
                held, size = [], 0
        if held:
            yield row(held)

    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(pack, "chunk long, n_bytes long, blob binary")


def _answers(kind: int):
    """One bit for each name that a chunk sent: it stands in another chunk (kind 0), in a
    smaller document of another chunk (kind 1)."""

    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        chunks, sizes = table.column("chunk").to_numpy(), table.column("n").to_numpy()
        blobs = table.column("names").to_pylist()
        if kind == 0:
            names = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs])
            order = np.argsort(names, kind="stable")
            new = np.ones(len(names), dtype=bool)
            new[1:] = names[order][1:] != names[order][:-1]
            group = np.cumsum(new) - 1
            flag = np.empty(len(names), dtype=bool)
            flag[order] = np.bincount(group)[group] > 1
        else:
            a = np.concatenate([np.frombuffer(x, np.uint64, int(n)) for x, n in zip(blobs, sizes, strict=True)])
            b = np.concatenate([np.frombuffer(x, np.uint32, int(n), 8 * int(n)) for x, n in zip(blobs, sizes, strict=True)])
            docs = np.concatenate([_unplanes(x, int(n)) for x, n in zip(table.column("docs").to_pylist(), sizes, strict=True)])
            order = np.lexsort((b, a))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            group = np.cumsum(new) - 1
            low = np.minimum.reduceat(docs[order], np.flatnonzero(new))
            flag = np.empty(len(order), dtype=bool)
            flag[order] = low[group] < docs[order]
        parts = np.split(flag, np.cumsum(sizes)[:-1])
        return pa.table({"chunk": chunks, "kind": pa.array([kind] * len(chunks), pa.int32()), "bucket": table.column("bucket"), "n": sizes, "bits": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())})

    return reduce


def _bits(answers: pa.Table, kind: int, total: int) -> np.ndarray:
    """All answers of a kind, in the order in which the names were sent (by bucket)."""
    picked = [(b, n, x) for k, b, n, x in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "n", "bits")), strict=True) if k == kind]
    parts = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for _, n, x in sorted(picked, key=lambda p: p[0])]
    out = np.concatenate(parts) if parts else np.zeros(0, dtype=bool)
    assert len(out) == total, (len(out), total)
    return out


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Remove each word under a ``window``-word passage that a smaller document has as well.

    Returns ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, unless ``with_text``
    is false, ``kept_text`` (kept words joined by one space). ``window``: 9 to 64 words.
    """
    if not _SLACK + 2 <= window <= 64:
        raise ValueError("window must be from 9 to 64 words")
    small_batches(documents.sparkSession)
    chunks = written(_chunked(documents, doc_id, text), "chunks", compression="uncompressed")
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(5, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    buckets = 1 << bits

    def send_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, _, _, _ = _Chunk(blob, window).anchors(buckets)
                cuts = _cuts((names >> np.uint64(32)).astype(np.int64), buckets)
                low = names.astype(np.uint32)
                sent = [(b, low[i:j]) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
                yield pa.record_batch([pa.array([b for b, _ in sent], pa.int64()), pa.array([chunk] * len(sent), pa.int64()), pa.array([len(x) for _, x in sent], pa.int64()), pa.array([x.tobytes() for _, x in sent], pa.binary()), pa.array([None] * len(sent), pa.binary())], names=["bucket", "chunk", "n", "names", "docs"])

    blobs = chunks.select("chunk", "blob")
    symbols = blobs.mapInArrow(send_symbols, _SENT).groupBy("bucket").applyInArrow(_answers(0), _ANSWER)
    symbols = written(symbols, "symbols")

    def shared(chunk: _Chunk, answers: pa.Table) -> tuple:
        names, here, at, place = chunk.anchors(buckets)
        return chunk.windows(here | _bits(answers, 0, len(names)), at, place)

    def send_windows(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for blob in left.column("blob").to_pylist():
            names, low, _, _ = shared(_Chunk(blob, window), right)
            cuts = _cuts(_bucket_of(names[:, 0], bits), buckets)
            for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if j > i:
                    out.append((b, j - i, names[i:j, 0].tobytes() + names[i:j, 1].astype(np.uint32).tobytes(), _planes(low[i:j])))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        chunk_id = left.column("chunk")[0].as_py() if left.num_rows else 0
        return pa.table({"bucket": pa.array(cols[0], pa.int64()), "chunk": pa.array([chunk_id] * len(out), pa.int64()), "n": pa.array(cols[1], pa.int64()), "names": pa.array(cols[2], pa.binary()), "docs": pa.array(cols[3], pa.binary())})

    sent = blobs.groupBy("chunk").cogroup(symbols.groupBy("chunk")).applyInArrow(send_windows, _SENT)
    windows = written(sent.groupBy("bucket").applyInArrow(_answers(1), _ANSWER), "windows")

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for blob in left.column("blob").to_pylist():
            chunk = _Chunk(blob, window)
            names, low, starts, place = shared(chunk, right)
            gone = chunk.removed(_bits(right, 1, len(names)), low, starts, place)
            words, first = chunk.words, chunk.words.first
            raw = words.buf.tobytes()
            for i, doc in enumerate(chunk.ids.tolist()):
                lo, hi = int(first[i]), int(first[i + 1])
                keep = np.flatnonzero(~gone[lo:hi]) + lo
                kept = b" ".join([raw[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)])
                rows.append((None if chunk.null[i] else doc, hi - lo, hi - lo - len(keep), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        fields = {"doc_id": pa.array(cols[0], pa.int64()), "n_words": pa.array(cols[1], pa.int64()), "n_removed": pa.array(cols[2], pa.int64()), "kept_sha256": pa.array(cols[3], pa.string())}
        return pa.table(fields | ({"kept_text": pa.array(cols[4], pa.string())} if with_text else {}))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return blobs.groupBy("chunk").cogroup(symbols.unionByName(windows).groupBy("chunk")).applyInArrow(finish, schema)
