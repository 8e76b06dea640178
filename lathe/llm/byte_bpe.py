"""Byte-level BPE encoding and decoding as a tree reduction.

A piece (one match of the split pattern) of up to ``LEAF`` bytes is merged directly, lowest
rank first. A longer one is cut into halves that are encoded recursively; the halves' tokens
are then joined: the bytes of a few tokens on both sides of the seam are encoded afresh, and
the window grows until the tokens at its edges are stable. They are when each new neighbouring
pair, encoded on its own, gives that pair back; a sequence of tokens whose neighbouring pairs
all do so is the encoding of its bytes, so nothing outside the window can change. The join is
associative, and time grows about linearly with the piece, not with its square.

Decoding puts the bytes of neighbouring tokens next to each other in one buffer; concatenation
is associative, so each text of a slice is a cut of it.

Edge cases: a null or empty text has no ids, no ids (or null) decode to empty bytes; unknown
ids raise; every input row gives one output row with its other columns untouched.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.scratch import small_batches
from lathe.llm.tokens import slices

LEAF = 48
#: Pieces whose ids a worker remembers (about 200 bytes each).
_REMEMBERED = 250_000
_WINDOW = 4


@cache
def vocabulary(path: str) -> tuple[dict[bytes, int], list[bytes | None]]:
    """Ranks by token bytes, and bytes by rank, of a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, tokens


class Codec:
    """Encodes pieces of bytes and decodes ids for one vocabulary."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        self.ranks, self.tokens = vocabulary(path)
        self.leaf = max(2, leaf)
        self.known: dict[str, bytes] = {}
        self.table = pa.array(self.tokens, pa.large_binary())
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge neighbours, the lowest rank first (the leftmost of equals)."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        costs = [ranks.get(a + b) for a, b in zip(parts[:-1], parts[1:], strict=True)]
        while True:
            best, at = None, -1
            for i, cost in enumerate(costs):
                if cost is not None and (best is None or cost < best):
                    best, at = cost, i
            if best is None:
                return [ranks[x] for x in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(costs):
                costs[at] = ranks.get(parts[at] + parts[at + 1])

    def stable(self, a: int, b: int) -> bool:
        """Whether the pair's bytes encode to the pair."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > _REMEMBERED:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def tree(self, piece: bytes) -> list[int]:
        """Encode a piece of any length."""
        if len(piece) <= self.leaf:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings, one after the other."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = _WINDOW
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            raw = b"".join([self.tokens[t] for t in left[len(left) - i :] + right[:j]])
            if len(raw) <= 2 * self.leaf or i == len(left) and j == len(right):
                middle = self.merge(raw)
            else:
                middle = self.tree(raw)
            before = i == len(left) or self.stable(left[len(left) - i - 1], middle[0])
            after = j == len(right) or self.stable(middle[-1], right[j])
            if before and after:
                return left[: len(left) - i] + middle + right[j:]
            i, j = (i if before else 2 * i), (j if after else 2 * j)

    def piece(self, text: str) -> bytes:
        """The ids of one match of the pattern, as 32-bit integers."""
        raw = text.encode()
        whole = self.ranks.get(raw)
        found = np.array([whole] if whole is not None else self.tree(raw), dtype=np.int32).tobytes()
        if len(raw) <= self.leaf:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            self.known[text] = found
        return found

    def encode(self, text: str, pattern) -> np.ndarray:
        known, piece = self.known.get, self.piece
        matches = pattern.findall(text) if len(text) <= 1_000_000 else (m.group() for m in pattern.finditer(text))
        return np.frombuffer(b"".join([known(m) or piece(m) for m in matches]), dtype=np.int32)

    def decode(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids side by side, and where each id's bytes begin (and the end)."""
        found = self.table.take(ids)
        if found.null_count:
            raise ValueError("an id is not in the vocabulary")
        offsets = np.frombuffer(found.buffers()[1], dtype=np.int64, count=len(found) + 1)
        data = found.buffers()[2]
        return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), offsets


@cache
def codec(path: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    return Codec(path)


#: Bytes of text (or rows of ids) that a worker turns over at once.
_PIECE_BYTES = 500_000
_PIECE_ROWS = 256


def _encoded(own: Codec, splitter, texts: pa.Array) -> pa.ListArray:  # noqa: ANN001
    ids = [own.encode(t or "", splitter) for t in texts.to_pylist()]
    offsets = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def _decoded(own: Codec, lists: pa.ListArray) -> pa.Array:
    data, offsets = own.decode(lists.flatten())
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    cuts = offsets[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return pa.array([data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, the ids (array of int) of the whole ``text``.

    ``path``: the rank file, at the same place on every executor; ``pattern``: what splits a
    text into pieces that are merged separately (syntax of the ``regex`` module).
    """
    position = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        splitter, own = regex.compile(pattern), codec(path)
        for piece in slices(batches, text, _PIECE_BYTES):
            yield pa.record_batch([*piece.columns, _encoded(own, splitter, piece.column(position))], names=[*piece.schema.names, out])

    return _added(df, run, {out: "array<int>"})


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the bytes (binary) of the array ``ids``."""
    position = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, _PIECE_ROWS):
                piece = batch.slice(lo, _PIECE_ROWS)
                yield pa.record_batch([*piece.columns, _decoded(own, piece.column(position))], names=[*piece.schema.names, out])

    return _added(df, run, {out: "binary"})


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of the ids in one pass: rows go to a worker and back once."""
    position = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        splitter, own = regex.compile(pattern), codec(path)
        for piece in slices(batches, text, _PIECE_BYTES):
            lists = _encoded(own, splitter, piece.column(position))
            yield pa.record_batch([*piece.columns, lists, _decoded(own, lists)], names=[*piece.schema.names, ids, decoded])

    return _added(df, run, {ids: "array<int>", decoded: "binary"})


def _added(df: DataFrame, run, columns: dict[str, str]) -> DataFrame:
    for out in columns:
        if out in df.columns:
            raise ValueError(f"there is a column {out} already: name another")
    small_batches(df.sparkSession)
    schema = df.select("*", *[F.lit(None).cast(kind).alias(out) for out, kind in columns.items()]).schema
    return df.mapInArrow(run, schema)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas), ``decoded_sha256``;
    columns so named are replaced."""
    joined = F.concat_ws(",", F.col(ids).cast("array<string>"))
    return df.withColumns({"n_tokens": F.size(ids).cast("long"), "ids_sha256": F.sha2(joined, 256), "decoded_sha256": F.sha2(F.col(decoded), 256)})
