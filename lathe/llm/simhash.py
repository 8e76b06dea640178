"""SimHash near-duplicates: fingerprints, links by pigeonhole blocks, components.

A fingerprint has a bit set where more than half of a text's word shingles have it set in
their 64-bit hash. Two fingerprints link at ``distance`` or fewer differing bits. The 64 bits
are split into ``distance + 2`` blocks; a close pair differs in at most ``distance`` of them,
so it agrees on some two blocks, and rows that agree on two blocks meet under one key. There
the Hamming distance is checked bit by bit.

Work is on distinct fingerprints, so exact copies cost one row. A key's fingerprints are never
expanded into all pairs: a group's task links members to the roots it has so far, splitting
large groups by further blocks, and sends a spanning forest (fewer edges than members). The
components come from rounds of star contraction in Spark, written to the shared folder
after each round.

Edge cases: a null or empty text has no words and fingerprint zero, linked like any other;
fewer words than a shingle are one shingle; repeated rows all come back; a null doc_id comes
back as it is and names no component (null only if all ids of a component are).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm.components import components
from lathe.llm.scratch import small_batches, written
from lathe.llm.tokens import LOWER, SPACES, buffer_of, slices, split

SHINGLE = 4
DISTANCE = 4
_SEED = 42


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all word shingles of lower-cased texts, and each text's first one."""
    buf, offsets = buffer_of(texts)
    words = split(LOWER[buf], offsets, SPACES)
    sizes = words.ends - words.starts
    n = np.diff(words.first)
    # the words of all texts, each followed by one space
    at = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    keep = np.ones(int(at[-1]), dtype=bool)
    keep[at[1:] - 1] = False
    joined = np.full(int(at[-1]), 32, dtype=np.uint8)
    joined[keep] = words.buf[~SPACES[words.buf]]
    per = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    first = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(per, out=first[1:])
    owner = np.repeat(np.arange(len(n)), per)
    lo = words.first[:-1][owner] + np.arange(len(owner)) - first[owner]
    hi = np.minimum(lo + shingle, words.first[1:][owner])
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = [digest(raw[s:e], _SEED) for s, e in zip(at[lo].tolist(), (at[hi] - 1).tolist(), strict=True)]
    return np.array(hashes, dtype=np.uint64), first


def fingerprint_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The fingerprint of each text: bits set in over half of its hashes."""
    n = np.diff(first)
    out = np.zeros(len(n), dtype=np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    counts = np.add.reduceat(bits, first[full], axis=0, dtype=np.int32)
    major = np.packbits(2 * counts > n[full][:, None], axis=1)
    out[full] = np.ascontiguousarray(major).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            fp = fingerprint_bits(*shingle_hashes(piece.column(1), shingle))
            yield pa.record_batch([piece.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    small_batches(documents.sparkSession)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _blocks(count: int) -> list[int]:
    """Bit masks of ``count`` blocks of nearly equal width that cover 64 bits."""
    edges = [64 * i // count for i in range(count + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def _keys(fp: Column, distance: int, agree: int) -> Column:
    """One key for each choice of ``agree`` of the ``distance + agree`` blocks."""
    out = []
    for i, picked in enumerate(combinations(_blocks(distance + agree), agree)):
        mask = sum(picked)
        out.append(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(mask - 2**64 if mask >= 2**63 else mask))))
    return F.array(*out)


def _forest(fp: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Edges that connect the members of one group as all its close pairs would: each member
    in turn reaches those not reached before."""
    a, b = [], []
    rest = np.arange(len(fp))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[at]) <= distance
            hit = rest[near]
            a += [int(at)] * len(hit)
            b += hit.tolist()
            queue += hit.tolist()
            rest = rest[~near]
    return a, b


#: Groups over this size are split into cells of pairs of parts, each part this large at most.
PART = 20_000


def links(prints: DataFrame, distance: int = DISTANCE, agree: int = 3) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``fp`` at ``distance`` or fewer bits.

    ``agree``: blocks that a key takes. More blocks make more keys a fingerprint and fewer
    chance meetings: 64 * agree / (distance + agree) bits must agree.
    """
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"), distance, agree)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes exploded keys by the fingerprints and would broadcast them
    met = keyed.hint("merge").join(sizes, "key")
    parts = F.ceil(F.col("n") / F.lit(PART)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    cells = F.when(parts == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j))
    )
    met = met.select("key", "fp", F.explode(cells).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def edges(groups: list[np.ndarray]) -> pa.RecordBatch:
            a, b = [], []
            for fp in groups:
                i, j = _forest(fp, distance)
                a.append(fp[i].view(np.int64) if i else np.zeros(0, np.int64))
                b.append(fp[j].view(np.int64) if j else np.zeros(0, np.int64))
            none = [np.zeros(0, np.int64)]
            return pa.record_batch([pa.array(np.concatenate(a or none)), pa.array(np.concatenate(b or none))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, cell, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
            groups = np.split(fp, cuts)
            done = []
            if last is not None and last != (key[0], cell[0]):
                done.append(np.concatenate(held))
                held = []
            if len(groups) > 1:
                done.append(np.concatenate([*held, groups[0]]))
                done += groups[1:-1]
                held = []
            held.append(groups[-1].copy())
            last = (key[-1], cell[-1])
            yield edges(done)
        if held:
            yield edges([np.concatenate(held)])

    grouped = met.repartition("key", "cell").sortWithinPartitions("key", "cell", "fp").select("key", "cell", "fp")
    return grouped.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for each row: the
    smallest doc_id reachable over links of ``distance`` or fewer bits."""
    rows = written(fingerprints(documents, doc_id, text, shingle), "prints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(prints, distance))
    member = prints.join(roots, prints.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("low").alias("component_id"))
    found = member.join(named, "root").select("fp", "component_id")
    # a row for each document: ten times its file as a broadcast
    return rows.hint("merge").join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``documents`` (all columns) less near-duplicates: of each component the
    document with the smallest doc_id stays. Of rows with one doc_id the one with the least
    text stays; rows with a null doc_id stay, as nothing names them."""
    found = near_duplicates(documents.where(F.col(doc_id).isNotNull()), doc_id, text, shingle, distance)
    first = written(found.where("doc_id = component_id").select(F.col("doc_id").alias("__first_id")).distinct(), "first")
    # an id for each document that stays: a broadcast is nine times its file
    named = documents.hint("merge").join(first, documents[doc_id].cast("long") == first["__first_id"]).drop("__first_id")
    one = named.withColumn("__nth", F.row_number().over(Window.partitionBy(doc_id).orderBy(text))).where("__nth = 1").drop("__nth")
    return one.unionByName(documents.where(F.col(doc_id).isNull()))
