"""Phrase collocations by direct-address tiling of frequency-ranked ids.

Phrases are counted level by level: words, pairs of words, pairs of frequent pairs that overlap
(three words), and so on. Each level works alike:

1. Texts are cut into chunks of one language and ``CHUNK_BYTES``. A chunk counts its own keys (words, then
   pairs of ids) and sends every key once, with its count, to the key's bucket: whatever is
   frequent is combined before the shuffle, so no key is heavier than the number of chunks.
2. A bucket adds up the counts, keeps keys of ``min_count`` or more, ranks them by frequency
   and numbers them ``rank * buckets + bucket``: ids are unique in a language, and small ids are
   frequent. It answers each chunk with the ids of the keys that chunk holds.
3. The chunk replaces keys by ids and pairs neighbours. Pairs of ids fall into tiles of ``TILE``
   by ``TILE`` ids; tiles that hold many of the chunk's pairs are counted in a dense array by
   ``numpy.bincount`` at the pair's own address, all others as sorted coordinates.

A phrase can only be frequent if both overlapping parts are, so no level loses one. Buckets
follow the bytes of the texts; a task holds one chunk or one bucket. All steps are exact.

Edge cases: a null language is ``und``, a null text is empty and holds no words; texts of any
length stay whole (phrases cross no text); repeated rows count again; no frequent phrase or no
rows: an empty result. Only the language and the text are read, so that other columns may have
any name.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm import tokens
from lathe.llm.scratch import small_batches, written

MIN_COUNT = 30
LONGEST = 4
#: Per cent of a phrase's places that a longer one must share to replace it.
NESTED = 80
TOP = 2000
UNKNOWN = "und"

#: Bytes of text of a chunk, and of text a bucket (of keys).
CHUNK_BYTES = 4_000_000
BUCKET_BYTES = 8_000_000
#: Ids of a tile's side, tiles of a side that may be dense, and pairs that make a tile dense.
TILE = 512
HEAD = 64
DENSE = TILE * TILE // 8

_PIECES = tokens.separators((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
_BREAKS = _PIECES | tokens.separators((0x20, 0x20), (0x09, 0x09))

_SENT = "lang string, chunk long, bucket long, start int, seq binary, counts binary, words array<string>, left binary, right binary"
_SENT_ARROW = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("bucket", pa.int64()), ("start", pa.int32()), ("seq", pa.binary()),
                         ("counts", pa.binary()), ("words", pa.list_(pa.string())), ("left", pa.binary()), ("right", pa.binary())])
_ANSWER = "lang string, chunk long, at binary, ids binary, id array<long>, n array<long>, words array<string>, left array<long>, right array<long>, total long"
_ANSWER_ARROW = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("at", pa.binary()), ("ids", pa.binary()), ("id", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())),
                           ("words", pa.list_(pa.string())), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())), ("total", pa.int64())])


# --- texts to words -------------------------------------------------------------------------


def _cuts(buf: np.ndarray) -> list[int]:
    """Where a long text is cut: after a separator, every ``SLICE_BYTES`` or more."""
    out = [0]
    while len(buf) - out[-1] > tokens.SLICE_BYTES:
        at = out[-1] + tokens.SLICE_BYTES
        while at < len(buf) and not _BREAKS[buf[at - 1]]:
            near = np.flatnonzero(_BREAKS[buf[at : at + 65_536]])
            at = min(at + (int(near[0]) + 1 if len(near) else 65_536), len(buf))
        out.append(at)
    return out if out[-1] == len(buf) else [*out, len(buf)]


def words(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Lower-cased words of a slice of texts, and flags of those that start a new piece."""
    buf, offsets = tokens.buffer_of(column)
    pieces = [(buf, offsets)]
    if len(column) == 1 and len(buf) > 2 * tokens.SLICE_BYTES:
        cuts = _cuts(buf)
        pieces = [(buf[a:b], np.array([0, b - a])) for a, b in itertools.pairwise(cuts)]
    broken = True
    for part, ends in pieces:
        part = tokens.LOWER[part]
        found = tokens.split(part, ends, _BREAKS)
        marks = np.cumsum(_PIECES[part]) if len(part) else np.zeros(0, np.int64)
        if not len(found.starts):
            broken |= bool(len(marks) and marks[-1])
            continue
        seen = marks[found.starts]
        owner = found.owner
        new = np.empty(len(seen), bool)
        new[0] = broken or seen[0] > 0
        new[1:] = (seen[1:] != seen[:-1]) | (owner[1:] != owner[:-1])
        broken = bool(marks[-1] > seen[-1])
        places = np.concatenate([[0], np.cumsum(found.ends - found.starts)])
        yield pa.LargeStringArray.from_buffers(len(seen), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(part[~_BREAKS[part]])), new


def _sequence(local: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Keys in order, -1 ahead of every piece."""
    out = np.full(len(local) + int(new.sum()), -1, np.int32)
    out[np.arange(len(local)) + np.cumsum(new)] = local
    return out


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of keys by bucket, and where each bucket starts."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _renumbered(seq: np.ndarray, order: np.ndarray) -> np.ndarray:
    place = np.full(len(order) + 1, -1, np.int32)  # -1 stays -1
    place[order] = np.arange(len(order), dtype=np.int32)
    return place[seq]


def _word_rows(lang: str, chunk: int, parts: list[tuple[pa.Array, np.ndarray]], buckets: int) -> list[dict]:
    """What a chunk sends at the first level, and its own sequence."""
    coded = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
    local = coded.indices.to_numpy()
    seq = _sequence(local, np.concatenate([new for _, new in parts]))
    counts = np.bincount(local, minlength=len(coded.dictionary)).astype("<i4")
    buf, offsets = tokens.buffer_of(coded.dictionary)
    names = tokens.Texts(buf, offsets[:-1], offsets[1:], offsets[:0]).names()
    order, starts = _by_bucket((names % np.uint64(buckets)).astype(np.int64), buckets)
    spelled, counts = coded.dictionary.take(pa.array(order)).cast(pa.string()), counts[order]
    rows = [{"lang": lang, "chunk": chunk, "seq": _renumbered(seq, order).astype("<i4").tobytes()}]
    for bucket in np.flatnonzero(np.diff(starts)).tolist():
        a, b = int(starts[bucket]), int(starts[bucket + 1])
        rows.append({"lang": lang, "chunk": chunk, "bucket": bucket, "start": a, "counts": counts[a:b].tobytes(), "words": spelled.slice(a, b - a)})
    return rows


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    columns = []
    for field in schema:
        values = [r.get(field.name) for r in rows]
        if pa.types.is_list(field.type):  # without a Python object for each entry
            sizes = [0 if v is None else len(v) for v in values]
            parts = [v if isinstance(v, pa.Array) else pa.array(v, field.type.value_type) for v in values if v is not None]
            flat = pa.concat_arrays(parts) if parts else pa.array([], field.type.value_type)
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat))
        else:
            columns.append(pa.array(values, field.type))
    return pa.Table.from_arrays(columns, schema=schema)


def _chunks(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        size: dict[str, int] = {}
        done = TaskContext.get().partitionId() << 32

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal done
            parts = held.pop(lang)
            del size[lang]
            yield from _table(_word_rows(lang, done, parts, buckets), _SENT_ARROW).to_batches()
            done += 1

        for batch in tokens.slices(batches, "text"):
            langs = batch.column(batch.schema.get_field_index("lang"))
            column = batch.column(batch.schema.get_field_index("text"))
            for lang in langs.unique().to_pylist():
                for part, new in words(column.filter(pc.equal(langs, lang))):
                    held.setdefault(lang, []).append((part, new))
                    size[lang] = size.get(lang, 0) + part.buffers()[2].size
                if size.get(lang, 0) >= CHUNK_BYTES:
                    yield from flush(lang)
                if sum(size.values()) >= 2 * CHUNK_BYTES:  # many languages
                    yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)

    return run


# --- pairs of ids -----------------------------------------------------------------------------


def _codes(left: np.ndarray, right: np.ndarray, ids: int) -> np.ndarray:
    """One integer for each pair, in order of the pairs; ``ids`` bounds all of them."""
    if ids < 2**31:
        return left * ids + right
    left, right = (np.unique(x, return_inverse=True) for x in (left, right))
    return left[1] * len(right[0]) + right[1]


def count_pairs(left: np.ndarray, right: np.ndarray, ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (left, right), their counts, and the number of each given pair."""
    inside = (left < TILE * HEAD) & (right < TILE * HEAD)
    tile = np.where(inside, left // TILE * HEAD + right // TILE, HEAD * HEAD)
    held = np.bincount(tile, minlength=HEAD * HEAD + 1)
    dense = np.flatnonzero(held[:-1] >= DENSE)
    order = np.argsort(tile.astype(np.int16), kind="stable") if len(dense) else np.zeros(0, np.int64)
    ends = np.cumsum(held)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    local, rest, known = np.empty(len(left), np.int32), np.ones(len(left), bool), 0
    for t in dense.tolist():
        own = order[ends[t] - held[t] : ends[t]]
        rest[own] = False
        cell = left[own] % TILE * TILE + right[own] % TILE
        counts = np.bincount(cell, minlength=TILE * TILE)
        used = np.flatnonzero(counts)
        number = np.empty(TILE * TILE, np.int32)
        number[used] = np.arange(known, known + len(used))
        local[own] = number[cell]
        known += len(used)
        found.append((t // HEAD * TILE + used // TILE, t % HEAD * TILE + used % TILE, counts[used]))
    own = np.flatnonzero(rest)
    if len(own):
        _, first, inverse, counts = np.unique(_codes(left[own], right[own], ids), return_index=True, return_inverse=True, return_counts=True)
        local[own] = known + inverse
        found.append((left[own][first], right[own][first], counts))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return (*(np.concatenate(c) for c in zip(*found, strict=True)), local)


def _pair_rows(lang: str, chunk: int, symbols: np.ndarray, buckets: int, ids: int, dtype: str, last: bool) -> list[dict]:
    """What a chunk sends at a further level, and its own sequence."""
    at = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
    left, right, counts, local = count_pairs(symbols[at], symbols[at + 1], ids)
    order, starts = _by_bucket((left * 40_503 + right) % buckets, buckets)
    left, right, counts = left[order].astype(dtype), right[order].astype(dtype), counts[order].astype("<i4")
    rows = []
    if not last:
        seq = np.full(len(symbols), -1, np.int32)
        seq[at] = local
        rows.append({"lang": lang, "chunk": chunk, "seq": _renumbered(seq, order).astype("<i4").tobytes()})
    for bucket in np.flatnonzero(np.diff(starts)).tolist():
        a, b = int(starts[bucket]), int(starts[bucket + 1])
        rows.append({"lang": lang, "chunk": chunk, "bucket": bucket, "start": a, "counts": counts[a:b].tobytes(), "left": left[a:b].tobytes(), "right": right[a:b].tobytes()})
    return rows


def _paired(buckets: int, ids: int, dtype: str, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        tokens.release()
        if not own.num_rows:
            return _table([], _SENT_ARROW)
        seq = np.frombuffer(own.column("seq")[0].as_buffer(), "<i4")
        symbols = np.full(int(seq.max(initial=-1)) + 2, -1, np.int64)  # the last one is that of -1
        for at, known in zip(answers.column("at"), answers.column("ids"), strict=True):
            symbols[np.frombuffer(at.as_buffer(), "<i4")] = np.frombuffer(known.as_buffer(), "<i8")
        return _table(_pair_rows(own.column("lang")[0].as_py(), own.column("chunk")[0].as_py(), symbols[seq], buckets, ids, dtype, last), _SENT_ARROW)

    return run


# --- buckets ----------------------------------------------------------------------------------


def _joined(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(v.as_buffer(), dtype) for v in column]).astype(np.int64)


def _ranked(buckets: int, ids: int, dtype: str, min_count: int, answer: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """Add up a bucket's keys, number the frequent ones, answer the chunks."""

    def run(key: tuple, sent: pa.Table) -> pa.Table:
        lang, bucket = key[0].as_py(), key[1].as_py()
        counts = _joined(sent.column("counts"), "<i4")
        by_word = not ids
        if by_word:
            flat = pa.concat_arrays([c.flatten() for c in sent.column("words").chunks]).cast(pa.large_string())
            coded = flat.dictionary_encode()
            local, held = coded.indices.to_numpy(), len(coded.dictionary)
        else:
            left, right = (_joined(sent.column(c), dtype) for c in ("left", "right"))
            _, first, local = np.unique(_codes(left, right, ids), return_index=True, return_inverse=True)
            held = len(first)
        n = np.zeros(held, np.int64)
        np.add.at(n, local, counts)
        often = np.flatnonzero(n >= min_count)
        if by_word:
            spelled = coded.dictionary.take(pa.array(often)).cast(pa.string())
            order = np.lexsort((pc.rank(spelled).to_numpy(), -n[often])) if len(often) else often
            spelled = spelled.take(pa.array(order))
        else:
            order = np.lexsort((often, -n[often]))  # keys are in order
        often = often[order]
        number = np.full(held, -1, np.int64)
        number[often] = np.arange(len(often)) * buckets + bucket
        frequent = {"lang": lang, "id": number[often], "n": n[often], "total": int(counts.sum())}
        frequent |= {"words": spelled} if by_word else {"left": left[first[often]], "right": right[first[often]]}
        rows, at = [frequent], 0
        if answer:
            known = number[local]
            for chunk, start, size in zip(sent.column("chunk").to_pylist(), sent.column("start").to_pylist(), sent.column("counts"), strict=True):
                size = len(size.as_buffer()) // 4
                mine = known[at : at + size]
                some = np.flatnonzero(mine >= 0)
                at += size
                if len(some):
                    rows.append({"lang": lang, "chunk": chunk, "at": (some + start).astype("<i4").tobytes(), "ids": mine[some].astype("<i8").tobytes()})
        tokens.release()
        return _table(rows, _ANSWER_ARROW)

    return run


# --- the levels -------------------------------------------------------------------------------


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Per number of words the frequent phrases: ``lang``, ``id``, ``n``, and ``word`` (one) or
    ``left`` and ``right`` (ids of both parts one word shorter); and ``lang``, ``n`` of all words."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    sent = written(texts.mapInArrow(_chunks(buckets), _SENT), "words", compression="zstd")
    levels: list[DataFrame] = []
    ids, dtype = 0, "<i4"
    for level in range(1, longest + 1):
        last = level == longest
        found = sent.where(F.col("bucket").isNotNull()).select("lang", "bucket", "chunk", "start", "counts", *(["words"] if level == 1 else ["left", "right"]))
        found = found.groupBy("lang", "bucket").applyInArrow(_ranked(buckets, ids, dtype, min_count, not last), _ANSWER)
        found = written(found, f"found{level}", compression="zstd")
        whole = found.where(F.col("chunk").isNull())
        if level == 1:
            total = whole.groupBy("lang").agg(F.sum("total").alias("n"))
            levels.append(whole.select("lang", F.inline(F.arrays_zip("id", "words", "n"))).toDF("lang", "id", "word", "n"))
        else:
            levels.append(whole.select("lang", F.inline(F.arrays_zip("id", "left", "right", "n"))).toDF("lang", "id", "left", "right", "n"))
        if last:
            break
        ids = 1 + (whole.agg(F.max(F.array_max("id"))).first()[0] or 0)
        dtype = "<i4" if ids < 2**31 else "<i8"
        own = sent.where(F.col("seq").isNotNull()).select("chunk", "lang", "seq").groupBy("chunk")
        answers = found.where(F.col("chunk").isNotNull()).select("chunk", "at", "ids").groupBy("chunk")
        sent = written(own.cogroup(answers).applyInArrow(_paired(buckets, ids, dtype, level + 1 == longest), _SENT), f"pairs{level + 1}", compression="zstd")
    return levels, total


# --- scores -----------------------------------------------------------------------------------


def _long(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def described(levels: list[DataFrame]) -> list[DataFrame]:
    """Each level's phrases: ``phrase``, ``a``, counts of all its beginnings (``head``) and ends
    (``tail``) by length, its last ``word``, and the ``(words, id)`` of all parts of two or more."""
    one = levels[0].select("lang", "id", F.col("word").alias("phrase"), "word", F.col("n").alias("a"), F.array("n").alias("head"), F.array("n").alias("tail"),
                           F.expr("cast(array() as array<struct<size:int,id:bigint>>)").alias("parts"))
    out = [one]
    for size, level in enumerate(levels[1:], 2):
        left, right = (out[-1].select(F.col("lang"), F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
                       for side, columns in (("left", ("phrase", "head", "parts")), ("right", ("word", "tail", "parts"))))
        own = [F.struct(F.lit(size - 1).alias("size"), F.col(side).alias("id")) for side in ("left", "right")] if size > 2 else []
        parts = F.array_union("left_parts", "right_parts")
        joined = level.join(left, ["lang", "left"]).join(right, ["lang", "right"]).select(
            "lang", "id", F.concat_ws(" ", "left_phrase", "right_word").alias("phrase"), F.col("right_word").alias("word"), F.col("n").alias("a"),
            F.concat("left_head", F.array("n")).alias("head"), F.concat("right_tail", F.array("n")).alias("tail"),
            (F.array_union(parts, F.array(*own)) if own else parts).alias("parts"),
        )
        out.append(written(joined, f"phrases{size}", compression="zstd"))
    return out


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST, nested: int = NESTED, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of two to ``longest`` words of each language: ``lang``, ``rank``,
    ``phrase``, ``a`` (places), ``l``, ``r`` (places of both parts at the lowest-scoring cut),
    ``n`` (words of the language), ``score`` (``2,000,000 a / (l + r)``, floored)."""
    levels, total = frequent_phrases(docs, lang, text, min_count, longest)
    whole = described(levels)[1:]
    scored = None
    for size, level in enumerate(whole, 2):
        level = level.withColumn("size", F.lit(size))
        scored = level if scored is None else scored.unionByName(level)
    inside = scored.select("lang", F.explode("parts").alias("p"), "a").groupBy("lang", F.col("p.size").alias("size"), F.col("p.id").alias("id")).agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "size", "id"], "left").where(F.col("longer").isNull() | (F.lit(100) * _long("longer") < F.lit(nested) * _long("a")))
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = kept.select("lang", "phrase", "a", "head", "tail", "size", cut).select(
        "lang", "phrase", "a", "k", F.element_at("head", F.col("k")).alias("l"), F.element_at("tail", F.col("size") - F.col("k")).alias("r"))
    score = F.expr("cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    first = best.withColumn("rank", rank).where(F.col("rank") <= top)
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def phrases_sql(min_count: int = MIN_COUNT, nested: int = NESTED, top: int = TOP) -> str:
    """The same over the table ``documents``, by all runs of one to four words."""
    return f"""
WITH lowered AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, unnest(list_transform(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]'), lambda p: regexp_extract_all(p, '[^ \\x09]+'))) AS w FROM lowered
), sizes AS (SELECT unnest([1, 2, 3, 4]) AS m),
grams AS (
  SELECT lang, m, array_to_string(g, ' ') AS phrase, count(*) AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, CAST(len(w) AS BIGINT) - m + 2), lambda i: list_slice(w, i, i + m - 1))) AS g FROM pieces, sizes
  ) GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE m = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE f >= {min_count}),
parts AS (
  SELECT lang, array_to_string(list_slice(w, i, i + p - 1), ' ') AS part, max(f) AS longer
  FROM often, (SELECT unnest([2, 3]) AS p), (SELECT unnest([1, 2, 3]) AS i) WHERE m > p AND i + p - 1 <= m GROUP BY ALL
), kept AS (
  SELECT o.* FROM often o LEFT JOIN parts x ON x.lang = o.lang AND x.part = o.phrase
  WHERE o.m > 1 AND (x.longer IS NULL OR 100 * x.longer::HUGEINT < {nested} * o.f::HUGEINT)
), cuts AS (
  SELECT o.lang, o.phrase, o.f AS a, k, l.f AS l, r.f AS r, (2000000 * o.f::HUGEINT) // (l.f + r.f) AS score
  FROM kept o, (SELECT unnest([1, 2, 3]) AS k), often l, often r
  WHERE k < o.m AND l.lang = o.lang AND r.lang = o.lang
    AND l.phrase = array_to_string(list_slice(o.w, 1, k), ' ') AND r.phrase = array_to_string(list_slice(o.w, k + 1, o.m), ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {top}
"""
