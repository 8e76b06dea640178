"""Toxicity by maximum-scoring segments of token log-odds.

Fit, on a bounded sample of labelled rows:

1. Spark counts in how many toxic and clean documents each term stands. Terms are words
   (lower-cased letters and digits) and their leading 4 and 6 bytes, a back-off for words that
   training never saw. A term's score is its log-odds ratio under a Dirichlet prior (a flat
   part and one in proportion to the term's documents of both classes), shrunk towards zero by
   ``Z`` standard errors; terms that reach zero are left out. A token has the highest score
   of its terms, divided by how often the text has had the word (words come in bursts), less
   a drift, so that ordinary text scores below zero.
2. A linear scan (all maximal scoring subsequences) finds a text's passages. Scores of
   passages in clean text have an exponential tail; its rate and frequency, measured on clean
   training rows, turn a passage's score and the text's length into the chance P of such a
   passage in clean text of that length (extreme-value distribution). A document's evidence
   is -ln P of its best passage plus that of its other passages with P <= ``SIGNIFICANT``.
3. A logistic curve maps evidence to a score from 0 to 1. Tail and curve are measured on each
   half of the sample with terms counted on the other half.

The sample's classes are bounded apart, so a large table's sample has another mix of classes
than its rows. A row counts as often in prior and curve as its class stands for training rows
(``weights``, 1 on the average), so the score does not depend on where the bound cuts.

The model that reaches executors has ``MAX_TERMS`` terms at most, whatever the corpus.

Edge cases: a null or empty text has no passages and the score of no evidence; labels that are
null or whose doc_id has no row are not used; a doc_id labelled twice is toxic if one label
says so; without any toxic or any clean training row all scores are the toxic share (0.0 if
there is no label at all); repeated rows are scored alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.scratch import small_batches, written
from lathe.llm.tokens import LOWER, NON_WORD, Texts, _poly, buffer_of, mixed, slices, split

#: Bound of the training sample: rows of each class, chosen by a hash of doc_id.
SAMPLE_ROWS = 20_000
#: Bound of the model.
MAX_TERMS = 200_000
PREFIXES = (4, 6)
Z = 2.0
FLAT, INFORMED = 0.1, 0.015
DRIFT = 1.0
SIGNIFICANT = 0.05
THRESHOLD = 0.7


@dataclass
class Terms:
    """Term names (sorted) and scores."""

    names: np.ndarray
    scores: np.ndarray

    def of(self, names: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.full(len(names), -np.inf)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, self.scores[at], -np.inf)


@dataclass
class Model:
    """What scoring needs; the same bytes on each executor."""

    terms: Terms
    rate: float
    often: float
    slope: float
    level: float

    def evidence(self, n_words: int, passages: list[float]) -> float:
        return evidence(n_words, passages, self.rate, self.often)

    def score(self, x: float) -> float:
        return 1 / (1 + math.exp(-(self.slope * math.log1p(x) + self.level)))


def term_names(words: Texts) -> list[np.ndarray]:
    """Names of each word's terms: itself and its leading bytes."""
    out = [words.names()]
    for k, size in enumerate(PREFIXES):
        cut = mixed(_poly(words.buf, words.starts, np.minimum(words.starts + size, words.ends), 1) + np.uint64(k + 1))
        out.append(np.where(words.ends - words.starts > size, cut, out[0]))
    return out


def _words(texts: pa.Array) -> Texts:
    buf, offsets = buffer_of(texts)
    return split(LOWER[buf], offsets, NON_WORD)


def token_scores(words: Texts, terms: Terms) -> np.ndarray:
    best = np.full(len(words.starts), -np.inf)
    every = term_names(words)
    for names in every:
        np.maximum(best, terms.of(names), out=best)
    best[~np.isfinite(best)] = 0.0
    at = np.flatnonzero(best > DRIFT)
    if len(at):
        owner = np.searchsorted(words.first, at, side="right")
        order = np.lexsort((at, every[0][at], owner))
        own, name = owner[order], every[0][at][order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (name[1:] != name[:-1])
        since = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        best[at[order]] /= 1 + since
    return best - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences (start, end, score), in linear time.

    Runs without a positive token are stepped over as one negative sum.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    out: list[list[float]] = []  # start, end, sum before, sum after, index of the last with a smaller sum before
    for i, before, after in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        new = [i, i + 1, before, after, -1]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = int(out[j][4])
            if j < 0 or out[j][3] >= new[3]:
                new[4] = j
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3], -1]
            del out[j:]
    return [(int(a), int(b), hi - lo) for a, b, lo, hi, _ in out]


def evidence(n_words: int, passages: list[float], rate: float, often: float) -> float:
    """-ln P of the best passage and of all others with P <= SIGNIFICANT."""
    if not passages:
        return 0.0
    found = []
    for s in passages:
        e = often * max(n_words, 1) * math.exp(-rate * s)
        found.append(-math.log(-math.expm1(-e)) if e > 1e-300 else rate * s - math.log(often * max(n_words, 1)))
    found.sort(reverse=True)
    return found[0] + sum(x for x in found[1:] if x >= -math.log(SIGNIFICANT))


def passages(texts: pa.Array, terms: Terms) -> list[tuple[int, list[tuple[int, int, float]]]]:
    """Word count and passages of each text."""
    words = _words(texts)
    scores, out = token_scores(words, terms), []
    positive = np.concatenate([[0], np.cumsum(scores > 0)])
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        out.append((hi - lo, segments(scores[lo:hi]) if positive[hi] > positive[lo] else []))
    return out


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id's text, modulo ``folds``, is ``fold`` (null: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _terms(counts: pa.Table, side: str, docs: dict[str, tuple[int, int]], weights: tuple[float, float]) -> Terms:
    """Scores from counts of the other half (``side`` a or b) or of all (empty side);
    ``weights``: of a toxic and a clean row."""
    a = counts.column(f"toxic{side}").to_numpy().astype(float)
    b = counts.column(f"clean{side}").to_numpy().astype(float)
    n_a, n_b = docs[side]
    w_a, w_b = weights
    prior, whole = FLAT + INFORMED * (w_a * a + w_b * b), INFORMED * (w_a * n_a + w_b * n_b)
    odds = np.log((a + prior) / (n_a + whole)) - np.log((b + prior) / (n_b + whole))
    error = np.sqrt(1 / (a + prior) + 1 / (b + prior))
    shrunk = np.where(odds > 0, np.maximum(odds - Z * error, 0), np.minimum(odds + Z * error, 0))
    keep = np.flatnonzero(shrunk)
    if len(keep) > MAX_TERMS:
        keep = keep[np.argsort(-np.abs(shrunk[keep]), kind="stable")[:MAX_TERMS]]
    names = counts.column("name").to_numpy().view(np.uint64)[keep]
    order = np.argsort(names)
    return Terms(names[order], shrunk[keep][order])


def _sample(documents: DataFrame, labels: DataFrame, train: Column, rows: int) -> tuple[DataFrame, dict[int, float]]:
    """At most about ``rows`` training rows of each class (text, toxic, half: 0 or 1), and the
    share of each class that they are."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(train)
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    cut = {y: max(1, int(min(1.0, rows / n) * 1_000_000)) for y, n in sizes.items()}
    spot = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    limit = F.when(F.col("toxic") == 1, F.lit(cut.get(1, 1_000_000))).otherwise(cut.get(0, 1_000_000))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    picked = known.where(spot < limit).select("doc_id", "toxic", half.alias("half"))
    # about 2 * rows ids: small enough to broadcast, so texts are not shuffled
    sample = documents.join(F.broadcast(picked), "doc_id").select("text", "toxic", "half")
    return sample, {y: n / 1_000_000 for y, n in cut.items()}


def fit(documents: DataFrame, labels: DataFrame, train: Column | None = None, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic: 0 or 1).

    ``train``: which doc_ids may be used (default: all but the held-out third).
    """
    small_batches(documents.sparkSession)
    train = ~held_out(F.col("doc_id")) if train is None else train
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    sample, share = _sample(documents, labels, train, rows)
    sample = written(sample, "sample")
    n = {(r.toxic, r.half): r.n for r in sample.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (n.get((y, 0), 0) + n.get((y, 1), 0) for y in (1, 0))
    if not toxic or not clean:
        share = toxic / (toxic + clean) if toxic + clean else 0.0
        level = math.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -800.0 + 100)
        return Model(Terms(np.zeros(0, np.uint64), np.zeros(0)), 1.0, 1.0, 0.0, level)
    mean = (toxic / share[1] + clean / share[0]) / (toxic + clean)
    weights = (1 / share[1] / mean, 1 / share[0] / mean)
    # counted on a half, to score the other
    docs = {"": (toxic, clean), "_0": (n.get((1, 0), 0), n.get((0, 0), 0)), "_1": (n.get((1, 1), 0), n.get((0, 1), 0))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            words = _words(piece.column(0))
            owner = words.owner
            group = 2 * piece.column(1).to_numpy() + piece.column(2).to_numpy()
            name = np.concatenate(term_names(words))
            who = np.concatenate([owner] * (1 + len(PREFIXES)))
            order = np.lexsort((who, name))
            name, who = name[order], who[order]
            once = np.ones(len(name), dtype=bool)
            once[1:] = (name[1:] != name[:-1]) | (who[1:] != who[:-1])
            name, kind = name[once], group[who[once]]
            distinct, place = np.unique(name, return_inverse=True)
            cols = [np.bincount(place[kind == k], minlength=len(distinct)).astype(np.int64) for k in (2, 0, 3, 1)]
            yield pa.record_batch([pa.array(distinct.view(np.int64)), *map(pa.array, cols)], names=["name", "toxic_0", "clean_0", "toxic_1", "clean_1"])

    parts = ("toxic_0", "clean_0", "toxic_1", "clean_1")
    counts = sample.mapInArrow(count, "name long, " + ", ".join(f"{c} long" for c in parts))
    counts = counts.groupBy("name").agg(*[F.sum(c).alias(c) for c in parts])
    counts = counts.withColumns({"toxic": F.expr("toxic_0 + toxic_1"), "clean": F.expr("clean_0 + clean_1")})
    # the same shrinkage as in _terms: only terms that can pass it for all rows or a half are of use
    telling = F.lit(False)
    for side, (n_a, n_b) in docs.items():
        a, b = F.col(f"toxic{side}"), F.col(f"clean{side}")
        w_a, w_b = weights
        prior, whole = F.lit(FLAT) + F.lit(INFORMED) * (F.lit(w_a) * a + F.lit(w_b) * b), INFORMED * (w_a * n_a + w_b * n_b)
        odds = F.log((a + prior) / F.lit(n_a + whole)) - F.log((b + prior) / F.lit(n_b + whole))
        telling = telling | (F.abs(odds) > F.lit(Z) * F.sqrt(1 / (a + prior) + 1 / (b + prior)))
    weight = F.abs(F.log((F.col("toxic") + 1) / F.lit(toxic + 2)) - F.log((F.col("clean") + 1) / F.lit(clean + 2)))
    table = counts.where(telling).orderBy(weight.desc(), "name").limit(MAX_TERMS).toArrow().combine_chunks()
    halves = [_terms(table, "_1", docs, weights), _terms(table, "_0", docs, weights)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            half = piece.column(2).to_numpy()
            found = [passages(piece.column(0), t) for t in halves]
            picked = [found[h][i] for i, h in enumerate(half.tolist())]
            yield pa.record_batch([piece.column(1), pa.array([n for n, _ in picked], pa.int64()), pa.array([[s for *_, s in p] for _, p in picked], pa.list_(pa.float64()))], names=["toxic", "n_words", "found"])

    seen = sample.mapInArrow(measure, "toxic int, n_words long, found array<double>").toArrow()
    toxic_flags, sizes, found = (seen.column(c).to_pylist() for c in ("toxic", "n_words", "found"))
    rate, often = _tail([s for y, p in zip(toxic_flags, found, strict=True) if not y for s in p], sum(n for y, n in zip(toxic_flags, sizes, strict=True) if not y))
    x = np.log1p([evidence(n, p, rate, often) for n, p in zip(sizes, found, strict=True)])
    y = np.array(toxic_flags, dtype=float)
    slope, level = _logistic(x, y, np.where(y > 0, *weights))
    return Model(_terms(table, "", docs, weights), rate, often, slope, level)


def _tail(scores: list[float], n_words: int) -> tuple[float, float]:
    """Rate of the exponential tail of clean passages' scores, and their number a word
    extrapolated to score zero. The upper half of the scores is the tail; one made-up
    passage of a word's size keeps both finite."""
    scores = sorted(scores)
    base = scores[len(scores) // 2] if scores else 0.0
    above = [s - base for s in scores if s > base] + [1.0]
    rate = len(above) / sum(above)
    often = len(above) * math.exp(min(rate * base, 50.0)) / max(n_words, 1)
    return rate, often


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and level of weighted rows, by Newton steps with a small ridge on
    the slope."""
    w = np.zeros(2)
    rows = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        ridge = np.array([0.05, 1e-3])
        slope = rows.T @ (weights * (p - y)) + ridge * w
        bend = (rows * (weights * p * (1 - p))[:, None]).T @ rows + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def score(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``passages`` (array of start word, end word, score;
    those with P <= SIGNIFICANT) for each row."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sent = documents.sparkSession.sparkContext.broadcast(model)  # at most MAX_TERMS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for piece in slices(batches, "text"):
            scores, spans = [], []
            for n, found in passages(piece.column(1), own.terms):
                scores.append(own.score(own.evidence(n, [s for *_, s in found])))
                spans.append([{"start": a, "end": b, "score": s} for a, b, s in found if own.evidence(n, [s]) >= -math.log(SIGNIFICANT)])
            yield pa.record_batch([piece.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "passages"])

    return rows.mapInArrow(run, "doc_id long, score double, passages array<struct<start: long, end: long, score: double>>")


def without_toxic(documents: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``documents`` (all columns) whose text scores less than ``threshold``."""
    small_batches(documents.sparkSession)
    position = documents.columns.index(text)
    sent = documents.sparkSession.sparkContext.broadcast(model)  # at most MAX_TERMS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for piece in slices(batches, text):
            found = passages(piece.column(position).cast(pa.string()), own.terms)
            keep = [own.score(own.evidence(n, [s for *_, s in p])) < threshold for n, p in found]
            yield piece.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
