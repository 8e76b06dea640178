"""Toxicity: passages against brute force, held-out accuracy, edge cases."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lathe.llm import toxicity as tx


def best_segments(scores, offset=0):
    """Maximal scoring subsequences by definition: the best one, then both sides."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 0 and (best is None or s > best[2] or s == best[2] and j - i < best[1] - best[0]):
                best = (i, j, s)
    if not best:
        return []
    i, j, s = best
    return [*best_segments(scores[:i], offset), (i + offset, j + offset, s), *best_segments(scores[j:], offset + j)]


def test_segments_match_definition():
    rnd = random.Random(1)
    for _ in range(400):
        scores = [float(rnd.choice([-3, -2, -1, 1, 2, 4])) + rnd.random() * 1e-3 for _ in range(rnd.randint(0, 14))]
        got = tx.segments(np.array(scores))
        want = best_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def corpus(n=700, seed=2):
    rnd = random.Random(seed)
    common = [a + b for a in "bdfglmnprst" for b in ("aro", "eni", "olu", "umak")]
    bad = ["zorgo", "vekki", "snarf"] + [f"plorp{x}" for x in "abcdefghij"]
    docs, labels = [], []
    for d in range(n):
        toxic = rnd.random() < 0.2
        w = [rnd.choice(common) for _ in range(rnd.randint(5, 300))]
        for _ in range(rnd.randint(2, 5) if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad).upper() + "!")
        docs.append((d, " ".join(w), "en", 0.5))
        labels.append((d, int(toxic)))
    return docs, labels


SCHEMA = "doc_id long, text string, toxic string, score double"


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    # the labels of the held-out third lie: using them would show
    lied = [(d, 1 - y if zlib.crc32(str(d).encode()) % 3 == 1 else y) for d, y in labels]
    df = spark.createDataFrame(docs, SCHEMA)
    model = tx.fit(df, spark.createDataFrame(lied, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in tx.score(df, model).collect()}
    held = [(d, y) for d, y in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    right = sum((got[d].score >= tx.THRESHOLD) == bool(y) for d, y in held)
    assert right >= 0.97 * len(held)
    texts = {d: t.split() for d, t, *_ in docs}
    spans = [texts[d][s.start : s.end] for d, y in held if y for s in got[d].passages]
    assert spans and sum(any("!" in w for w in x) for x in spans) >= 0.9 * len(spans)
    flags = {r[0]: r[1] for r in df.select("doc_id", tx.held_out(F.col("doc_id"))).collect()}
    assert flags == {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in flags}


def test_edge_cases(spark):
    docs, labels = corpus(200)
    long = "zorgo vekki " + " ".join(f"w{i}" for i in range(40_000))
    odd = [(1000, None, None, None), (1001, "", "", 0.0), (None, "zorgo snarf vekki", "x", 1.0), (1002, "?! ...", "x", 1.0), (3, docs[3][1], "again", 2.0), (1003, long, "x", 0.0)]
    more = [(None, 1), (1000, None), (5, None), (99999, 1), (7, 1), (7, 0), (1001, 0)]
    df = spark.createDataFrame(docs + odd, SCHEMA)
    model = tx.fit(df, spark.createDataFrame(labels + more, "doc_id long, toxic int"))
    got = tx.score(df, model).collect()
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[1000] == by[1001] == by[1002] and by[1000][0] < tx.THRESHOLD
    assert by[3][0] == by[3][1]
    assert tx.score(df.limit(0), model).collect() == []


def test_one_class_or_none(spark):
    df = spark.createDataFrame([(2, "a b", "x", 1.0)], SCHEMA)
    for labels, want in (([], 0.0), ([(2, 0), (3, 0)], 0.0), ([(2, 1)], 1.0)):
        model = tx.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
        assert abs(tx.score(df, model).first().score - want) < 1e-6


def test_bounded_classes_keep_their_weight(spark):
    docs, labels = corpus(1200, 9)
    rnd = random.Random(3)
    # labels that the text can't tell, so that the curve's level shows in the scores
    noisy = [(d, int(rnd.random() < (0.8 if y else 0.05))) for d, y in labels]
    df, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(noisy, "doc_id long, toxic int")
    share = sum(y for _, y in noisy) / len(noisy)
    means = []
    for rows in (tx.SAMPLE_ROWS, 200):
        model = tx.fit(df, known, F.lit(True), rows=rows)
        means.append(np.mean([r.score for r in tx.score(df, model).collect()]))
    assert abs(means[0] - share) < 0.02 and abs(means[1] - share) < 0.05
