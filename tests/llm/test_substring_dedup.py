"""Substring deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row

from lathe.llm import substring_dedup as sd

WORDS = __import__("re").compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    docs = [(d, WORDS.findall(t or "")) for d, t in rows]
    key = lambda d: (d is None, d or 0)
    first = {}
    for d, w in docs:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, key(d)), key(d))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key(d):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_words string")
    return sorted([tuple(r) for r in sd.remove_repeats(df, **kw).collect()], key=str)


def corpus(seed, n=60, vocabulary=400):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["é", "of", "of", "the"]
    passages = [[rnd.choice(words) for _ in range(rnd.randint(9, 40))] for _ in range(8)]
    passages += [["buy"] * 20, ["a", "b"] * 12, ["x"] * 13]
    rows = []
    for d in rnd.sample(range(1000), n):
        w = [rnd.choice(words) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(w))
            w[at:at] = rnd.choice(passages)[rnd.randint(0, 3) :]
        rows.append((d, rnd.choice([" ", "\n", "\t ", "  "]).join(w)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(sd, "CHUNK_BYTES", 2000 if seed % 2 else 100_000)
    rows = corpus(seed, vocabulary=400 if seed < 2 else 3)
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    same = " ".join("abcdefghijklmnop")
    rows = [(5, None), (6, ""), (7, same), (7, same), (None, same), (None, same), (9, "  \n "), (3, long), (4, long + " end"), (-2, "one")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_every_window_has_a_shared_start():
    """Two copies of a window in other surroundings agree on one of the first eight starts."""
    rnd = np.random.default_rng(1)
    for trial in range(3000):
        alphabet = rnd.integers(1, 2**63, rnd.integers(1, 6) if trial % 2 else 50).astype(np.uint64)
        core = rnd.choice(alphabet, 13)
        seen = []
        for _ in range(2):
            left, right = rnd.choice(alphabet, rnd.integers(0, 9)), rnd.choice(alphabet, rnd.integers(0, 9))
            names = np.concatenate([left, core, right])
            at, _ = sd.recompress(names, np.array([0, len(names)]))
            seen.append({int(x) - len(left) for x in at} & set(range(8)))
        assert seen[0] & seen[1]
