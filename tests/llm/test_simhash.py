"""SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from lathe.llm import simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def fingerprint(text, k=4):
    w = WORDS.findall((text or "").translate(LOWER))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, distance=4):
    fps = [fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted([(d, f"{fps[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(rows)], key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, fp int, key int")
    return sorted([tuple(r) for r in simhash.near_duplicates(df).collect()], key=str)


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    words = [f"W{i}" for i in range(300)] + ["É", "É"]
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 300))] for _ in range(12)]
    rows = []
    for d in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((1000 - d, rnd.choice([" ", "\n", " \t"]).join(w).upper() if d % 3 else " ".join(w)))
    assert len({r[2] for r in brute(rows)}) < 150
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    long = " ".join(str(i * 7919 % 1000) for i in range(40_000))
    rows = [(1, None), (2, ""), (3, "one"), (4, "One"), (4, "One"), (None, "one"), (None, "lonely words"), (8, long), (9, long + " x"), (-1, " \n")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("part", [3, 20_000])
def test_links_keep_all_components(spark, monkeypatch, part):
    """Chains and clouds of close fingerprints, with groups split into cells."""
    monkeypatch.setattr(simhash, "PART", part)
    rnd = random.Random(part)
    fps = set()
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(40):
            fps.add(x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))))
        for _ in range(10):
            x ^= sum(1 << b for b in rnd.sample(range(64), 4))
            fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = dict(tuple(r) for r in simhash.components(simhash.links(df)).collect())
    label = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
    comp = {}
    for i in range(len(fps)):  # flood fill
        if i in comp:
            continue
        comp[i], queue = i, [i]
        while queue:
            j = queue.pop()
            for k in np.flatnonzero(np.bitwise_count(fps ^ fps[j]) <= 4):
                if int(k) not in comp:
                    comp[int(k)] = i
                    queue.append(int(k))
    pairs = {(label[i], comp[i]) for i in range(len(fps))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def joins(df):
    return re.findall(r"\w+Join\b", df._jdf.queryExecution().executedPlan().toString())


def test_exploded_keys_are_not_broadcast(spark):
    """A file of fingerprints is small beside its keys; Spark's estimate has only the file."""
    rnd = random.Random(5)
    fps = {2 * rnd.getrandbits(62) for _ in range(500)}
    prints = simhash.written(spark.createDataFrame([(x + b,) for x in fps for b in (0, 1)], "fp long"), "prints")
    edges = simhash.links(prints)
    assert {frozenset(e) for e in edges.collect()} == {frozenset((x, x + 1)) for x in fps}
    assert set(joins(edges)) == {"SortMergeJoin"}


def test_rows_of_documents_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i % 40}") for i in range(200)], "doc_id long, text string")
    assert joins(simhash.near_duplicates(docs))[0] == "SortMergeJoin"


def test_ids_that_stay_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i % 40}") for i in range(200)], "doc_id long, text string")
    kept = simhash.keep_one(docs)
    assert set(joins(kept)) == {"SortMergeJoin"}
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in simhash.near_duplicates(docs).collect()})
