"""Decontamination against all windows by a plain edit distance."""

import random
import re

import numpy as np

from lathe.llm import decontaminate as dc

WORDS = re.compile(r"[^\W_]+")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, items, edits=dc.EDITS):
    out = []
    for d, t in docs:
        w = WORDS.findall((t or "").lower())
        for i, x in items:
            q = WORDS.findall((x or "").lower())
            m = len(q)
            near = [(distance(w[p : p + m], q), p) for p in range(len(w) - m + 1)] if m else []
            if near and min(near)[0] <= int(edits * m):
                out.append((d, i, min(near)[1], m, min(near)[0]))
    return sorted(out, key=str)


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    words = ["the", "of", "and", "to"] * 12 + [f"w{i}" for i in range(150)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(m))) for k, m in enumerate([5, 8, 12, 20, 20, 35, 35, 60, 3, 1])]
    items[-1] = (9, "Solitaire")
    docs = []
    for d in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randint(0, 80))]
        if rnd.random() < 0.6:
            q = rnd.choice(items)[1].split()
            for _ in range(rnd.randint(0, max(1, len(q) // 5))):
                at = rnd.randrange(len(q))
                rnd.choice([lambda: q.__setitem__(at, "new"), lambda: q.insert(at, "more"), lambda: q.pop(at) if len(q) > 1 else None])()
            at = rnd.randint(0, len(w))
            w[at:at] = q
        docs.append((d, rnd.choice([" ", ", ", "\n"]).join(w).title() if d % 2 else " ".join(w)))
    return docs, items


def run(spark, docs, items, **kw):
    a = spark.createDataFrame([(d, t, 9, "x") for d, t in docs], "doc_id long, text string, item_id int, edits string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return sorted([tuple(r) for r in dc.leaks(a, b, **kw).collect()], key=str)


def test_exact_distances():
    rnd = np.random.default_rng(0)
    a, b = rnd.integers(0, 3, (500, 9)).astype(np.uint64), rnd.integers(0, 3, (500, 9)).astype(np.uint64)
    for limit in (0, 1, 3, 9):
        want = [min(distance(list(x), list(y)), limit + 1) for x, y in zip(a, b, strict=True)]
        assert dc.edit_distances(a, b, limit).tolist() == want


def test_recall_and_no_false_leaks(spark):
    docs, items = corpus()
    want = brute(docs, items)
    got = run(spark, docs, items)
    pairs = {r[:2]: r for r in want}
    assert all(r[:2] in pairs and r[4] >= pairs[r[:2]][4] for r in got)
    assert len(got) >= 0.95 * len(want) and len(want) > 20
    assert sum(r in want for r in got) >= 0.95 * len(want)
    exact = [r for r in want if r[4] == 0]
    assert exact and set(exact) <= set(got)


def test_recall_at_the_limit():
    rnd = random.Random(7)
    met = total = 0
    for trial in range(60):
        m = rnd.choice([10, 20, 40])
        q = [f"q{rnd.randint(0, 400)}" for _ in range(m)]
        w = list(q)
        for at in rnd.sample(range(m), int(dc.EDITS * m)):
            w[at] = "changed"
        items = dc.Items([1], [" ".join(q)], dc.EDITS, dc.BITS, dc.REPEATS)
        met += bool(items.search(dc._words(dc.pa.array([" ".join(w)]))))
        total += 1
    assert met >= 0.95 * total


def test_blocks_and_edge_cases(spark, monkeypatch):
    docs, items = corpus(3, 20)
    long = " ".join(f"z{i}" for i in range(30_000)) + " " + items[5][1]
    docs += [(100, None), (101, ""), (None, items[4][1]), (102, long), (5, items[3][1]), (5, items[3][1])]
    items += [(50, None), (51, ""), (52, "?!"), (None, "alpha beta gamma delta epsilon"), (53, items[3][1])]
    docs.append((103, "x alpha beta gamma delta epsilon y"))
    whole = run(spark, docs, items, repeats=60)
    assert whole == brute(docs, items)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 300)
    assert run(spark, docs, items, repeats=60) == whole
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    bad = {r[0] for r in whole} - {None}
    assert sorted((r.doc_id for r in dc.clean(a, b, repeats=60).collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)


def test_distances_of_unequal_lengths():
    rnd = np.random.default_rng(1)
    for m in range(1, 10):
        a, b = rnd.integers(0, 3, (200, m)).astype(np.uint64), rnd.integers(0, 3, (200, 9)).astype(np.uint64)
        for limit in (0, 1, 3, 9):
            want = [min(distance(list(x), list(y)), limit + 1) for x, y in zip(a, b, strict=True)]
            assert dc.edit_distances(a, b, limit).tolist() == want


def test_documents_shorter_than_an_item(spark):
    rnd = random.Random(11)
    items = [(k, " ".join(f"q{rnd.randint(0, 900)}" for _ in range(m))) for k, m in enumerate([5, 6, 10, 20, 40])]
    docs, want = [], []
    for item, q in items:
        for less in range(1, len(q.split()) // 5 + 2):
            w = q.split()
            for at in sorted(rnd.sample(range(len(w)), less), reverse=True):
                w.pop(at)
            docs.append((len(docs), " ".join(w)))
            if less <= int(dc.EDITS * len(q.split())):
                want.append((len(docs) - 1, item, 0, len(w), less))
    docs += [(500, "elsewhere " * 9), (501, "q1"), (502, "")]
    assert run(spark, docs, items, repeats=60, short_texts=True) == sorted(want, key=str)
    near = [r for r in want if r[4] == 1]
    assert len(near) == len(items) and set(near) <= set(run(spark, docs, items, short_texts=True))


def test_windows_and_short_documents_together(spark):
    docs, items = corpus()
    want = brute(docs, items)
    for d, t in docs:
        w = WORDS.findall(t.lower())
        for i, x in items:
            q = x.lower().split()
            if w and len(w) < len(q) and distance(w, q) <= int(dc.EDITS * len(q)):
                want.append((d, i, 0, len(w), distance(w, q)))
    assert any(r[3] < len(dict(items)[r[1]].split()) for r in want)
    assert run(spark, docs, items, repeats=60, short_texts=True) == sorted(want, key=str)


def test_query_looks_at_short_documents(spark, tmp_path):
    from lathe.llm import queries

    item = "one two three four five six seven eight"
    spark.createDataFrame([(1, item.rsplit(" ", 1)[0]), (2, "other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in queries.op6_decontamination(spark, str(tmp_path)).collect()] == [(1, 7, 0, 7, 1)]
