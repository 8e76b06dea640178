"""Line deduplication against a dictionary of templates."""

import random
import re
from collections import Counter

import duckdb
import pytest

from lathe.llm import line_dedup as ld


def masked(line):
    return " ".join("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x09-\x0D\x20]+", line))


def templates(rows, min_docs):
    """The template of each masked line: its leaf, or itself."""
    owners = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if masked(line):
                owners.setdefault(masked(line), set()).add((d, t))
    leaves = {}
    for m in owners:
        w = m.split(" ")
        leaves.setdefault((len(w), *w[: ld.DEPTH]), []).append(m)
    out = {m: m for m in owners}
    for leaf, lines in leaves.items():
        docs = sum(len(owners[m]) for m in lines)
        if len(lines) < 2 or docs < min_docs:
            continue
        constants = {}
        for p in range(ld.DEPTH, leaf[0]):
            votes = Counter()
            for m in lines:
                votes[m.split(" ")[p]] += len(owners[m])
            constants |= {p: w for w, n in votes.items() if 2 * n > docs}
        if constants and 2 * (len(constants) + ld.DEPTH) > leaf[0]:
            out |= {m: leaf for m in lines if sum(m.split(" ")[p] == w for p, w in constants.items()) >= ld.AGREE * len(constants)}
    return out


def brute(rows, min_docs):
    key = lambda d, t: (d is None, d or 0, t or "")
    owners, of = {}, templates(rows, min_docs)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if masked(line):
                owners.setdefault(of[masked(line)], set()).add(key(d, t))
    out = []
    for d, t in rows:
        kept, seen, lines = [], set(), (t or "").split("\n")
        for line in lines:
            m = of.get(masked(line))
            if m and len(owners[m]) >= min_docs and (min(owners[m]) != key(d, t) or m in seen):
                continue
            seen.add(m)
            kept.append(line)
        out.append((d, None if t is None else "\n".join(kept), 0 if t is None else len(lines), 0 if t is None else len(lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "n", 7) for d, t in rows], "doc_id long, text string, n_lines string, line int")
    out = ld.drop_recurring(df, **kw)
    assert out.columns == ["doc_id", "text", "line", "n_lines", "n_dropped"]
    return sorted([tuple(r) for r in out.select("doc_id", "text", "n_lines", "n_dropped").collect()], key=str)


def corpus():
    rnd = random.Random(4)
    common = ["All rights reserved.", "Page {} of {}", "é  ü\t{} end", "x", "Posted on {} by a", "  pad  ded {}", "Posted by NAME in NAME", "Read the full NAME here now", "The NAME of NAME ended"]
    rows = []
    for d in range(80):
        lines = [" ".join(rnd.choice("abcdefgh") * 3 for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(0, 6))]
        lines += [re.sub("NAME", lambda _: rnd.choice(["Ann", "Bob", "Cyd", "Sport", "News"]), rnd.choice(common).replace("{}", str(rnd.randint(0, 99)))) for _ in range(rnd.randint(0, 4))] + [""] * rnd.randint(0, 1)
        rnd.shuffle(lines)
        rows.append((d * 3 % 80, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("min_docs", [2, 5])
def test_matches_brute_force(spark, min_docs):
    rows = corpus()
    want = brute(rows, min_docs)
    assert any(r[3] for r in want)
    assert run(spark, rows, min_docs=min_docs) == want


def test_varying_words_are_one_template(spark):
    """Names differ on every document; lines that merely start alike stay, and so do lists."""
    rows = [(i, f"Posted by Name{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyz'[i // 26]} in {['News', 'Sport', 'Art'][i % 3]}\nIn the {'k' * (i + 1)} {'m' * (i + 1)} went {'s' * (i + 2)}") for i in range(30)]
    rows.append((99, "Item one is red\nItem one is blue\nItem one is pale\nItem one is dark\nItem one is green"))
    got = run(spark, rows)
    assert got == brute(rows, 5)
    assert [r[3] for r in sorted(got)] == [0] + [1] * 29 + [0] and all("went" in r[1] for r in got if r[0] < 99)


def test_hot_leaf_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(ld, "PART_ROWS", 7)
    rows = corpus() + [(1000 + i, f"Posted by {'q' * (i % 40 + 1)} in News\nAll rights reserved.") for i in range(200)]
    assert run(spark, rows) == brute(rows, 5)


def test_edge_cases(spark):
    long = "\n".join(f"line {chr(97 + i % 26) * (i // 26 + 1)}" for i in range(3000))
    rows = [(1, None), (None, None), (2, ""), (3, "\n\n \n"), (4, "a b\nc"), (4, "a b\nc"), (None, "a b\nd"), (7, "a b"), (8, "a  b"), (9, long), (10, long), (11, "q " * 20000), (-5, "c")]
    assert run(spark, rows, min_docs=2) == brute(rows, 2)
    assert run(spark, []) == []


def test_sql_form(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus())] + [(500, None), (None, "All rights reserved.\nq")]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(db.execute(ld.drop_recurring_sql(3)).fetchall(), key=str) == run(spark, rows, min_docs=3)
