"""License scan against plain search for phrases and templates."""

import random
import re

import numpy as np
import pyarrow as pa

from lathe.llm import license_scan as ls

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_places(t, phrases):
    w, out = words_of(t), []
    for p, label in phrases.items():
        q = words_of(p)
        out += [(i, label) for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
    return sorted(out)


def longest(w, i, sequences):
    """Length of the longest word sequence that ends at word i and stands in a sequence."""
    n = 0
    while n <= i and any(w[i - n : i + 1] == s[j : j + n + 1] for s in sequences for j in range(len(s) - n)):
        n += 1
    return n


def test_matching_statistics():
    rnd = random.Random(3)
    for _ in range(200):
        sequences = [[rnd.randint(0, 3) for _ in range(rnd.randint(1, 9))] for _ in range(rnd.randint(1, 4))]
        auto = ls.Automaton()
        for i, s in enumerate(sequences):
            auto.add(i, s)
        auto.finish()
        w = [rnd.randint(0, 4) for _ in range(30)]
        got = list(auto.stream(w))
        assert [n for _, n in got] == [longest(w, i, sequences) for i in range(len(w))]
        for i, (state, n) in enumerate(got):
            ends = {(k, j + n - 1) for k, s in enumerate(sequences) for j in range(len(s) - n + 1) if n and s[j : j + n] == w[i - n + 1 : i + 1]}
            assert not n or auto.places[state] == ends


PHRASES = {"mit license": "mit", "license": "any", "general public license": "gpl", "public license apache": "odd", "mit": "m"}


def test_phrases_match_plain_search(spark):
    rnd = random.Random(4)
    vocabulary = ["MIT", "License", "general", "Public", "apache", "the", "x", "é", "licensé", "license2"]
    rows = [(d, rnd.choice([" ", "-", "\n", "_", ". "]).join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60)))) for d in range(200)]
    rows += [(None, None), (300, ""), (301, "mit license " * 30_000), (301, "MIT LICENSE"), (302, "x " * 50_000 + "general public license")]
    for phrases in (PHRASES, ls.PHRASES):
        df = spark.createDataFrame([(d, t, 0, "z") for d, t in rows], "doc_id long, text string, n_words int, places string")
        got = sorted(((r.doc_id, r.n_words, sorted((p.word, p.label) for p in r.places)) for r in ls.scan(df, phrases=phrases).collect()), key=str)
        assert got == sorted(((d, len(words_of(t)), brute_places(t, phrases)) for d, t in rows), key=str)
        assert ls.scan(df.limit(0), phrases=phrases).collect() == []


def test_templates(spark):
    filler = " ".join(f"word{i}" for i in range(50))
    mit = ls.TEMPLATES["mit"][0]
    edited = mit.replace("obtaining a copy", "who gets a copy").replace("merge, publish", "merge and publish").upper()
    half = " ".join(mit.split()[:20])
    rows = [(1, f"{filler} {mit} {filler}"), (2, f"{filler}\n{edited}"), (3, f"{filler} {half} {filler}"), (4, filler), (5, "ALL RIGHTS RESERVED"), (6, None), (7, " ".join(reversed(mit.split())))]
    rows.append((8, ls.TEMPLATES["bsd"][0] + " " + ls.TEMPLATES["apache"][0]))
    got = {r.doc_id: r for r in ls.summary(ls.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [got[d].labels for d in range(1, 9)] == ["mit", "mit", "", "", "rights-reserved", "", "", "apache,bsd"]
    assert got[1].score == 1.0 and 0.8 <= got[2].score < 1 and got[4].score == 0.0
    assert got[8].base_labels == "apache" and got[8].n_base == 1 and got[4].first_word is None
    span = ls.Scanner(ls.PHRASES, ls.TEMPLATES).scan(ls._words(pa.array([rows[0][1]])))[0][1]
    n = len(words_of(mit))
    assert [(s, e) for s, e, *_ in span] == [(50, 50 + n)] and np.isclose(span[0][3], 1.0)
