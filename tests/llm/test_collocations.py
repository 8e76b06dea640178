"""Phrase collocations: equal to plain counting at any chunk, bucket and tile size; edge cases."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lathe.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, "x", 1) for i, (l, t) in enumerate(rows)], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, least=30, nested=80, top=2000):
    grams: dict[str, Counter] = {}
    for lang, text in rows:
        held = grams.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\\x0a-\\x0d]", lowered(text or "")):
            words = re.findall("[^ \\t]+", piece)
            held.update(tuple(words[i : i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    out = set()
    for lang, held in grams.items():
        n = sum(c for g, c in held.items() if len(g) == 1)
        often = {g: c for g, c in held.items() if len(g) > 1 and c >= least}
        found = []
        for g, a in often.items():
            longer = [c for h, c in often.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if all(100 * c < nested * a for c in longer):
                score, _, left, right = min((int(Fraction(2000000 * a, held[g[:k]] + held[g[k:]])), k, held[g[:k]], held[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def answers(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def made(rng, texts):
    words = ["the", "of", "The", "straße", "日本", "a", "new", "york", "city", "hall", "x\x00y", "é"] + [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(texts):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(words[: rng.choice([3, 8, 52])]))
            if rng.random() < 0.2:
                parts.append("New York City Hall of")
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; ", "\x0b", "?!"]))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(parts)))
    return rows


@pytest.mark.parametrize("chunk", [2_000, 8_000_000])
def test_equals_plain_counting(spark, monkeypatch, chunk):
    monkeypatch.setattr(co, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(co, "BUCKET_BYTES", chunk * 2)
    rows = made(random.Random(1), 500)
    want = brute(rows)
    assert len(want) > 50 and answers(co.phrases(frame(spark, rows))) == want
    small = co.phrases(frame(spark, rows), min_count=40, nested=50, top=7)
    assert answers(small) == brute(rows, 40, 50, 7)


def test_hot_phrase_and_overlaps(spark):
    rows = [("en", "ha ha ha ha ha")] * 400 + [("en", "go now")] * 29 + [("de", "so so")] * 30
    assert answers(co.phrases(frame(spark, rows))) == brute(rows)


def test_tiles(monkeypatch):
    monkeypatch.setattr(co, "TILE", 8)
    monkeypatch.setattr(co, "HEAD", 4)
    monkeypatch.setattr(co, "DENSE", 40)
    rng = np.random.default_rng(3)
    left, right = (np.minimum(rng.geometric(0.08, 5000) - 1, 400).astype(np.int64) for _ in range(2))
    for ids in (401, 2**40):  # the second needs codes of the pairs at hand
        a, b, n, local = co.count_pairs(left, right, ids)
        want = Counter(zip(left.tolist(), right.tolist(), strict=True))
        assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == want and len(a) == len(want)
        assert (a[local] == left).all() and (b[local] == right).all()
    assert [len(x) for x in co.count_pairs(left[:0], right[:0], 5)] == [0, 0, 0, 0]


@pytest.mark.parametrize("limit", [10, 17, 1_000_000])
def test_long_texts_are_cut_between_words(monkeypatch, limit):
    monkeypatch.setattr(co.tokens, "SLICE_BYTES", limit)
    text = " ".join(made(random.Random(2), 1)[0][1] for _ in range(3)) + " one two three. four five " + "x" * 90 + " " + "y " * 50 + ",,, z"
    words, new = [], []
    for part, flags in co.words(pa.array([text])):
        words += part.to_pylist()
        new += flags.tolist()
    pieces = [re.findall("[^ \\t]+", p) for p in re.split("[.,;:!?\\x0a-\\x0d]", lowered(text))]
    assert words == [w for p in pieces for w in p]
    assert new == [i == 0 for p in pieces for i, _ in enumerate(p)]


def test_edge_cases(spark):
    rows = [(None, None), ("en", ""), ("en", " \t\n"), ("en", ".,;"), ("de", "Wort")]
    out = co.phrases(frame(spark, rows))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0
    assert co.phrases(frame(spark, rows).where("false")).count() == 0
    levels, total = co.frequent_phrases(frame(spark, [("en", "A b"), ("en", "a b."), (None, "c")]), min_count=2)
    assert [level.count() for level in levels] == [2, 1, 0, 0]
    assert {tuple(r) for r in total.collect()} == {("en", 4), ("und", 1)}
