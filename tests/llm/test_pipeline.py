"""The pipeline, stage by stage, against brute force; registered queries."""

import base64
import hashlib

import corpus_pipeline as cp
import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lathe.llm import line_dedup, queries, toxicity
from tests.llm import test_decontaminate, test_line_dedup, test_simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """Each stage's input and output, written and read as the driver does."""
    folder = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 4 = 0")
    odd = spark.createDataFrame([(None, None, None, None, None), (3, "", "en", "x", 0), (3, "", "en", "x", 0), (7, None, "en", "x", 5)], docs.schema)
    docs, out = docs.unionByName(odd), {}
    for name, stage in cp.STAGES:
        made = stage(spark, docs, "/root/testdata/sf0.01")
        made.write.parquet(str(folder / name))
        out[name] = (docs, spark.read.parquet(str(folder / name)))
        docs = out[name][1]
    return out


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)


def test_order_and_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    for name in list(steps)[:-1]:
        assert steps[name][1].columns == COLUMNS


def test_toxic(spark, steps):
    before, after = steps["toxicity"]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = toxicity.score(before, toxicity.fit(before, labels)).where(F.col("score") < toxicity.THRESHOLD)
    assert rows(after, "doc_id") == rows(scored, "doc_id")
    assert set(rows(after, *COLUMNS)) <= set(rows(before, *COLUMNS))


def test_lines(steps):
    before, after = steps["line_dedup"]
    want = test_line_dedup.brute(rows(before, "doc_id", "text"), line_dedup.MIN_DOCS)
    assert rows(after, "doc_id", "text") == sorted([r[:2] for r in want], key=str)
    assert after.where("n_chars <> length(text)").count() == 0


def test_near_duplicates(steps):
    before, after = steps["simhash_near_dedup"]
    groups = test_simhash.brute(rows(before.where("doc_id is not null"), "doc_id", "text"))
    assert rows(after.where("doc_id is not null"), "doc_id") == sorted({(c,) for *_, c in groups}, key=str)
    assert after.where("doc_id is null").count() == before.where("doc_id is null").count()


def test_leaks(spark, steps):
    before, after = steps["benchmark_decontamination"]
    items = rows(spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet"), "item_id", "text")
    docs = dict(rows(before, "doc_id", "text"))
    kept = {d for (d,) in rows(after, "doc_id")}
    gone = set(docs) - kept
    verbatim = {d for d, t in docs.items() if d is not None and any(x and x in (t or "") for _, x in items)}
    assert verbatim <= gone
    for d in list(gone)[:3] + sorted((k for k in kept if k is not None), key=lambda k: len(docs[k] or ""))[:25]:
        found = test_decontaminate.brute([(d, docs[d])], [x for x in items if abs(len(x[1]) - 200) < 100] if d in kept else items)
        assert bool(found) == (d in gone)


def test_tokens(steps):
    before, after = steps["byte_bpe"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(cp.VOCABULARY), "rb"))}
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(d, oracle.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows(before, "doc_id", "text")]
    assert rows(after, "doc_id", "ids", "decoded_sha256") == sorted(want, key=str)


def test_clashing_names_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    own = {"n_lines": F.lit(777), "n_dropped": F.col("doc_id"), "ids": F.lit("x"), "decoded": F.lit(1), "score": F.lit(2), "fp": F.lit(3), "item_id": F.lit(4)}
    for table in (docs.withColumns(own), docs.withColumns(own).where("false")):
        for name, stage in cp.STAGES:
            out = stage(spark, table, sf)
            if name != "byte_bpe":
                assert out.columns == table.columns
                assert {tuple(r) for r in out.select("doc_id", *own).collect()} <= {tuple(r) for r in table.select("doc_id", *own).collect()}
            else:
                assert out.columns == [c for c in table.columns if c != "ids"] + ["ids", "n_tokens", "ids_sha256", "decoded_sha256"]
                assert out.where("decoded <> 1 or n_lines <> 777").count() == 0
            assert (out.count() == 0) == (table.count() == 0)


def test_run_and_registry(spark, sf):
    out = cp.run(spark, sf)
    assert out.columns == [*COLUMNS, "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {table} AS FROM '{sf}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    assert rows(got, *sorted(got.columns)) == sorted(db.execute(f"SELECT {', '.join(sorted(got.columns))} FROM ({queries.ORACLES[name]})").fetchall(), key=str)
