"""Training-corpus pipeline over ``documents``: the stages in order, and a runner.

Each stage takes all rows that the stage before kept and returns the columns of ``documents``
(``n_chars`` follows the text); the last one adds what the tokeniser made of each text.

Edge cases, alike in all stages: a null or empty text is kept (it is not toxic, has no lines to
drop, leaks nothing and has no ids) unless a near-duplicate of a smaller doc_id (empty texts are
copies of one another); rows without a doc_id stay where a stage names rows by it; repeated rows
are judged alike, and one of them stays after the near-duplicates; texts are never cut; an empty
table stays empty. Other columns pass through, whatever their names; only the last stage replaces
columns named as its own (``ids``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import byte_bpe, decontaminate, line_dedup, simhash, toxicity
from lathe.llm.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity; learnt from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs across documents."""
    own = {c: f"__own_{c}" for c in ("n_lines", "n_dropped")}  # a user's columns of these names
    out = line_dedup.drop_recurring(docs.withColumnsRenamed(own)).drop(*own).withColumnsRenamed({v: k for k, v in own.items()})
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_texts=True)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, and digests of the ids and of the bytes decoded again."""
    docs = docs.drop("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    decoded = "__decoded"
    both = byte_bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, decoded=decoded)
    return byte_bpe.digests(both, decoded=decoded).drop(decoded)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("byte_bpe", tokenise),
]

#: Scoring, edit verification and tokenising have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
