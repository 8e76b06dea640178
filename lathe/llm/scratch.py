"""Intermediate tables in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from lathe.session import ensure_checkpoint_dir


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    It cuts the lineage: executors lost later cost a reread, not the work above.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch of whole texts on its way to or from Python.
BATCH_BYTES = 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: ten thousand rows of long texts would be gigabytes. A
    session with a lower bound keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(key).lower()).groups()
    if int(number) * 1024 ** " kmg".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
