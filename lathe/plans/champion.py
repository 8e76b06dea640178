"""The champion of a run as one artifact: raw rows in, predictions out, before and after reload.

A :class:`Champion` is an MLlib ``Transformer``: it holds the fitted preparation (with the tables
of long category lists), the engineered features, the feature order, the label order and the
fitted estimator (for nearest neighbours the training rows and their id). It is written and
read like any MLlib model, alone or as a stage of a ``PipelineModel``.
"""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import engineer, models, prep


class Champion(Transformer, MLWritable, MLReadable):
    def __init__(self, preparation: prep.PrepModel, steps: list[engineer.Feature], model: models.FittedModel, key: str | None = None) -> None:
        super().__init__()
        self.preparation, self.steps, self.model, self.key = preparation, list(steps), model, key

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """The raw rows with ``prediction`` and, for classes, ``probabilities`` and ``score``
        (they replace raw columns so named). The target need not be there; if it is, it is
        not read."""
        made = ["prediction", "probabilities", "score"]
        # the raw row travels along as it is: preparation changes and drops columns
        rows = dataset.withColumn("_raw", F.struct(*[F.col(f"`{c}`") for c in dataset.columns]))
        given = dataset.columns
        rows = self.preparation.transform(rows.drop(self.model.target))
        rows, _ = engineer.engineer(rows, self.steps, raw_columns=given, check=False)
        scored = self.model.transform(rows.select("_raw", *[F.col(f"`{c}`") for c in self.model.features]))
        own = [c for c in made if c in scored.columns]
        return scored.select(*[F.col("_raw")[c].alias(c) for c in given if c not in own], *own)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: Champion) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802 - the name MLlib calls
        own, spark = self.instance, SparkSession.getActiveSession()
        steps = [[f.operation, list(f.inputs), f.output, f.step_id] for f in own.steps]
        DefaultParamsWriter.saveMetadata(own, path, spark, extraMetadata={"steps": steps, "key": own.key})
        own.preparation.save(spark, f"{path}/preparation")
        own.model.save(f"{path}/model")


class _Reader(MLReader):
    def load(self, path: str) -> Champion:
        spark = SparkSession.getActiveSession()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        steps = [engineer.Feature(op, tuple(inputs), output, step_id) for op, inputs, output, step_id in meta["steps"]]
        own = Champion(prep.PrepModel.load(spark, f"{path}/preparation"), steps, models.load_model(spark, f"{path}/model"), meta["key"])
        own._resetUid(meta["uid"])
        return own
