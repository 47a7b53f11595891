"""Fitted models as tables: export, load, and the explanation of single items."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import evaluation, similarity

#: Columns of a stored model: arrays row by row, settings as JSON.
MODEL = "name string, shape array<int>, data array<double>, settings string"


@dataclass
class CacheModel:
    """A cache classifier as it is served: class texts [classes, d], support keys [n, d] with labels, the weights, the
    calibration, the least familiar cosine and the least sure probability; what it scored on the test rows."""

    text: np.ndarray
    keys: np.ndarray
    labels: np.ndarray
    weight: float = 2.0
    sharpness: float = 5.0
    tau: float = 1.0
    bias: np.ndarray | None = None
    familiar: float = 0.0
    sure: float = 0.5
    facts: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.bias = np.zeros(len(self.text)) if self.bias is None else self.bias

    def parts(self, df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """key, class, text_part, cache_part, bias_part, z (their sum)."""
        import pandas as pd

        texts = pd.DataFrame({"class": np.arange(len(self.text)), "vec": list(self.text)})
        support = pd.DataFrame({"label": self.labels, "vec": list(self.keys)})
        both = similarity.score_parts(df, texts, support, self.sharpness, key=key, vector=vector)
        bias = F.element_at(F.array(*[F.lit(float(x)) for x in self.bias]), F.col("class") + 1)
        named = both.select(key, "class", F.col("text").alias("text_part"), (F.lit(float(self.weight)) * F.col("cache")).alias("cache_part"), bias.alias("bias_part"))
        return named.withColumn("z", F.col("text_part") + F.col("cache_part") + F.col("bias_part"))

    def explain(self, df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """key, class, the parts less their means over the classes, z, p (calibrated), pred, margin, familiarity, unsure,
        familiar: all that is told about an item, one row for each class."""
        import pandas as pd
        from pyspark.sql import Window

        parts = self.parts(df, key, vector)
        p = evaluation.softmax(parts, key, "z", "p", self.tau)
        every = Window.partitionBy(key)
        centred = [(F.col(c) - F.avg(c).over(every)).alias(f"{c}_centred") for c in ("text_part", "cache_part")]
        support = df.sparkSession.createDataFrame(pd.DataFrame({"_n": np.arange(len(self.keys)), "_v": [k.tolist() for k in self.keys]}))
        near = similarity.nearest(df.select(F.col(key).alias("_n"), F.col(vector).alias("_v")), support, "_n", "_v").select(F.col("_n").alias(key), F.col("cos").alias("familiarity"))
        pred = evaluation.margins(parts, key).join(evaluation.predicted(p, key, "p").select(key, F.col("top").alias("conf")), key).join(near, key)
        flags = pred.select(key, "pred", "margin", "familiarity", (F.col("conf") < self.sure).alias("unsure"), (F.col("familiarity") >= self.familiar).alias("familiar"))
        return p.select(key, "class", "text_part", "cache_part", "bias_part", *centred, "z", "p").join(flags, key)


def save(model: CacheModel, spark: SparkSession, path: str) -> None:
    """A model as a table of MODEL rows, replaced as a whole."""
    arrays = {"text": model.text, "keys": model.keys, "labels": np.asarray(model.labels, float), "bias": model.bias}
    settings = {k: getattr(model, k) for k in ("weight", "sharpness", "tau", "familiar", "sure", "facts")}
    rows = [(n, list(map(int, a.shape)), a.astype(float).ravel().tolist(), None) for n, a in arrays.items()]
    spark.createDataFrame([*rows, ("settings", None, None, json.dumps(settings))], MODEL).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> CacheModel:
    """The model stored at path; a handful of rows."""
    rows = {r["name"]: r for r in spark.read.schema(MODEL).parquet(path).collect()}
    arrays = {n: np.array(r["data"]).reshape(r["shape"]) for n, r in rows.items() if n != "settings"}
    return CacheModel(**(arrays | {"labels": arrays["labels"].astype(int)}), **json.loads(rows["settings"]["settings"]))
