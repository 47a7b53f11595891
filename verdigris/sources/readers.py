"""Readers and writers: explicit schemas, image folders, ground-truth lines, run logs, the feature and prediction stores, small JSON files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources import formats
from verdigris.sources.formats import RUN_LOG

FEATURES = "path string, vec array<float>, backbone string, mode string"
PREDICTIONS = "path string, probs array<float>, method string, K string, seed int"
ITEMS = "path string, label int, class_name string, md5 string, group int"


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, class_name (the folder's name, lower case, without a leading number), md5, bytes of every file below folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    parent = F.element_at(F.split("path", "/"), -2)
    return raw.select("path", class_of(parent).alias("class_name"), F.md5("content").alias("md5"), F.col("length").alias("bytes"))


def class_of(folder: Column) -> Column:
    """'3. Black Mould' -> 'black mould'."""
    return F.lower(F.regexp_replace(folder, r"^\d+\.\s*", ""))


def labels_of(files: DataFrame, classes: DataFrame, path: str = "path") -> DataFrame:
    """files with label: the class (lower case) that the file's name begins with, else the nearest folder's that is one, else null.

    classes has a column class, of any number of rows. A name is looked up by each of its beginnings of a class's
    length, so both ways are joins by equality; of several classes the longest beginning wins.
    """
    known = classes.select(F.lower("class").alias("__class")).filter("__class <> ''").distinct()
    lengths = [r[0] for r in known.select(F.length("__class").alias("n")).distinct().orderBy("n").collect()] or [0]
    parts = F.split(F.lower(path), "/")
    name, depth = F.element_at(parts, -1), F.size(parts)
    # places from best to worst: beginnings of the name, longest first, then folders from the nearest
    begun = F.transform(F.array(*map(F.lit, lengths)), lambda n: F.struct((-n).alias("place"), F.substring(name, F.lit(1), n).alias("__class")))
    folders = F.transform(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))), lambda i: F.struct(i.cast("int").alias("place"), F.when(i < depth, F.get(parts, depth - 1 - i)).alias("__class")))
    looked = files.select(path).distinct().select(path, F.inline(F.concat(begun, folders)))
    found = looked.join(known, "__class").groupBy(path).agg(F.min_by("__class", "place").alias("label"))
    return files.join(found, path, "left")


def boxes_of(numbers: Column) -> Column:
    """A flat array of numbers cut into arrays of four."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / 4).cast("int") - 1), lambda i: F.slice(numbers, i * 4 + 1, 4))


def ground_truth(lines: DataFrame, text: str = "value") -> DataFrame:
    """path, label, boxes from lines 'path label [x0 y0 x1 y1]...' of white-space (or comma) separated fields; lines of one path join their boxes."""
    fields = lines.select(F.split(F.trim(F.regexp_replace(text, r"[\s,]+", " ")), " ").alias("f"), F.monotonically_increasing_id().alias("at")).filter(F.size("f") >= 2)
    numbers = F.transform(F.slice("f", 3, F.size("f")), lambda x: x.cast("double"))
    rows = fields.select(F.col("f")[0].alias("path"), F.col("f")[1].cast("int").alias("label"), F.when(F.size("f") >= 6, boxes_of(numbers)).otherwise(F.array().cast("array<array<double>>")).alias("boxes"), "at")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "boxes"))), lambda x: x["boxes"]))
    return rows.groupBy("path").agg(F.min_by("label", "at").alias("label"), joined.alias("boxes"))


def name_parts(name: Column, pattern: str, names: list[str]) -> list[Column]:
    """The groups of a pattern as columns of the given names; null where it does not match."""
    return [F.when(F.regexp_like(name, F.lit(pattern)), F.regexp_extract(name, pattern, i + 1)).alias(x) for i, x in enumerate(names)]


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of one JSON object a line, under the fixed schema: missing fields are null, whole numbers are doubles where they
    may be either. A log that formats.append_runs added to is read by its format."""
    if not exists(spark, f"{path}/{formats.COMMITS}"):
        return spark.read.schema(RUN_LOG).json(path)
    formats.register(spark)
    return spark.read.format("run_log").load(path)


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def save_features(df: DataFrame, path: str) -> None:
    """Feature rows (FEATURES) into the store, replacing only the (backbone, mode) partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("backbone", "mode").parquet(path)


def features(spark: SparkSession, path: str, backbone: str, mode: str) -> DataFrame:
    """path, vec of one partition of the store."""
    return spark.read.schema(FEATURES).parquet(path).filter((F.col("backbone") == backbone) & (F.col("mode") == mode)).select("path", "vec")


def bound(items: DataFrame, feats: DataFrame, key: str = "path") -> DataFrame:
    """Items with their features; raises KeyError with examples if an item has none."""
    missing = [r[0] for r in items.join(feats.select(key), key, "left_anti").select(key).limit(3).collect()]
    if missing:
        raise KeyError(f"no features for {missing}")
    return items.join(feats, key)


def save_splits(df: DataFrame, path: str) -> None:
    """Split rows with columns split, k, seed, partitioned by them."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "k", "seed").parquet(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; refuses more than most rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in rows]) + "\n"


def _file(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file(spark, path)
    return files.exists(where)


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Length and modification time of a file or folder."""
    files, where = _file(spark, path)
    status = files.getFileStatus(where)
    return status.getLen(), status.getModificationTime()


def text_of(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if it is not there."""
    return "\n".join(r[0] for r in spark.read.text(path).coalesce(1).collect()) if exists(spark, path) else None


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small JSON file that is there whole or not at all: written beside, then renamed over the old one."""
    files, where = _file(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(beside, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=1).encode()))
    finally:
        out.close()
    files.delete(where, False)
    if not files.rename(beside, where):
        raise OSError(f"{path} cannot be written")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON document (an object or a list of them), under a schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if it is there whole, else made, written there and read again."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_predictions(df: DataFrame, path: str, method: str, k: str, seed: int, key: str = "path", probs: str = "probs") -> None:
    """The probabilities of a run into the prediction store, replacing only that run's."""
    rows = df.select(F.col(key).cast("string").alias("path"), F.col(probs).cast("array<float>").alias("probs"), F.lit(method).alias("method"), F.lit(k).alias("K"), F.lit(seed).alias("seed"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "K", "seed").parquet(path)


def predictions(spark: SparkSession, path: str, method: str, k: str, seed: int) -> DataFrame:
    """path, probs, pred (the first of the largest) of one run."""
    rows = spark.read.schema(PREDICTIONS).parquet(path).filter((F.col("method") == method) & (F.col("K") == k) & (F.col("seed") == seed))
    return rows.select("path", "probs", (F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("pred"))


def splits(spark: SparkSession, path: str, split: str, k: str, seed: int) -> DataFrame:
    """The rows of one split that save_splits wrote; only its partition is read."""
    return spark.read.parquet(path).filter((F.col("split") == split) & (F.col("k") == k) & (F.col("seed") == seed)).drop("split", "k", "seed")


#: Batches of a resumed extraction at most.
BATCHES = 24


def resumed(todo: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], key: str, batch: int = 100_000, limit: int | None = None) -> DataFrame:
    """The table at path after make() has added what it lacks of todo, batch by batch: a run that stops goes on after its
    last whole batch. With limit, only the first so many rows in the order of key are worked on now.

    Each batch reads the table once, so there are BATCHES at most, of more than batch rows where the table needs them. Batches are shares of the hash of key, so one batch's rows are never in another's.
    """
    spark = todo.sparkSession
    rest = todo.join(spark.read.parquet(path).select(key), key, "left_anti") if exists(spark, path) else todo
    if limit is not None:
        rest = rest.orderBy(key).limit(limit)
    keys = rest.select(key).collect() if limit is not None else None  # the limit bounds them
    rest = rest if keys is None else todo.join(F.broadcast(spark.createDataFrame(keys, todo.select(key).schema)), key, "left_semi")
    n = min(BATCHES, max(1, -(-rest.count() // batch)))
    for i in range(n):
        make(rest.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)).write.mode("append").parquet(path)
    return spark.read.parquet(path)
