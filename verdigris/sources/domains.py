"""What differs between domains: where their tables are, which classes and prompts they have; and the store as one object."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from verdigris.sources import readers


@dataclass(frozen=True)
class Domain:
    """A domain's folder and settings. classes, templates and prompts may be overridden by a file prompts.json in the folder."""

    name: str
    folder: str
    classes: tuple[str, ...] = ()
    templates: tuple[str, ...] = ("a photo of {}.",)
    prompts: tuple[str, ...] = ()

    @classmethod
    def open(cls, spark: SparkSession, name: str, top: str, **settings) -> Domain:
        """The domain called name below a folder, with its prompts.json if there is one."""
        made = cls(name, f"{top.rstrip('/')}/{name}", **settings)
        text = readers.text_of(spark, f"{made.folder}/prompts.json")
        known = {f.name for f in fields(cls)} - {"name", "folder"}
        return replace(made, **{k: tuple(v) for k, v in json.loads(text).items() if k in known}) if text is not None else made

    def items(self, spark: SparkSession) -> DataFrame:
        """The item table: the cleaned one if it is there, else the raw one."""
        for table in ("items_clean", "items"):
            if readers.exists(spark, f"{self.folder}/{table}"):
                return spark.read.schema(readers.ITEMS).parquet(f"{self.folder}/{table}")
        raise FileNotFoundError(f"{self.folder} has no items")

    def split(self, spark: SparkSession, split: str, k: str | None = None, seed: int | None = None) -> DataFrame:
        """The rows of one split; only its partition is read."""
        rows = spark.read.parquet(f"{self.folder}/splits").filter(f"split = '{split}'")
        rows = rows if k is None else rows.filter(rows["k"] == k)
        return rows if seed is None else rows.filter(rows["seed"] == seed)


@dataclass
class Store:
    """Features of one backbone (and a second), of the modes asked for. Modes that are optional and not there are skipped;
    tables are opened once and only when they are used."""

    spark: SparkSession
    path: str
    backbone: str
    need: tuple[str, ...] = ("global",)
    optional: tuple[str, ...] = ()
    second: str | None = None
    _open: dict[tuple[str, str], DataFrame] = field(default_factory=dict, repr=False)

    @cached_property
    def there(self) -> set[tuple[str, str]]:
        """The (backbone, mode) partitions of the store."""
        rows = self.spark.read.schema(readers.FEATURES).parquet(self.path).select("backbone", "mode").distinct()
        return {(r["backbone"], r["mode"]) for r in rows.collect()}

    @property
    def modes(self) -> tuple[str, ...]:
        """The modes that can be read. Raises KeyError if one that is needed is missing."""
        missing = [m for m in self.need if (self.backbone, m) not in self.there]
        if missing:
            raise KeyError(f"{self.backbone} has no {missing}")
        return (*self.need, *(m for m in self.optional if (self.backbone, m) in self.there))

    def features(self, mode: str = "global", backbone: str | None = None) -> DataFrame:
        """path, vec of one mode."""
        at = (backbone or self.backbone, mode)
        if at not in self._open:
            self._open[at] = readers.features(self.spark, self.path, *at)
        return self._open[at]

    def batch(self, items: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
        """items with a vector for each mode (named after it), and the second backbone's; every item must have those needed."""
        out = items if not columns else items.select("path", *columns)
        for mode in self.modes:
            side = self.features(mode).withColumnRenamed("vec", mode)
            out = readers.bound(out, side) if mode in self.need else out.join(side, "path", "left")
        return readers.bound(out, self.features("global", self.second).withColumnRenamed("vec", "second")) if self.second else out
