"""Pluggable encoders and detectors: batch functions that run in Arrow batches, and what Spark does before and after them.

An encoder turns contents into vectors; which parts of an item it sees is decided in Spark, as boxes in shares of the
item's width and height, so that a mode is a column and not code of the encoder. A detector gives raw boxes for prompts;
corners, filters, suppression and slots are Spark expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import vec
from verdigris.operators import regions

#: What an item is looked at: whole, drawn crops, the cells of a grid, its regions.
MODES = ("global", "aug", "grid", "regions")
#: A box in shares of the item's size.
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


class Encoder(Protocol):
    """name, dim, and three batch steps. text is None for an encoder without a text side."""

    name: str
    dim: int
    text: Callable[[list[str]], np.ndarray] | None

    def open(self, content: object) -> object:
        """A content as the encoder sees it, once for all boxes."""

    def cut(self, opened: object, box: tuple[float, float, float, float]) -> object:
        """The part in a box."""

    def encode(self, parts: list) -> np.ndarray:
        """[parts, dim]."""


class Detector(Protocol):
    """detect gives, for each content, rows (prompt's number, cx, cy, w, h, score), sizes in units of the longer side."""

    name: str

    def detect(self, contents: list, prompts: Sequence[str]) -> list[np.ndarray]: ...


@dataclass(frozen=True)
class Letters:
    """A plain encoder to test with, of texts as items: an item is its characters in rows, from top to bottom; a part's
    vector is how often each letter from a to z occurs in it, of unit length (zero without letters)."""

    name: str = "letters"
    dim: int = 26

    def open(self, content: str | None) -> str:
        return (content or "").lower()

    def cut(self, opened: str, box: tuple[float, float, float, float]) -> str:
        x0, y0, x1, y1 = box
        rows = opened[int(y0 * len(opened)) : int(y1 * len(opened))]
        return rows[int(x0 * len(rows)) : int(x1 * len(rows))]

    def encode(self, parts: list[str]) -> np.ndarray:
        v = np.array([[t.count(chr(97 + i)) for i in range(26)] for t in parts], float).reshape(-1, 26)
        return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-8)

    def text(self, texts: list[str]) -> np.ndarray:
        return self.encode([self.open(t) for t in texts])


@dataclass(frozen=True)
class Stripes:
    """A plain detector to test with, of vectors as items: prompt i finds the box whose centre, size and score are the
    absolute values of components 5 i to 5 i + 4."""

    name: str = "stripes"

    def detect(self, contents: list, prompts: Sequence[str]) -> list[np.ndarray]:
        each = [np.abs(np.asarray(c, float)[: 5 * len(prompts)]).reshape(-1, 5) for c in contents]
        return [np.column_stack([np.arange(len(x)), x]) for x in each]


def whole() -> Column:
    return F.array(F.struct(F.lit(0e0).alias("x0"), F.lit(0e0).alias("y0"), F.lit(1e0).alias("x1"), F.lit(1e0).alias("y1")))


def grid_cells(side: int = 3) -> Column:
    """The cells of a grid, row by row."""
    edge = lambda i: F.lit(i / side)
    return F.array(*[F.struct(edge(c).alias("x0"), edge(r).alias("y0"), edge(c + 1).alias("x1"), edge(r + 1).alias("y1")) for r in range(side) for c in range(side)])


def tiles(width: Column, height: Column, size: int, step: int) -> Column:
    """Squares of a fixed size in pixels, a step apart, as far as they fit (one at least), as shares of the item's size."""
    starts = lambda side: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((side - size) / step)).cast("int")), lambda i: i * step)
    at = lambda x, side: F.least(F.lit(1e0), x / side)
    row = lambda y: F.transform(starts(width), lambda x: F.struct(at(x, width).alias("x0"), at(y, height).alias("y0"), at(x + size, width).alias("x1"), at(y + size, height).alias("y1")))
    return F.flatten(F.transform(starts(height), row))


def drawn_crops(key: Column, n: int, least: float = 0.5, seed: str = "aug") -> Column:
    """n boxes of at least a share of each side, drawn by md5 of seed, key and number."""
    share = lambda i, what: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), i.cast("string"), F.lit(what))), 1, 8), 16, 10).cast("double") / 2.0**32

    def box(i: Column) -> Column:
        side = F.lit(least) + (1 - least) * share(i, "side")
        x, y = share(i, "x") * (1 - side), share(i, "y") * (1 - side)
        return F.struct(x.alias("x0"), y.alias("y0"), (x + side).alias("x1"), (y + side).alias("y1"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), box)


def encoded(df: DataFrame, encoder: Encoder, boxes: Column, mode: str, key: str = "path", content: str = "content", batch: int = 256) -> DataFrame:
    """path, vecs (a vector for each box), backbone, mode. Null contents are empty ones; a null array of boxes gives no vector.

    Parts go to the encoder batch by batch, whatever the number of boxes of an item.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode} is none of {MODES}")
    rows = df.select(F.col(key).cast("string").alias("path"), F.col(content).alias("content"), boxes.cast(f"array<{BOX}>").alias("boxes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, edges, found = [], [0], []
            for c, bs in zip(b.column("content"), b.column("boxes")):
                opened = encoder.open(c.as_py())
                for x in bs.as_py() or []:
                    parts.append(encoder.cut(opened, (x["x0"], x["y0"], x["x1"], x["y1"])))
                    if len(parts) >= batch:
                        found.append(encoder.encode(parts))
                        parts = []
                edges.append(edges[-1] + len(bs.as_py() or []))
            if parts:
                found.append(encoder.encode(parts))
            flat = np.concatenate(found).astype(np.float32) if found else np.zeros((0, encoder.dim), np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) * encoder.dim + 1, encoder.dim), pa.int32()), pa.array(flat.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), vectors)], names=["path", "vecs"])

    got = rows.mapInArrow(run, "path string, vecs array<array<float>>")
    return got.withColumns({"backbone": F.lit(encoder.name), "mode": F.lit(mode)})


def encoded_texts(df: DataFrame, encoder: Encoder, text: str, key: str) -> DataFrame:
    """key, vec of every row's text; refused for an encoder without a text side."""
    if encoder.text is None:
        raise ValueError(f"{encoder.name} has no text encoder")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = encoder.text([x or "" for x in b.column("t").to_pylist()]) if b.num_rows else np.zeros((0, encoder.dim))
            yield pa.RecordBatch.from_pydict({"k": b.column("k"), "vec": pa.array(list(v.astype(np.float64)), pa.list_(pa.float64()))})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, vec array<double>").withColumnRenamed("k", key)


def phrases(classes: Column, templates: Sequence[str]) -> Column:
    """The templates ('a photo of {}.') filled with a class's name."""
    return F.array(*[F.replace(F.lit(t), F.lit("{}"), classes) for t in templates])


def class_vectors(df: DataFrame, encoder: Encoder, name: str, templates: Sequence[str], descriptions: Sequence[str], half: float = 0.5) -> DataFrame:
    """name, vec: the mean of a class's descriptions plus half its template's vector, normalised. df has a row for each class."""
    of = lambda kind, texts: df.select(F.col(name).alias("c"), F.posexplode(phrases(F.col(name), texts)).alias("n", "t")).select(F.struct("c", "n").alias("k"), F.col("t"), F.lit(kind).alias("kind"))
    rows = of("t", templates).unionByName(of("d", descriptions)).select(F.to_json(F.struct("k.c", "k.n", "kind")).alias("k"), "t")
    found = encoded_texts(rows, encoder, "t", "k").withColumn("j", F.from_json("k", "c string, n int, kind string")).select("j.*", "vec")
    means = lambda kind, out: vec.mean_vector(found.filter(F.col("kind") == kind), ["c"], "vec", encoder.dim, out)
    both = means("d", "d").join(means("t", "t"), "c")
    return both.select(F.col("c").alias(name), vec.normalized(vec.plus(F.col("d"), F.col("t"), half)).alias("vec"))


def detected(df: DataFrame, detector: Detector, prompts: Sequence[str], key: str = "path", content: str = "content") -> DataFrame:
    """path, raw: what the detector finds, as structs (prompt, cx, cy, w, h, score)."""
    kind = "array<struct<prompt:string,cx:double,cy:double,w:double,h:double,score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = detector.detect(b.column("content").to_pylist(), prompts)
            rows = [[{"prompt": prompts[int(r[0])], "cx": r[1], "cy": r[2], "w": r[3], "h": r[4], "score": r[5]} for r in x.tolist()] for x in found]
            entry = pa.struct([("prompt", pa.string()), *[(c, pa.float64()) for c in ("cx", "cy", "w", "h", "score")]])
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(rows, pa.list_(entry))], names=["path", "raw"])

    rows = df.select(F.col(key).cast("string").alias("path"), F.col(content).alias("content"))
    return rows.mapInArrow(run, f"path string, raw {kind}")


# Least score and largest share of the image of an object, an instance and a spot; the object's wider share where none passes.
THRESHOLDS = {"object": (0.2, 0.85), "instance": (0.06, 0.85), "spot": (0.05, 0.12)}
WIDER = 0.98


def item_regions(raw: Column, kinds: dict[str, str], width: Column, height: Column, overlap: float = 0.3) -> Column:
    """{object, regions} of an item from raw detections: corners in pixels, filtered by score and area, overlapping ones
    suppressed, the best object, and up to four slots of instances and spots. kinds: object, instance or spot for each prompt."""
    boxes = F.transform(raw, lambda d: F.struct(d["prompt"].alias("prompt"), d["score"].alias("score"), regions.corners(d["cx"], d["cy"], d["w"], d["h"], width, height).alias("b")))
    flat = F.transform(boxes, lambda d: F.struct(d["b"]["x0"].alias("x0"), d["b"]["y0"].alias("y0"), d["b"]["x1"].alias("x1"), d["b"]["y1"].alias("y1"), d["score"].alias("score"), d["prompt"].alias("prompt")))
    image = width * height

    def of(kind: str, most: float | None = None) -> Column:
        named = [p for p, k in kinds.items() if k == kind]
        least, largest = THRESHOLDS[kind]
        fine = lambda d: d["prompt"].isin(named) & (d["score"] >= least) & (regions.area(d) / image < (most or largest)) & (regions.area(d) / image > 0.002)
        return regions.suppressed(F.filter(flat, fine), overlap)

    objects = F.when(F.size(of("object")) > 0, of("object")).otherwise(of("object", WIDER))
    marked = lambda boxes, kind: F.transform(boxes, lambda d: F.struct(*[d[c].alias(c) for c in ("x0", "y0", "x1", "y1", "score", "prompt")], F.lit(kind).alias("kind")))
    return F.struct(F.get(objects, F.lit(0)).alias("object"), regions.slots(marked(of("instance"), "instance"), marked(of("spot"), "spot")).alias("regions"))
