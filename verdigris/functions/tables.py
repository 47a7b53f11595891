"""Table functions for SQL: suppression over partitions of a table of boxes, windows of each row. register() names them in a session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from verdigris.functions.boxes import kept_boxes, tile_corners

#: Columns that suppressed() wants of its table, besides the one it is partitioned by.
BOX = ("k", "x0", "y0", "x1", "y1", "score")


@arrow_udtf(returnType="item bigint, k int, x0 double, y0 double, x1 double, y1 double, score double")
class Suppressed:
    """item, k, x0, y0, x1, y1, score of the boxes that suppression leaves of each partition.

    suppressed(TABLE(t) PARTITION BY item): t has item, k and the box; boxes of falling score (ties by k) are each kept
    unless they overlap a kept one of the partition more than 0.3. Rows with a null in the box, its score or k are left
    out. A partition is one item's boxes, which a task holds; items are spread over the tasks by their hash.
    """

    def __init__(self) -> None:
        self.parts: list[pa.Table] = []

    def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
        self.parts.append(pa.table({c: table.column(c) for c in ("item", *BOX)}))
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if not self.parts:
            return
        rows = pa.concat_tables(self.parts).cast(pa.schema([("item", pa.int64()), ("k", pa.int32()), *[(c, pa.float64()) for c in BOX[1:]]]))
        whole = np.logical_and.reduce([rows[c].is_valid().to_numpy() for c in BOX])
        rows = rows.filter(pa.array(whole)).sort_by([("score", "descending"), ("k", "ascending")])
        corners = np.stack([rows[c].to_numpy() for c in BOX[1:5]], 1)
        yield rows.take(pa.array(kept_boxes(corners), pa.int64()))


@arrow_udtf(returnType="item bigint, place int, x0 double, y0 double, x1 double, y1 double")
class Tiles:
    """item, place, x0, y0, x1, y1 of the tiles of images, as shares of their sides: tiles(TABLE(t), side, step).

    t has item, width and height in pixels; an image without a width or a height has no tiles. Rows need not meet, so
    the table is not partitioned. (Spark allows no lateral join with a function of Arrow batches.)
    """

    def eval(self, table: pa.RecordBatch, side: pa.Array, step: pa.Array) -> Iterator[pa.Table]:
        s, t = side[0].as_py(), step[0].as_py()
        for item, w, h in zip(*(table.column(c).to_pylist() for c in ("item", "width", "height"))):
            if not w or not h or w < 0 or h < 0:
                continue
            corners = tile_corners(w, h, s, t)
            columns = {c: pa.array(corners[:, i]) for i, c in enumerate(("x0", "y0", "x1", "y1"))}
            yield pa.table({"item": pa.array([item] * len(corners), pa.int64()), "place": pa.array(np.arange(len(corners)), pa.int32()), **columns})


def register(spark: SparkSession) -> None:
    """suppressed and tiles as functions of spark's SQL."""
    spark.udtf.register("suppressed", Suppressed)
    spark.udtf.register("tiles", Tiles)
