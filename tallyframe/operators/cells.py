"""Boxes on grids whose cells follow the boxes' own size, so that only neighbours are compared, however large or dense the plane is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.storage import release, written

#: Rows of the dealt side that one key of a join holds at most, on average, in one task.
BLOCK = 2048
SPAN = ("x0", "x1", "y0", "y1")


def spanned(boxes: DataFrame, keys: list[str], left: Column, right: Column, top: Column, bottom: Column, columns: int = 1) -> DataFrame:
    """boxes, written, with the first and last column (x0, x1) and row (y0, y1) of cells that they touch, null without a place,
    and a cell's size (cell_w, cell_h).

    A key's cell is its mean box, or one of so many columns of it. Where wide boxes are the high ones it is stretched, so that n
    boxes touch 3 (2 + columns) n cells at most.
    """
    wide, high = (right - left).alias("wide"), (bottom - top).alias("high")
    sizes = boxes.select(*keys, wide, high).groupBy(*keys).agg(F.avg("wide").alias("w"), F.avg("high").alias("h"), F.avg(F.col("wide") * F.col("high")).alias("area"))
    # boxes without width or height touch one column or row, whatever its size
    some = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0)
    stretch = F.sqrt(F.greatest(F.lit(1.0), F.col("area") / some("w") / some("h")))
    grid = written(sizes.select(*keys, (some("w") * stretch / columns).alias("cell_w"), (some("h") * stretch).alias("cell_h")), "grid")
    at = lambda c, size: F.floor(c / F.col(size))
    ends = (at(left, "cell_w"), at(right, "cell_w"), at(top, "cell_h"), at(bottom, "cell_h"))
    known = (left + right + top + bottom).isNotNull()
    out = written(boxes.join(grid, keys).select(*boxes.columns, *[F.when(known, e).alias(n) for e, n in zip(ends, SPAN, strict=True)], "cell_w", "cell_h"), "boxes")
    release(grid)
    return out


def touched(boxes: DataFrame) -> DataFrame:
    """A row for each cell (cx, cy) that a spanned box touches."""
    return boxes.withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1")))


def met(many: DataFrame, few: DataFrame, keys: list[str], on: Column) -> DataFrame:
    """Rows of `many` (m) and `few` (f) of equal keys for which `on` holds.

    A key's rows of `few` are dealt to blocks of about BLOCK, and its rows of `many` go to each of them, so no task holds more
    than a block of one key and a crowded key is shared by as many tasks as it has blocks. Nothing is broadcast on a guess.
    """
    crowds = few.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    crowds = written(crowds.select(*keys, F.ceil(F.col("n") / BLOCK).alias("__blocks")), "crowds")
    blocks = F.coalesce("__blocks", F.lit(1))
    dealt = few.join(crowds, keys, "left").withColumn("__block", F.pmod(F.xxhash64(*few.columns), blocks)).drop("__blocks")
    sent = many.join(crowds, keys, "left").withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("__blocks")
    together = [*keys, "__block"]
    n = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # what a task makes does not follow from the size of what it reads
    m, f = sent.repartition(n, *together).alias("m"), dealt.repartition(n, *together).alias("f")
    for k in together:
        on = (F.col(f"m.{k}") == F.col(f"f.{k}")) & on
    return m.join(f.hint("merge"), on)
