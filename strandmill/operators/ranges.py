"""Ranks and range counts over sorted positions, without one task for a chromosome.

Positions are cut into bins of a width; within a bin rows are numbered, and the bins before give the offset. Bins are
few (a chromosome's length by the width), so the window over them is small whatever the number of rows is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16


def _offsets(sizes: DataFrame, by: list[str], out: str) -> DataFrame:
    """(by, bin, n) -> (by, bin, out): what the bins before hold."""
    before = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*by, "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(out))


def rank_by_position(rows: DataFrame, by: list[str], position: str, order: list[Column | str], out: str = "ord", width: int = WIDTH) -> DataFrame:
    """Adds the row's place, from 1, among those of equal `by` in order of position, then `order`."""
    binned = rows.withColumn("bin", F.floor(F.col(position) / width))
    offsets = _offsets(binned.groupBy(*by, "bin").agg(F.count("*").alias("n")), by, "offset")
    inside = F.row_number().over(Window.partitionBy(*by, "bin").orderBy(position, *order))
    placed = binned.withColumn(out, inside).join(offsets, [*by, "bin"])
    return placed.withColumn(out, F.col(out) + F.col("offset")).drop("bin", "offset")


def count_within(loci: DataFrame, points: DataFrame, by: list[str], key: str, start: str, position: str, reach: int, width: int = WIDTH) -> DataFrame:
    """(key, by, n): points of equal `by` with a position within reach of the locus' start, both ends included.

    Two ends of each locus and all points are sorted together bin by bin; a point counts one, and the running sum at
    the upper end less that at the lower end is the number wanted. No pair of a locus and a point is made.
    """
    # At one position: lower ends first, then points, then upper ends.
    ends = loci.select(*by, key, F.explode(F.array(F.struct((F.col(start) - reach).alias("at"), F.lit(0).alias("turn")), F.struct((F.col(start) + reach).alias("at"), F.lit(2).alias("turn")))).alias("e"))
    ends = ends.select(*by, key, F.col("e.at").cast("long").alias("at"), F.col("e.turn").alias("turn"))
    marks = points.select(*by, F.lit(None).cast(loci.schema[key].dataType).alias(key), F.col(position).cast("long").alias("at"), F.lit(1).alias("turn"))
    events = ends.unionByName(marks).withColumn("bin", F.floor(F.col("at") / width))
    point = (F.col("turn") == 1).cast("long")
    offsets = _offsets(events.groupBy(*by, "bin").agg(F.sum(point).alias("n")), by, "offset")
    running = F.sum(point).over(Window.partitionBy(*by, "bin").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0))
    seen = events.withColumn("seen", running).where("turn <> 1").join(offsets, [*by, "bin"])
    total = F.col("seen") + F.col("offset")
    return seen.groupBy(key, *by).agg(F.sum(F.when(F.col("turn") == 2, total).otherwise(-total)).alias("n"))


def counts_before(marks: DataFrame, points: DataFrame, by: list[str], position: str, width: int = WIDTH) -> DataFrame:
    """Adds n to marks: points of equal `by` before the mark's place `at` (turn 0), or at or before it (turn 2).

    Marks and points are sorted together bin by bin, as in `count_within`.
    """
    own = [c for c in marks.columns if c not in by]
    marked = marks.select(*by, F.struct(*own).alias("mark"), F.col("at").cast("long").alias("_at"), F.col("turn").alias("_turn"))
    none = F.lit(None).cast(marked.schema["mark"].dataType)
    dots = points.select(*by, none.alias("mark"), F.col(position).cast("long").alias("_at"), F.lit(1).alias("_turn"))
    events = marked.unionByName(dots).withColumn("bin", F.floor(F.col("_at") / width))
    point = (F.col("_turn") == 1).cast("long")
    offsets = _offsets(events.groupBy(*by, "bin").agg(F.sum(point).alias("n")), by, "offset")
    running = F.sum(point).over(Window.partitionBy(*by, "bin").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0))
    seen = events.withColumn("seen", running).where("_turn <> 1").join(offsets, [*by, "bin"])
    return seen.select(*by, "mark.*", (F.col("seen") + F.col("offset")).alias("n"))
