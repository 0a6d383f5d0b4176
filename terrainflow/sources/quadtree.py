"""Boxes in a loose quadtree: joins of features with boxes of any size, and a Parquet layout that box reads prune."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of level k are squares of 1024 / 2^k degrees from -512 on: sizes are powers of two, so quotients are exact.
WORLD, ORIGIN, DEEPEST = 1024.0, -512.0, 24
#: Boxes reach back by a cell, and a little for rounded differences.
REACH = 1.0001


def _size(level: Column) -> Column:
    return F.lit(WORLD) / F.pow(F.lit(2.0), level)


def _index(value: Column, size: Column) -> Column:
    return F.floor((value - ORIGIN) / size).cast("bigint")


def box_level(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The deepest level whose cells are no smaller than the box; null for boxes with a null, a NaN, swapped sides or places beyond 512 degrees."""
    extent = F.greatest(east - west, north - south)
    fit = F.size(F.filter(F.array(*[F.lit(WORLD / 2**k) for k in range(DEEPEST + 1)]), lambda s: s >= extent)) - 1
    inside = (west >= ORIGIN) & (south >= ORIGIN) & (east < -ORIGIN) & (north < -ORIGIN) & (west <= east) & (south <= north)
    return F.when(inside, fit)


def _interleave(value: Column) -> Column:
    """Bits of a number below 2^25 at the even places."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return value


def features_in_boxes(features: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each feature (west, south, east, north, ...) that touches a box (request_id, west, south, east, north), with its request_id.

    A feature lies in the cell of its south-west corner, at the level of its size: one row for each level that boxes have at or
    above its own. A box looks in the cells of its own level (all smaller features, 4 x 4 cells at most) and of each level above
    (the features of that level, 3 x 3 at most), so neither a large box nor a large feature is cut into more rows than that.
    A pair meets in one cell only: results need no distinct, and repeated rows stay repeated. Boxes that are empty, swapped, null
    or beyond 512 degrees touch nothing, and features likewise. The levels of the boxes and those of the features, 25 each at
    most, are read by the driver; boxes look at levels only that features have. The join asks for a merge: the planner does not
    count the cells that boxes explode to and would broadcast them.
    """
    sides = ("west", "south", "east", "north")
    asked = boxes.select("request_id", *[F.col(c).cast("double").alias(f"_{c}") for c in sides])
    asked = asked.withColumn("_q", box_level(*[F.col(f"_{c}") for c in sides])).where("_q is not null")
    levels = sorted(r[0] for r in asked.select("_q").distinct().collect())
    placed = features.withColumn("_f", box_level(*[F.col(c).cast("double") for c in sides])).where("_f is not null")
    there = sorted(r[0] for r in placed.select("_f").distinct().collect())
    looks = F.array(F.struct(F.col("_q").alias("k"), F.lit(False).alias("own")))
    if there:
        own = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(True).alias("own")) for k in there])
        looks = F.concat(F.filter(own, lambda e: e.k <= F.col("_q")), looks)
    asked = asked.withColumn("_e", F.explode(looks)).select("*", F.col("_e.k").alias("_k"), F.col("_e.own").alias("_own")).withColumn("_s", _size(F.col("_k")))
    last = F.pow(F.lit(2.0), F.col("_k")).cast("bigint") - 1
    span = lambda low, high: F.sequence(_index(F.greatest(low - REACH * F.col("_s"), F.lit(ORIGIN)), F.col("_s")), F.least(_index(high, F.col("_s")), last))
    asked = asked.withColumn("_bx", F.explode(span(F.col("_west"), F.col("_east")))).withColumn("_by", F.explode(span(F.col("_south"), F.col("_north")))).drop("_e", "_s", "_q")

    above = F.filter(F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>"), lambda k: k < F.col("_f"))
    placed = placed.withColumn("_k", F.explode(F.concat(F.array("_f"), above))).withColumn("_own", F.col("_k") == F.col("_f"))
    placed = placed.withColumns({"_bx": _index(F.col("west"), _size(F.col("_k"))), "_by": _index(F.col("south"), _size(F.col("_k")))})
    hit = placed.hint("merge").join(asked.hint("merge"), ["_k", "_own", "_bx", "_by"]).where("west <= _east and east >= _west and south <= _north and north >= _south")
    return hit.select(*features.columns, "request_id")


def write_features(features: DataFrame, path: str) -> None:
    """Features as Parquet by level (a folder each), sorted by the Morton code of their cell; features without a box are left out."""
    placed = features.withColumn("level", box_level(*[F.col(c).cast("double") for c in ("west", "south", "east", "north")])).where("level is not null")
    at = [_interleave(_index(F.col(c), _size(F.col("level")))) for c in ("west", "south")]
    coded = placed.withColumn("code", at[0].bitwiseOR(F.shiftleft(at[1], 1)))
    coded.repartitionByRange("level", "code").sortWithinPartitions("level", "code").write.mode("overwrite").partitionBy("level").parquet(path)


def _morton(x: int, y: int) -> int:
    return sum(((x >> b & 1) << 2 * b) | ((y >> b & 1) << 2 * b + 1) for b in range(DEEPEST + 1))


def code_ranges(box: tuple[float, float, float, float], level: int) -> list[tuple[int, int]]:
    """Ranges of codes of a level (both ends included) that hold all its features which touch a box (west, south, east, north).

    The box, with a cell before it, is covered by at most 4 x 4 squares of one size; squares in a row are one range.
    """
    west, south, east, north = box
    size = WORLD / 2**level
    low = [max(0, math.floor((v - REACH * size - ORIGIN) / size)) for v in (west, south)]
    high = [min(2**level - 1, math.floor((v - ORIGIN) / size)) for v in (east, north)]
    if high[0] < low[0] or high[1] < low[1]:
        return []
    up = 0
    while max(h - a for a, h in zip(low, high, strict=True)) >> up > 2:
        up += 1
    squares = sorted(_morton(x, y) for x in range(low[0] >> up, (high[0] >> up) + 1) for y in range(low[1] >> up, (high[1] >> up) + 1))
    out: list[tuple[int, int]] = []
    for s in squares:
        first, last = s << 2 * up, ((s + 1) << 2 * up) - 1
        if out and out[-1][1] + 1 == first:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def read_features(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Features that `write_features` stored and that touch a box. Folders of levels and ranges of codes prune the scan."""
    stored = spark.read.parquet(path)
    near = F.lit(False)
    for level in range(DEEPEST + 1):
        codes = F.lit(False)
        for first, last in code_ranges(box, level):
            codes = codes | F.col("code").between(first, last)
        near = near | ((F.col("level") == level) & codes)
    west, south, east, north = box
    touches = (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    return stored.where(touches & near).drop("level", "code")
