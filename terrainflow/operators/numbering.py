"""Row numbers of groups of any size, in two levels: places inside range partitions, and how many rows lie before each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrainflow.operators.iterate import cut_lineage


def numbered(rows: DataFrame, name: str, order: Sequence[Column | str], by: str = "site_id") -> DataFrame:
    """Adds `name` (long, from 1): the place of each row in its group by `order`, as row_number gives it.

    A window over a group would sort it in one task. Here rows are dealt to range partitions of (group, order), so a large
    group spans many; each part of a group is sorted alone, and the counts of the parts before it are added. Those counts are
    one row for each part. Rows that tie in `order` share a part, so an order that tells rows apart keeps parts small.
    A null group is a group; an empty table stays empty.
    """
    placed = cut_lineage(rows.repartitionByRange(F.col(by), *order).withColumn("_part", F.spark_partition_id()))
    part = [F.struct(by).alias("_group"), "_part"]  # structs are equal where their nulls are
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*part).agg(F.count("*").alias("_n")).select("_group", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = placed.withColumn("_group", part[0]).withColumn("_place", F.row_number().over(Window.partitionBy("_group", "_part").orderBy(*order)))
    return inside.join(offsets, ["_group", "_part"]).withColumn(name, F.col("_place") + F.col("_before")).drop("_group", "_part", "_place", "_before")
