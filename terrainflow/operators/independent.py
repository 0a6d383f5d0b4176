"""Greedy thinning of points by distance, in order of priority, as rounds of joins.

Sequential greedy keeps the strongest point, drops all that conflict with it, and goes on. The same set comes out of
rounds in which every point without a stronger live neighbour is kept and its neighbours are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainflow.operators.iterate import cut_lineage

MAX_ROUNDS = 200


def near_pairs(points: DataFrame, distance: float, strict: bool) -> DataFrame:
    """points (site_id, id, priority, x, y) -> pairs with the weaker first: site_id, id, other, place (scan order of the other's bin).

    Bins of the distance turn the range join into an equality join with 3 x 3 bins.
    """
    bx, by = F.floor(F.col("x") / distance), F.floor(F.col("y") / distance)
    binned = points.withColumns({"bx": bx, "by": by})
    offsets = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit((i + 1) * 3 + j + 1).alias("place")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    probes = binned.withColumn("o", F.explode(offsets)).select("site_id", "id", "priority", "x", "y", (F.col("bx") + F.col("o.dx")).alias("bx"), (F.col("by") + F.col("o.dy")).alias("by"), "o.place")
    there = binned.select("site_id", "bx", "by", F.col("id").alias("other"), F.col("priority").alias("p2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    square = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    close = square < distance * distance if strict else square <= distance * distance
    return probes.hint("merge").join(there, ["site_id", "bx", "by"]).where((F.col("p2") < F.col("priority")) & close).select("site_id", "id", "other", "place", F.col("p2").alias("other_priority"))


def thin(points: DataFrame, distance: float, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept: site_id, id; dropped: site_id, id, because): priority is unique in a site, the smallest is strongest.

    because: the kept point in conflict that a scan of bins west to east, south to north, then by priority meets first.
    """
    points = cut_lineage(points.select("site_id", "id", "priority", "x", "y"))
    pairs = cut_lineage(near_pairs(points, distance, strict))
    state = points.select("site_id", "id", F.lit(None).cast("boolean").alias("kept"))
    kept = None
    for _ in range(MAX_ROUNDS):
        live = state.where("kept is null").select("site_id", "id")
        live_pairs = pairs.join(live.hint("merge"), ["site_id", "id"], "left_semi").join(live.withColumnRenamed("id", "other").hint("merge"), ["site_id", "other"], "left_semi")
        strong = cut_lineage(live.join(live_pairs.select("site_id", "id").distinct().hint("merge"), ["site_id", "id"], "left_anti"))
        kept = strong if kept is None else kept.unionByName(strong)
        gone = pairs.join(strong.withColumnRenamed("id", "other").hint("merge"), ["site_id", "other"], "left_semi").select("site_id", "id").distinct().withColumn("_gone", F.lit(True))
        state = state.join(strong.withColumn("_strong", F.lit(True)).hint("merge"), ["site_id", "id"], "left").join(gone.hint("merge"), ["site_id", "id"], "left")
        state = cut_lineage(state.select("site_id", "id", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("_strong"), True).when(F.col("_gone"), False).alias("kept")))
        if state.where("kept is null").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("thinning did not settle")
    kept = state.where("kept").select("site_id", "id")
    first = pairs.join(kept.withColumnRenamed("id", "other").hint("merge"), ["site_id", "other"], "left_semi").groupBy("site_id", "id").agg(F.min_by("other", F.struct("place", "other_priority")).alias("because"))
    return kept, state.where("not kept").select("site_id", "id").join(first.hint("merge"), ["site_id", "id"])
