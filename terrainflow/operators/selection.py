"""Exact percentiles of groups of any size, by brackets around the wanted ranks that shrink pass by pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrainflow.operators.iterate import cut_lineage

#: Brackets of at most so many rows are sorted as they are (80 kB each); larger ones are cut at PIVOTS of their own values.
SORTED = 10_000
PIVOTS = 63
MAX_ROUNDS = 64


def exact_quantiles(values: DataFrame, column: str, probabilities: Sequence[float], by: str = "site_id", most: int = SORTED) -> DataFrame:
    """values -> by, q: the percentiles of each group as an array, linear between ranks, as `percentile` gives them.

    `percentile` holds the values of a group in one task. Here a wanted rank starts with its whole group as bracket. Larger
    brackets than `most` are cut at sketched percentiles of their rows; exact counts tell which piece holds the rank, and how
    many rows lie before. Values equal to a pivot are a piece of their own, so ties end at once and each pass shrinks a bracket,
    by about PIVOTS where values differ. Nulls are left out, a group without values gives no row, NaN is the largest value.
    """
    rows = cut_lineage(values.where(F.col(column).isNotNull()).select(by, F.col(column).cast("double").alias("v")))
    whole = rows.groupBy(by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = [F.lit(float(p)) * (F.col("n") - 1) for p in probabilities]
    ranks = F.array_distinct(F.array(*[f(p) for p in place for f in (F.floor, F.ceil)]))
    targets = cut_lineage(whole.select(by, "n", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("bigint").alias("before"), F.col("n").alias("size")))
    bracket = [by, "lo", "hi"]
    settled = None
    for _ in range(MAX_ROUNDS):
        small = (F.col("size") <= most) | F.col("lo").eqNullSafe(F.col("hi"))
        done = targets.where(small)
        settled = done if settled is None else settled.unionByName(done)
        wide = targets.where(~small)
        if wide.isEmpty():
            break
        inside = lambda brackets: rows.join(brackets, by).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        share = F.array(*[F.lit((k + 1) / (PIVOTS + 1)) for k in range(PIVOTS)])
        pivots = cut_lineage(inside(wide.select(*bracket).distinct()).groupBy(*bracket).agg(F.percentile_approx("v", share, 10_000).alias("pivots")))
        below = F.size(F.filter("pivots", lambda x: x < F.col("v")))
        piece = below + F.size(F.filter("pivots", lambda x: x <= F.col("v")))
        pieces = inside(pivots).groupBy(*bracket, piece.alias("piece")).agg(F.count("*").alias("n_piece"), F.min("v").alias("lo_piece"), F.max("v").alias("hi_piece"))
        earlier = Window.partitionBy(*bracket).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        pieces = pieces.withColumn("skip", F.coalesce(F.sum("n_piece").over(earlier), F.lit(0)))
        at = F.col("rank") - F.col("before") - F.col("skip")
        hit = wide.join(pieces, bracket).where((at >= 0) & (at < F.col("n_piece")))
        targets = cut_lineage(hit.select(by, "n", "rank", F.col("lo_piece").alias("lo"), F.col("hi_piece").alias("hi"), (F.col("before") + F.col("skip")).alias("before"), F.col("n_piece").alias("size")))
    else:
        raise RuntimeError("percentiles did not settle")
    equal = F.col("lo").eqNullSafe(F.col("hi"))
    alike = settled.where(equal).select(by, "n", "rank", F.col("lo").alias("v"))
    rest = settled.where(~equal)
    ordered = rows.join(rest.select(*bracket).distinct(), by).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    ordered = ordered.groupBy(*bracket).agg(F.array_sort(F.collect_list("v")).alias("sorted"))
    picked = rest.join(ordered, bracket).select(by, "n", "rank", F.get("sorted", (F.col("rank") - F.col("before")).cast("int")).alias("v"))
    found = alike.unionByName(picked).groupBy(by, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def between(p):
        low, high = F.floor(p), F.ceil(p)
        a, b = F.col("at")[low], F.col("at")[high]
        return F.when(a.eqNullSafe(b), a).otherwise((high - p) * a + (p - low) * b)

    return found.select(by, F.array(*[between(p) for p in place]).alias("q"))
