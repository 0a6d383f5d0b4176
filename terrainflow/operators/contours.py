"""Contours: diagnostics, lengths, samples, and grids from samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrainflow.operators.iterate import cut_lineage
from terrainflow.operators.numbering import numbered
from terrainflow.operators.selection import exact_quantiles


def contour_points(contours: DataFrame) -> DataFrame:
    """contours -> site_id, contour_id, seq, x, y, elevation_m; points that are not finite are left out."""
    out = contours.select("site_id", "contour_id", "elevation_m", F.posexplode("coords").alias("seq", "p")).select("site_id", "contour_id", "seq", "p.x", "p.y", "elevation_m")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return out.where(finite("x") & finite("y") & finite("elevation_m"))


def contour_lengths(points: DataFrame) -> DataFrame:
    """site_id, contour_id, length_m of each polyline."""
    w = Window.partitionBy("site_id", "contour_id").orderBy("seq")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    return points.withColumn("d", F.sqrt(dx * dx + dy * dy)).groupBy("site_id", "contour_id").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length_m"))


def contour_diagnostics(contours: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """One row a site: count, distinct levels and their frequency, range, mean, median, deviation, intervals, lengths."""
    level = F.round("elevation_m", 6)
    counted = contours.withColumn("level", level).groupBy("site_id", "level").agg(F.count("*").alias("n"))
    gap = counted.withColumn("gap", F.col("level") - F.lag("level").over(Window.partitionBy("site_id").orderBy("level")))
    levels = gap.groupBy("site_id").agg(
        F.count("*").alias("unique_elevation_count"), F.sort_array(F.collect_list("level")).alias("levels"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "n")))).alias("frequency"),
        F.coalesce(F.min("gap"), F.lit(0.0)).alias("interval_min_m"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("interval_mean_m"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("interval_max_m"),
    )
    e = F.col("elevation_m")
    whole = contours.groupBy("site_id").agg(F.count("*").alias("contour_count"), F.min(e).alias("elevation_min_m"), F.max(e).alias("elevation_max_m"), F.avg(e).alias("elevation_mean_m"), F.stddev_pop(e).alias("elevation_std_m"))
    whole = whole.join(exact_quantiles(contours, "elevation_m", (0.5,)).select("site_id", F.col("q")[0].alias("elevation_median_m")), "site_id", "left")
    points = contour_points(contours) if points is None else points
    lengths = contour_lengths(points).groupBy("site_id").agg(F.min("length_m").alias("length_min_m"), F.avg("length_m").alias("length_mean_m"), F.max("length_m").alias("length_max_m"))
    box = points.groupBy("site_id").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return whole.join(levels, "site_id").join(lengths, "site_id", "left").join(box, "site_id", "left")


def distinct_samples(points: DataFrame) -> DataFrame:
    """The first sample of each (x, y) in input order, with seq from 0 in that order."""
    first = points.groupBy("site_id", "x", "y").agg(F.min(F.struct("contour_id", "seq", "elevation_m")).alias("f"))
    placed = numbered(first, "place", ["f.contour_id", "f.seq"])
    return placed.select("site_id", "x", "y", F.col("f.elevation_m").alias("elevation_m"), (F.col("place") - 1).cast("int").alias("sample"))


def make_grid(box: DataFrame, resolution: float) -> DataFrame:
    """box (site_id, x_min, x_max, y_min, y_max) -> site_id, row, col, x, y: points from the minimum in steps up to max + step; row 0 is the lowest y."""
    steps = lambda a, b: F.ceil((F.col(b) + resolution - F.col(a)) / resolution).cast("int")
    sized = box.withColumns({"cols": steps("x_min", "x_max"), "rows": steps("y_min", "y_max")}).where("cols >= 2 and rows >= 2")
    rows = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    return cells.select("site_id", "row", "col", (F.col("x_min") + F.col("col") * resolution).alias("x"), (F.col("y_min") + F.col("row") * resolution).alias("y"))


def nearest_samples(cells: DataFrame, samples: DataFrame, k: int, bin_size: float) -> DataFrame:
    """cells with near: the k nearest samples (distance, sample, x, y, elevation_m), ties by the lower sample.

    Bins of growing size: a cell is done when its k-th sample is nearer than the ring of bins that was searched; only
    the others go on, with bins twice as large, until all are done. Samples that are fewer than k end the search; a site
    without any has null. The planner takes rows that `explode` makes for the rows it has, so joins with them ask for a merge:
    a broadcast of nine rows a cell would meet on the driver.
    """
    total = samples.groupBy("site_id").agg(F.count("*").alias("_total"))
    left = cells.join(total, "site_id", "left").select("site_id", "row", "col", "x", "y", F.coalesce("_total", F.lit(0)).alias("_total"))
    done = None
    offsets = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    while True:
        binned = samples.select("site_id", "sample", F.col("x").alias("sx"), F.col("y").alias("sy"), "elevation_m", F.floor(F.col("x") / bin_size).alias("bx"), F.floor(F.col("y") / bin_size).alias("by"))
        probes = left.withColumn("o", F.explode(offsets)).withColumns({"bx": F.floor(F.col("x") / bin_size) + F.col("o.dx"), "by": F.floor(F.col("y") / bin_size) + F.col("o.dy")}).drop("o")
        square = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
        pairs = probes.hint("merge").join(binned.hint("merge"), ["site_id", "bx", "by"]).withColumn("d2", square)
        order = Window.partitionBy("site_id", "row", "col").orderBy("d2", "sample")
        best = pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
        near = best.groupBy("site_id", "row", "col").agg(F.array_sort(F.collect_list(F.struct("d2", "sample", F.col("sx").alias("x"), F.col("sy").alias("y"), "elevation_m"))).alias("near"))
        state = cut_lineage(left.join(near.hint("merge"), ["site_id", "row", "col"], "left"))
        enough = (F.size("near") >= F.least(F.lit(k), F.col("_total"))) & (F.element_at("near", -1).d2 <= bin_size * bin_size)
        everything = F.coalesce(F.size("near"), F.lit(0)) >= F.col("_total")
        ok = F.coalesce(enough | everything, F.lit(False))
        done = state.where(ok) if done is None else done.unionByName(state.where(ok))
        left = state.where(~ok).drop("near")
        if left.limit(1).count() == 0:
            break
        bin_size *= 2
    return done.drop("_total")


def grid_nearest(cells: DataFrame, samples: DataFrame, bin_size: float) -> DataFrame:
    """cells with the elevation of the nearest sample, the lower sample on ties."""
    near = nearest_samples(cells, samples, 1, bin_size)
    return near.select("site_id", "row", "col", "x", "y", F.element_at("near", 1).elevation_m.alias("elevation"))


def grid_planar(cells: DataFrame, samples: DataFrame, bin_size: float, k: int = 8) -> DataFrame:
    """cells with the plane through the nearest three samples that are not in line, where the cell lies in their triangle; else the nearest sample.

    Not a Delaunay interpolation: equal to it on planes, close elsewhere.
    """
    near = nearest_samples(cells, samples, k, bin_size)
    a, b = F.element_at("near", 1), F.element_at("near", 2)
    cross = lambda p: (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)
    third = F.get(F.filter(F.slice("near", 3, k), lambda p: F.abs(cross(p)) > 1e-9), F.lit(0))
    w = near.withColumns({"a": a, "b": b}).withColumn("c", F.when(F.size("near") >= 3, third))
    det = (F.col("b.y") - F.col("c.y")) * (F.col("a.x") - F.col("c.x")) + (F.col("c.x") - F.col("b.x")) * (F.col("a.y") - F.col("c.y"))
    l1 = ((F.col("b.y") - F.col("c.y")) * (F.col("x") - F.col("c.x")) + (F.col("c.x") - F.col("b.x")) * (F.col("y") - F.col("c.y"))) / det
    l2 = ((F.col("c.y") - F.col("a.y")) * (F.col("x") - F.col("c.x")) + (F.col("a.x") - F.col("c.x")) * (F.col("y") - F.col("c.y"))) / det
    w = w.withColumns({"l1": F.when(F.col("c").isNotNull() & (det != 0), l1), "l2": F.when(F.col("c").isNotNull() & (det != 0), l2)}).withColumn("l3", 1 - F.col("l1") - F.col("l2"))
    inside = F.least("l1", "l2", "l3") >= -1e-9
    plane = F.col("l1") * F.col("a.elevation_m") + F.col("l2") * F.col("b.elevation_m") + F.col("l3") * F.col("c.elevation_m")
    return w.select("site_id", "row", "col", "x", "y", F.when(F.coalesce(inside, F.lit(False)), plane).otherwise(F.col("a.elevation_m")).alias("elevation"))
