"""Quality figures of elevation grids, hydrology and catchments: one row a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrainflow.functions.scores import clamp
from terrainflow.operators.iterate import cut_lineage
from terrainflow.operators.selection import exact_quantiles

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
MAX_VERTICES = 200_000


def _share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def elevation_stats(cells: DataFrame) -> DataFrame:
    """Min, max, mean, median, population deviation and p01 to p99 of valid elevations (linear between ranks)."""
    agg = cells.where("elevation is not null").groupBy("site_id").agg(F.min("elevation").alias("min_m"), F.max("elevation").alias("max_m"), F.avg("elevation").alias("mean_m"), F.stddev_pop("elevation").alias("std_m"))
    agg = agg.join(exact_quantiles(cells, "elevation", PERCENTILES), "site_id")
    return agg.select("site_id", "min_m", "max_m", "mean_m", "std_m", F.col("q")[3].alias("median_m"), *[F.col("q")[k].alias(f"p{int(100 * p):02d}_m") for k, p in enumerate(PERCENTILES)])


def local_change(cells: DataFrame) -> DataFrame:
    """Absolute difference to the right and lower neighbours: mean, max, p95; zeros where no pair is valid."""
    right = cells.select("site_id", "row", (F.col("col") - 1).alias("col"), F.col("elevation").alias("z2"))
    lower = cells.select("site_id", (F.col("row") - 1).alias("row"), "col", F.col("elevation").alias("z2"))
    pairs = cells.select("site_id", "row", "col", "elevation").join(right.unionByName(lower).hint("merge"), ["site_id", "row", "col"])
    change = cut_lineage(pairs.select("site_id", F.abs(F.col("elevation") - F.col("z2")).alias("d")).where("d is not null"))
    found = change.groupBy("site_id").agg(F.avg("d").alias("mean_change_m"), F.max("d").alias("max_change_m"))
    found = found.join(exact_quantiles(change, "d", (0.95,)).select("site_id", F.col("q")[0].alias("p95_change_m")), "site_id")
    sites = cells.select("site_id").distinct()
    return sites.join(found, "site_id", "left").fillna(0.0, ["mean_change_m", "max_change_m", "p95_change_m"])


def slope_stats(cells: DataFrame) -> DataFrame:
    """Min, mean, max, p05, median and p95 of valid slopes (linear between ranks)."""
    agg = cells.where("slope is not null").groupBy("site_id").agg(F.min("slope").alias("min_slope"), F.avg("slope").alias("mean_slope"), F.max("slope").alias("max_slope"))
    agg = agg.join(exact_quantiles(cells, "slope", (0.05, 0.5, 0.95)), "site_id")
    return agg.select("site_id", "min_slope", "mean_slope", "max_slope", F.col("q")[0].alias("p05_slope"), F.col("q")[1].alias("median_slope"), F.col("q")[2].alias("p95_slope"))


def gradient_stats(cells: DataFrame) -> DataFrame:
    g = F.col("gradient")
    return cells.where(g.isNotNull()).groupBy("site_id").agg(F.avg(g).alias("mean_gradient"), F.max(g).alias("max_gradient"), _share(g > 1.0).alias("extreme_fraction"), _share(g < 1e-3).alias("flat_fraction"))


def terrain_summary(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """rows, cols, elevation range and mean, mean and max slope over valid cells, valid fraction, area of the whole grid."""
    valid = F.col("elevation").isNotNull() & F.col("slope").isNotNull() & F.col("gradient").isNotNull()
    agg = cells.groupBy("site_id").agg(
        F.min("elevation").alias("min_elevation"), F.max("elevation").alias("max_elevation"), F.avg("elevation").alias("mean_elevation"),
        F.avg(F.when(valid, F.col("slope"))).alias("mean_slope"), F.max(F.when(valid, F.col("slope"))).alias("max_slope"), F.sum(valid.cast("int")).alias("_valid"),
    )
    area = F.col("rows") * F.col("cols") * F.col("resolution_m") * F.col("resolution_m")
    out = agg.join(meta, "site_id").withColumns({"valid_fraction": F.col("_valid") / (F.col("rows") * F.col("cols")), "area_m2": area, "area_ha": area / 1e4, "area_km2": area / 1e6})
    return out.drop("_valid")


def preprocess_summary(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Counts of total, valid and missing cells, range, warnings; error where nothing is valid."""
    z = F.col("elevation")
    agg = cells.groupBy("site_id").agg(F.count(z).alias("valid_cells"), F.min(z).alias("min_elevation"), F.max(z).alias("max_elevation")).join(meta, "site_id")
    total, share = F.col("rows") * F.col("cols"), F.col("valid_fraction")
    out = agg.withColumns({"total_cells": total, "invalid_cells": total - F.col("valid_cells"), "valid_fraction": F.col("valid_cells") / total})
    warnings = F.array_compact(F.array(F.when(share < 1, "some cells have no data"), F.when(share < 0.5, "most cells have no data"), F.when(F.col("min_elevation") == F.col("max_elevation"), "the surface is flat")))
    return out.withColumns({"warnings": warnings, "error": F.when(F.col("valid_cells") == 0, "no valid cell")})


def lowest_cell(cells: DataFrame) -> DataFrame:
    """Lowest valid cell of each site, the first in row-major order on ties."""
    low = F.min_by(F.struct("row", "col", "elevation"), F.struct("elevation", "row", "col"))
    return cells.where("elevation is not null").groupBy("site_id").agg(low.alias("c")).select("site_id", "c.row", "c.col", "c.elevation")


def contour_consistency(cells: DataFrame, vertices: DataFrame, grid: DataFrame, most: int = MAX_VERTICES) -> DataFrame:
    """vertices (site_id, seq, x, y, elevation_m) against the nearest cell; grid: site_id, x0, y0, resolution_m, rows, cols.

    The grid is regular, so the nearest cell is a rounded quotient. Over `most` vertices a site is judged on those with
    the smallest hash, as its check is a sample by design.
    """
    snap = lambda v, origin, n: F.greatest(F.lit(0), F.least(n - 1, F.floor((v - origin) / F.col("resolution_m") + 0.5))).cast("int")
    order = Window.partitionBy("site_id").orderBy(F.xxhash64("seq", "x", "y"), "seq")
    v = vertices.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n").join(grid, "site_id")
    v = v.select("site_id", snap(F.col("y"), F.col("y0"), F.col("rows")).alias("row"), snap(F.col("x"), F.col("x0"), F.col("cols")).alias("col"), "elevation_m")
    error = v.join(cells.select("site_id", "row", "col", "elevation"), ["site_id", "row", "col"]).select("site_id", (F.col("elevation") - F.col("elevation_m")).alias("e")).where("e is not null")
    size = F.abs("e")
    agg = error.groupBy("site_id").agg(F.count("*").alias("sampled_points"), F.avg(size).alias("mae_m"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse_m"), F.max(size).alias("max_error_m"), _share(size <= 1).alias("within_1m"), _share(size <= 5).alias("within_5m"))
    score = clamp(F.col("within_1m") + 0.5 * F.greatest(F.col("within_5m") - F.col("within_1m"), F.lit(0.0)))
    return agg.withColumn("contour_score", score)


def dem_score(df: DataFrame) -> DataFrame:
    """valid_fraction, nan_fraction, contour_score, extreme_fraction -> dem_score, dem_status, dem_warnings."""
    score = clamp(0.30 * clamp(F.col("valid_fraction")) + 0.20 * clamp(1 - F.col("nan_fraction")) + 0.40 * F.col("contour_score") + 0.10 * clamp(1 - F.col("extreme_fraction")))
    status = F.when(F.col("dem_score") >= 0.90, "good").when(F.col("dem_score") >= 0.75, "acceptable").when(F.col("dem_score") >= 0.50, "poor").otherwise("invalid")
    warnings = [
        F.when(F.col("valid_fraction") < 0.95, "less than 95 % of the cells are valid"),
        F.when(F.col("nan_fraction") > 0, "there are cells without data"),
        F.when(F.col("extreme_fraction") > 0.01, "more than 1 % of the gradients are extreme"),
        F.when(F.col("contour_score") < 0.90, "the grid departs from the contours"),
        F.when(F.col("dem_status") == "invalid", "the grid is not fit for use"),
    ]
    return df.withColumn("dem_score", score).withColumn("dem_status", status).withColumn("dem_warnings", F.array_compact(F.array(*warnings)))


def hydrology_quality(flow: DataFrame, accumulation: DataFrame, outlets: DataFrame, column: str = "elevation", catchment_ok: DataFrame | None = None) -> DataFrame:
    """Checks of directions, accumulation, cycles, sinks, edge outflow and outlet, with score, status and reasons.

    outlets: site_id, row, col, selected. catchment_ok: site_id, area_ok, geometry_ok (optional).
    """
    cells = flow.where(F.col(column).isNotNull()).join(accumulation.hint("merge"), ["site_id", "cell"], "left")
    acc = F.col("accumulation")
    sums = cells.groupBy("site_id").agg(
        F.count("*").alias("valid_cells"),
        F.sum((~F.col("flow_dir").between(-1, 7)).cast("int")).alias("invalid_directions"),
        F.sum(acc.isNull().cast("int")).alias("cycle_cells"),
        F.sum((acc < 1).cast("int")).alias("_low"),
        F.min(acc).alias("min_accumulation"),
        F.max(acc).alias("max_accumulation"),
        F.sum(F.col("sink").cast("int")).alias("sink_cells"),
        F.sum(F.col("edge_outflow").cast("int")).alias("edge_cells"),
    )
    over = cells.join(sums.select("site_id", "valid_cells"), "site_id").where(acc > F.col("valid_cells") + 1e-9).groupBy("site_id").agg(F.count("*").alias("_over"))
    chosen = outlets.where("selected").join(flow.where(F.col(column).isNotNull() & (F.col("flow_dir") < 0)).select("site_id", "row", "col"), ["site_id", "row", "col"], "left_semi").select("site_id", F.lit(True).alias("outlet_ok"))
    out = sums.join(over, "site_id", "left").join(chosen, "site_id", "left")
    if catchment_ok is not None:
        out = out.join(catchment_ok, "site_id", "left")
    else:
        out = out.withColumns({"area_ok": F.lit(True), "geometry_ok": F.lit(True)})
    n = F.col("valid_cells")
    out = out.withColumns({"invalid_accumulation": F.coalesce("_low", F.lit(0)) + F.coalesce("_over", F.lit(0)), "outlet_ok": F.coalesce("outlet_ok", F.lit(False)), "sink_fraction": F.col("sink_cells") / n, "edge_fraction": F.col("edge_cells") / n, "cycle_fraction": F.col("cycle_cells") / n})
    reasons = F.array_compact(
        F.array(
            F.when(F.col("invalid_directions") > 0, "invalid_flow_direction"),
            F.when(F.col("invalid_accumulation") > 0, "invalid_accumulation"),
            F.when(~F.col("outlet_ok"), "missing_outlet"),
            F.when(~F.coalesce("area_ok", F.lit(True)), "invalid_catchment_area"),
            F.when(~F.coalesce("geometry_ok", F.lit(True)), "malformed_catchment_geometry"),
        )
    )
    direction = 1 - F.col("invalid_directions") / n
    finite = F.when(F.col("cycle_cells") + F.col("invalid_accumulation") == 0, 1.0).otherwise((n - F.col("cycle_cells")) / n)
    score = 0.35 * direction + 0.35 * finite + 0.20 * (1 - F.least(2 * F.col("sink_fraction"), F.lit(1.0))) + 0.10 * (1 - F.least(2 * F.col("cycle_fraction"), F.lit(1.0))) - F.least(0.5 * F.col("edge_fraction"), F.lit(0.5))
    quiet = (F.col("sink_cells") == 0) & (F.col("cycle_cells") == 0) & (F.col("edge_fraction") <= 0.5)
    status = F.when(F.size("invalid_reasons") > 0, "invalid").when((F.col("hydrology_score") >= 0.85) & quiet, "good").when(F.col("hydrology_score") >= 0.65, "acceptable").otherwise("poor")
    sink_level = F.when(F.col("sink_fraction") > 0.10, "high").when(F.col("sink_fraction") > 0.03, "moderate").otherwise("low")
    return out.withColumn("invalid_reasons", reasons).withColumn("hydrology_score", clamp(score)).withColumns({"hydrology_status": status, "sink_level": sink_level}).drop("_low", "_over")


def catchment_check(areas: DataFrame, outlets: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """areas (site_id, outlet, cells), outlets (site_id, cell, accumulation_cells) -> with relative difference and area_ok."""
    joined = outlets.select("site_id", F.col("cell").alias("outlet"), "accumulation_cells").join(areas.select("site_id", "outlet", "cells"), ["site_id", "outlet"], "left")
    acc, cells = F.col("accumulation_cells"), F.coalesce("cells", F.lit(0))
    difference = F.when(acc == 0, 1.0).otherwise(F.abs(cells - acc) / F.when(acc == 0, 1.0).otherwise(acc))
    return joined.withColumn("area_difference", difference).withColumn("area_ok", (cells > 0) & (F.col("area_difference") <= tolerance))


def geometry_check(rings: DataFrame) -> DataFrame:
    """rings (site_id, outlet, ring, hole, area_cells, corners) -> site_id, outlet, geometry_ok: outer rings that are closed, of four points, with area."""
    size = F.size("corners")
    ok = (size >= 4) & (F.element_at("corners", 1) == F.element_at("corners", -1)) & (F.col("area_cells") > 0)
    return rings.groupBy("site_id", "outlet").agg((F.min(ok.cast("int")) == 1).alias("_all"), F.max((~F.col("hole")).cast("int")).alias("_outer")).select("site_id", "outlet", (F.col("_all") & (F.col("_outer") == 1)).alias("geometry_ok"))


def data_quality(sections: dict[str, DataFrame]) -> DataFrame:
    """One row a site: each section's columns as a struct, joined on site_id, and all of it as JSON."""
    out = None
    for name, df in sections.items():
        part = df.select("site_id", F.struct(*[c for c in df.columns if c != "site_id"]).alias(name))
        out = part if out is None else out.join(part, "site_id", "full")
    return out.withColumn("report", F.to_json(F.struct(*sections)))


def contour_metrics(contours: DataFrame) -> DataFrame:
    """contours (site_id, elevation_m, coords) -> counts of contours and their points, elevation range and mean."""
    e = F.col("elevation_m")
    out = contours.groupBy("site_id").agg(F.count("*").alias("contour_count"), F.sum(F.coalesce(F.size("coords"), F.lit(0))).cast("bigint").alias("coordinate_count"), F.min(e).alias("elevation_min_m"), F.max(e).alias("elevation_max_m"), F.avg(e).alias("elevation_mean_m"))
    return out.withColumn("elevation_range_m", F.col("elevation_max_m") - F.col("elevation_min_m"))


def dem_metrics(cells: DataFrame, meta: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Dense cells with slope -> shape, share without data, ranges. quality: site_id, dem_status, dem_score (optional; null without)."""
    z, s = F.col("elevation"), F.col("slope")
    seen = cells.groupBy("site_id").agg(F.count(z).alias("_valid"), F.min(z).alias("elevation_min_m"), F.max(z).alias("elevation_max_m"), F.min(s).alias("slope_min_degrees"), F.max(s).alias("slope_max_degrees"), F.avg(s).alias("slope_mean_degrees"))
    size = F.col("rows").cast("bigint") * F.col("cols")
    out = meta.select("site_id", F.col("rows").cast("bigint").alias("dem_rows"), F.col("cols").cast("bigint").alias("dem_columns"), size.alias("dem_cells"), F.col("resolution_m").alias("dem_resolution_m")).join(seen, "site_id", "left")
    share = F.coalesce("_valid", F.lit(0)) / F.col("dem_cells")
    out = out.withColumns({"valid_cell_fraction": share, "dem_nan_percentage": (1 - share) * 100, "elevation_range_m": F.col("elevation_max_m") - F.col("elevation_min_m")}).drop("_valid")
    if quality is None:
        return out.withColumns({"dem_status": F.lit(None).cast("string"), "dem_quality_score": F.lit(None).cast("double")})
    return out.join(quality.select("site_id", "dem_status", F.col("dem_score").alias("dem_quality_score")), "site_id", "left")


def hydrology_metrics(flow: DataFrame, accumulation: DataFrame, column: str = "elevation") -> DataFrame:
    """D8 cells and accumulation -> share of valid cells with a direction, sinks, cells on cycles, range, mean and median of the accumulation."""
    cells = cut_lineage(flow.where(F.col(column).isNotNull()).select("site_id", "cell", "flow_dir", "sink", "on_ring").join(accumulation.hint("merge"), ["site_id", "cell"], "left"))
    acc = F.col("accumulation")
    count = lambda c: F.sum(c.cast("bigint"))
    sums = cells.groupBy("site_id").agg(
        F.count("*").alias("hydrology_valid_cells"),
        (count(F.col("flow_dir") >= 0) / F.count("*") * 100).alias("valid_flow_direction_percentage"),
        count(F.col("sink")).alias("sink_cells"),
        count(F.col("on_ring")).alias("edge_outflow_cells"),
        count(acc.isNull()).alias("unresolved_cycle_cells"),
        F.min(acc).alias("flow_accumulation_min_cells"),
        F.max(acc).alias("flow_accumulation_max_cells"),
        F.avg(acc).alias("flow_accumulation_mean_cells"),
    )
    middle = exact_quantiles(cells, "accumulation", (0.5,)).select("site_id", F.col("q")[0].alias("flow_accumulation_median_cells"))
    return sums.join(middle, "site_id", "left")


def catchment_metrics(areas: DataFrame) -> DataFrame:
    """areas of one outlet a site -> catchment_area_m2, catchment_area_hectares, catchment_area_km2, catchment_cell_count."""
    return areas.select("site_id", F.col("area_m2").alias("catchment_area_m2"), F.col("area_ha").alias("catchment_area_hectares"), F.col("area_km2").alias("catchment_area_km2"), F.col("cells").alias("catchment_cell_count"))


def candidate_metrics(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows a site of both tables: candidate_count, rejected_candidate_count, recommendation_count."""
    both = accepted.select("site_id", F.lit(1).alias("a"), F.lit(0).alias("r")).unionByName(rejected.select("site_id", F.lit(0).alias("a"), F.lit(1).alias("r")))
    return both.groupBy("site_id").agg(F.sum("a").alias("candidate_count"), F.sum("r").alias("rejected_candidate_count"), F.sum("a").alias("recommendation_count"))


def external_availability(sites: DataFrame, **providers: DataFrame) -> DataFrame:
    """external_data: for each provider whether the site has a row there that is not of status unavailable."""
    out = sites.select("site_id").distinct()
    for name, df in providers.items():
        there = df.where(F.coalesce(F.col("status") != "unavailable", F.lit(True))) if "status" in df.columns else df
        out = out.join(there.select("site_id", F.lit(True).alias(name)).distinct(), "site_id", "left").fillna(False, [name])
    return out.select("site_id", F.struct(*providers).alias("external_data"))


def quality_metrics(*sections: DataFrame) -> DataFrame:
    """The sections of a site side by side, one row a site; where two have a figure of the same name, the later one's counts.

    A site that a section lacks has nulls there, or what an earlier section says of the same figure.
    """
    out = sections[0]
    for df in sections[1:]:
        twice = [c for c in df.columns if c in out.columns and c != "site_id"]
        out = out.join(df.withColumnsRenamed({c: f"_{c}" for c in twice}), "site_id", "full")
        out = out.withColumns({c: F.coalesce(f"_{c}", c) for c in twice}).drop(*[f"_{c}" for c in twice])
    return out
