"""Whole analyses: from cells or contours to ranked sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrainflow.functions.geo import analysis_bounds, from_utm
from terrainflow.operators import hydrology as h
from terrainflow.operators.boundaries import in_wgs84, multipolygons, nested_rings
from terrainflow.operators.candidates import CandidateConfig, generate_candidates
from terrainflow.operators.contours import contour_points, distinct_samples, grid_nearest, make_grid
from terrainflow.operators.iterate import cut_lineage
from terrainflow.operators.quality import catchment_check, dem_score, gradient_stats, hydrology_quality, terrain_summary
from terrainflow.operators.rainfall import RainfallConfig, runoff, seasonal_rainfall
from terrainflow.operators.scoring import EngineConfig, rank_legacy, run_engine
from terrainflow.operators.spatial import ContextConfig, enrich, exclude_near_water
from terrainflow.operators.stencil import dense_grid, with_slope
from terrainflow.sources.sinks import geojson_polygons


def analyze_hydrology(cells: DataFrame, meta: DataFrame, fill: bool = True, tile: int = h.TILE) -> dict[str, DataFrame]:
    """filled, flow, accumulation, outlets (all terminal cells by rank), drainage, summary of each site."""
    dense = cut_lineage(dense_grid(cells.select("site_id", "row", "col", "elevation"), meta))
    filled = h.fill_depressions(dense, meta, tile=tile) if fill else h.with_ring(dense, meta).withColumns({"filled": F.col("elevation"), "modified": F.lit(False), "reachable": F.col("elevation").isNotNull()})
    filled = cut_lineage(filled)
    flow = cut_lineage(h.d8(filled, meta, "filled"))
    routed = cut_lineage(h.route(flow, "filled"))
    accumulation, drainage = routed.select("site_id", "cell", "accumulation"), routed.select("site_id", "cell", "outlet")
    outlets = cut_lineage(h.outlets(flow, accumulation, 5, "filled"))
    return {"filled": filled, "flow": flow, "accumulation": accumulation, "routed": routed, "outlets": outlets, "drainage": drainage, "summary": h.hydrology_summary(filled, flow, accumulation, meta)}


def main_outlets(hydro: dict[str, DataFrame]) -> DataFrame:
    """site_id, outlet, kind, accumulation_cells, outlet_source: the primary outlet, or else the lowest valid cell (the first in row-major order).

    A site without a valid cell has no outlet. The fallback has no kind; its accumulation is null where it lies on a cycle.
    """
    ranked = hydro["outlets"].where("selected")
    source = F.when(F.col("kind") == "boundary", "hydrology_candidate_max_drainage").otherwise("hydrology_internal_endpoint")
    primary = ranked.select("site_id", F.col("cell").alias("outlet"), "kind", "accumulation_cells", source.alias("outlet_source"))
    low = hydro["flow"].where("elevation is not null").join(primary.select("site_id"), "site_id", "left_anti")
    low = low.groupBy("site_id").agg(F.min_by("cell", F.struct("elevation", "cell")).alias("cell"))
    low = low.join(hydro["accumulation"].hint("merge"), ["site_id", "cell"], "left")
    fallback = low.select("site_id", F.col("cell").alias("outlet"), F.lit(None).cast("string").alias("kind"), F.col("accumulation").alias("accumulation_cells"), F.lit("hydrology_lowest_valid_cell").alias("outlet_source"))
    return primary.unionByName(fallback)


def candidate_cells(hydro: dict[str, DataFrame], cells: DataFrame, meta: DataFrame) -> DataFrame:
    """All cells with what candidates need: x, y, slope, accumulation, outlet.

    Flow has the cells of a dense grid with their elevation, so slopes come from it. Both joins are of all cells and ask for a
    merge: the planner takes checkpointed cells for far smaller than they are and would broadcast them.
    """
    base = with_slope(hydro["flow"].select("site_id", "row", "col", "cell", "elevation"), meta).select("site_id", "row", "col", "cell", "elevation", "slope")
    placed = base.join(cells.select("site_id", "row", "col", "x", "y").hint("merge"), ["site_id", "row", "col"], "left")
    return placed.join(hydro["routed"].select("site_id", "cell", "accumulation", "outlet").hint("merge"), ["site_id", "cell"], "left")


def engine_pipeline(cells: DataFrame, meta: DataFrame, segments: DataFrame, daily: DataFrame, zone: int = 44, south: bool = False, candidates: CandidateConfig = CandidateConfig(), context: ContextConfig = ContextConfig(), rain: RainfallConfig = RainfallConfig(), engine: EngineConfig = EngineConfig(), water_buffer_m: float = 30.0) -> DataFrame:  # noqa: B008
    """cells (site_id, row, col, x, y, elevation) -> ranked candidates: generation, water exclusion, enrichment, runoff, engine."""
    hydro = analyze_hydrology(cells, meta)
    accepted, _, _ = generate_candidates(candidate_cells(hydro, cells, meta), hydro["outlets"], meta, candidates)
    points = cut_lineage(accepted.withColumnsRenamed({"candidate_id": "id", "candidate_rank": "rank"}))
    kept, _ = exclude_near_water(points, segments, water_buffer_m)
    placed = enrich(kept, segments, context).withColumn("g", from_utm(F.col("x"), F.col("y"), F.lit(zone), F.lit(south)))
    placed = placed.withColumns({"latitude": F.col("g.latitude"), "longitude": F.col("g.longitude"), "catchment_area_m2": F.col("drainage_area_m2"), "terrain_support": F.lit(True)}).drop("g")
    wet = runoff(placed.join(seasonal_rainfall(daily, rain).select("site_id", "seasonal_total_mm", "mean_annual_mm"), "site_id", "left"), rain).withColumn("rainfall_mm", F.col("seasonal_total_mm"))
    quality = hydrology_quality(hydro["flow"], hydro["accumulation"], hydro["outlets"], "filled").select("site_id", "hydrology_score", "hydrology_status")
    ranked = run_engine(wet.join(quality, "site_id", "left").drop("rank", "score_slope"), engine, key="id")
    label = F.when(F.col("rank") == 1, "primary").otherwise(F.concat(F.lit("alternative-"), (F.col("rank") - 1).cast("string")))
    return ranked.withColumn("label", label)


def contour_pipeline(contours: DataFrame, resolution: float = 5.0) -> dict[str, DataFrame]:
    """Contours -> grid by nearest sample, quality, hydrology, catchment of the primary outlet and its area."""
    points = cut_lineage(contour_points(contours))
    box = points.groupBy("site_id").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    grid = make_grid(box, resolution)
    cells = cut_lineage(grid_nearest(grid, distinct_samples(points), 4 * resolution))
    meta = cut_lineage(cells.groupBy("site_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.lit(resolution).alias("resolution_m")))
    sloped = with_slope(cells, meta)
    hydro = analyze_hydrology(cells, meta)
    primary = cut_lineage(main_outlets(hydro))
    members = h.catchments(hydro["flow"], primary.select("site_id", "outlet"), "filled", routed=hydro["routed"])
    stats = terrain_summary(sloped, meta).join(gradient_stats(sloped).select("site_id", "extreme_fraction"), "site_id")
    quality = dem_score(stats.withColumns({"nan_fraction": 1 - F.col("valid_fraction"), "contour_score": F.lit(1.0)}))
    return hydro | {"cells": cells, "meta": meta, "quality": quality, "outlet": primary, "catchment": members, "area": h.catchment_area(members, meta)}


def location_pipeline(requests: DataFrame, raster: DataFrame) -> DataFrame:
    """requests with bounds; raster (request_id, row, col, elevation, in metres) -> hydrology and area of each request's primary outlet."""
    bounds = analysis_bounds(requests)
    cells = raster.withColumnRenamed("request_id", "site_id")
    meta = cut_lineage(cells.groupBy("site_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.first("resolution_m").alias("resolution_m")))
    hydro = analyze_hydrology(cells, meta)
    primary = cut_lineage(main_outlets(hydro))
    area = h.catchment_area(h.catchments(hydro["flow"], primary.select("site_id", "outlet"), "filled", routed=hydro["routed"]), meta)
    found = primary.join(area, ["site_id", "outlet"]).withColumnRenamed("site_id", "request_id")
    return bounds.join(found, "request_id", "left")


def site_recommendation(summaries: DataFrame, presence: DataFrame | None = None) -> DataFrame:
    """summaries (site_id, mean_slope, area_m2, ...) -> one legacy-ranked row a site with fixed distances; sites that are rejected get a fallback row.

    presence (site_id, n_water, n_roads, n_buildings): the distances tell whether there are any (300 or 120, 200 or 500, 150 or
    500 m) and the counts go into the score; a site without a row has none. Without presence all are taken to be there.
    """
    base = summaries.select("site_id", F.lit("site").alias("candidate_id"), F.col("mean_slope").alias("slope_degrees"), F.col("area_m2").alias("catchment_area_m2"), F.lit(None).cast("double").alias("rainfall_mm"), F.lit(300.0).alias("water_distance_m"), F.lit(200.0).alias("road_distance_m"), F.lit(150.0).alias("building_distance_m"), F.lit(0).alias("n_water"), F.lit(0).alias("n_roads"), F.lit(0).alias("n_buildings"))
    if presence is not None:
        counts = ["n_water", "n_roads", "n_buildings"]
        base = base.drop(*counts).join(presence.select("site_id", *[F.col(c).cast("int").alias(c) for c in counts]), "site_id", "left").fillna(0, counts)
        far = {"water": (300.0, 120.0, "n_water"), "road": (200.0, 500.0, "n_roads"), "building": (150.0, 500.0, "n_buildings")}
        base = base.withColumns({f"{k}_distance_m": F.when(F.col(n) > 0, a).otherwise(b) for k, (a, b, n) in far.items()})
    ranked = rank_legacy(base).select("site_id", "overall_score", "confidence", "recommendation", "rank")
    return base.select("site_id").join(ranked, "site_id", "left").withColumn("recommendation", F.coalesce("recommendation", F.lit("not_recommended")))


def alternatives(flow: DataFrame, accumulation: DataFrame, main: DataFrame, k: int = 3, terminals: int = 8, apart: int = 5) -> DataFrame:
    """Up to k alternatives of each site's main outlet (site_id, cell): first terminal cells in row-major order, then cells by accumulation.

    Terminal cells are taken as they come; other cells keep a Manhattan distance of `apart` to those chosen. The pool is
    bounded: of the others only the strongest that k picks can need are looked at.
    """
    from terrainflow.operators.hydrology import terminal_cells

    ends = terminal_cells(flow, terminals + 1, [c for c in ("filled", "elevation") if c in flow.columns][0]).select("site_id", "row", "col", "cell").join(main.select("site_id", "cell"), ["site_id", "cell"], "left_anti").withColumns({"accumulation": F.lit(None).cast("double"), "terminal": F.lit(True)})
    need = k * (2 * apart * apart + 1) + terminals + 1  # cells that k picks can rule out
    order = Window.partitionBy("site_id").orderBy(F.desc("accumulation"), "row", "col")
    pool = flow.select("site_id", "row", "col", "cell").join(accumulation.where("accumulation is not null").hint("merge"), ["site_id", "cell"]).join(main.select("site_id", "cell"), ["site_id", "cell"], "left_anti")
    pool = pool.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= need).drop("_n").withColumn("terminal", F.lit(False))

    def pick(pdf):
        chosen = []
        rows = pdf.sort_values(["terminal", "accumulation", "row", "col"], ascending=[False, False, True, True]).drop_duplicates("cell", keep="first")
        first = rows[rows["terminal"]].sort_values(["row", "col"])
        for r in first.head(terminals).itertuples():
            if len(chosen) < k:
                chosen.append((r.site_id, len(chosen) + 1, r.row, r.col, r.cell))
        for r in rows[~rows["terminal"]].itertuples():
            if len(chosen) >= k:
                break
            if all(abs(r.row - c[2]) + abs(r.col - c[3]) >= apart for c in chosen):
                chosen.append((r.site_id, len(chosen) + 1, r.row, r.col, r.cell))
        import pandas as pd

        return pd.DataFrame(chosen, columns=["site_id", "alternative", "row", "col", "cell"])

    return ends.unionByName(pool.select(*ends.columns)).groupBy("site_id").applyInPandas(pick, "site_id bigint, alternative int, row int, col int, cell bigint")


def candidates_from_cells(picked: DataFrame, cells: DataFrame, members: DataFrame, meta: DataFrame, frames: DataFrame, score: DataFrame | None = None) -> DataFrame:
    """Candidates from cells: place in WGS84, elevation, slope, own catchment area, score.

    picked: site_id, cell and what names them. cells: site_id, row, col, cell, elevation, slope_degrees. members: catchments whose
    outlets are the picked cells; a cell without one (no data) has area 0. frames: see `boundaries.in_wgs84`. score: site_id,
    suitability_score of the site; null without it.
    """
    area = h.catchment_area(members, meta).select("site_id", F.col("outlet").alias("cell"), *[F.col(c).alias(f"catchment_{c}") for c in ("area_m2", "area_ha", "area_km2")])
    at = from_utm(F.col("x0") + F.col("col") * F.col("dx"), F.col("y0") + F.col("row") * F.col("dy"), F.col("zone"), F.col("south"))
    out = picked.join(cells.select("site_id", "cell", "row", "col", "elevation", "slope_degrees").hint("merge"), ["site_id", "cell"]).join(area, ["site_id", "cell"], "left").fillna(0.0, [c for c in area.columns if c.startswith("catchment_")])
    out = out.join(frames, "site_id", "left").withColumn("_p", at).withColumns({"longitude": F.col("_p.longitude"), "latitude": F.col("_p.latitude")}).drop("_p", "x0", "y0", "dx", "dy", "zone", "south")
    return out.join(score, "site_id", "left") if score is not None else out.withColumn("suitability_score", F.lit(None).cast("double"))


def alternative_candidates(flow: DataFrame, accumulation: DataFrame, main: DataFrame, meta: DataFrame, frames: DataFrame, score: DataFrame | None = None, k: int = 3, routed: DataFrame | None = None) -> DataFrame:
    """The alternatives of each site's main outlet as candidates, each with the area of its own catchment."""
    column = "filled" if "filled" in flow.columns else "elevation"
    picked = cut_lineage(alternatives(flow, accumulation, main, k).select("site_id", "cell", F.concat(F.lit("alternative-"), F.col("alternative").cast("string")).alias("candidate_id")))
    members = h.catchments(flow, picked.select("site_id", F.col("cell").alias("outlet")), column, routed=routed)
    sloped = with_slope(flow.select("site_id", "row", "col", "cell", "elevation"), meta).select("site_id", "row", "col", "cell", "elevation", F.col("slope").alias("slope_degrees"))
    return candidates_from_cells(picked, sloped, members, meta, frames, score)


def analyze_catchment(flow: DataFrame, accumulation: DataFrame, outlets: DataFrame, meta: DataFrame, frames: DataFrame, column: str = "elevation", routed: DataFrame | None = None) -> DataFrame:
    """outlets (site_id, outlet) -> area, its agreement with the accumulation, and the boundary in WGS84 as polygons and GeoJSON."""
    members = cut_lineage(h.catchments(flow, outlets, column, routed=routed))
    area = h.catchment_area(members, meta)
    asked = outlets.select("site_id", F.col("outlet").alias("cell")).distinct()
    check = catchment_check(area, asked.join(accumulation.select("site_id", "cell", F.col("accumulation").alias("accumulation_cells")).hint("merge"), ["site_id", "cell"]))
    placed = members.join(flow.select("site_id", "cell", "row", "col").hint("merge"), ["site_id", "cell"])
    shape = multipolygons(in_wgs84(nested_rings(placed), frames))
    out = area.join(check.drop(*[c for c in area.columns if c in check.columns and c not in ("site_id", "outlet")]), ["site_id", "outlet"], "left")
    return out.join(shape, ["site_id", "outlet"], "left").withColumn("boundary", geojson_polygons(F.col("polygons")))
