"""One query per operator group over tables derived from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrainflow.functions import geo
from terrainflow.operators import boundaries as bnd
from terrainflow.operators import candidates as cand
from terrainflow.operators import contours as con
from terrainflow.operators import hydrology as h
from terrainflow.operators import quality as qa
from terrainflow.operators import rainfall as rain
from terrainflow.operators import scoring as sc
from terrainflow.operators import spatial as sp
from terrainflow.operators.iterate import cut_lineage, shared_folder
from terrainflow.operators.stencil import dense_grid, with_neighbours, with_slope
from terrainflow.plans import pipelines, tables
from terrainflow.sources import features as feat
from terrainflow.sources import kml, quadtree, sinks

FLOAT = ("double", "float")


def tidy(df, digits=6):
    """Doubles rounded, for comparison."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t in FLOAT else F.col(c) for c, t in df.dtypes])


def _grid(spark, d):
    cells = tables.dem_cells(spark, d)
    meta = tables.dem_meta(cells)
    return dense_grid(cells, meta), meta


def _flow(spark, d):
    dense, meta = _grid(spark, d)
    return h.d8(dense, meta), meta


def d8_direction(spark, d):
    flow, _ = _flow(spark, d)
    return flow.groupBy("site_id", F.col("flow_dir").cast("int").alias("flow_dir")).agg(F.count("*").alias("n"))


def d8_cells(spark, d):
    flow, _ = _flow(spark, d)
    return flow.select("site_id", "cell", F.col("flow_dir").cast("int").alias("flow_dir"), "downstream", "sink", "edge_outflow")


def d8_wide(spark, d):
    cells = tables.dem_wide(spark, d)
    meta = tables.dem_meta(cells)
    flow = h.d8(dense_grid(cells, meta), meta)
    return flow.groupBy("row").agg(F.sum((F.col("flow_dir") >= 0).cast("int")).cast("bigint").alias("routed"), F.sum(F.col("sink").cast("int")).cast("bigint").alias("sinks"))


def neighbours(spark, d):
    dense, _ = _grid(spark, d)
    return tidy(with_neighbours(dense).groupBy("site_id").agg(*[F.sum(f"n{k}").alias(f"sum_n{k}") for k in range(8)]), 3)


def slope(spark, d):
    dense, meta = _grid(spark, d)
    return tidy(with_slope(dense, meta).select("site_id", "row", "col", "gradient", "slope"))


def terrain_summary(spark, d):
    dense, meta = _grid(spark, d)
    return tidy(qa.terrain_summary(with_slope(dense, meta), meta).select("site_id", "rows", "cols", "min_elevation", "max_elevation", "mean_elevation", "mean_slope", "max_slope", "valid_fraction", "area_m2"))


def preprocess_summary(spark, d):
    dense, meta = _grid(spark, d)
    out = qa.preprocess_summary(dense, meta)
    return tidy(out.select("site_id", F.col("total_cells").cast("bigint").alias("total_cells"), "valid_cells", F.col("invalid_cells").cast("bigint").alias("invalid_cells"), "valid_fraction", F.size("warnings").alias("n_warnings"), "error"))


def elevation_stats(spark, d):
    return tidy(qa.elevation_stats(tables.dem_cells(spark, d)))


def local_change(spark, d):
    return tidy(qa.local_change(tables.dem_cells(spark, d)))


def slope_stats(spark, d):
    dense, meta = _grid(spark, d)
    return tidy(qa.slope_stats(with_slope(dense, meta)))


def gradient_stats(spark, d):
    dense, meta = _grid(spark, d)
    return tidy(qa.gradient_stats(with_slope(dense, meta)))


def lowest_cell(spark, d):
    return tidy(qa.lowest_cell(tables.dem_cells(spark, d)))


def internal_sinks(spark, d):
    dense, meta = _grid(spark, d)
    return h.internal_sinks(dense, meta)


def fill_depressions(spark, d):
    dense, meta = _grid(spark, d)
    return tidy(h.fill_depressions(dense, meta).where("elevation is not null").select("site_id", "row", "col", "filled", "modified", "reachable"))


def fill_tiles(spark, d):
    """The same levels from tiles of 8 cells as from one tile a site: number of cells and sums by site."""
    dense, meta = _grid(spark, d)
    out = h.fill_depressions(dense, meta, tile=8).where("elevation is not null")
    return tidy(out.groupBy("site_id").agg(F.count("*").alias("n"), F.sum("filled").alias("sum_filled"), F.sum(F.col("modified").cast("int")).cast("bigint").alias("modified")), 1)


def flow_accumulation(spark, d):
    flow, _ = _flow(spark, d)
    return h.flow_accumulation(cut_lineage(flow))


def drainage_outlet(spark, d):
    flow, _ = _flow(spark, d)
    return h.drainage_outlet(cut_lineage(flow))


def _routed(spark, d, n=5):
    """Flow, meta, the first n outlets of each site and the routed cells, which accumulation and catchments share."""
    flow, meta = _flow(spark, d)
    flow = cut_lineage(flow)
    routed = cut_lineage(h.route(flow).drop("way"))
    return flow, meta, h.outlets(flow, routed.drop("outlet"), n), routed


def _ends(spark, d, n=5):
    return _routed(spark, d, n)[:3]


def outlets(spark, d):
    return _ends(spark, d)[2]


def terminal_cells(spark, d):
    return h.terminal_cells(_flow(spark, d)[0])


def _members(spark, d):
    flow, meta, ends, routed = _routed(spark, d, 2)
    members = cut_lineage(h.catchments(flow, ends.select("site_id", F.col("cell").alias("outlet")), routed=routed))
    return members.join(flow.select("site_id", "cell", "row", "col"), ["site_id", "cell"]), meta, ends


def catchment_area(spark, d):
    members, meta, _ = _members(spark, d)
    return h.catchment_area(members, meta)


def mask_runs(spark, d):
    return h.mask_runs(_members(spark, d)[0])


def boundary_edges(spark, d):
    return h.boundary_edges(_members(spark, d)[0]).groupBy("site_id", "outlet").agg(F.count("*").alias("edges"))


def catchment_rings(spark, d):
    """Net area of the stitched rings in cells: the size of each catchment."""
    rings = bnd.nested_rings(_members(spark, d)[0])
    return tidy(rings.groupBy("site_id", "outlet").agg(F.sum(F.when(F.col("hole"), -F.col("area_cells")).otherwise(F.col("area_cells"))).alias("cells")))


def catchment_parts(spark, d):
    """Parts and corners of each catchment's outline; holes: pieces of what lies around that it encloses, between its parts too."""
    rings = bnd.nested_rings(_members(spark, d)[0])
    count = lambda c: F.sum(c.cast("bigint"))
    return rings.groupBy("site_id", "outlet").agg(count(~F.col("hole")).alias("parts"), F.max("enclosed").cast("bigint").alias("holes"), count(F.size("corners") - 1).alias("vertices"))


def catchment_vertices(spark, d):
    """Corners where an outline turns, and how many rings turn there."""
    rings = bnd.nested_rings(_members(spark, d)[0])
    return bnd.ring_vertices(rings).groupBy("site_id", "outlet", "r", "c").agg(F.count("*").alias("rings"))


def _frames(spark, d):
    cells = tables.dem_cells(spark, d)
    placed = cells.withColumns({"x": tables.X0 + 1000 * (F.col("site_id") % 100) + 5.0 * F.col("col"), "y": tables.Y0 + 5.0 * F.col("row")})
    return bnd.grid_frames(placed, F.lit(44), F.lit(False))


def catchment_boundary(spark, d):
    """The corners of every ring in WGS84."""
    rings = bnd.in_wgs84(bnd.nested_rings(_members(spark, d)[0]), _frames(spark, d))
    each = rings.select("site_id", "outlet", F.explode(F.slice(F.arrays_zip("corners", "points"), F.lit(1), F.size("corners") - 1)).alias("v"))
    return tidy(each.select("site_id", "outlet", "v.corners.r", "v.corners.c", "v.points.longitude", "v.points.latitude").distinct(), 7)


def catchment_geojson(spark, d):
    """Catchments with area, check and the kind of their boundary, read back from the GeoJSON; the number of its points."""
    flow, meta, ends, routed = _routed(spark, d, 2)
    out = pipelines.analyze_catchment(flow, routed.drop("outlet"), ends.select("site_id", F.col("cell").alias("outlet")), meta, _frames(spark, d), routed=routed)
    points = F.size(F.split("boundary", r"\[-?[0-9]")) - 1
    return tidy(out.select("site_id", "outlet", "cells", "area_m2", "area_ok", F.get_json_object("boundary", "$.type").alias("kind"), points.cast("bigint").alias("points")))


def catchment_check(spark, d):
    members, meta, ends = _members(spark, d)
    return tidy(qa.catchment_check(h.catchment_area(members, meta), ends))


def geometry_check(spark, d):
    return qa.geometry_check(bnd.nested_rings(_members(spark, d)[0]))


def hydrology_summary(spark, d):
    dense, meta = _grid(spark, d)
    hydro = pipelines.analyze_hydrology(dense, meta)
    return tidy(hydro["summary"])


def hydrology_quality(spark, d):
    flow, _, ends, routed = _routed(spark, d)
    out = qa.hydrology_quality(flow, routed.drop("outlet"), ends)
    return tidy(out.select("site_id", "valid_cells", "sink_cells", "edge_cells", "sink_fraction", "hydrology_score", "hydrology_status", "sink_level"))


def _acc_cells(spark, d):
    flow, meta = _flow(spark, d)
    flow = cut_lineage(flow)
    return cut_lineage(flow.select("site_id", "row", "col", "cell").join(h.flow_accumulation(flow), ["site_id", "cell"], "left"))


def local_maxima(spark, d):
    return cand.local_maxima(_acc_cells(spark, d).select("site_id", "row", "col", "accumulation")).where("accumulation is not null")


def plateau_peaks(spark, d):
    return cand.plateau_peaks(cand.local_maxima(_acc_cells(spark, d).select("site_id", "row", "col", "accumulation")).where("accumulation is not null"))


def _placed(cells):
    return cells.withColumns({"x": tables.X0 + 1000 * F.col("site_id") + 5.0 * F.col("col"), "y": tables.Y0 + 5.0 * F.col("row")})


def _generated(spark, d):
    cells = _placed(tables.dem_cells(spark, d))
    meta = tables.dem_meta(cells)
    hydro = pipelines.analyze_hydrology(cells, meta)
    return cand.generate_candidates(pipelines.candidate_cells(hydro, cells, meta), hydro["outlets"], meta)


def candidate_rank(spark, d):
    accepted = _generated(spark, d)[0]
    return tidy(accepted.select("site_id", "candidate_id", "row", "col", "flow_accumulation_cells", "drainage_area_m2", "candidate_score", "candidate_rank"))


def rejection_counts(spark, d):
    return _generated(spark, d)[2]


def separation(spark, d):
    """Points at least 40 m apart, strongest first."""
    from terrainflow.operators.independent import thin

    b = tables.buildings(spark, d)
    kept, _ = thin(b.select("site_id", F.col("feature_id").alias("id"), ((F.col("feature_id") * 31) % 100 * 1000 + F.col("feature_id") % 100).alias("priority"), "x", "y"), 40.0)
    return kept


def leader_clusters(spark, d):
    b = tables.buildings(spark, d)
    return sp.leader_clusters(b.select("site_id", F.col("feature_id").alias("id"), F.col("feature_id").alias("seq"), "x", "y"), 60.0)


def alternatives(spark, d):
    flow, _, ends, routed = _routed(spark, d, 1)
    return pipelines.alternatives(flow, routed.drop("outlet"), ends.select("site_id", "cell"))


def alternative_candidates(spark, d):
    """Alternatives of each site's main outlet with place, slope, the area of their own catchments and the site's score."""
    dense, _ = _grid(spark, d)
    flow, meta, ends, routed = _routed(spark, d, 1)
    score = pipelines.site_recommendation(qa.terrain_summary(with_slope(dense, meta), meta)).select("site_id", F.col("overall_score").alias("suitability_score"))
    return tidy(pipelines.alternative_candidates(flow, routed.drop("outlet"), ends.select("site_id", "cell"), meta, _frames(spark, d), score, routed=routed))


def legacy_scores(spark, d):
    scored = sc.legacy_scores(tables.site_candidates(spark, d))
    return tidy(scored.select("site_id", "candidate_id", *[c for c in scored.columns if c.startswith("score_")], "overall_score"))


def legacy_rank(spark, d):
    return tidy(sc.rank_legacy(tables.site_candidates(spark, d)).select("site_id", "candidate_id", "overall_score", "confidence", "recommendation", "rank"))


def eligibility(spark, d):
    return sc.eligibility(sc.features(tables.site_candidates(spark, d))).groupBy("ineligible_reason").agg(F.count("*").alias("n"))


def engine_scores(spark, d):
    out = sc.component_scores(sc.features(tables.site_candidates(spark, d)))
    return tidy(out.select("site_id", "candidate_id", *sc.WEIGHTS), 9)


def engine_confidence(spark, d):
    return tidy(sc.features(tables.site_candidates(spark, d)).select("site_id", "candidate_id", sc.confidence().alias("confidence")), 9)


def engine_rank(spark, d):
    return tidy(sc.run_engine(tables.site_candidates(spark, d)).select("site_id", "candidate_id", "overall_score", "rank", "recommendation"))


def explanations(spark, d):
    out = sc.run_engine(tables.site_candidates(spark, d))
    return out.select("site_id", "candidate_id", F.size("missing_evidence").alias("n_missing"), F.array_contains("concerns", "little upstream drainage").alias("dry"))


def explainability(spark, d):
    scored = sc.legacy_scores(tables.site_candidates(spark, d)).withColumnsRenamed({"score_slope": "slope", "score_catchment_area": "catchment"})
    return sc.explainability(scored).select("site_id", "candidate_id", "phrases")


def _sites(spark, d):
    return tables.dem_meta(tables.dem_cells(spark, d)).count()


def seasonal_rainfall(spark, d):
    out = rain.seasonal_rainfall(tables.rainfall_daily(spark, d, _sites(spark, d)))
    return tidy(out, 4)


def runoff(spark, d):
    c = tables.site_candidates(spark, d).drop("runoff_m3", "storage_m3").withColumn("terrain_support", F.col("candidate_id") % 2 == 0)
    return tidy(rain.runoff(c, rainfall="rainfall_mm").select("site_id", "candidate_id", "runoff_m3", "storage_m3", "water_availability_status"))


def candidate_runoff(spark, d):
    daily = tables.rainfall_daily(spark, d, 3).select((21.0 + F.col("site_id") / 10).alias("lat6"), F.lit(81.0).alias("lon6"), "date", "mm")
    c = tables.site_candidates(spark, d).drop("runoff_m3", "storage_m3", "rainfall_mm").withColumns({"latitude": F.when(F.col("candidate_id") % 9 != 0, 21.0 + (F.col("candidate_id") % 4) / 10), "longitude": F.lit(81.0), "terrain_support": F.lit(True)})
    return tidy(rain.candidate_runoff(c, daily, as_of="2025-06-01").select("candidate_id", "rainfall_status", "rainfall_mm", "runoff_m3", "storage_m3"), 4)


def analysis_bounds(spark, d):
    return tidy(geo.analysis_bounds(tables.requests(spark, d)))


def utm_round_trip(spark, d):
    """Zone, EPSG code, and the distance between a place and its way there and back, in millionths of a degree."""
    r = tables.requests(spark, d)
    zone, south = geo.utm_zone(F.col("longitude")), F.col("latitude") < 0
    xy = geo.to_utm(F.col("longitude"), F.col("latitude"), zone, south)
    back = r.withColumn("p", xy).withColumn("g", geo.from_utm(F.col("p.x"), F.col("p.y"), zone, south))
    off = F.greatest(F.abs(F.col("g.longitude") - F.col("longitude")), F.abs(F.col("g.latitude") - F.col("latitude")))
    return back.select("request_id", zone.alias("zone"), geo.utm_epsg(F.col("longitude"), F.col("latitude")).alias("epsg"), F.round(off * 1e6).cast("bigint").alias("off"))


def padded_bbox(spark, d):
    return geo.padded_bbox(tables.site_candidates(spark, d).where("latitude is not null"), 1000.0)


def bbox_relation(spark, d):
    b = geo.analysis_bounds(tables.requests(spark, d))
    here = {c: F.col(c) for c in ("south", "north", "west", "east")}
    return b.select("request_id", geo.bbox_relation(here, {"south": F.lit(-40.0), "north": F.lit(40.0), "west": F.lit(-120.05), "east": F.lit(120.0)}).alias("relation"))


def extent_center(spark, d):
    return tidy(geo.extent_center(tables.site_candidates(spark, d)))


def tag_map(spark, d):
    tagged = feat.merged_tags(tables.tag_rows(spark, d))
    get = lambda k: F.try_element_at("tags", F.lit(k)).alias(k)
    return tagged.select("osm_id", get("building"), get("name"), get("highway"), feat.feature_kind(F.col("tags")).alias("kind"))


def feature_layers(spark, d):
    return feat.feature_layers(feat.merged_tags(tables.tag_rows(spark, d))).groupBy("layer").agg(F.count("*").alias("n"))


def features_in_bbox(spark, d):
    b = tables.buildings(spark, d).select("feature_id", *[(F.col(v) / k).alias(n) for v, k, n in (("x", 1e4, "west"), ("x", 1e4, "east"), ("y", 1e5, "south"), ("y", 1e5, "north"))])
    boxes = spark.range(4).select(F.col("id").alias("request_id"), (50.0 + F.col("id")).alias("west"), (50.9 + F.col("id")).alias("east"), F.lit(23.0).alias("south"), (23.5003 + F.col("id") / 1000).alias("north"))
    return feat.features_in_bbox(b, boxes).groupBy("request_id").agg(F.count("*").alias("n"))


def _boxed(spark, d):
    """Buildings, roads and water squares with their boxes in degrees (a metre is a hundred-thousandth): layer, feature_id, west, south, east, north."""
    deg = lambda v, zero: (v - zero) / 1e5
    box = lambda df, layer, x1, y1, x2, y2: df.select(F.lit(layer).alias("layer"), "feature_id", deg(x1, tables.X0).alias("west"), deg(y1, tables.Y0).alias("south"), deg(x2, tables.X0).alias("east"), deg(y2, tables.Y0).alias("north"))
    x, y, half = F.col("cx"), F.col("cy"), F.col("half")
    out = box(tables.buildings(spark, d), "buildings", F.col("x"), F.col("y"), F.col("x"), F.col("y"))
    out = out.unionByName(box(tables.roads(spark, d), "roads", F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    return out.unionByName(box(tables.water(spark, d), "water_areas", x - half, y - half, x + half, y + half))


def _asked_boxes(spark, d):
    """A box around each supplier's place, of 10 m to 80 km half a side: request_id, west, south, east, north."""
    key = F.col("s_suppkey")
    x, y = (1000 * F.floor(key / 7) + (key * 29) % 160) / 1e5, ((key * 41) % 160) / 1e5
    half = F.lit(10.0) * F.pow(F.lit(2.0), key % 14) / 1e5
    return tables.read(spark, d, "supplier").select(key.cast("bigint").alias("request_id"), (x - half).alias("west"), (y - half).alias("south"), (x + half).alias("east"), (y + half).alias("north"))


def features_in_boxes(spark, d):
    """Features of all layers in boxes of all sizes, a box for each supplier."""
    return feat.features_in_bbox(_boxed(spark, d), _asked_boxes(spark, d)).groupBy("request_id", "layer").agg(F.count("*").alias("n"), F.sum("feature_id").alias("sum_id"))


def stored_features(spark, d):
    """Features of all layers written by cell and read back in one box, of half the places of the suppliers."""
    path = shared_folder(spark, "features")
    quadtree.write_features(_boxed(spark, d), path)
    most = tables.read(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0]
    east = 1000 * (most // 14) / 1e5
    return quadtree.read_features(spark, path, (0.0, 0.0, east, 0.001)).groupBy("layer").agg(F.count("*").alias("n"), F.sum("feature_id").alias("sum_id"))


def clip_relations(spark, d):
    """Customers as nodes, orders as ways (a node each), nations as multipolygon relations of ways."""
    nodes = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), (F.col("c_custkey") % 100).cast("double").alias("lon"), (F.col("c_custkey") % 37).cast("double").alias("lat"))
    ways = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("way_id"), F.col("o_custkey").alias("node_id")).distinct()
    members = tables.read(spark, d, "orders").select((F.col("o_orderkey") % 40).alias("relation_id"), F.when(F.col("o_orderkey") % 40 < 30, "multipolygon").otherwise("route").alias("relation_type"), F.lit("way").alias("member_type"), F.col("o_orderkey").alias("member_id")).distinct()
    n, w, r = feat.clip_relations(nodes, ways, members, (3.0, 10.0, 6.0, 14.0))
    one = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one(n, "node").unionByName(one(w, "way")).unionByName(one(r, "relation"))


def nearest_distance(spark, d):
    points = tables.probe_points(spark, d)
    return tidy(sp.nearest_distance(points, tables.segments(spark, d)).select("site_id", "id", "water_distance_m", "road_distance_m", "building_distance_m"))


def nearest_within(spark, d):
    """The same with a cap of 60 m, through bins."""
    points = tables.probe_points(spark, d)
    return tidy(sp.nearest_distance(points, tables.segments(spark, d), 60.0).select("site_id", "id", "water_distance_m", "road_distance_m", "building_distance_m"))


def within_count(spark, d):
    return sp.count_within(tables.probe_points(spark, d), tables.segments(spark, d), 75.0).select("site_id", "id", "n_water", "n_road", "n_building")


def feasibility(spark, d):
    near = sp.nearest_distance(tables.probe_points(spark, d), tables.segments(spark, d))
    return sp.feasibility(near).groupBy("feasibility", "feasibility_reason").agg(F.count("*").alias("n"))


def water_exclusion(spark, d):
    return sp.exclude_near_water(tables.probe_points(spark, d), tables.segments(spark, d), 30.0)[0].select("site_id", "id")


def enrichment(spark, d):
    points = tables.probe_points(spark, d).withColumn("rank", (F.col("id") / 32).cast("int"))
    out = sp.enrich(points, tables.segments(spark, d), sp.ContextConfig(max_enriched_candidates=20))
    return out.groupBy("enrichment_status", "feasibility").agg(F.count("*").alias("n"))


def enrichment_counts(spark, d):
    """Candidates of each site by feasibility and by reason."""
    points = tables.probe_points(spark, d).withColumn("rank", (F.col("id") / 32).cast("int"))
    out = sp.enrichment_diagnostics(sp.enrich(points, tables.segments(spark, d), sp.ContextConfig(max_enriched_candidates=20)))
    reasons = {"water": "inside_or_on_water_body", "building": "insufficient_building_clearance", "road": "insufficient_road_clearance", "limit": "not_enriched_candidate_limit"}
    return out.select("site_id", "feasible_count", "rejected_count", "unknown_count", *[F.coalesce(F.try_element_at("feasibility_reasons", F.lit(v)), F.lit(0)).alias(f"n_{k}") for k, v in reasons.items()])


def contour_parse(spark, d):
    contours, _ = kml.parse_contours(tables.contour_docs(spark, d))
    return contours.select("site_id", "elevation_m", F.size("coords").alias("points"), "name")


def contour_diagnostics(spark, d):
    contours, _ = kml.parse_contours(tables.contour_docs(spark, d))
    out = con.contour_diagnostics(contours)
    return tidy(out.select("site_id", "contour_count", "unique_elevation_count", "elevation_min_m", "elevation_max_m", "elevation_mean_m", "elevation_median_m", "elevation_std_m", "interval_min_m", "interval_mean_m", "interval_max_m"))


def contour_lengths(spark, d):
    contours, _ = kml.parse_contours(tables.contour_docs(spark, d))
    return tidy(con.contour_lengths(con.contour_points(contours)).groupBy("site_id").agg(F.count("*").alias("n"), F.max("length_m").alias("longest")))


def kml_files(spark, d):
    """Contours of KML files by the XML reader: nested folders, a prefix, SimpleData, CDATA; every third file is cut off and an error."""
    cells = tables.dem_cells(spark, d).where("elevation is not null")
    point = F.format_string("%d,%d,0", "col", "row")
    lines = cells.groupBy("site_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", point.alias("p")))), lambda s: s.p), " ").alias("c"))
    named = F.format_string("<k:name><![CDATA[<b>row</b> & %d </Placemark>]]></k:name>", "row")
    field = F.format_string('<k:ExtendedData><k:SchemaData><k:SimpleData name="note">7</k:SimpleData><k:SimpleData name="ELEVATION_m">%d.5 m</k:SimpleData></k:SchemaData></k:ExtendedData>', F.col("row") + 100)
    mark = F.concat(F.lit("<k:Folder><k:Folder><k:Placemark>"), named, F.when(F.col("row") % 2 == 0, field).otherwise(""), F.lit("<k:LineString><k:coordinates>"), "c", F.lit("</k:coordinates></k:LineString></k:Placemark></k:Folder></k:Folder>"))
    docs = lines.groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", mark.alias("m")))), lambda s: s.m), "").alias("body"))
    end = F.when(F.col("site_id") % 3 == 1, "<k:Placemark><k:name>cut").otherwise("</k:Document></k:kml>")
    path = shared_folder(spark, "kml")
    files = docs.select("site_id", F.concat(F.lit('<k:kml xmlns:k="http://www.opengis.net/kml/2.2"><k:Document>'), "body", end).alias("value"))
    files.repartition("site_id").write.partitionBy("site_id").text(path)
    contours, errors = kml.read_placemarks(spark, path, F.col("site_id").cast("bigint"))
    good = contours.select("site_id", "contour_id", "elevation_m", "name", F.size("coords").alias("points"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(errors, allowMissingColumns=True)


def first_number(spark, d):
    return tables.read(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("p_partkey"), kml.first_number(F.col("p_brand")).alias("number"))


def grid_nearest(spark, d):
    """A grid over the buildings of each site, each with the key of the nearest as its elevation."""
    b = tables.buildings(spark, d)
    points = b.select("site_id", F.lit(0).alias("contour_id"), F.col("feature_id").alias("seq"), "x", "y", (F.col("feature_id") % 100).cast("double").alias("elevation_m"))
    box = points.groupBy("site_id").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return con.grid_nearest(con.make_grid(box, 25.0), con.distinct_samples(points), 50.0)


def grid_planar(spark, d):
    """Samples of a plane: the grid gives the plane back inside triangles of near samples."""
    b = tables.buildings(spark, d)
    points = b.select("site_id", F.lit(0).alias("contour_id"), F.col("feature_id").alias("seq"), "x", "y", (0.01 * F.col("x") + 0.02 * F.col("y")).alias("elevation_m"))
    box = points.groupBy("site_id").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return tidy(con.grid_planar(con.make_grid(box, 25.0), con.distinct_samples(points), 50.0), 4)


def contour_consistency(spark, d):
    cells = tables.dem_cells(spark, d)
    v = cells.select("site_id", (F.col("row") * 32 + F.col("col")).alias("seq"), (5.0 * F.col("col") + 1).alias("x"), (5.0 * F.col("row") - 1).alias("y"), F.col("elevation").alias("elevation_m")).where("elevation_m is not null")
    grid = tables.dem_meta(cells).select("site_id", "rows", "cols", "resolution_m", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"))
    out = qa.contour_consistency(cells.withColumn("elevation", F.col("elevation") + (F.col("col") % 4) * 2.0), v, grid)
    return tidy(out)


def dem_quality(spark, d):
    dense, meta = _grid(spark, d)
    sloped = with_slope(dense, meta)
    stats = qa.terrain_summary(sloped, meta).join(qa.gradient_stats(sloped), "site_id")
    out = qa.dem_score(stats.withColumns({"nan_fraction": 1 - F.col("valid_fraction"), "contour_score": F.lit(0.95)}))
    return tidy(out.select("site_id", "dem_score", "dem_status", F.size("dem_warnings").alias("n_warnings")))


def data_quality(spark, d):
    dense, meta = _grid(spark, d)
    return qa.data_quality({"elevation": qa.elevation_stats(dense), "terrain": qa.terrain_summary(with_slope(dense, meta), meta)}).select("site_id", "report")


def data_quality_metrics(spark, d):
    """All six sections: contours, grid, hydrology, catchment of the main outlet, candidates, what else is there."""
    dense, meta = _grid(spark, d)
    sloped = with_slope(dense, meta)
    stats = qa.terrain_summary(sloped, meta).join(qa.gradient_stats(sloped), "site_id")
    grade = qa.dem_score(stats.withColumns({"nan_fraction": 1 - F.col("valid_fraction"), "contour_score": F.lit(0.95)}))
    flow, _, ends, routed = _routed(spark, d, 1)
    main = h.catchment_area(h.catchments(flow, ends.select("site_id", F.col("cell").alias("outlet")), routed=routed), meta)
    contours, _ = kml.parse_contours(tables.contour_docs(spark, d))
    c = tables.site_candidates(spark, d)
    others = qa.external_availability(meta, dem=dense, rainfall=tables.rainfall_daily(spark, d, _sites(spark, d)), land_context=tables.segments(spark, d))
    out = qa.quality_metrics(
        qa.contour_metrics(contours), qa.dem_metrics(sloped, meta, grade), qa.hydrology_metrics(flow, routed.drop("outlet")), qa.catchment_metrics(main),
        qa.candidate_metrics(c.where("feasibility <> 'rejected'"), c.where("feasibility = 'rejected'")), others,
    )
    out = out.join(meta.select("site_id"), "site_id", "left_semi")
    return tidy(out.select(*[x for x in out.columns if x != "external_data"], *[F.col(f"external_data.{n}").alias(f"has_{n}") for n in ("dem", "rainfall", "land_context")]))


def site_recommendation(spark, d):
    dense, meta = _grid(spark, d)
    return tidy(pipelines.site_recommendation(qa.terrain_summary(with_slope(dense, meta), meta)))


def contour_pipeline(spark, d):
    contours, _ = kml.parse_contours(tables.contour_docs(spark, d))
    placed = contours.withColumn("coords", F.transform("coords", lambda p: F.struct(((p.x - 81) * 100_000).alias("x"), ((p.y - 21) * 100_000).alias("y"))))
    return tidy(pipelines.contour_pipeline(placed, 10.0)["area"])


def location_pipeline(spark, d):
    raster = tables.dem_cells(spark, d).withColumnRenamed("site_id", "request_id").withColumn("resolution_m", F.lit(5.0))
    return tidy(pipelines.location_pipeline(tables.requests(spark, d), raster))


def engine_pipeline(spark, d):
    cells = _placed(tables.dem_cells(spark, d))
    meta = tables.dem_meta(cells)
    out = pipelines.engine_pipeline(cells, meta, tables.segments(spark, d), tables.rainfall_daily(spark, d, _sites(spark, d)))
    return tidy(out.select("site_id", "label", "id", "overall_score", "confidence", "recommendation", "summary"))


def kml_documents(spark, d):
    ranked = sc.run_engine(tables.site_candidates(spark, d)).where("rank <= 3").select("site_id", "rank", "latitude", "longitude")
    sites = geo.padded_bbox(tables.site_candidates(spark, d).where("latitude is not null"), 500.0).withColumns({"latitude": (F.col("south") + F.col("north")) / 2, "longitude": (F.col("west") + F.col("east")) / 2})
    contours, _ = kml.parse_contours(tables.contour_docs(spark, d))
    return sinks.kml_documents(sinks.site_placemarks(sites, ranked, contours))


def report_json(spark, d):
    return sinks.report_json(tables.site_candidates(spark, d).drop("site_id"), "candidate_id")


def queries():
    skip = {"tidy"}
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in skip | {"queries"}}
