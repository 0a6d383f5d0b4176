"""Branches of the whole analyses: outlets to fall back on, sites without features, enrichment limits, alternatives as candidates."""

import json

import pytest
from pyspark.sql import functions as F

from terrainflow.operators import boundaries as bnd
from terrainflow.operators import hydrology as h
from terrainflow.operators import quality as qa
from terrainflow.operators import scoring as sc
from terrainflow.operators import spatial as sp
from terrainflow.operators.stencil import dense_grid
from terrainflow.plans import pipelines


def grid(spark, sites):
    rows = [(k, r, c, z) for k, g in sites.items() for r, line in enumerate(g) for c, z in enumerate(line)]
    cells = spark.createDataFrame(rows, "site_id bigint, row int, col int, elevation double")
    meta = cells.groupBy("site_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.lit(5.0).alias("resolution_m"))
    return dense_grid(cells, meta), meta


def test_outlet_is_the_primary_one_or_the_lowest_cell_or_none(spark):
    ranked = spark.createDataFrame([(1, 5, "boundary", 9.0, True), (1, 6, "internal", 3.0, False), (2, 4, "internal", 2.0, True)], "site_id bigint, cell bigint, kind string, accumulation_cells double, selected boolean")
    flow = spark.createDataFrame([(1, 0, 1.0), (3, 2, 7.0), (3, 0, 8.0), (3, 1, 7.0), (4, 0, None)], "site_id bigint, cell bigint, elevation double")
    acc = spark.createDataFrame([(3, 2, 4.0)], "site_id bigint, cell bigint, accumulation double")
    got = {r.site_id: (r.outlet, r.kind, r.accumulation_cells, r.outlet_source) for r in pipelines.main_outlets({"outlets": ranked, "flow": flow, "accumulation": acc}).collect()}
    assert got == {
        1: (5, "boundary", 9.0, "hydrology_candidate_max_drainage"),
        2: (4, "internal", 2.0, "hydrology_internal_endpoint"),
        3: (1, None, None, "hydrology_lowest_valid_cell"),  # cells 1 and 2 tie, the first counts
    }


def test_presence_of_features_sets_the_distances(spark):
    sites = spark.createDataFrame([(k, 3.0, 90_000.0) for k in range(4)], "site_id bigint, mean_slope double, area_m2 double")
    presence = spark.createDataFrame([(0, 0, 0, 0), (1, 1, 0, 0), (2, 2, 3, 1)], "site_id bigint, n_water bigint, n_roads bigint, n_buildings bigint")
    got = {r.site_id: r.overall_score for r in pipelines.site_recommendation(sites, presence).collect()}
    assert got[3] == got[0], "a site without a row has no features"
    assert len({round(v, 9) for v in (got[0], got[1], got[2])}) == 3
    plain = {r.overall_score for r in pipelines.site_recommendation(sites).collect()}
    assert len(plain) == 1


def test_enrichment_beyond_the_limit_has_no_distances_and_counts_as_unknown(spark):
    points = spark.createDataFrame([(1, k, k, 100.0 * k, 0.0) for k in range(1, 6)] + [(2, 1, 9, 0.0, 0.0)], "site_id bigint, id bigint, rank int, x double, y double")
    houses = sp.point_features(spark.createDataFrame([(1, 7, 110.0, 0.0)], "site_id bigint, feature_id bigint, x double, y double"), "building")
    out = sp.enrich(points, houses, sp.ContextConfig(max_enriched_candidates=3)).cache()
    rows = {(r.site_id, r.id): r for r in out.collect()}
    assert rows[1, 1].feasibility == "rejected" and rows[1, 1].n_building == 1 and rows[1, 1].n_road == 0
    assert rows[1, 4].building_distance_m is None and rows[1, 4].n_building == 0 and rows[1, 4].feasibility_reason == "not_enriched_candidate_limit"
    got = {r.site_id: (r.feasible_count, r.rejected_count, r.unknown_count, r.feasibility_reasons) for r in sp.enrichment_diagnostics(out).collect()}
    assert got == {1: (2, 1, 2, {"insufficient_building_clearance": 1, "not_enriched_candidate_limit": 2}), 2: (0, 0, 1, {"not_enriched_candidate_limit": 1})}
    assert sp.enrichment_diagnostics(out.where("feasibility = 'feasible'")).first().feasibility_reasons == {}


def test_catchments_and_alternatives_of_a_slope(spark):
    dense, meta = grid(spark, {1: [[10.0 * r + c for c in range(6)] for r in range(6)]})
    flow = h.d8(dense, meta).cache()
    acc = h.flow_accumulation(flow)
    main = spark.createDataFrame([(1, 0)], "site_id bigint, outlet bigint")
    frames = spark.createDataFrame([(1, 500_000.0, 2_000_000.0, 5.0, 5.0, 44, False)], "site_id bigint, x0 double, y0 double, dx double, dy double, zone int, south boolean")
    one = pipelines.analyze_catchment(flow, acc, main, meta, frames).first()
    sizes = {r.cell: r.accumulation for r in acc.collect()}
    assert (one.cells, one.area_m2, one.area_ok) == (sizes[0], 25.0 * sizes[0], True)
    assert json.loads(one.boundary)["type"] in ("Polygon", "MultiPolygon")
    score = spark.createDataFrame([(1, 0.5)], "site_id bigint, suitability_score double")
    picked = pipelines.alternative_candidates(flow, acc, main.withColumnRenamed("outlet", "cell"), meta, frames, score).orderBy("candidate_id").collect()
    assert [r.candidate_id for r in picked] == ["alternative-1", "alternative-2", "alternative-3"]
    for r in picked:
        assert r.cell != 0 and r.cell == r.row * 6 + r.col and r.elevation == 10.0 * r.row + r.col
        assert r.catchment_area_m2 == 25.0 * sizes[r.cell] and r.suitability_score == 0.5
        assert r.longitude == pytest.approx(81.0 + r.col * 5 / 105_200, abs=1e-3)


def test_quality_sections_side_by_side(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "site_id bigint, elevation_min_m double")
    b = spark.createDataFrame([(1, 5.0, 7)], "site_id bigint, elevation_min_m double, dem_cells int")
    there = spark.createDataFrame([(1, "unavailable"), (2, None), (9, "available")], "site_id bigint, status string")
    out = qa.quality_metrics(a, b, qa.external_availability(a, rainfall=there, land=a.where("site_id = 1")))
    got = {r.site_id: (r.elevation_min_m, r.dem_cells, r.external_data.rainfall, r.external_data.land) for r in out.collect()}
    assert got == {1: (5.0, 7, False, True), 2: (3.0, None, True, False)}


def test_phrases_follow_two_limits_for_each_component(spark):
    rows = spark.createDataFrame([(1, 0.6, 0.7, 0.3), (2, 0.59, 0.69, 0.29), (3, 0.1, 0.39, None)], "id int, slope double, land double, rainfall double")
    got = {r.id: r.phrases for r in sc.explainability(rows).collect()}
    assert got == {1: ["slope: good", "rainfall: moderate", "land: good"], 2: ["slope: moderate", "rainfall: poor", "land: moderate"], 3: ["slope: poor", "land: poor"]}


def test_frames_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "site_id bigint, row int, col int, x double, y double")
    assert bnd.grid_frames(empty, F.lit(44), F.lit(False)).count() == 0
