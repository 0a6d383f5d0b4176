import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrainflow.functions.geo import metric_crs
from terrainflow.operators.contours import grid_nearest
from terrainflow.operators.spatial import containing, distances, distinct_boxes, nearest_distance, ring_features
from terrainflow.sources import features as feat
from terrainflow.sources.kml import read_rainfall

POINT = "struct<x:double,y:double>"


def test_tags_and_layers(spark):
    rows = [(1, '"a"=>"1","a"=>"2","highway"=>"x"', None, "primary"), (2, "not tags", "lake", None), (3, None, None, None), (4, '"landuse"=>"basin","building"=>"yes"', None, None)]
    df = feat.merged_tags(spark.createDataFrame(rows, "osm_id bigint, other_tags string, water string, highway string"))
    tags = {r.osm_id: dict(r.tags) for r in df.collect()}
    assert tags == {1: {"a": "2", "highway": "primary"}, 2: {"water": "lake"}, 3: {}, 4: {"landuse": "basin", "building": "yes"}}
    layers = sorted((r.osm_id, r.layer) for r in feat.feature_layers(df).collect())
    assert layers == [(1, "roads"), (2, "water_areas"), (4, "buildings"), (4, "water_areas")]
    kinds = {r.osm_id: r.k for r in df.select("osm_id", feat.feature_kind(F.col("tags")).alias("k")).collect()}
    assert kinds == {1: "road", 2: "water", 3: None, 4: "water"}
    assert {r.k for r in feat.feature_layers(df).select(feat.layer_kind(F.col("layer")).alias("k")).collect()} == {"road", "water", "building"}


def test_geometry_parts(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    rows = [(1, "polygon", [(square, [square, square[:2]]), (square[:3], [])]), (2, "line", [(square[:2], []), (square[:1], [])]), (3, "point", [(square[:1], [])])]
    df = spark.createDataFrame(rows, f"feature_id bigint, geom_type string, parts array<struct<outer:array<{POINT}>,holes:array<array<{POINT}>>>>")
    kept = sorted((r.feature_id, r.part, len(r.outer), len(r.holes)) for r in feat.normalise(df).collect())
    assert kept == [(1, 0, 4, 1), (2, 0, 2, 0)]
    assert [r.n for r in feat.normalise(df).orderBy("feature_id").select(feat.hole_count().alias("n")).collect()] == [1, 0]
    named = feat.explode_parts(df.withColumn("tags_json", F.when(F.col("feature_id") == 1, '{"a":"b"}').otherwise("{bad")))
    assert sorted((r.element_id, dict(r.tags)) for r in named.collect()) == [("1", {"a": "b"}), ("1#1", {"a": "b"}), ("2", {}), ("2#1", {}), ("3", {})]
    shapes = spark.createDataFrame([(1, "water", square, None, None), (2, "road", square, None, None), (3, "building", [], 1.0, 2.0), (4, "water", [], None, None), (5, "water", square[:3], None, None)], f"id int, kind string, points array<{POINT}>, x double, y double")
    assert {r.id: r.geom_type for r in feat.geometry_cols(shapes).collect()} == {1: "polygon", 2: "line", 3: "point", 4: None, 5: "line"}


def test_layer_stats_and_manifest(spark):
    line = [(0.0, 0.0), (1.0, 1.0)]
    rows = [(1, "roads", line, [], "k1", True), (2, "roads", line, [], "k1", True), (3, "roads", [], [], "k2", True), (4, "roads", line, [], "k3", False), (5, "water", line * 2, [line * 2], "k4", True)]
    df = spark.createDataFrame(rows, f"feature_id bigint, layer string, outer array<{POINT}>, holes array<array<{POINT}>>, geometry_key string, in_area boolean")
    stats = {r.layer: (r.candidates, r.skipped_empty, r.skipped_outside, r.duplicates, r.features, r.interior_rings) for r in feat.layer_stats(df).collect()}
    assert stats == {"roads": (4, 1, 1, 1, 1, 0), "water": (1, 0, 0, 0, 1, 1)}
    text = json.loads(feat.manifest(feat.layer_stats(df), (1.0, 2.0, 3.0, 4.0)).first().manifest)
    assert text["study_area"]["north"] == 3.0 and text["layers"]["roads"]["duplicates"] == 1 and text["total_features"] == 2


def test_dataset_gate(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 50.0, 50.0, 51.0, 51.0), (3, 9.5, 9.5, 11.0, 11.0)], "request_id bigint, south double, west double, north double, east double")
    one = spark.createDataFrame([(True, "2025-01-01", 0.0, 0.0, 10.0, 10.0)], "readable boolean, built string, south double, west double, north double, east double").withColumn("built", F.to_date("built"))
    status = lambda m, as_of: {r.request_id: (r.dataset_status, r.coverage) for r in feat.dataset_gate(boxes, m, 30, as_of).collect()}
    assert status(one, "2025-01-10") == {1: ("ok", "full"), 2: ("out_of_coverage", "none"), 3: ("ok", "partial")}
    assert {s for s, _ in status(one, "2025-03-10").values()} == {"stale"}
    assert {s for s, _ in status(one.withColumn("readable", F.lit(False)), "2025-01-10").values()} == {"unreadable"}
    assert {s for s, _ in status(one.limit(0), "2025-01-10").values()} == {"missing"}


def test_holes_are_outside(spark):
    ring = lambda h: [(-h, -h), (h, -h), (h, h), (-h, h), (-h, -h)]
    water = ring_features(spark.createDataFrame([(0, 1, [ring(10.0), ring(4.0)])], f"site_id bigint, feature_id bigint, rings array<array<{POINT}>>"), "water")
    points = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 7.0, 0.0), (0, 3, 13.0, 14.0), (0, 4, 10.0, 0.0), (0, 5, 100.0, 0.0)], "site_id bigint, id bigint, x double, y double")
    want = {1: 4.0, 2: 0.0, 3: 5.0, 4: 0.0, 5: 90.0}
    assert {r.id: r.distance for r in distances(points, water).collect()} == want
    assert {r.id: r.distance for r in distances(points, water, 20.0, 8.0).collect()} == {k: v for k, v in want.items() if v <= 20}


def test_crs_boxes_and_rain_payloads(spark):
    rows = [(0, "EPSG:4326", 81.3, 21.2), (0, "EPSG:4326", 81.4, 21.3), (1, "EPSG:32644", 5e5, 2e6), (2, "EPSG:4326", -70.0, -33.0), (3, "local", 1.0, 2.0)]
    crs = metric_crs(spark.createDataFrame(rows, "site_id bigint, crs string, x double, y double"))
    assert {r.site_id: r.metric_crs for r in crs.collect()} == {0: "EPSG:32644", 1: "EPSG:32644", 2: "EPSG:32719", 3: "local"}
    boxes = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)] * 2 + [(1.0, 2.0, 3.0, 5.0)], "south double, west double, north double, east double")
    assert distinct_boxes(boxes).count() == 2
    payload = spark.createDataFrame([(1, (["2024-06-01", "2024-06-02"], [1.5, None])), (2, (["2024-06-01"], [1.0, 2.0]))], "location_id bigint, daily struct<time:array<string>,precipitation_sum:array<double>>")
    assert sorted((r.location_id, r.date, r.mm) for r in read_rainfall(payload).collect()) == [(1, "2024-06-01", 1.5), (1, "2024-06-02", 0.0)]


def plain_distance(x, y, seg):
    x1, y1, x2, y2 = seg
    dx, dy = x2 - x1, y2 - y1
    t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(x - x1 - t * dx, y - y1 - t * dy)


def plain_inside(x, y, edges):
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges) % 2 == 1


SEGMENTS = "site_id bigint, feature_id bigint, kind string, area boolean, x1 double, y1 double, x2 double, y2 double"


def star(cx, cy, n, rng, lo, hi):
    at = [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n) for r in [rng.uniform(lo, hi)]]
    return [(*a, *b) for a, b in zip(at, at[1:] + at[:1], strict=True)]


def test_nearest_by_rings_equals_all_pairs(spark):
    """Points near and far (beyond several rings), long lines, areas with holes, kinds that a site lacks, missing coordinates."""
    rng, rows, features = random.Random(8), [], {}
    for s in range(4):
        for f in range(rng.randint(1, 25)):
            x, y = rng.uniform(-300, 300), rng.uniform(-300, 300)
            kind = rng.choice(["road", "building"] if s == 1 else ["road", "building", "water"])
            if kind == "water":
                edges = star(x, y, 12, rng, 30, 80) + (star(x, y, 8, rng, 5, 20) if f % 2 else [])
            else:
                edges = [(x, y, x + rng.uniform(-900, 900), y + rng.uniform(-900, 900))] if kind == "road" else [(x, y, x, y)]
            features[s, f] = (kind, edges)
            rows += [(s, f, kind, kind == "water", *e) for e in edges]
    places = [(s, k, *(rng.uniform(-400, 400) if k % 5 else rng.uniform(-9000, 9000) for _ in "xy")) for s in range(5) for k in range(60)]
    points = spark.createDataFrame([*places, (0, 99, None, 1.0)], "site_id bigint, id bigint, x double, y double")
    got = {(r.site_id, r.id): (r.water_distance_m, r.road_distance_m, r.building_distance_m) for r in nearest_distance(points, spark.createDataFrame(rows, SEGMENTS)).collect()}
    assert got[0, 99] == (None, None, None) and len(got) == 301
    for s, k, x, y in places:
        want = []
        for kind in ("water", "road", "building"):
            found = [0.0 if kind == "water" and plain_inside(x, y, e) else min(plain_distance(x, y, seg) for seg in e) for (t, _), (m, e) in features.items() if (t, m) == (s, kind)]
            want.append(min(found, default=None))
        assert got[s, k] == pytest.approx(tuple(want)), (s, k)


def test_points_in_an_area_of_many_edges(spark):
    """A point meets the edges of its band only, not all of the area."""
    rng = random.Random(2)
    edges = star(0, 0, 100_000, rng, 900, 1000) + star(100, 50, 1000, rng, 200, 220)
    places = [(0, k, rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)) for k in range(200)]
    points = spark.createDataFrame(places, "site_id bigint, id bigint, px double, py double")
    segments = spark.createDataFrame(pd.DataFrame([(0, 1, "water", True, *e) for e in edges], columns=[c.split()[0] for c in SEGMENTS.split(", ")]), SEGMENTS)
    got = {r.id for r in containing(points, segments).collect()}
    a = np.array(edges)
    inside = lambda x, y: ((((a[:, 1] > y) != (a[:, 3] > y)) & (x < (a[:, 2] - a[:, 0]) * (y - a[:, 1]) / np.where(a[:, 3] == a[:, 1], 1, a[:, 3] - a[:, 1]) + a[:, 0])).sum() % 2) == 1
    assert got == {k for _, k, x, y in places if inside(x, y)}


def test_far_cells_and_sites_without_samples_stay(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0.0, 0.0), (0, 0, 1, 3e6, 0.0), (1, 0, 0, 0.0, 0.0)], "site_id bigint, row int, col int, x double, y double")
    samples = spark.createDataFrame([(0, 0, 1.0, 1.0, 7.0), (0, 1, 2.0, 2.0, 9.0)], "site_id bigint, sample bigint, x double, y double, elevation_m double")
    got = {(r.site_id, r.col): r.elevation for r in grid_nearest(cells, samples, 1000.0).collect()}
    assert got == {(0, 0): 7.0, (0, 1): 9.0, (1, 0): None}
