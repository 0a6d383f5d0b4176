"""Outlines of masks: rings against flood fills, places in WGS84, GeoJSON and KML text."""

import json
import random
import re
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from terrainflow.functions.geo import to_utm
from terrainflow.operators import boundaries as b
from terrainflow.sources import sinks

MASKS = [
    ["1110", "1010", "1111", "0000", "0001"],
    ["011", "101", "111"],  # the ends of a bow meet at a corner
    ["1111", "1011", "1101", "1111"],  # two holes meet at a corner
    ["1111111", "1000001", "1011101", "1010101", "1011101", "1000001", "1111111"],  # an island with a hole in a hole
    ["1"],
    ["1111", "1001", "1011", "1111", "0110"],
]
MEMBER = "site_id bigint, outlet bigint, row int, col int"


def rows_of(masks):
    return [(k, 9, r, c) for k, mask in enumerate(masks) for r, row in enumerate(mask) for c, v in enumerate(row) if v == "1"]


def pieces(cells):
    """Sets of cells that hang together along sides."""
    left, out = set(cells), []
    while left:
        piece, front = set(), [left.pop()]
        while front:
            r, c = front.pop()
            piece.add((r, c))
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if p in left:
                    left.remove(p)
                    front.append(p)
        out.append(piece)
    return out


def expected(mask):
    """(cells inside the shell, sizes of its holes) of each part."""
    cells = {(r, c) for r, row in enumerate(mask) for c, v in enumerate(row) if v == "1"}
    around = {(r, c) for r in range(-1, len(mask) + 1) for c in range(-1, len(mask[0]) + 1)}
    out = []
    for part in pieces(cells):
        holes = sorted(len(p) for p in pieces(around - part) if (-1, -1) not in p)
        out.append((len(part) + sum(holes), holes))
    return sorted(out)


def test_rings_of_any_mask_are_its_shells_and_their_holes(spark):
    rng = random.Random(4)
    masks = MASKS + [["".join("1" if rng.random() < rng.choice((0.5, 0.7, 0.8)) else "0" for _ in range(9)) for _ in range(8)] for _ in range(40)]
    masks = [m for m in masks if any("1" in row for row in m)]
    found = {}
    for r in b.nested_rings(spark.createDataFrame(rows_of(masks), MEMBER)).collect():
        corners = [tuple(p) for p in r.corners]
        assert corners[0] == corners[-1] and len(set(corners)) == len(corners) - 1, "rings are closed and touch no corner twice"
        assert all((p[0] == q[0]) != (p[1] == q[1]) for p, q in zip(corners, corners[1:], strict=False))
        found.setdefault(r.site_id, {}).setdefault(r.part, []).append((r.hole, r.area_cells))
    for k, mask in enumerate(masks):
        got = sorted((next(a for h, a in rings if not h), sorted(a for h, a in rings if h)) for rings in found[k].values())
        assert got == expected(mask), mask


def test_repeated_members_count_once_and_no_members_give_no_rings(spark):
    rows = rows_of(MASKS[:1])
    once = b.nested_rings(spark.createDataFrame(rows, MEMBER)).collect()
    assert sorted(map(str, once)) == sorted(map(str, b.nested_rings(spark.createDataFrame(rows * 2, MEMBER)).collect()))
    assert b.nested_rings(spark.createDataFrame([], MEMBER)).count() == 0


def test_boundary_in_wgs84_goes_back_to_the_same_metres(spark):
    members = spark.createDataFrame(rows_of(MASKS), MEMBER)
    grid = spark.createDataFrame([(k, r, c, 400_000.0 + 5 * c, 1_900_000.0 - 10 * r) for k, m in enumerate(MASKS) for r in range(len(m)) for c in range(len(m[0]))], "site_id bigint, row int, col int, x double, y double")
    frames = b.grid_frames(grid, F.lit(43), F.lit(False))
    assert {(f.dx, f.dy) for f in frames.collect()} == {(5.0, -10.0), (1.0, 1.0)}, "one row or column: a step of one"
    placed = b.in_wgs84(b.nested_rings(members), frames).join(frames, "site_id")
    each = placed.select("x0", "y0", "dx", "dy", F.explode(F.arrays_zip("corners", "points")).alias("v"))
    back = each.select("*", to_utm(F.col("v.points.longitude"), F.col("v.points.latitude"), F.lit(43), F.lit(False)).alias("m")).collect()
    assert back
    for r in back:
        assert r.m.x == pytest.approx(r.x0 + (r.v.corners.c - 0.5) * r.dx, abs=1e-4)
        assert r.m.y == pytest.approx(r.y0 + (r.v.corners.r - 0.5) * r.dy, abs=1e-4)


def test_geojson_and_placemarks_of_parts(spark):
    members = spark.createDataFrame(rows_of(MASKS[:2]), MEMBER)
    frames = spark.createDataFrame([(0, 500_000.0, 2_000_000.0, 5.0, 5.0, 44, False), (1, 500_000.0, 2_000_000.0, 5.0, 5.0, 44, False)], "site_id bigint, x0 double, y0 double, dx double, dy double, zone int, south boolean")
    shapes = b.multipolygons(b.in_wgs84(b.nested_rings(members), frames)).orderBy("site_id")
    two, one = shapes.select("parts", "holes", sinks.geojson_polygons(F.col("polygons")).alias("g"), sinks.multipolygon_placemarks(F.lit("Catchment <1>"), F.col("polygons")).alias("k")).collect()
    shape = json.loads(two.g)
    assert (two.parts, two.holes, shape["type"]) == (2, 1, "MultiPolygon")
    assert [[len(ring) for ring in part] for part in shape["coordinates"]] == [[7, 5], [5]]
    assert json.loads(one.g)["type"] == "Polygon" and len(json.loads(one.g)["coordinates"]) == 2
    assert re.findall("<name>(.*?)</name>", two.k) == ["Catchment &lt;1&gt; 1", "Catchment &lt;1&gt; 2"]
    assert re.findall("<name>(.*?)</name>", one.k) == ["Catchment &lt;1&gt;"]
    first = shape["coordinates"][1][0]
    text = " ".join(f"{x:.12g},{y:.12g},0" for x, y in first)
    assert f"<coordinates>{text}</coordinates>" in two.k


def test_a_document_has_the_catchment_after_the_bounds(spark):
    sites = spark.createDataFrame([(0, 18.0, 81.0, 17.9, 80.9, 18.1, 81.1)], "site_id bigint, latitude double, longitude double, south double, west double, north double, east double")
    ranked = spark.createDataFrame([(0, 1, 18.01, 81.01), (0, 2, 18.02, 81.02)], "site_id bigint, rank int, latitude double, longitude double")
    frames = spark.createDataFrame([(0, 500_000.0, 2_000_000.0, 5.0, 5.0, 44, False)], "site_id bigint, x0 double, y0 double, dx double, dy double, zone int, south boolean")
    shape = b.multipolygons(b.in_wgs84(b.nested_rings(spark.createDataFrame(rows_of(MASKS[:1]), MEMBER)), frames))
    text = sinks.kml_documents(sinks.site_placemarks(sites, ranked, catchments=shape)).first().kml
    names = re.findall("<name>(.*?)</name>", text)
    assert names == ["Centre", "Analysis Boundary", "Catchment Boundary 1", "Catchment Boundary 2", "Recommended Site", "Alternative Candidate 1"]
    ElementTree.fromstring(text.split("?>", 1)[1])


def test_numbers_have_twelve_significant_digits(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, -1.0, 10.0, 100.0, 180.0, -90.5, 0.1, 1e-4, 9.9999999999999e-5, 1.5e-7, -2e-10, 99.9999999999999, 9.99999999999, 1 / 3, -123.456789012345]
    values += [rng.uniform(-180, 180) * 10 ** -rng.randrange(9) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", sinks.significant(F.col("v")).alias("t")).collect()
    assert [(r.v, r.t) for r in rows] == [(r.v, f"{r.v:.12g}") for r in rows]


def test_shapes_without_polygons_have_no_text(spark):
    empty = spark.createDataFrame([(1, None), (2, [])], "site_id bigint, polygons array<array<array<struct<longitude:double,latitude:double>>>>")
    for r in empty.select(sinks.geojson_polygons(F.col("polygons")).alias("g"), sinks.multipolygon_placemarks(F.lit("x"), F.col("polygons")).alias("k")).collect():
        assert r.g is None and r.k is None


def test_parts_that_meet_at_corners_enclose_a_piece(spark):
    around = [(0, 1), (1, 0), (1, 2), (2, 1)]  # four cells around (1, 1), joined at corners only
    holed = [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    rows = [(1, 0, r, c) for r, c in around] + [(2, 0, r, c) for r, c in holed] + [(3, 0, 0, 0), (3, 0, 1, 1)]
    rings = b.nested_rings(spark.createDataFrame(rows, MEMBER)).collect()
    got = {s: (sum(not r.hole for r in rings if r.site_id == s), sum(r.hole for r in rings if r.site_id == s), {r.enclosed for r in rings if r.site_id == s}) for s in (1, 2, 3)}
    assert got == {1: (4, 0, {1}), 2: (1, 1, {1}), 3: (2, 0, {0})}
