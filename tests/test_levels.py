"""Row numbers in two levels, boxes in a quadtree, KML by the XML reader."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrainflow.operators import hydrology as h
from terrainflow.operators.numbering import numbered
from terrainflow.sources import kml, quadtree

SIDES = "west double, south double, east double, north double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_equal_those_of_a_window_and_a_large_group_spans_parts(spark):
    hot = spark.range(30_000).select(F.when(F.col("id") % 5 == 0, F.col("id") % 7).otherwise(F.lit(100)).alias("site_id"), "id", (F.hash("id") % 500).alias("v"))
    hot = hot.withColumn("site_id", F.when(F.col("site_id") != 3, F.col("site_id")))  # a null group
    order = [F.desc("v"), "id"]
    got = numbered(hot, "place", order)
    want = hot.withColumn("place", F.row_number().over(Window.partitionBy("site_id").orderBy(*order)).cast("bigint"))
    assert got.count() == 30_000
    assert got.select("site_id", "id", "place").exceptAll(want.select("site_id", "id", "place")).isEmpty()
    spans = hot.repartitionByRange(8, "site_id", *order).where("site_id = 100").select(F.spark_partition_id()).distinct().count()
    assert spans > 1


def test_numbers_of_an_empty_table_and_of_repeated_rows(spark):
    assert numbered(spark.createDataFrame([], "site_id int, v int"), "n", ["v"]).collect() == []
    rows = numbered(spark.createDataFrame([(1, 5), (1, 5), (1, 5), (2, 5)], "site_id int, v int"), "n", ["v"]).collect()
    assert sorted((r.site_id, r.n) for r in rows) == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_first_ends_of_a_site_are_cut_before_the_shuffle(spark):
    cells = spark.range(64).select((F.col("id") % 3).alias("site_id"), "id", F.col("id").alias("cell"), (F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"), F.lit(1.0).alias("elevation"), F.lit(-1).alias("flow_dir"))
    text = plan(h.terminal_cells(cells, 3))
    assert text.count("WindowGroupLimit") == 2  # in each task, then of what is left


def boxes(rng, n, spread, sizes):
    out = []
    for i in range(n):
        w, s = rng.uniform(-spread, spread), rng.uniform(-spread, spread)
        a, b = rng.choice(sizes), rng.choice(sizes)
        if rng.random() < 0.3:
            w, s = float(round(w)), float(round(s))  # on borders of cells
        out.append((i, w, s, w + a * rng.choice([0.3, 1.0]), s + b))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_boxes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    sizes = [0.0, 1e-5, 0.001, 0.01, 0.5, 1.0, 2.0, 16.0, 90.0]
    features, asked = boxes(rng, 400, 40, sizes), boxes(rng, 60, 40, sizes)
    touch = {(q[0], f[0]) for q in asked for f in features if f[1] <= q[3] and f[3] >= q[1] and f[2] <= q[4] and f[4] >= q[2]}
    f = spark.createDataFrame(features, f"feature_id int, {SIDES}")
    got = quadtree.features_in_boxes(f, spark.createDataFrame(asked, f"request_id int, {SIDES}")).select("request_id", "feature_id").collect()
    assert len(got) == len(touch) and {tuple(r) for r in got} == touch


def test_odd_boxes_touch_nothing_and_repeated_rows_stay(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 0.0, 1.0, 1.0), (2, nan, 0.0, 1.0, 1.0), (3, 1.0, 0.0, 0.0, 1.0), (4, 0.0, 0.0, inf, 1.0), (5, 0.0, 0.0, 600.0, 1.0), (6, 0.0, 0.0, 0.0, nan)]
    good = [(7, 0.5, 0.5, 0.5, 0.5), (7, 0.5, 0.5, 0.5, 0.5)]
    f = spark.createDataFrame(odd + good, f"feature_id int, {SIDES}")
    q = spark.createDataFrame(odd + [(9, -180.0, -90.0, 180.0, 90.0), (10, 0.5, 0.5, 0.5, 0.5)], f"request_id int, {SIDES}")
    got = sorted((r.request_id, r.feature_id) for r in quadtree.features_in_boxes(f, q).collect())
    assert got == [(9, 7), (9, 7), (10, 7), (10, 7)]
    assert quadtree.features_in_boxes(f, q.limit(0)).collect() == []


def test_a_box_of_any_size_looks_in_few_cells(spark):
    f = spark.createDataFrame([(1, 10.0, 10.0, 10.0, 10.0)], f"feature_id int, {SIDES}")
    for size in (1e-6, 0.01, 3.0, 170.0):
        got = quadtree.features_in_boxes(f, spark.createDataFrame([(1, 10 - size, 10 - size, 10 + size, 10 + size)], f"request_id int, {SIDES}"))
        assert got.count() == 1
        for level in range(quadtree.DEEPEST + 1):
            assert len(quadtree.code_ranges((10 - size, 10 - size, 10 + size, 10 + size), level)) <= 16


def test_stored_features_are_pruned_and_whole(spark, tmp_path):
    rng = random.Random(9)
    features = boxes(rng, 2000, 40, [0.0, 0.001, 0.5, 16.0])
    path = str(tmp_path / "features")
    quadtree.write_features(spark.createDataFrame(features, f"feature_id int, {SIDES}"), path)
    for w, s, e, n in ((-3.0, 4.0, 2.0, 9.0), (0.0, 0.0, 0.0, 0.0), (-180.0, -90.0, 180.0, 90.0), (39.0, 39.0, 39.001, 39.001)):
        got = quadtree.read_features(spark, path, (w, s, e, n))
        want = sorted(f[0] for f in features if f[1] <= e and f[3] >= w and f[2] <= n and f[4] >= s)
        assert sorted(r.feature_id for r in got.collect()) == want
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    text = plan(quadtree.read_features(spark, path, (-3.0, 4.0, 2.0, 9.0)))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [" in text and "level#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(code" in text and "LessThanOrEqual(west,2.0)" in text


GOOD = """<?xml version="1.0"?><k:kml xmlns:k="http://www.opengis.net/kml/2.2"><k:Document><k:Folder><k:Folder>
<k:Placemark id="a"><k:name><![CDATA[ring <b>3</b> </Placemark>]]></k:name><k:ExtendedData><k:SchemaData schemaUrl="#s"><k:SimpleData name="x">9</k:SimpleData>
<k:SimpleData name="Contour_Elev">120.5 m</k:SimpleData></k:SchemaData></k:ExtendedData><k:LineString><k:coordinates>81,21,0
81.1,21.1,0</k:coordinates></k:LineString></k:Placemark></k:Folder></k:Folder>
<k:Placemark><k:name>130 &amp; more</k:name><k:MultiGeometry><k:Point><k:coordinates>0,0</k:coordinates></k:Point><k:LineString><k:coordinates>1,2 3,4 bad x,y</k:coordinates></k:LineString><k:LineString><k:coordinates>5,6 7,8</k:coordinates></k:LineString></k:MultiGeometry></k:Placemark>
<k:Placemark><k:name>no number</k:name><k:LineString><k:coordinates>1,2 3,4</k:coordinates></k:LineString></k:Placemark>
<k:Placemark><k:elevation>-4.5</k:elevation><k:name>7</k:name><k:Polygon><k:outerBoundaryIs><k:LinearRing><k:coordinates>0,0 1,0 1,1 0,0</k:coordinates></k:LinearRing></k:outerBoundaryIs></k:Polygon></k:Placemark>
<k:Placemark><k:name>8</k:name><k:LineString><k:coordinates>1,2</k:coordinates></k:LineString></k:Placemark></k:Document></k:kml>"""


def test_placemarks_by_the_xml_reader(spark, tmp_path):
    line = "<Placemark><name>5</name><LineString><coordinates>1,2 3,4</coordinates></LineString></Placemark>"
    for name, text in {"good": GOOD, "cut": f"<kml><Document>{line}<Placemark><name>6</name></Document></kml>", "text": "no XML", "bare": "<kml><Document><Placemark><name>x</name></Placemark></Document></kml>", "plain": f"<kml>{line}</kml>"}.items():
        (tmp_path / f"{name}.kml").write_text(text)
    contours, errors = kml.read_placemarks(spark, str(tmp_path), F.regexp_extract("_metadata.file_name", r"(\w+)\.kml", 1))
    got = sorted((r.site_id, r.contour_id, r.elevation_m, r.name, [tuple(p) for p in r.coords]) for r in contours.collect())
    assert got == [
        ("good", 0, 120.5, "ring <b>3</b> </Placemark>", [(81.0, 21.0), (81.1, 21.1)]),
        ("good", 1, 130.0, "130 & more", [(1.0, 2.0), (3.0, 4.0)]),
        ("good", 3, -4.5, "7", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]),
        ("plain", 0, 5.0, "5", [(1.0, 2.0), (3.0, 4.0)]),
    ]
    bad, none = "the document is not well-formed", "no contour with an elevation and two points"
    assert {r.site_id: r.error for r in errors.collect()} == {"cut": bad, "text": bad, "bare": none}
