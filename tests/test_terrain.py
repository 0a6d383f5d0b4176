import heapq
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from terrainflow.functions.geo import analysis_bounds
from terrainflow.operators import candidates as cand
from terrainflow.operators import hydrology as h
from terrainflow.operators.boundaries import nested_rings
from terrainflow.operators.independent import thin
from terrainflow.operators.rainfall import RainfallConfig, seasonal_rainfall
from terrainflow.operators.scoring import EngineConfig, Limits, rank_legacy
from terrainflow.operators.spatial import leader_clusters
from terrainflow.operators.stencil import OFFSETS, clean_elevation, dense_grid, with_slope
from terrainflow.sources.kml import parse_contours, raster_cells, read_contours
from terrainflow.sources.sinks import geojson_col, line_placemark, polygon_placemark, report_json
from terrainflow.streaming.rain import seasonal_totals_stream


def grid_table(spark, grids):
    """{site: rows of values} -> (dense cells, meta)."""
    cells = [(s, r, c, v) for s, g in grids.items() for r, row in enumerate(g) for c, v in enumerate(row)]
    meta = [(s, len(g), len(g[0]), 10.0) for s, g in grids.items()]
    return (
        clean_elevation(spark.createDataFrame(cells, "site_id bigint, row int, col int, elevation double")),
        spark.createDataFrame(meta, "site_id bigint, rows int, cols int, resolution_m double"),
    )


def flood(z, eps=1e-4):
    """Priority flood on lists; None: no data."""
    rows, cols = len(z), len(z[0])
    level, heap = {}, []
    for r in range(rows):
        for c in range(cols):
            if z[r][c] is not None and (r in (0, rows - 1) or c in (0, cols - 1)):
                level[r, c] = z[r][c]
                heapq.heappush(heap, (z[r][c], r, c))
    while heap:
        p, r, c = heapq.heappop(heap)
        for a, b in OFFSETS:
            n = (r + a, c + b)
            if 0 <= n[0] < rows and 0 <= n[1] < cols and z[n[0]][n[1]] is not None and n not in level:
                v = z[n[0]][n[1]]
                level[n] = v if v > p else p + eps
                heapq.heappush(heap, (level[n], *n))
    return level


def random_grids(n, seed):
    rng = random.Random(seed)
    out = {}
    for s in range(n):
        rows, cols = rng.randint(1, 14), rng.randint(1, 14)
        out[s] = [[None if rng.random() < 0.1 else float(rng.randint(0, 8)) for _ in range(cols)] for _ in range(rows)]
    return out


@pytest.mark.parametrize("tile", [3, 5, 256])
def test_fill_equals_priority_flood(spark, tile):
    grids = random_grids(25, tile)
    cells, meta = grid_table(spark, grids)
    got = {(r.site_id, r.row, r.col): r for r in h.fill_depressions(cells, meta, tile=tile).collect()}
    for s, g in grids.items():
        want = flood(g)
        for r, row in enumerate(g):
            for c, z in enumerate(row):
                cell = got[s, r, c]
                assert cell.filled == want.get((r, c), z), (s, r, c)
                assert cell.reachable == ((r, c) in want)


def test_invariants_of_a_filled_grid(spark):
    grids = random_grids(12, 77)
    cells, meta = grid_table(spark, grids)
    filled = h.fill_depressions(cells, meta)
    flow = h.d8(filled, meta, "filled").cache()
    acc = h.flow_accumulation(flow, "filled").cache()
    total = {r.site_id: r.n for r in flow.where("filled is not null").groupBy("site_id").agg(F.count("*").alias("n")).collect()}
    ends = flow.where("filled is not null and flow_dir < 0").join(acc, ["site_id", "cell"]).groupBy("site_id").agg(F.sum("accumulation").alias("a")).collect()
    assert {r.site_id: r.a for r in ends} == {k: float(v) for k, v in total.items()}
    assert flow.where("reachable and not on_ring and flow_dir < 0").count() == 0
    outlets = h.outlets(flow, acc, 3, "filled")
    sizes = h.catchments(flow, outlets.select("site_id", F.col("cell").alias("outlet")), "filled").groupBy("site_id", "outlet").count()
    both = sizes.join(outlets.select("site_id", F.col("cell").alias("outlet"), "accumulation_cells"), ["site_id", "outlet"]).collect()
    assert both and all(r["count"] == r.accumulation_cells for r in both)


def test_small_grids(spark):
    plane = [[100 + 0.5 * r + 0.25 * c for c in range(6)] for r in range(6)]
    flat = [[10.0] * 5 for _ in range(5)]
    sink = [row[:] for row in plane]
    sink[2][2] = 0.0
    only = [[float("nan")] * 3, [float("nan"), 5.0, float("inf")], [float("nan")] * 3]
    cells, meta = grid_table(spark, {0: plane, 1: flat, 2: sink, 3: only})
    flow = h.d8(cells, meta).cache()
    of = lambda s: {(r.row, r.col): r for r in flow.where(F.col("site_id") == s).collect()}
    assert of(0)[3, 3].flow_dir == 7 and of(0)[0, 3].flow_dir == 6 and of(0)[0, 0].flow_dir == -1
    assert {r.flow_dir for r in of(1).values()} == {-1}
    assert [k for k, r in of(2).items() if r.sink] == [(2, 2)]
    assert [k for k, r in of(3).items() if r.elevation is not None] == [(1, 1)]
    slopes = with_slope(cells.where("site_id = 0"), meta).select("gradient").distinct().collect()
    assert all(abs(r.gradient - (0.05**2 + 0.025**2) ** 0.5) < 1e-12 for r in slopes)
    assert {r.site_id: r.internal_sinks for r in h.internal_sinks(cells, meta).collect()} == {0: 0, 1: 9, 2: 1, 3: 1}


def test_cycles_have_no_accumulation(spark):
    # 0 -> 1 -> 3 -> 2 -> 0, and 4 -> 0
    rows = [(0, 0, 1, 1.0), (0, 1, 3, 1.0), (0, 3, 2, 1.0), (0, 2, 0, 1.0), (0, 4, 0, 1.0), (0, 5, -1, 1.0), (0, 6, 5, 1.0), (0, 7, 99, 1.0)]
    flow = spark.createDataFrame(rows, "site_id bigint, cell bigint, downstream bigint, elevation double")
    assert {r.cell: r.accumulation for r in h.flow_accumulation(flow).collect()} == {0: None, 1: None, 2: None, 3: None, 4: 1.0, 5: 2.0, 6: 1.0, 7: 1.0}
    assert {r.cell: r.outlet for r in h.drainage_outlet(flow).collect()} == {0: None, 1: None, 2: None, 3: None, 4: None, 5: 5, 6: 5, 7: 7}


def plain_route(down):
    """{cell: downstream} of one site -> ({cell: accumulation}, {cell: outlet}, {cell: members}) step by step."""
    paths, outlet = {}, {}
    for c in down:
        path, at = [], c
        while at in down and at not in path:
            path.append(at)
            at = down[at]
        paths[c], outlet[c] = path, None if at in path else path[-1]
    members = {c: sorted(x for x in down if c in paths[x]) for c in down}
    on_cycle = {c for c in down if down[c] in paths and c in paths[down[c]]}
    return {c: None if c in on_cycle else float(len(members[c])) for c in down}, outlet, members


@pytest.mark.parametrize("tile", [3, 256])
def test_routing_equals_the_plain_walk(spark, tile):
    """Flat indices and any target: trees, cycles inside tiles and across them, targets that are no cells."""
    rng, rows, sites = random.Random(tile), [], {}
    for s in range(6):
        n = rng.randint(1, 60)
        pick = (lambda c: rng.randint(-1, max(-1, c - 1))) if s % 3 else (lambda c: rng.randint(-1, n + 3))  # noqa: B023
        sites[s] = {c: pick(c) for c in range(n) if rng.random() < 0.9 or c == 0}
        rows += [(s, c, d, 1.0) for c, d in sites[s].items()] + [(s, n + 7, 0, None)]
    flow = spark.createDataFrame(rows, "site_id bigint, cell bigint, downstream bigint, elevation double").repartition(3).cache()
    got = {(r.site_id, r.cell): r for r in h.route(flow, tile=tile).collect()}
    outlets = flow.where("cell % 3 = 0").select("site_id", F.col("cell").alias("outlet"))
    inside = {}
    for r in h.catchments(flow, outlets, tile=tile).collect():
        inside.setdefault((r.site_id, r.outlet), []).append(r.cell)
    labels = {(r.site_id, r.cell): r for r in h.flow_labels(flow, tile=tile).collect()}
    assert len(got) == sum(map(len, sites.values()))
    for s, down in sites.items():
        acc, outlet, members = plain_route(down)
        for c in down:
            assert (got[s, c].accumulation, got[s, c].outlet) == (acc[c], outlet[c]), (s, c)
            if c % 3 == 0:
                assert sorted(inside[s, c]) == members[c], (s, c)
            if outlet[c] is not None:
                x = labels[s, c]
                assert sorted(labels[s, m].first for m in members[c]) == list(range(x.first, x.last + 1))


def test_routing_of_grids_does_not_depend_on_tiles(spark):
    cells, meta = grid_table(spark, random_grids(6, 7))
    flow = h.d8(h.fill_depressions(cells, meta), meta, "filled").cache()
    rows = lambda t: {(r.site_id, r.cell): (r.accumulation, r.outlet) for r in h.route(flow, "filled", t).collect()}
    assert rows(4) == rows(256)


def test_rings_of_a_mask_with_a_hole_and_two_parts(spark):
    mask = ["1110", "1010", "1111", "0000", "0001"]
    members = spark.createDataFrame([(0, 9, r, c) for r, row in enumerate(mask) for c, v in enumerate(row) if v == "1"], "site_id bigint, outlet bigint, row int, col int")
    rings = nested_rings(members).collect()
    assert sorted((r.part, r.hole, r.area_cells) for r in rings) == [(1, False, 10.0), (1, True, 1.0), (2, False, 1.0)]
    assert all(r.corners[0] == r.corners[-1] for r in rings)
    runs = sorted((r.row, r.col_start, r.col_end) for r in h.mask_runs(members).collect())
    assert runs == [(0, 0, 2), (1, 0, 0), (1, 2, 2), (2, 0, 3), (4, 3, 3)]


def greedy(points, distance, strict):
    kept, because = [], {}
    for i, _, x, y in sorted(points, key=lambda p: p[1]):
        bx, by = x // distance, y // distance
        near = [(((k[2] // distance) - bx, (k[3] // distance) - by), k[1], k[0]) for k in kept if ((k[2] - x) ** 2 + (k[3] - y) ** 2 < distance**2 or not strict and (k[2] - x) ** 2 + (k[3] - y) ** 2 == distance**2)]
        if near:
            because[i] = min(near)[2]
        else:
            kept.append((i, _, x, y))
    return {k[0] for k in kept}, because


@pytest.mark.parametrize("strict", [True, False])
def test_thinning_equals_the_sequential_pick(spark, strict):
    rng = random.Random(4)
    points = [(i, (i * 37) % 199, float(rng.randint(0, 60)), float(rng.randint(0, 60))) for i in range(199)]
    table = spark.createDataFrame([(0, *p) for p in points], "site_id bigint, id bigint, priority bigint, x double, y double")
    kept, dropped = thin(table, 10.0, strict)
    want, because = greedy(points, 10.0, strict)
    assert {r.id for r in kept.collect()} == want
    assert {r.id: r.because for r in dropped.collect()} == because


def test_leader_clusters(spark):
    points = [(0, i, i, float(x), 0.0) for i, x in enumerate([0, 5, 10, 11, 30])]
    table = spark.createDataFrame(points, "site_id bigint, id bigint, seq bigint, x double, y double")
    assert {r.id: r.leader for r in leader_clusters(table, 10.0).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    assert leader_clusters(table, 0.0).where("id = leader").count() == 5


def test_peaks_and_separation(spark):
    values = [[1.0, 5, 5, 1, 1], [1, 1, 5, 1, 1], [1, 1, 1, 1, 7], [0, 0, 0, 7, 0]]
    cells = spark.createDataFrame([(0, r, c, float(v)) for r, row in enumerate(values) for c, v in enumerate(row)], "site_id bigint, row int, col int, accumulation double")
    peaks = cand.plateau_peaks(cand.local_maxima(cells))
    assert {(r.row, r.col) for r in peaks.collect()} == {(0, 1), (0, 4), (2, 0), (2, 4), (3, 3)}
    c = spark.createDataFrame([(0, "a", 0, 0, 9.0, 0.0, 0.0), (0, "b", 0, 1, 8.0, 49.9, 0.0), (0, "c", 0, 2, 7.0, 50.0, 0.0)], "site_id bigint, candidate_id string, row int, col int, flow_accumulation_cells double, x double, y double")
    kept, dropped = cand.separate(c, 50.0)
    assert sorted(r.candidate_id for r in kept.collect()) == ["a", "c"]
    assert [(r.candidate_id, r.duplicate_of) for r in dropped.collect()] == [("b", "a")]


KML = """<kml xmlns="http://www.opengis.net/kml/2.2"><Document>
<Placemark><name> Contour 105.5 m </name><LineString><coordinates>81.1,21.2,0 81.2,21.3
 nan,nan foo,bar 81.3,21.4</coordinates></LineString></Placemark>
<Placemark><name>x</name><ExtendedData><SchemaData><SimpleData name="ID">7</SimpleData><SimpleData name="ELEV_M">-12</SimpleData></SchemaData></ExtendedData><LineString><coordinates>1,2 3,4</coordinates></LineString></Placemark>
<Placemark><elevation>9</elevation><name>Contour 1</name><LineString><coordinates>1,2</coordinates></LineString></Placemark>
<Placemark><name>none</name><LineString><coordinates>1,2 3,4</coordinates></LineString></Placemark>
</Document></kml>"""


def test_contours_from_text_and_files(spark, tmp_path):
    contours, errors = parse_contours(spark.createDataFrame([("a", KML), ("b", "<kml></kml>")], "site_id string, kml string"))
    rows = sorted((r.contour_id, r.elevation_m, r.name, len(r.coords)) for r in contours.collect())
    assert rows == [(0, 105.5, "Contour 105.5 m", 3), (1, -12.0, "x", 2)]
    assert [r.site_id for r in errors.collect()] == ["b"]
    (tmp_path / "a.kml").write_text(KML)
    (tmp_path / "bad.kmz").write_bytes(b"PK\x03\x04 not an archive")
    (tmp_path / "empty.kml").write_text("no markup")
    with zipfile.ZipFile(tmp_path / "b.kmz", "w") as z:
        z.writestr("x/other.kml", KML)
    with zipfile.ZipFile(tmp_path / "c.kmz", "w") as z:
        z.writestr("readme.txt", "no")
    contours, errors = read_contours(spark, str(tmp_path))
    assert {r.site_id.rsplit("/", 1)[1] for r in contours.collect()} == {"a.kml", "b.kmz"}
    assert {r.site_id.rsplit("/", 1)[1] for r in errors.collect()} == {"bad.kmz", "empty.kml", "c.kmz"}


def test_raster_bounds_and_sinks(spark):
    rows = spark.createDataFrame([(0, 0, [1.0, -9999.0]), (0, 1, [3.0, float("nan")]), (1, 0, [-9999.0])], "site_id bigint, row int, elevations array<double>")
    cells, summary = raster_cells(rows, 10.0, 5.0, -10.0, 95.0, -9999.0)
    assert {(r.row, r.col): (r.x, r.y, r.elevation) for r in cells.where("site_id = 0").collect()} == {(0, 0): (5.0, 95.0, 1.0), (0, 1): (15.0, 95.0, None), (1, 0): (5.0, 85.0, 3.0), (1, 1): (15.0, 85.0, None)}
    assert {r.site_id: (r.valid_fraction, r.error) for r in summary.collect()} == {0: (0.5, None), 1: (0.0, "every cell is without data")}
    bad = analysis_bounds(spark.createDataFrame([(1, 91.0, 0.0, 1.0), (2, 0.0, 181.0, 1.0), (3, 0.0, 0.0, 101.0), (4, 90.0, 0.0, 1.0), (5, None, 0.0, 1.0)], "request_id bigint, latitude double, longitude double, radius_km double"))
    assert {r.request_id: r.error for r in bad.collect()} == {1: "latitude", 2: "longitude", 3: "radius_km", 4: None, 5: "latitude"}
    points = F.array(*[F.struct(F.lit(float(x)).alias("longitude"), F.lit(float(y)).alias("latitude")) for x, y in ((1, 2), (3, 4), (500, 1), (5, 2.5))])
    row = spark.range(1).select(line_placemark(F.lit("a<b"), points).alias("l"), polygon_placemark(F.lit("p"), points).alias("p"), polygon_placemark(F.lit("q"), F.slice(points, 1, 2)).alias("q"), geojson_col(F.array(points)).alias("g")).first()
    assert "<name>a&lt;b</name>" in row.l and "1,2,0 3,4,0 5,2.5,0" in row.l
    assert row.p.count("1,2,0") == 2 and row.q is None and row.g.startswith('{"type":"Polygon"')
    assert report_json(spark.createDataFrame([(1, float("nan"), 2.0)], "site_id bigint, a double, b double")).first().report == '{"b":2.0}'


def test_rain_in_batch_and_as_a_stream(spark, tmp_path):
    rows = [(0, "2024-06-01", 5.0), (0, "2024-09-30", None), (0, "2024-10-01", 9.0), (0, "bad", 1.0), (1, "2024-01-01", 3.0), (2, "2023-07-04", 2.5)]
    daily = spark.createDataFrame(rows, "site_id bigint, date string, mm double")
    want = {0: (5.0, 2, 1.0), 2: (2.5, 1, 0.5)}
    view = lambda df: {r.site_id: (r.seasonal_total_mm, r.daily_values_used, r.mean_annual_mm) for r in df.collect()}
    assert view(seasonal_rainfall(daily)) == want
    daily.where("site_id < 2").write.parquet(str(tmp_path / "in/a"))
    daily.where("site_id = 2").write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(daily.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = seasonal_totals_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    assert view(spark.read.parquet(str(last))) == want


def test_settings_are_checked():
    for bad in (dict(weights={"hydrology": -1.0}), dict(weights={"hydrology": 0.0}), dict(distances={"road": (5.0, 5.0)})):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
    for bad in (dict(runoff_coefficient=0.0), dict(seasonal_months=()), dict(seasonal_months=(13,)), dict(rainfall_years=0)):
        with pytest.raises(ValueError):
            RainfallConfig(**bad)


def test_legacy_rank_is_stable_and_filters(spark):
    rows = [(0, k, 5.0, 20_000.0, None, None, None, None, None, None, None) for k in range(3)] + [(0, 9, 36.0, 1.0, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "site_id bigint, candidate_id bigint, slope_degrees double, catchment_area_m2 double, rainfall_mm double, water_distance_m double, road_distance_m double, building_distance_m double, n_water int, n_roads int, n_buildings int")
    ranked = rank_legacy(df, Limits()).orderBy("rank").collect()
    assert [r.candidate_id for r in ranked] == [0, 1, 2]
    assert all(r.score_land_use == 0.75 and r.score_water_distance == 0.5 for r in ranked)


def test_dense_grid_adds_missing_cells(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1.0)], "site_id bigint, row int, col int, elevation double")
    meta = spark.createDataFrame([(0, 2, 3, 5.0)], "site_id bigint, rows int, cols int, resolution_m double")
    assert dense_grid(cells, meta).count() == 6


def test_engine_pipeline_takes_the_rain_of_every_site(spark, monkeypatch):
    from terrainflow.plans import pipelines, queries, tables

    path, seen = "/root/testdata/sf0.001", {}
    columns = "site_id bigint, label string, id bigint, overall_score double, confidence double, recommendation string, summary string"
    monkeypatch.setattr(pipelines, "engine_pipeline", lambda cells, meta, segments, daily: seen.update(meta=meta, daily=daily) or spark.createDataFrame([], columns))
    queries.engine_pipeline(spark, path)
    sites = {r.site_id for r in seen["meta"].collect()}
    assert {r.site_id for r in seen["daily"].collect()} == sites == {r.site_id for r in tables.dem_cells(spark, path).select("site_id").distinct().collect()}


def test_filling_goes_on_until_levels_settle(spark, monkeypatch):
    """A pit row whose water leaves at one end, over more tiles than a limit of rounds would allow."""
    grid = [[9.0] * 14, [0.0, *[5.0 - 0.1 * c for c in range(1, 13)], 9.0], [9.0] * 14]
    dense, meta = grid_table(spark, {0: grid})
    monkeypatch.setattr(h, "MAX_ROUNDS", 2, raising=False)
    levels = lambda tile: {(r.row, r.col): (round(r.filled, 6), r.reachable) for r in h.fill_depressions(dense, meta, tile=tile).collect()}
    assert levels(2) == levels(64)
