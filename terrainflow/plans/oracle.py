"""DuckDB SQL of the terrain queries."""

from __future__ import annotations

from terrainflow.operators import scoring as sc
from terrainflow.plans import boundary_sql as bs

CELLS = """cells AS (SELECT (o_orderkey // 1024)::BIGINT AS site_id, ((o_orderkey % 1024) // 32)::INT AS r, (o_orderkey % 32)::INT AS c,
  CASE WHEN o_orderkey % 97 <> 13 THEN 100.0::DOUBLE + 0.5::DOUBLE * ((o_orderkey % 1024) // 32) + 0.25::DOUBLE * (o_orderkey % 32) + round(o_totalprice / 250000.0::DOUBLE, 3) END AS z FROM orders),
meta AS (SELECT site_id, max(r) + 1 AS nr, max(c) + 1 AS nc FROM cells GROUP BY 1),
grid AS (SELECT site_id, nr, nc, r, unnest(range(nc))::INT AS c FROM (SELECT site_id, nr, nc, unnest(range(nr))::INT AS r FROM meta)),
dense AS (SELECT g.site_id, g.r, g.c, g.nr, g.nc, z, (g.r * g.nc + g.c)::BIGINT AS cell, (g.r = 0 OR g.c = 0 OR g.r = g.nr - 1 OR g.c = g.nc - 1) AS ring FROM grid g LEFT JOIN cells s ON g.site_id = s.site_id AND g.r = s.r AND g.c = s.c)"""
OFFSETS = "offs(k, dr, dc, dist) AS (VALUES (0,-1,0,1.0::DOUBLE),(1,-1,1,sqrt(2.0::DOUBLE)),(2,0,1,1.0::DOUBLE),(3,1,1,sqrt(2.0::DOUBLE)),(4,1,0,1.0::DOUBLE),(5,1,-1,sqrt(2.0::DOUBLE)),(6,0,-1,1.0::DOUBLE),(7,-1,-1,sqrt(2.0::DOUBLE)))"
NEAR = f"""{CELLS}, {OFFSETS},
near AS (SELECT a.site_id, a.r, a.c, a.z, a.cell, a.ring, a.nc, k, dr, dc, b.z AS nz, (a.z - b.z) / (5.0::DOUBLE * dist) AS s FROM (SELECT d.*, k, dr, dc, dist, d.r + dr AS r2, d.c + dc AS c2 FROM dense d CROSS JOIN offs) a JOIN dense b ON b.site_id = a.site_id AND b.r = a.r2 AND b.c = a.c2)"""
FLOW = f"""{NEAR},
best AS (SELECT * FROM (SELECT site_id, cell, k, dr, dc, nc, row_number() OVER (PARTITION BY site_id, cell ORDER BY s DESC, k) AS n FROM near WHERE s > 0) WHERE n = 1),
flow AS (SELECT d.site_id, d.r, d.c, d.cell, d.z, d.ring, coalesce(k, -1)::INT AS flow_dir, coalesce(d.cell + dr * d.nc + dc, -1)::BIGINT AS downstream FROM dense d LEFT JOIN best b ON d.site_id = b.site_id AND d.cell = b.cell)"""
PATHS = f"""{FLOW},
paths AS (SELECT site_id, cell AS source, cell AS pos FROM flow WHERE z IS NOT NULL UNION ALL SELECT p.site_id, p.source, f.downstream FROM paths p JOIN flow f ON f.site_id = p.site_id AND f.cell = p.pos WHERE f.downstream >= 0)"""
ACC = f"{PATHS}, acc AS (SELECT site_id, pos AS cell, count(*)::DOUBLE AS accumulation FROM paths GROUP BY 1, 2)"
ENDS = f"""{ACC},
ends AS (SELECT f.site_id, f.cell, f.r, f.c, CASE WHEN ring THEN 'boundary' ELSE 'internal' END AS kind, accumulation AS accumulation_cells,
  row_number() OVER (PARTITION BY f.site_id ORDER BY CASE WHEN ring THEN 'boundary' ELSE 'internal' END, accumulation DESC, f.r, f.c)::INT AS rank
  FROM flow f JOIN acc a ON a.site_id = f.site_id AND a.cell = f.cell WHERE z IS NOT NULL AND flow_dir < 0)"""
MEMBERS = f"{ENDS}, members AS (SELECT p.site_id, e.cell AS outlet, p.source AS cell, f.r, f.c FROM ends e JOIN paths p ON p.site_id = e.site_id AND p.pos = e.cell JOIN flow f ON f.site_id = p.site_id AND f.cell = p.source WHERE e.rank <= 2)"
SLOPE = f"""{CELLS},
grads AS (SELECT d.site_id, d.r, d.c, z, nr, nc,
  CASE WHEN nc < 2 THEN NULL WHEN c = 0 THEN (lead(z) OVER h - z) / 5.0::DOUBLE WHEN c = nc - 1 THEN (z - lag(z) OVER h) / 5.0::DOUBLE ELSE (lead(z) OVER h - lag(z) OVER h) / 10.0::DOUBLE END AS gx,
  CASE WHEN nr < 2 THEN NULL WHEN r = 0 THEN (lead(z) OVER v - z) / 5.0::DOUBLE WHEN r = nr - 1 THEN (z - lag(z) OVER v) / 5.0::DOUBLE ELSE (lead(z) OVER v - lag(z) OVER v) / 10.0::DOUBLE END AS gy
  FROM dense d WINDOW h AS (PARTITION BY site_id, r ORDER BY c), v AS (PARTITION BY site_id, c ORDER BY r)),
slopes AS (SELECT *, CASE WHEN z IS NOT NULL THEN sqrt(gx * gx + gy * gy) END AS g, degrees(atan(CASE WHEN z IS NOT NULL THEN sqrt(gx * gx + gy * gy) END)) AS s FROM grads)"""
FILL = f"""{CELLS},
fill AS (SELECT site_id, r, c, z, ring, CASE WHEN ring THEN z END AS w, 0 AS it FROM dense WHERE z IS NOT NULL
  UNION ALL SELECT f.site_id, f.r, f.c, f.z, f.ring, CASE WHEN f.ring THEN f.z WHEN m.m IS NULL THEN NULL WHEN f.z > m.m THEN f.z ELSE m.m + 0.0001::DOUBLE END, f.it + 1
  FROM fill f LEFT JOIN (SELECT a.site_id, a.r, a.c, min(b.w) AS m FROM fill a JOIN fill b ON a.site_id = b.site_id AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY 1, 2, 3) m
    ON m.site_id = f.site_id AND m.r = f.r AND m.c = f.c WHERE f.it < 48),
filled AS (SELECT *, coalesce(w, z) AS filled, coalesce(w > z + 0.00005::DOUBLE, false) AS modified, w IS NOT NULL AS reachable FROM fill WHERE it = 48)"""
BOXED = """boxed AS (SELECT layer, feature_id::BIGINT AS feature_id, (x1 - 500000.0::DOUBLE) / 1e5::DOUBLE AS west, (y1 - 2350000.0::DOUBLE) / 1e5::DOUBLE AS south, (x2 - 500000.0::DOUBLE) / 1e5::DOUBLE AS east, (y2 - 2350000.0::DOUBLE) / 1e5::DOUBLE AS north FROM (
  SELECT 'buildings' AS layer, c_custkey AS feature_id, x AS x1, y AS y1, x AS x2, y AS y2 FROM (SELECT c_custkey, (500000 + 1000 * (c_custkey // 100) + (c_custkey * 37) % 311 - 75)::DOUBLE AS x, (2350000 + (c_custkey * 53) % 317 - 75)::DOUBLE AS y FROM customer)
  UNION ALL SELECT CASE WHEN k % 2 = 1 THEN 'roads' ELSE 'water_areas' END, k, CASE WHEN k % 2 = 1 THEN x ELSE x - h END, CASE WHEN k % 2 = 1 THEN y ELSE y - h END, CASE WHEN k % 2 = 1 THEN x + 60 ELSE x + h END, CASE WHEN k % 2 = 1 THEN y + k % 50 ELSE y + h END
  FROM (SELECT s_suppkey AS k, (500000 + 1000 * (s_suppkey // 7) + (s_suppkey * 29) % 160)::DOUBLE AS x, (2350000 + (s_suppkey * 41) % 160)::DOUBLE AS y, (5 + s_suppkey % 20)::DOUBLE AS h FROM supplier)))"""
CANDIDATES = """cand AS (SELECT (c_custkey // 100)::BIGINT AS site_id, c_custkey::BIGINT AS candidate_id, ((c_custkey * 7) % 400 / 10.0)::DOUBLE AS slope, ((c_custkey * 7919) % 4000000)::DOUBLE AS area,
  CASE WHEN c_custkey % 11 <> 0 THEN ((c_custkey * 37) % 3100)::DOUBLE END AS rain, CASE WHEN c_custkey % 7 <> 0 THEN ((c_custkey * 13) % 700)::DOUBLE END AS water,
  CASE WHEN c_custkey % 9 <> 0 THEN ((c_custkey * 17) % 600)::DOUBLE END AS road, CASE WHEN c_custkey % 8 <> 0 THEN ((c_custkey * 23) % 650)::DOUBLE END AS building,
  CASE WHEN c_custkey % 6 <> 0 THEN ((c_custkey * 331) % 600000)::DOUBLE END AS runoff, CASE WHEN c_custkey % 5 <> 0 THEN ((c_custkey * 151) % 300000)::DOUBLE END AS storage,
  CASE WHEN c_custkey % 4 <> 0 THEN ((c_custkey * 977) % 150000)::DOUBLE END AS flow, CASE WHEN c_custkey % 10 <> 0 THEN (c_custkey % 101) / 100.0::DOUBLE END AS dem, CASE WHEN c_custkey % 12 <> 0 THEN (c_custkey % 97) / 96.0::DOUBLE END AS hyd,
  CASE WHEN c_custkey % 3 = 0 THEN 'feasible' WHEN c_custkey % 3 = 1 THEN 'unknown' WHEN c_custkey % 2 = 0 THEN 'feasible' ELSE 'rejected' END AS feas,
  CASE WHEN c_custkey % 50 <> 0 THEN 21.0::DOUBLE + (c_custkey % 300) / 1000.0::DOUBLE END AS lat, CASE WHEN c_custkey % 70 = 0 THEN 200.0::DOUBLE ELSE 81.0::DOUBLE + (c_custkey % 500) / 1000.0::DOUBLE END AS lon,
  (c_custkey % 3)::INT AS n_water, (c_custkey % 5)::INT AS n_roads, (c_custkey % 7)::INT AS n_buildings FROM customer)"""


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def _trapezoid(v: str, low: float, a: float, b: float, high: float) -> str:
    return f"CASE WHEN {v} < {a} THEN {_clamp(f'({v} - {low}) / ({a - low}::DOUBLE)')} WHEN {v} > {b} THEN 1.0::DOUBLE - {_clamp(f'({v} - {b}) / ({high - b}::DOUBLE)')} ELSE 1.0::DOUBLE END"


def _bounded(v: str, low: float, high: float, a: float, b: float, invert: bool = False) -> str:
    inside = f"greatest({low}::DOUBLE, least({high}::DOUBLE, {v}))"
    below, above = _clamp(f"({inside} - {low}) / ({a - low}::DOUBLE)"), _clamp(f"({inside} - {b}) / ({high - b}::DOUBLE)")
    tail = (lambda x: f"1.0::DOUBLE - {x}") if invert else (lambda x: x)
    return f"CASE WHEN {v} IS NULL THEN 0.5::DOUBLE WHEN {inside} < {a} THEN {tail(below)} WHEN {inside} > {b} THEN {tail(above)} ELSE 1.0::DOUBLE END"


def _distance(v: str, low: float, high: float) -> str:
    return f"CASE WHEN {v} IS NULL THEN 0.5::DOUBLE WHEN {v} <= 0 OR {v} < {low} THEN 0.0::DOUBLE WHEN {v} >= {high} THEN 1.0::DOUBLE ELSE ({v} - {low}) / ({high - low}::DOUBLE) END"


def _legacy() -> str:
    w = sc.LEGACY_WEIGHTS
    total = sum(w.values())
    grade = "greatest(0.0::DOUBLE, tan(radians(slope)) * 100.0::DOUBLE)"
    return f"""{CANDIDATES}, parts AS (SELECT *, {_trapezoid(grade, 0.0, 2.0, 12.0, 35.0)} AS s_slope,
  CASE WHEN area <= 0 THEN 0.0::DOUBLE ELSE {_trapezoid("area", 10000.0, 15000.0, 1500000.0, 3000000.0)} END AS s_area,
  CASE WHEN coalesce(rain, 0) <= 0 THEN 0.0::DOUBLE ELSE {_trapezoid("rain", 200.0, 600.0, 1800.0, 2500.0)} END AS s_rain,
  CASE WHEN water IS NULL THEN 0.5::DOUBLE WHEN water <= 0 THEN 1.0::DOUBLE ELSE {_clamp("1.0::DOUBLE - water / 300.0::DOUBLE")} END AS s_water,
  {_distance("road", 25.0, 250.0)} AS s_road, {_distance("building", 25.0, 250.0)} AS s_building,
  {_clamp("1.0::DOUBLE - (CASE WHEN n_water > 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + 0.15::DOUBLE * least(n_roads, 3) / 3.0::DOUBLE + 0.20::DOUBLE * least(n_buildings, 3) / 3.0::DOUBLE)")} AS s_land FROM cand),
scored AS (SELECT *, least(s_road, s_building) AS s_both, {_clamp(f"{w['slope'] / total}::DOUBLE * s_slope + {w['catchment_area'] / total}::DOUBLE * s_area + {w['rainfall'] / total}::DOUBLE * s_rain + {w['water_distance'] / total}::DOUBLE * s_water + {w['road_distance'] / total}::DOUBLE * least(s_road, s_building) + {w['land_use'] / total}::DOUBLE * s_land")} AS overall FROM parts)"""


def _engine() -> str:
    b, d, w = sc.BOUNDS, sc.DISTANCES, sc.WEIGHTS
    total, conf = sum(w.values()), sc.CONFIDENCE_WEIGHTS
    near = " + ".join(_paren(_distance(k, *d[k])) for k in ("water", "road", "building"))
    return f"""{CANDIDATES}, raw AS (SELECT *, {_bounded("runoff", *b["runoff"])} AS r0, {_bounded("storage", *b["storage"])} AS s0 FROM cand),
parts AS (SELECT *, CASE WHEN floor(flow) > 0 THEN least(1.0::DOUBLE, floor(flow) / 100000.0::DOUBLE) ELSE {_bounded("area", *b["catchment"])} END AS hydrology,
  {_bounded("slope", *b["slope"], invert=True)} AS terrain, ({near}) / 3.0::DOUBLE AS geography, {_bounded("rain", *b["rainfall"])} AS rainfall,
  CASE WHEN r0 > 0.7 AND s0 > 0.7 THEN r0 * 0.9::DOUBLE ELSE r0 END AS runoff_s, CASE WHEN r0 > 0.7 AND s0 > 0.7 THEN s0 * 0.9::DOUBLE ELSE s0 END AS storage_s,
  CASE WHEN lat IS NULL OR lon IS NULL THEN 'missing_coordinates' WHEN lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180 THEN 'invalid_coordinates' WHEN slope > 35 THEN 'slope_exceeds_limit' WHEN area < 0 THEN 'catchment_too_small' WHEN rain < 0 THEN 'insufficient_rainfall' WHEN feas = 'rejected' THEN 'geographic_rejection' END AS reason,
  {_clamp(f"{conf['dem_quality']}::DOUBLE * CASE WHEN dem IS NULL THEN 0.5::DOUBLE ELSE {_clamp('dem')} END + {conf['hydrology_quality']}::DOUBLE * CASE WHEN hyd IS NULL THEN 0.5::DOUBLE ELSE {_clamp('hyd')} END + {conf['geographic_availability']}::DOUBLE * CASE feas WHEN 'feasible' THEN 1.0::DOUBLE WHEN 'rejected' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END + {conf['rainfall_availability']}::DOUBLE * CASE WHEN rain IS NULL THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END + {conf['runoff_storage_availability']}::DOUBLE * CASE WHEN runoff IS NULL THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END")} AS confidence FROM raw),
scored AS (SELECT *, round({_clamp(f"{w['hydrology'] / total}::DOUBLE * hydrology + {w['terrain'] / total}::DOUBLE * terrain + {w['geography'] / total}::DOUBLE * geography + {w['rainfall'] / total}::DOUBLE * rainfall + {w['runoff'] / total}::DOUBLE * runoff_s + {w['storage'] / total}::DOUBLE * storage_s")}, 4) AS overall FROM parts)"""


def _paren(x: str) -> str:
    return f"({x})"


POINTS = f"{CELLS}, points AS (SELECT site_id, (r * 32 + c)::BIGINT AS id, 500000.0::DOUBLE + 1000 * site_id + 5.0::DOUBLE * c AS x, 2350000.0::DOUBLE + 5.0::DOUBLE * r AS y FROM cells WHERE z IS NOT NULL)"
NEAREST = f"""{POINTS},
b AS (SELECT (c_custkey // 100)::BIGINT AS site_id, c_custkey::BIGINT AS id, 500000.0::DOUBLE + 1000 * (c_custkey // 100) + (c_custkey * 37) % 311 - 75 AS x, 2350000.0::DOUBLE + (c_custkey * 53) % 317 - 75 AS y FROM customer),
sup AS (SELECT (s_suppkey // 7)::BIGINT AS site_id, s_suppkey::BIGINT AS id, 500000.0::DOUBLE + 1000 * (s_suppkey // 7) + (s_suppkey * 29) % 160 AS x, 2350000.0::DOUBLE + (s_suppkey * 41) % 160 AS y, (5 + s_suppkey % 20)::DOUBLE AS half FROM supplier),
db AS (SELECT p.site_id, p.id, 'building' AS kind, b.id AS f, sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) AS d FROM points p JOIN b USING (site_id)),
rt AS (SELECT p.site_id, p.id, s.id AS f, p.x AS px, p.y AS py, s.x AS x1, s.y AS y1, 60.0::DOUBLE AS dx, (s.id % 50)::DOUBLE AS dy FROM points p JOIN sup s USING (site_id) WHERE s.id % 2 = 1),
dr AS (SELECT site_id, id, 'road' AS kind, f, sqrt((px - (x1 + t * dx)) * (px - (x1 + t * dx)) + (py - (y1 + t * dy)) * (py - (y1 + t * dy))) AS d FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy))) AS t FROM rt)),
wt AS (SELECT p.site_id, p.id, s.id AS f, abs(p.x - s.x) AS u, abs(p.y - s.y) AS v, half, CASE WHEN s.id % 4 = 0 THEN half / 2 END AS hole FROM points p JOIN sup s USING (site_id) WHERE s.id % 2 = 0),
dw AS (SELECT site_id, id, 'water' AS kind, f, CASE WHEN u > half OR v > half THEN sqrt(greatest(u - half, 0) * greatest(u - half, 0) + greatest(v - half, 0) * greatest(v - half, 0)) WHEN hole IS NOT NULL AND u < hole AND v < hole THEN least(hole - u, hole - v) ELSE 0.0::DOUBLE END AS d FROM wt),
dist AS (SELECT * FROM db UNION ALL SELECT * FROM dr UNION ALL SELECT * FROM dw)"""
RAIN = f"""{CELLS}, daily AS (SELECT (user_id % (SELECT count(DISTINCT site_id) FROM cells))::BIGINT AS site_id, (ts::DATE + to_months((user_id % 12)::INT))::DATE AS day, round(sum(value), 2) AS mm FROM events GROUP BY 1, 2)"""
DOCS = f"{CELLS}, marks AS (SELECT site_id, r, (100 + r)::DOUBLE AS e, count(z)::INT AS n, 'Contour ' || (100 + r) || ' m' AS name FROM cells GROUP BY 1, 2 HAVING count(z) >= 2)"
TAGS = "tags AS (SELECT c_custkey::BIGINT AS osm_id, c_custkey % 2 = 0 AS even, c_name FROM customer)"


FLOW_WIDE = FLOW.replace("(o_orderkey // 1024)::BIGINT", "0::BIGINT").replace("((o_orderkey % 1024) // 32)", "(o_orderkey // 120)").replace("o_orderkey % 32", "o_orderkey % 120").replace("(o_orderkey%32)", "(o_orderkey%120)")


def _site_recommendation() -> str:
    grade = "greatest(0.0::DOUBLE, tan(radians(m)) * 100.0::DOUBLE)"
    score = f"{0.25}::DOUBLE * ({_trapezoid(grade, 0.0, 2.0, 12.0, 35.0)}) + 0.20::DOUBLE * (CASE WHEN a <= 0 THEN 0.0::DOUBLE ELSE {_trapezoid('a', 10000.0, 15000.0, 1500000.0, 3000000.0)} END) + 0.10::DOUBLE * {125 / 225}::DOUBLE + 0.10::DOUBLE"
    return f"SELECT site_id, round(s, 6) AS overall_score, round(0.55 + 0.45 * s, 6) AS confidence, CASE WHEN s IS NULL THEN 'not_recommended' WHEN s >= 0.7 THEN 'highly_suitable' WHEN s >= 0.4 THEN 'moderately_suitable' ELSE 'marginal' END AS recommendation, CASE WHEN s IS NOT NULL THEN 1 END::INT AS rank FROM (SELECT site_id, CASE WHEN m <= 35 THEN {score} END AS s FROM (SELECT site_id, avg(s) AS m, (any_value(nr) * any_value(nc) * 25.0)::DOUBLE AS a FROM slopes GROUP BY 1))"


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


GRADE = "SELECT site_id, round(score, 6) AS dem_score, CASE WHEN score >= 0.9 THEN 'good' WHEN score >= 0.75 THEN 'acceptable' WHEN score >= 0.5 THEN 'poor' ELSE 'invalid' END AS dem_status, ((vf < 0.95)::INT + (1 - vf > 0)::INT + (xf > 0.01)::INT + (score < 0.5)::INT)::INT AS n_warnings FROM (SELECT *, 0.30::DOUBLE * vf + 0.20::DOUBLE * (1 - (1 - vf)) + 0.40::DOUBLE * 0.95::DOUBLE + 0.10::DOUBLE * (1 - xf) AS score FROM (SELECT site_id, count(s) / (any_value(nr) * any_value(nc))::DOUBLE AS vf, avg((g > 1.0)::INT) AS xf FROM slopes GROUP BY 1))"


#: Hydrology over filled elevation: `flow`, `acc`, `term` (the terminal cell of each cell), `ends`.
FILLED = f"""{FILL}, dense2 AS MATERIALIZED (SELECT d.site_id, d.r, d.c, d.nr, d.nc, filled AS z, d.z AS elevation, d.cell, d.ring, modified, reachable FROM dense d LEFT JOIN filled f ON f.site_id = d.site_id AND f.r = d.r AND f.c = d.c),
{FLOW.removeprefix(CELLS + ", ").replace("dense", "dense2").replace("flow AS (", "flow AS MATERIALIZED (")}, {PATHS.removeprefix(FLOW + ",")},
acc AS MATERIALIZED (SELECT site_id, pos AS cell, count(*)::DOUBLE AS accumulation FROM paths GROUP BY 1, 2),
term AS (SELECT p.site_id, p.source AS cell, p.pos AS outlet FROM paths p JOIN flow f ON f.site_id = p.site_id AND f.cell = p.pos WHERE f.flow_dir < 0), {ENDS.removeprefix(ACC + ",")}"""
#: Candidates: a cell of each plateau of peaks and the first five ends; constraints, thinning at 50 m, scores, ranks.
GENERATED = f"""{FILLED}, {SLOPE.removeprefix(CELLS + ",")},
peaks AS MATERIALIZED (SELECT f.site_id, f.r, f.c, f.cell, a.accumulation FROM flow f JOIN acc a ON a.site_id = f.site_id AND a.cell = f.cell WHERE NOT EXISTS (SELECT 1 FROM flow g JOIN acc b ON b.site_id = g.site_id AND b.cell = g.cell WHERE g.site_id = f.site_id AND g.r BETWEEN f.r - 1 AND f.r + 1 AND g.c BETWEEN f.c - 1 AND f.c + 1 AND b.accumulation > a.accumulation)),
reach AS (SELECT site_id, cell, r, c, cell AS other FROM peaks UNION SELECT x.site_id, x.cell, y.r, y.c, y.cell FROM reach x JOIN peaks y ON y.site_id = x.site_id AND abs(y.r - x.r) + abs(y.c - x.c) = 1),
groups AS (SELECT site_id, cell, min(other) AS g FROM reach GROUP BY 1, 2),
seeds AS (SELECT site_id, cell FROM (SELECT p.*, row_number() OVER (PARTITION BY p.site_id, g ORDER BY accumulation DESC, p.cell) AS n FROM peaks p JOIN groups USING (site_id, cell)) WHERE n = 1 UNION SELECT site_id, cell FROM ends WHERE rank <= 5),
built AS MATERIALIZED (SELECT d.site_id, d.cell, d.r, d.c, d.elevation AS z, 500000.0::DOUBLE + 1000 * d.site_id + 5.0::DOUBLE * d.c AS x, 2350000.0::DOUBLE + 5.0::DOUBLE * d.r AS y, sl.s, accumulation AS a, accumulation * 25.0::DOUBLE AS area, e.kind IS NOT DISTINCT FROM 'boundary' AS edge,
  CASE WHEN sl.s IS NULL THEN 'invalid_slope' WHEN accumulation < 2 THEN 'insufficient_drainage_area' END AS why
  FROM seeds q JOIN dense2 d ON d.site_id = q.site_id AND d.cell = q.cell JOIN acc ON acc.site_id = q.site_id AND acc.cell = q.cell JOIN slopes sl ON sl.site_id = d.site_id AND sl.r = d.r AND sl.c = d.c
  LEFT JOIN term t ON t.site_id = q.site_id AND t.cell = q.cell LEFT JOIN ends e ON e.site_id = q.site_id AND e.cell = t.outlet AND e.rank <= 5),
queue AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY a DESC, r, c) AS n FROM built WHERE why IS NULL),
walk AS (SELECT site_id, 0::BIGINT AS n, []::STRUCT(cell BIGINT, x DOUBLE, y DOUBLE)[] AS taken FROM (SELECT DISTINCT site_id FROM queue)
  UNION ALL SELECT w.site_id, q.n, CASE WHEN len(list_filter(w.taken, lambda k: (k.x - q.x) * (k.x - q.x) + (k.y - q.y) * (k.y - q.y) < 2500)) = 0 THEN list_append(w.taken, {{'cell': q.cell, 'x': q.x, 'y': q.y}}) ELSE w.taken END
  FROM walk w JOIN queue q ON q.site_id = w.site_id AND q.n = w.n + 1),
kept AS (SELECT site_id, unnest(taken, recursive := true) FROM (SELECT site_id, arg_max(taken, n) AS taken FROM walk GROUP BY 1)),
stats AS (SELECT d.site_id, max(accumulation) AS max_a, min(elevation) AS lo, max(elevation) AS hi FROM dense2 d LEFT JOIN acc ON acc.site_id = d.site_id AND acc.cell = d.cell GROUP BY 1),
grade AS (SELECT *, greatest(0, tan(radians(s)) * 100) AS pct FROM queue JOIN kept USING (site_id, cell) JOIN stats USING (site_id)),
scored AS (SELECT *, round(least(1, greatest(0,
  0.35::DOUBLE * CASE WHEN area < 15000 THEN greatest(0, (area - 10000) / 5000.0::DOUBLE) WHEN area > 1500000 THEN greatest(0, 1 - (area - 1500000) / 1500000.0::DOUBLE) ELSE 1 END + 0.25::DOUBLE * least(1, a / greatest(max_a, 1))
  + 0.2::DOUBLE * CASE WHEN pct < 2 THEN pct / 2.0::DOUBLE WHEN pct > 12 THEN greatest(0, 1 - (pct - 12) / 23.0::DOUBLE) ELSE 1 END
  + 0.1::DOUBLE * CASE WHEN hi > lo THEN least(1, greatest(0, 1 - (z - lo) / (hi - lo))) ELSE 1 END + 0.1::DOUBLE * CASE WHEN edge THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END)), 6) AS score FROM grade),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, a DESC, r, c)::INT AS place FROM scored)"""


def oracle_sql() -> dict[str, str]:
    r6 = lambda x, name: f"round({x}, 6) AS {name}"
    r9 = lambda x, name: f"round({x}, 9) AS {name}"  # noqa: E731  scores with a few decimals may stand on half a unit of the sixth
    pct = lambda v, p: f"quantile_cont({v}, {p})"
    nearest = "SELECT p.site_id, p.id, round(min(d) FILTER (kind = 'water'), 6) AS water_distance_m, round(min(d) FILTER (kind = 'road'), 6) AS road_distance_m, round(min(d) FILTER (kind = 'building'), 6) AS building_distance_m FROM points p LEFT JOIN {} d ON d.site_id = p.site_id AND d.id = p.id GROUP BY 1, 2"
    return {
        "d8_direction": _with(FLOW, "SELECT site_id, flow_dir, count(*) AS n FROM flow GROUP BY 1, 2"),
        "d8_cells": _with(FLOW, "SELECT site_id, cell, flow_dir, downstream, z IS NOT NULL AND flow_dir < 0 AND NOT ring AS sink, z IS NOT NULL AND ring AS edge_outflow FROM flow"),
        "slope": _with(SLOPE, f"SELECT site_id, r AS row, c AS col, {r6('g', 'gradient')}, {r6('s', 'slope')} FROM slopes"),
        "neighbours": _with(NEAR, "SELECT site_id, " + ", ".join(f"round(sum(nz) FILTER (k = {k}), 3) AS sum_n{k}" for k in range(8)) + " FROM near GROUP BY 1"),
        "terrain_summary": _with(SLOPE, f"SELECT site_id, any_value(nr)::INT AS rows, any_value(nc)::INT AS cols, {r6('min(z)', 'min_elevation')}, {r6('max(z)', 'max_elevation')}, {r6('avg(z)', 'mean_elevation')}, {r6('avg(s)', 'mean_slope')}, {r6('max(s)', 'max_slope')}, round(count(s) / (any_value(nr) * any_value(nc))::DOUBLE, 6) AS valid_fraction, (any_value(nr) * any_value(nc) * 25.0)::DOUBLE AS area_m2 FROM slopes GROUP BY 1"),
        "preprocess_summary": _with(CELLS, "SELECT site_id, count(*) AS total_cells, count(z) AS valid_cells, count(*) - count(z) AS invalid_cells, round(count(z) / count(*)::DOUBLE, 6) AS valid_fraction, ((count(z) < count(*))::INT + (count(z) < 0.5 * count(*))::INT + (coalesce(min(z) = max(z), false))::INT)::INT AS n_warnings, CASE WHEN count(z) = 0 THEN 'no valid cell' END AS error FROM dense GROUP BY 1"),
        "elevation_stats": _with(CELLS, f"SELECT site_id, {r6('min(z)', 'min_m')}, {r6('max(z)', 'max_m')}, {r6('avg(z)', 'mean_m')}, {r6('stddev_pop(z)', 'std_m')}, {r6('median(z)', 'median_m')}, " + ", ".join(r6(pct("z", p / 100), f"p{p:02d}_m") for p in (1, 5, 25, 50, 75, 95, 99)) + " FROM cells WHERE z IS NOT NULL GROUP BY 1"),
        "local_change": _with(CELLS, f"SELECT s.site_id, coalesce({'round(avg(d), 6)'}, 0) AS mean_change_m, coalesce(round(max(d), 6), 0) AS max_change_m, coalesce(round({pct('d', 0.95)}, 6), 0) AS p95_change_m FROM (SELECT DISTINCT site_id FROM cells) s LEFT JOIN (SELECT a.site_id, abs(a.z - b.z) AS d FROM cells a JOIN cells b ON a.site_id = b.site_id AND ((b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c = a.c)) WHERE a.z IS NOT NULL AND b.z IS NOT NULL) p ON p.site_id = s.site_id GROUP BY 1"),
        "slope_stats": _with(SLOPE, f"SELECT site_id, {r6('min(s)', 'min_slope')}, {r6('avg(s)', 'mean_slope')}, {r6('max(s)', 'max_slope')}, {r6(pct('s', 0.05), 'p05_slope')}, {r6(pct('s', 0.5), 'median_slope')}, {r6(pct('s', 0.95), 'p95_slope')} FROM slopes WHERE s IS NOT NULL GROUP BY 1"),
        "gradient_stats": _with(SLOPE, f"SELECT site_id, {r6('avg(g)', 'mean_gradient')}, {r6('max(g)', 'max_gradient')}, {r6('avg((g > 1.0)::INT)', 'extreme_fraction')}, {r6('avg((g < 0.001)::INT)', 'flat_fraction')} FROM slopes WHERE g IS NOT NULL GROUP BY 1"),
        "lowest_cell": _with(CELLS, "SELECT site_id, r AS row, c AS col, round(z, 6) AS elevation FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY z, r, c) AS n FROM cells WHERE z IS NOT NULL) WHERE n = 1"),
        "internal_sinks": _with(FLOW, "SELECT site_id, (count(*) FILTER (z IS NOT NULL AND flow_dir < 0 AND NOT ring))::BIGINT AS internal_sinks FROM flow GROUP BY 1"),
        "fill_depressions": _with(FILL, "SELECT site_id, r AS row, c AS col, round(filled, 6) AS filled, modified, reachable FROM filled"),
        "fill_tiles": _with(FILL, "SELECT site_id, count(*) AS n, round(sum(filled), 1) AS sum_filled, (count(*) FILTER (modified))::BIGINT AS modified FROM filled GROUP BY 1"),
        "flow_accumulation": _with(ACC, "SELECT site_id, cell, accumulation FROM acc"),
        "drainage_outlet": _with(PATHS, "SELECT p.site_id, p.source AS cell, p.pos AS outlet FROM paths p JOIN flow f ON f.site_id = p.site_id AND f.cell = p.pos WHERE f.downstream < 0"),
        "outlets": _with(ENDS, "SELECT site_id, cell, r AS row, c AS col, kind, accumulation_cells, rank, rank = 1 AS selected FROM ends WHERE rank <= 5"),
        "terminal_cells": _with(FLOW, "SELECT * FROM (SELECT site_id, r AS row, c AS col, cell, row_number() OVER (PARTITION BY site_id ORDER BY r, c)::INT AS rank FROM flow WHERE z IS NOT NULL AND flow_dir < 0) WHERE rank <= 5"),
        "catchment_area": _with(MEMBERS, "SELECT site_id, outlet, count(*) AS cells, (count(*) * 25.0)::DOUBLE AS area_m2, (count(*) * 25.0)::DOUBLE / 1e4 AS area_ha, (count(*) * 25.0)::DOUBLE / 1e6 AS area_km2 FROM members GROUP BY 1, 2"),
        "mask_runs": _with(MEMBERS, "SELECT site_id, outlet, r AS row, min(c)::INT AS col_start, max(c)::INT AS col_end FROM (SELECT *, c - row_number() OVER (PARTITION BY site_id, outlet, r ORDER BY c) AS g FROM members) GROUP BY site_id, outlet, r, g"),
        "boundary_edges": _with(MEMBERS, "SELECT m.site_id, m.outlet, (4 * count(*) - sum((SELECT count(*) FROM members n WHERE n.site_id = m.site_id AND n.outlet = m.outlet AND abs(n.r - m.r) + abs(n.c - m.c) = 1)))::BIGINT AS edges FROM members m GROUP BY 1, 2"),
        "catchment_rings": _with(MEMBERS, "SELECT site_id, outlet, count(*)::DOUBLE AS cells FROM members GROUP BY 1, 2"),
        "geometry_check": _with(MEMBERS, "SELECT site_id, outlet, true AS geometry_ok FROM members GROUP BY 1, 2"),
        "catchment_parts": _with(f"{MEMBERS}, {bs.VERTICES}, {bs.PARTS}", "SELECT site_id, outlet, parts, holes, vertices FROM pieces JOIN turns USING (site_id, outlet)"),
        "catchment_vertices": _with(f"{MEMBERS}, {bs.VERTICES}", "SELECT * FROM vertices"),
        "catchment_boundary": _with(f"{MEMBERS}, {bs.VERTICES}, {bs.FRAMES}, spots AS (SELECT v.*, x0 + (c - 0.5::DOUBLE) * dx AS x, y0 + (r - 0.5::DOUBLE) * dy AS y FROM vertices v JOIN frames USING (site_id)), {bs.wgs84('spots')}", "SELECT site_id, outlet, r, c, round(longitude, 7) AS longitude, round(latitude, 7) AS latitude FROM placed"),
        "catchment_geojson": _with(f"{MEMBERS}, {bs.VERTICES}, {bs.PARTS}", "SELECT site_id, outlet, n AS cells, (25.0 * n)::DOUBLE AS area_m2, true AS area_ok, CASE WHEN parts > 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, (vertices + parts + holes)::BIGINT AS points FROM pieces JOIN turns USING (site_id, outlet) JOIN (SELECT site_id, outlet, count(*) AS n FROM members GROUP BY 1, 2) USING (site_id, outlet)"),
        "alternatives": _with(f"{ENDS}, {bs.alternatives()}", "SELECT site_id, alternative::INT AS alternative, r AS row, c AS col, cell FROM chosen3"),
        "alternative_candidates": _with(
            f"{ENDS}, {SLOPE.removeprefix(CELLS + ',')}, {bs.alternatives()}, {bs.FRAMES}, site AS ({_site_recommendation()}), spots AS (SELECT p.*, x0 + c * dx AS x, y0 + r * dy AS y FROM chosen3 p JOIN frames USING (site_id)), {bs.wgs84('spots')}",
            "SELECT p.site_id, p.cell, 'alternative-' || alternative AS candidate_id, p.r AS row, p.c AS col, round(s.z, 6) AS elevation, round(s.s, 6) AS slope_degrees, accumulation * 25.0::DOUBLE AS catchment_area_m2, round(accumulation * 25.0::DOUBLE / 1e4::DOUBLE, 6) AS catchment_area_ha, round(accumulation * 25.0::DOUBLE / 1e6::DOUBLE, 6) AS catchment_area_km2, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, site.overall_score AS suitability_score "
            "FROM placed p JOIN slopes s ON s.site_id = p.site_id AND s.r = p.r AND s.c = p.c JOIN acc a ON a.site_id = p.site_id AND a.cell = p.cell LEFT JOIN site ON site.site_id = p.site_id",
        ),
        "separation": _with(bs.thinned("(c_custkey * 31) % 100 * 1000 + c_custkey % 100", 40.0, True), "SELECT site_id, id FROM kept"),
        "leader_clusters": _with(
            bs.thinned("c_custkey", 60.0, False),
            "SELECT site_id, id, id AS leader FROM kept UNION ALL SELECT site_id, id, leader FROM (SELECT b.site_id, b.id, k.id AS leader, row_number() OVER (PARTITION BY b.site_id, b.id ORDER BY floor(k.x / 60.0) - floor(b.x / 60.0), floor(k.y / 60.0) - floor(b.y / 60.0), k.p) AS n "
            "FROM b JOIN kept k ON k.site_id = b.site_id AND k.p < b.p AND (k.x - b.x) * (k.x - b.x) + (k.y - b.y) * (k.y - b.y) <= 3600.0 WHERE NOT EXISTS (SELECT 1 FROM kept o WHERE o.id = b.id)) WHERE n = 1",
        ),
        "catchment_check": _with(MEMBERS, "SELECT e.site_id, e.cell AS outlet, any_value(accumulation_cells) AS accumulation_cells, count(*) AS cells, 0.0::DOUBLE AS area_difference, true AS area_ok FROM ends e JOIN members m ON m.site_id = e.site_id AND m.outlet = e.cell WHERE rank <= 2 GROUP BY 1, 2"),
        "hydrology_quality": _with(FLOW, "SELECT site_id, valid_cells, sink_cells, edge_cells, round(sf, 6) AS sink_fraction, round(score, 6) AS hydrology_score, CASE WHEN score >= 0.85 AND sink_cells = 0 AND ef <= 0.5 THEN 'good' WHEN score >= 0.65 THEN 'acceptable' ELSE 'poor' END AS hydrology_status, CASE WHEN sf > 0.10 THEN 'high' WHEN sf > 0.03 THEN 'moderate' ELSE 'low' END AS sink_level FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE + 0.35::DOUBLE + 0.20::DOUBLE * (1 - least(2 * sf, 1.0::DOUBLE)) + 0.10::DOUBLE - least(0.5::DOUBLE * ef, 0.5::DOUBLE))) AS score FROM (SELECT site_id, count(*) AS valid_cells, (count(*) FILTER (flow_dir < 0 AND NOT ring))::BIGINT AS sink_cells, (count(*) FILTER (ring))::BIGINT AS edge_cells, (count(*) FILTER (flow_dir < 0 AND NOT ring)) / count(*)::DOUBLE AS sf, (count(*) FILTER (ring)) / count(*)::DOUBLE AS ef FROM flow WHERE z IS NOT NULL GROUP BY 1))"),
        "local_maxima": _with(ACC, "SELECT f.site_id, f.r AS row, f.c AS col, a.accumulation FROM flow f JOIN acc a ON a.site_id = f.site_id AND a.cell = f.cell WHERE NOT EXISTS (SELECT 1 FROM flow g JOIN acc b ON b.site_id = g.site_id AND b.cell = g.cell WHERE g.site_id = f.site_id AND g.r BETWEEN f.r - 1 AND f.r + 1 AND g.c BETWEEN f.c - 1 AND f.c + 1 AND b.accumulation > a.accumulation)"),
        "d8_wide": _with(FLOW_WIDE, "SELECT r AS row, (count(*) FILTER (flow_dir >= 0))::BIGINT AS routed, (count(*) FILTER (z IS NOT NULL AND flow_dir < 0 AND NOT ring))::BIGINT AS sinks FROM flow GROUP BY 1"),
        "contour_consistency": _with(f"{CELLS}, e AS (SELECT site_id, (c % 4) * 2.0::DOUBLE AS e FROM cells WHERE z IS NOT NULL), m AS (SELECT site_id, count(*) AS n, avg(e) AS mae, sqrt(avg(e * e)) AS rmse, max(e) AS mx, avg((e <= 1)::INT) AS w1, avg((e <= 5)::INT) AS w5 FROM e GROUP BY 1)", "SELECT site_id, n AS sampled_points, round(mae, 6) AS mae_m, round(rmse, 6) AS rmse_m, mx AS max_error_m, round(w1, 6) AS within_1m, round(w5, 6) AS within_5m, round(w1 + 0.5 * greatest(w5 - w1, 0), 6) AS contour_score FROM m"),
        "features_in_bbox": "SELECT request_id, count(*) AS n FROM (SELECT (500000 + 1000 * (c_custkey // 100) + (c_custkey * 37) % 311 - 75) / 1e4::DOUBLE AS x, (2350000 + (c_custkey * 53) % 317 - 75) / 1e5::DOUBLE AS y FROM customer) b JOIN (SELECT unnest(range(4))::BIGINT AS request_id) q ON x BETWEEN 50.0 + request_id AND 50.9 + request_id AND y BETWEEN 23.0 AND 23.5003 + request_id / 1000.0 GROUP BY 1",
        "features_in_boxes": f"WITH {BOXED}, asked AS (SELECT s_suppkey::BIGINT AS request_id, (1000 * (s_suppkey // 7) + (s_suppkey * 29) % 160) / 1e5::DOUBLE AS x, ((s_suppkey * 41) % 160) / 1e5::DOUBLE AS y, 10.0::DOUBLE * (1 << (s_suppkey % 14)::INT) / 1e5::DOUBLE AS h FROM supplier) SELECT request_id, layer, count(*) AS n, sum(feature_id)::BIGINT AS sum_id FROM boxed JOIN asked ON west <= x + h AND east >= x - h AND south <= y + h AND north >= y - h GROUP BY 1, 2",
        "stored_features": f"WITH {BOXED} SELECT layer, count(*) AS n, sum(feature_id)::BIGINT AS sum_id FROM boxed WHERE west <= (SELECT 1000 * (max(s_suppkey) // 14) / 1e5::DOUBLE FROM supplier) AND east >= 0 AND south <= 0.001::DOUBLE AND north >= 0 GROUP BY 1",
        "kml_files": _with(CELLS, "SELECT site_id, (row_number() OVER (PARTITION BY site_id ORDER BY r) - 1)::INT AS contour_id, (CASE WHEN r % 2 = 0 THEN r + 100.5 ELSE r END)::DOUBLE AS elevation_m, '<b>row</b> & ' || r || ' </Placemark>' AS name, n::INT AS points, NULL::VARCHAR AS error FROM (SELECT site_id, r, count(*) AS n FROM cells WHERE z IS NOT NULL GROUP BY 1, 2) WHERE n >= 2 AND site_id % 3 <> 1 UNION ALL SELECT site_id, NULL, NULL, NULL, NULL, 'the document is not well-formed' FROM (SELECT DISTINCT site_id FROM cells WHERE z IS NOT NULL AND site_id % 3 = 1)"),
        "hydrology_summary": _with(
            FILLED,
            f"""SELECT s.*, greatest(sinks_original - sinks_remaining, 0) AS sinks_resolved, {r6("routed_cells / valid_cells::DOUBLE", "direction_fraction")} FROM (
  SELECT f.site_id, count(*) AS valid_cells, (count(*) FILTER (flow_dir < 0 AND NOT f.ring))::BIGINT AS sinks_remaining, (count(*) FILTER (flow_dir >= 0))::BIGINT AS routed_cells, (count(*) FILTER (f.ring))::BIGINT AS edge_outflow_cells,
    (count(*) FILTER (NOT f.ring AND NOT EXISTS (SELECT 1 FROM dense b WHERE b.site_id = f.site_id AND b.r BETWEEN f.r - 1 AND f.r + 1 AND b.c BETWEEN f.c - 1 AND f.c + 1 AND b.z < d.elevation)))::BIGINT AS sinks_original,
    (count(*) FILTER (modified))::BIGINT AS modified_cells, {r6("max(d.z - d.elevation)", "max_fill_depth_m")}, (count(*) FILTER (NOT reachable))::BIGINT AS unreachable_cells, max(accumulation) AS max_accumulation, {r6("avg(accumulation)", "mean_accumulation")}, (count(*) FILTER (accumulation IS NULL))::BIGINT AS cycle_cells
  FROM flow f JOIN dense2 d ON d.site_id = f.site_id AND d.cell = f.cell LEFT JOIN acc a ON a.site_id = f.site_id AND a.cell = f.cell WHERE f.z IS NOT NULL GROUP BY 1) s""",
        ),
        "candidate_rank": _with(GENERATED, "SELECT site_id, printf('cand-%05d-%05d', r, c) AS candidate_id, r AS row, c AS col, a AS flow_accumulation_cells, area AS drainage_area_m2, score AS candidate_score, place AS candidate_rank FROM ranked WHERE place <= 25"),
        "rejection_counts": _with(GENERATED, "SELECT b.site_id, CASE WHEN b.why IS NOT NULL THEN b.why WHEN k.cell IS NULL THEN 'candidate_too_close' ELSE 'candidate_limit_exceeded' END AS rejection_reason, count(*) AS n FROM built b LEFT JOIN ranked k ON k.site_id = b.site_id AND k.cell = b.cell WHERE b.why IS NOT NULL OR k.cell IS NULL OR place > 25 GROUP BY 1, 2"),
        "clip_relations": "WITH inside AS (SELECT c_custkey AS node_id FROM customer WHERE c_custkey % 37 BETWEEN 3 AND 6 AND c_custkey % 100 BETWEEN 10 AND 14), wn AS (SELECT DISTINCT o_orderkey AS way_id, o_custkey AS node_id FROM orders), m AS (SELECT DISTINCT o_orderkey % 40 AS relation_id, o_orderkey AS way_id FROM orders WHERE o_orderkey % 40 < 30), w1 AS (SELECT DISTINCT way_id FROM wn WHERE node_id IN (SELECT node_id FROM inside)), rel AS (SELECT DISTINCT relation_id FROM m WHERE way_id IN (SELECT way_id FROM w1)), w2 AS (SELECT way_id FROM w1 UNION SELECT way_id FROM m WHERE relation_id IN (SELECT relation_id FROM rel)), n2 AS (SELECT node_id FROM inside UNION SELECT node_id FROM wn WHERE way_id IN (SELECT way_id FROM w2)) SELECT 'node' AS kind, count(*) AS n FROM n2 UNION ALL SELECT 'way', count(*) FROM w2 UNION ALL SELECT 'relation', count(*) FROM rel",
        "candidate_runoff": _with("daily AS (SELECT (user_id % 3)::INT AS s, (ts::DATE + to_months((user_id % 12)::INT))::DATE AS day, round(sum(value), 2) AS mm FROM events GROUP BY 1, 2), tot AS (SELECT s, sum(mm) AS t FROM daily WHERE month(day) IN (6, 7, 8, 9) AND year(day) BETWEEN 2020 AND 2024 GROUP BY 1), q AS (SELECT c_custkey::BIGINT AS candidate_id, c_custkey % 9 <> 0 AS placed, ((c_custkey * 7919) % 4000000)::DOUBLE AS area, CASE WHEN c_custkey % 9 <> 0 THEN t END AS t FROM customer LEFT JOIN tot ON s = c_custkey % 4)", "SELECT candidate_id, CASE WHEN NOT placed THEN 'missing_coordinates' WHEN t IS NULL THEN 'provider_unavailable' ELSE 'ok' END AS rainfall_status, round(t, 4) AS rainfall_mm, round(v, 4) AS runoff_m3, round(CASE WHEN v > 0 THEN v * 0.5::DOUBLE END, 4) AS storage_m3 FROM (SELECT *, CASE WHEN t / 5 >= 1 AND area >= 100 THEN t / 5 / 1000.0::DOUBLE * area * 0.3::DOUBLE END AS v FROM q)"),
        "plateau_peaks": _with(f"{ACC}, peaks AS MATERIALIZED (SELECT f.site_id, f.r, f.c, f.cell, a.accumulation FROM flow f JOIN acc a ON a.site_id = f.site_id AND a.cell = f.cell WHERE NOT EXISTS (SELECT 1 FROM flow g JOIN acc b ON b.site_id = g.site_id AND b.cell = g.cell WHERE g.site_id = f.site_id AND g.r BETWEEN f.r - 1 AND f.r + 1 AND g.c BETWEEN f.c - 1 AND f.c + 1 AND b.accumulation > a.accumulation)), reach AS (SELECT site_id, cell, r, c, cell AS other FROM peaks UNION SELECT x.site_id, x.cell, y.r, y.c, y.cell FROM reach x JOIN peaks y ON y.site_id = x.site_id AND abs(y.r - x.r) + abs(y.c - x.c) = 1), groups AS (SELECT site_id, cell, min(other) AS g FROM reach GROUP BY 1, 2)", "SELECT site_id, r AS row, c AS col, accumulation FROM (SELECT p.*, row_number() OVER (PARTITION BY p.site_id, g ORDER BY accumulation DESC, p.cell) AS n FROM peaks p JOIN groups USING (site_id, cell)) WHERE n = 1"),
        "site_recommendation": _with(SLOPE, _site_recommendation()),
        "legacy_scores": _with(_legacy(), f"SELECT site_id, candidate_id, {r6('s_slope', 'score_slope')}, {r6('s_area', 'score_catchment_area')}, {r6('s_rain', 'score_rainfall')}, {r6('s_water', 'score_water_distance')}, {r6('s_road', 'score_road_distance')}, {r6('s_building', 'score_building_distance')}, {r6('s_land', 'score_land_use')}, {r6('s_both', 'score_road_building_distance')}, {r6('overall', 'overall_score')} FROM scored"),
        "legacy_rank": _with(_legacy(), f"SELECT site_id, candidate_id, {r6('overall', 'overall_score')}, {r6(_clamp('0.55::DOUBLE + 0.45::DOUBLE * overall'), 'confidence')}, CASE WHEN overall >= 0.7 THEN 'highly_suitable' WHEN overall >= 0.4 THEN 'moderately_suitable' ELSE 'marginal' END AS recommendation, row_number() OVER (PARTITION BY site_id ORDER BY overall DESC, candidate_id)::INT AS rank FROM scored WHERE slope <= 35 AND area >= 0 AND (rain IS NULL OR rain >= 0) AND (water IS NULL OR water >= 25) AND (road IS NULL OR road >= 25) AND (building IS NULL OR building >= 25)"),
        "eligibility": _with(_engine(), "SELECT reason AS ineligible_reason, count(*) AS n FROM scored GROUP BY 1"),
        "engine_scores": _with(_engine(), f"SELECT site_id, candidate_id, {r9('hydrology', 'hydrology')}, {r9('terrain', 'terrain')}, {r9('geography', 'geography')}, {r9('rainfall', 'rainfall')}, {r9('runoff_s', 'runoff')}, {r9('storage_s', 'storage')} FROM scored"),
        "engine_confidence": _with(_engine(), f"SELECT site_id, candidate_id, {r9('confidence', 'confidence')} FROM scored"),
        "engine_rank": _with(_engine(), "SELECT site_id, candidate_id, overall AS overall_score, row_number() OVER (PARTITION BY site_id ORDER BY overall DESC, confidence DESC, lat, lon, candidate_id)::INT AS rank, CASE WHEN overall >= 0.7 THEN 'highly_suitable' WHEN overall >= 0.4 THEN 'moderately_suitable' ELSE 'marginal' END AS recommendation FROM scored WHERE reason IS NULL"),
        "explanations": _with(_engine(), "SELECT site_id, candidate_id, ((feas = 'unknown')::INT + (rain IS NULL)::INT + (runoff IS NULL)::INT + (storage IS NULL)::INT)::INT AS n_missing, hydrology < 0.4 AS dry FROM scored WHERE reason IS NULL"),
        "seasonal_rainfall": _with(RAIN, "SELECT site_id, round(sum(mm), 4) AS seasonal_total_mm, count(*) AS daily_values_used, min(day) AS date_start, max(day) AS date_end, round(sum(mm) / 5, 4) AS mean_annual_mm FROM daily WHERE month(day) IN (6, 7, 8, 9) GROUP BY 1"),
        "runoff": _with(CANDIDATES, "SELECT site_id, candidate_id, round(v, 6) AS runoff_m3, round(CASE WHEN candidate_id % 2 = 0 AND v > 0 THEN v * 0.5::DOUBLE END, 6) AS storage_m3, CASE WHEN rain IS NULL OR rain < 1 THEN 'insufficient_rainfall_data' WHEN area < 100 THEN 'catchment_too_small' WHEN v < 10 THEN 'very_low' WHEN v < 1000 THEN 'low' WHEN v < 10000 THEN 'moderate' WHEN v < 100000 THEN 'good' ELSE 'high' END AS water_availability_status FROM (SELECT *, CASE WHEN rain >= 1 AND area >= 100 THEN rain / 1000.0::DOUBLE * area * 0.3::DOUBLE END AS v FROM cand)"),
        "analysis_bounds": "SELECT request_id, latitude, longitude, radius_km, NULL::VARCHAR AS error, round(greatest(-90.0::DOUBLE, latitude - dl), 6) AS south, round(least(90.0::DOUBLE, latitude + dl), 6) AS north, round(greatest(-180.0::DOUBLE, longitude - dl / cos(radians(latitude))), 6) AS west, round(least(180.0::DOUBLE, longitude + dl / cos(radians(latitude))), 6) AS east FROM (SELECT n_nationkey::BIGINT AS request_id, (-60.0 + 5 * n_nationkey)::DOUBLE AS latitude, (-170.0 + 14 * n_nationkey)::DOUBLE AS longitude, (1.0 + n_nationkey % 10)::DOUBLE AS radius_km, degrees((1.0 + n_nationkey % 10)::DOUBLE / 6371.0::DOUBLE) AS dl FROM nation)",
        "utm_round_trip": "SELECT n_nationkey::BIGINT AS request_id, z AS zone, (CASE WHEN -60 + 5 * n_nationkey >= 0 THEN 32600 ELSE 32700 END + z)::INT AS epsg, 0::BIGINT AS off FROM (SELECT n_nationkey, greatest(1, least(60, floor((10 + 14 * n_nationkey) / 6.0) + 1))::INT AS z FROM nation)",
        "padded_bbox": _with(CANDIDATES, "SELECT site_id, round(min(lat) - p, 4) AS south, round(min(lon) - p / greatest(abs(cos(radians(avg(lat)))), 1e-6), 4) AS west, round(max(lat) + p, 4) AS north, round(max(lon) + p / greatest(abs(cos(radians(avg(lat)))), 1e-6), 4) AS east FROM cand, (SELECT 1000.0::DOUBLE / 111320.0::DOUBLE AS p) WHERE lat IS NOT NULL GROUP BY site_id, p"),
        "bbox_relation": "SELECT n_nationkey::BIGINT AS request_id, CASE WHEN lat - dl >= -40 AND lat + dl <= 40 AND lon - dn >= -120.05 AND lon + dn <= 120 THEN 'full' WHEN lat + dl < -40 OR lat - dl > 40 OR lon + dn < -120.05 OR lon - dn > 120 THEN 'none' ELSE 'partial' END AS relation FROM (SELECT n_nationkey, (-60.0 + 5 * n_nationkey)::DOUBLE AS lat, (-170.0 + 14 * n_nationkey)::DOUBLE AS lon, degrees((1.0 + n_nationkey % 10)::DOUBLE / 6371.0::DOUBLE) AS dl, degrees((1.0 + n_nationkey % 10)::DOUBLE / 6371.0::DOUBLE) / cos(radians((-60.0 + 5 * n_nationkey)::DOUBLE)) AS dn FROM nation)",
        "extent_center": _with(CANDIDATES, "SELECT site_id, round((min(lat) + max(lat)) / 2, 6) AS latitude, round((min(lon) + max(lon)) / 2, 6) AS longitude FROM cand GROUP BY 1"),
        "tag_map": _with(TAGS, "SELECT osm_id, CASE WHEN even THEN 'yes' END AS building, CASE WHEN even THEN c_name END AS name, CASE WHEN NOT even THEN 'residential' END AS highway, CASE WHEN even THEN 'building' ELSE 'road' END AS kind FROM tags"),
        "feature_layers": _with(TAGS, "SELECT CASE WHEN even THEN 'buildings' ELSE 'roads' END AS layer, count(*) AS n FROM tags GROUP BY 1"),
        "nearest_distance": _with(NEAREST, nearest.format("dist")),
        "nearest_within": _with(f"{NEAREST}, capped AS (SELECT * FROM dist WHERE d <= 60)", nearest.format("capped")),
        "within_count": _with(NEAREST, "SELECT p.site_id, p.id, count(d) FILTER (kind = 'water' AND d <= 75) AS n_water, count(d) FILTER (kind = 'road' AND d <= 75) AS n_road, count(d) FILTER (kind = 'building' AND d <= 75) AS n_building FROM points p LEFT JOIN dist d ON d.site_id = p.site_id AND d.id = p.id GROUP BY 1, 2"),
        "enrichment": _with(f"{NEAREST}, {bs.ENRICHED}", "SELECT CASE WHEN why = 'not_enriched_candidate_limit' THEN why ELSE 'enriched' END AS enrichment_status, status AS feasibility, count(*) AS n FROM judged GROUP BY 1, 2"),
        "enrichment_counts": _with(f"{NEAREST}, {bs.ENRICHED}", "SELECT site_id, count(*) FILTER (status = 'feasible') AS feasible_count, count(*) FILTER (status = 'rejected') AS rejected_count, count(*) FILTER (status = 'unknown') AS unknown_count, count(*) FILTER (why = 'inside_or_on_water_body') AS n_water, count(*) FILTER (why = 'insufficient_building_clearance') AS n_building, count(*) FILTER (why = 'insufficient_road_clearance') AS n_road, count(*) FILTER (why = 'not_enriched_candidate_limit') AS n_limit FROM judged GROUP BY 1"),
        "feasibility": _with(f"{NEAREST}, m AS (SELECT p.site_id, p.id, min(d) FILTER (kind = 'water') AS w, min(d) FILTER (kind = 'road') AS r, min(d) FILTER (kind = 'building') AS b FROM points p LEFT JOIN dist d ON d.site_id = p.site_id AND d.id = p.id GROUP BY 1, 2), q AS (SELECT CASE WHEN w <= 0 THEN 'inside_or_on_water_body' WHEN b < 25 THEN 'insufficient_building_clearance' WHEN r < 25 THEN 'insufficient_road_clearance' END AS why FROM m)", "SELECT CASE WHEN why IS NULL THEN 'feasible' ELSE 'rejected' END AS feasibility, why AS feasibility_reason, count(*) AS n FROM q GROUP BY 1, 2"),
        "water_exclusion": _with(NEAREST, "SELECT site_id, id FROM points p WHERE NOT EXISTS (SELECT 1 FROM dist d WHERE d.site_id = p.site_id AND d.id = p.id AND kind = 'water' AND d.d <= 30)"),
        "contour_parse": _with(DOCS, "SELECT site_id, e AS elevation_m, n AS points, name FROM marks"),
        "contour_diagnostics": _with(DOCS, f"SELECT a.*, interval_min_m, interval_mean_m, interval_max_m FROM (SELECT site_id, count(*) AS contour_count, count(DISTINCT e) AS unique_elevation_count, min(e) AS elevation_min_m, max(e) AS elevation_max_m, {r6('avg(e)', 'elevation_mean_m')}, {r6('median(e)', 'elevation_median_m')}, {r6('stddev_pop(e)', 'elevation_std_m')} FROM marks GROUP BY 1) a JOIN (SELECT site_id, coalesce(min(g), 0) AS interval_min_m, coalesce(round(avg(g), 6), 0) AS interval_mean_m, coalesce(max(g), 0) AS interval_max_m FROM (SELECT site_id, e - lag(e) OVER (PARTITION BY site_id ORDER BY e) AS g FROM marks) GROUP BY 1) b USING (site_id)"),
        "contour_lengths": _with(DOCS, "SELECT site_id, count(*) AS n, round(max(l), 6) AS longest FROM (SELECT site_id, r, max(x) - min(x) AS l FROM (SELECT c.site_id, c.r, round(81.0::DOUBLE + 0.01::DOUBLE * c.site_id + 0.00005::DOUBLE * c.c, 6) AS x FROM cells c JOIN marks m ON m.site_id = c.site_id AND m.r = c.r WHERE z IS NOT NULL) GROUP BY 1, 2) GROUP BY 1"),
        "first_number": r"SELECT p_partkey::BIGINT AS p_partkey, nullif(regexp_extract(p_brand, '[-+]?(?:\d+(?:\.\d*)?|\.\d+)'), '')::DOUBLE AS number FROM part",
        "data_quality_metrics": _with(
            f"{ENDS}, {SLOPE.removeprefix(CELLS + ',')}, {DOCS.removeprefix(CELLS + ',')}, {CANDIDATES}, grade AS ({GRADE}), {bs.METRICS}",
            bs.METRICS_SELECT,
        ),
        "dem_quality": _with(SLOPE, GRADE),
        "grid_nearest": "WITH b AS (SELECT (c_custkey // 100)::BIGINT AS site_id, c_custkey::BIGINT AS id, (500000.0 + 1000 * (c_custkey // 100) + (c_custkey * 37) % 311 - 75)::DOUBLE AS x, (2350000.0 + (c_custkey * 53) % 317 - 75)::DOUBLE AS y FROM customer), box AS (SELECT site_id, min(x) AS x0, min(y) AS y0, ceil((max(x) + 25 - min(x)) / 25)::INT AS nc, ceil((max(y) + 25 - min(y)) / 25)::INT AS nr FROM b GROUP BY 1), g AS (SELECT site_id, r, unnest(range(nc))::INT AS c, x0, y0 FROM (SELECT *, unnest(range(nr))::INT AS r FROM box WHERE nr >= 2 AND nc >= 2)) SELECT site_id, r AS row, c AS col, x, y, elevation FROM (SELECT g.site_id, g.r, g.c, x0 + c * 25.0::DOUBLE AS x, y0 + r * 25.0::DOUBLE AS y, (b.id % 100)::DOUBLE AS elevation, row_number() OVER (PARTITION BY g.site_id, g.r, g.c ORDER BY (x0 + c * 25.0::DOUBLE - b.x) * (x0 + c * 25.0::DOUBLE - b.x) + (y0 + r * 25.0::DOUBLE - b.y) * (y0 + r * 25.0::DOUBLE - b.y), b.id) AS n FROM g JOIN b USING (site_id)) WHERE n = 1",
    }
