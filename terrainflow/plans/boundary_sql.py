"""DuckDB SQL of outlines, alternatives, thinning and data-quality figures: longer forms that `oracle` adds to its own."""

from __future__ import annotations

from terrainflow.functions import geo

#: Corners by the quadrants that the mask fills around them: one or three make a turn, two opposite ones two turns.
VERTICES = """corners AS (SELECT site_id, outlet, r + dr AS r, c + dc AS c, dr * 2 + dc AS q FROM members CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc)),
vertices AS (SELECT site_id, outlet, r::INT AS r, c::INT AS c, CASE WHEN count(*) = 2 THEN 2 ELSE 1 END::BIGINT AS rings FROM corners GROUP BY 1, 2, 3, 4 HAVING count(*) IN (1, 3) OR (count(*) = 2 AND sum(q) = 3))"""

#: Pieces of the mask and of what lies around it, joined along sides; what is left of the latter without the outside are holes.
PARTS = """box AS (SELECT site_id, outlet, min(r) - 1 AS r0, max(r) + 1 AS r1, min(c) - 1 AS c0, max(c) + 1 AS c1 FROM members GROUP BY 1, 2),
framed AS (SELECT b.site_id, b.outlet, b.r, b.c, m.cell IS NOT NULL AS inside FROM (SELECT site_id, outlet, r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM box)) b
  LEFT JOIN members m ON m.site_id = b.site_id AND m.outlet = b.outlet AND m.r = b.r AND m.c = b.c),
runs AS (SELECT site_id, outlet, inside, r, min(c) AS a, max(c) AS b, r * 100000 + min(c) AS id FROM (SELECT *, c - row_number() OVER (PARTITION BY site_id, outlet, inside, r ORDER BY c) AS g FROM framed) GROUP BY 1, 2, 3, 4, g),
links AS (SELECT x.site_id, x.outlet, x.inside, x.id, y.id AS other FROM runs x JOIN runs y ON x.site_id = y.site_id AND x.outlet = y.outlet AND x.inside = y.inside AND abs(x.r - y.r) = 1 AND x.a <= y.b AND y.a <= x.b),
reach AS (SELECT site_id, outlet, inside, id, id AS seen FROM runs UNION SELECT k.site_id, k.outlet, k.inside, k.id, l.other FROM reach k JOIN links l ON l.site_id = k.site_id AND l.outlet = k.outlet AND l.inside = k.inside AND l.id = k.seen),
roots AS (SELECT site_id, outlet, inside, id, min(seen) AS root FROM reach GROUP BY 1, 2, 3, 4),
pieces AS (SELECT site_id, outlet, count(DISTINCT root) FILTER (inside) AS parts, count(DISTINCT root) FILTER (NOT inside) - 1 AS holes FROM roots GROUP BY 1, 2),
turns AS (SELECT site_id, outlet, sum(rings)::BIGINT AS vertices FROM vertices GROUP BY 1, 2)"""

#: Grids as the boundary queries place them: centre of cell 0, 0 and steps in metres.
FRAMES = "frames AS (SELECT site_id, 500000.0::DOUBLE + 1000 * (site_id % 100) AS x0, 2350000.0::DOUBLE AS y0, CASE WHEN nc > 1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS dx, CASE WHEN nr > 1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS dy FROM meta)"


def wgs84(source: str, zone: int = 44) -> str:
    """CTEs that add longitude and latitude to `source` (x, y in a northern UTM zone): the last one is `placed`."""
    radius = geo.SCALE * geo._RECTIFYING
    number = lambda v: f"({v!r})::DOUBLE"
    terms = lambda outer, a, b: " ".join(f"- {number(k)} * {outer}({2 * j}.0::DOUBLE * xi) * {b}({2 * j}.0::DOUBLE * eta)" for j, k in enumerate(geo._BETA, 1))
    phi = "conformal"
    for _ in range(6):
        phi = f"asin(tanh(atanh(sin(conformal)) + {number(geo._ECC)} * atanh({number(geo._ECC)} * sin({phi}))))"
    return f"""scaled AS (SELECT *, y / {number(radius)} AS xi, (x - 500000.0::DOUBLE) / {number(radius)} AS eta FROM {source}),
plane AS (SELECT *, xi {terms("sin", "xi", "cosh")} AS a, eta {terms("cos", "xi", "sinh")} AS b FROM scaled),
sphere AS (SELECT *, asin(sin(a) / cosh(b)) AS conformal, degrees(atan2(sinh(b), cos(a))) + {zone * 6 - 183} AS longitude FROM plane),
placed AS (SELECT *, degrees({phi}) AS latitude FROM sphere)"""


def alternatives(k: int = 3, terminals: int = 8, apart: int = 5) -> str:
    """CTEs over `ends`, `flow`, `acc`: terminal cells in order, then cells by accumulation away from those chosen: `chosen{k}`."""
    parts = [
        f"""main AS (SELECT site_id, cell FROM ends WHERE rank = 1),
terms AS (SELECT * FROM (SELECT f.site_id, f.r, f.c, f.cell, row_number() OVER (PARTITION BY f.site_id ORDER BY f.r, f.c) AS t FROM flow f JOIN main m ON m.site_id = f.site_id AND m.cell <> f.cell WHERE f.z IS NOT NULL AND f.flow_dir < 0) WHERE t <= {terminals}),
pool AS (SELECT f.site_id, f.r, f.c, f.cell, accumulation FROM flow f JOIN acc a ON a.site_id = f.site_id AND a.cell = f.cell JOIN main m ON m.site_id = f.site_id AND m.cell <> f.cell),
chosen0 AS (SELECT site_id, r, c, cell, 0 AS alternative FROM terms WHERE false)"""
    ]
    for j in range(1, k + 1):
        away = f"NOT EXISTS (SELECT 1 FROM terms t WHERE t.site_id = p.site_id AND t.t >= {j}) AND NOT EXISTS (SELECT 1 FROM chosen{j - 1} q WHERE q.site_id = p.site_id AND abs(q.r - p.r) + abs(q.c - p.c) < {apart})"
        parts.append(
            f"""chosen{j} AS (SELECT * FROM chosen{j - 1} UNION ALL SELECT site_id, r, c, cell, {j} FROM terms WHERE t = {j}
  UNION ALL SELECT site_id, r, c, cell, {j} FROM (SELECT p.*, row_number() OVER (PARTITION BY p.site_id ORDER BY accumulation DESC, r, c) AS n FROM pool p WHERE {away}) WHERE n = 1)"""
        )
    return ",\n".join(parts)


def thinned(priority: str, distance: float, strict: bool) -> str:
    """CTEs over customers as buildings: points taken one after another by priority, kept if none of those kept is near: `kept`."""
    near = "<" if strict else "<="
    return f"""b AS (SELECT (c_custkey // 100)::BIGINT AS site_id, c_custkey::BIGINT AS id, (500000.0 + 1000 * (c_custkey // 100) + (c_custkey * 37) % 311 - 75)::DOUBLE AS x, (2350000.0 + (c_custkey * 53) % 317 - 75)::DOUBLE AS y, ({priority})::BIGINT AS p FROM customer),
queue AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY p) AS n FROM b),
walk AS (SELECT site_id, 0::BIGINT AS n, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, p BIGINT)[] AS taken FROM (SELECT DISTINCT site_id FROM b)
  UNION ALL SELECT w.site_id, q.n, CASE WHEN len(list_filter(w.taken, lambda k: (k.x - q.x) * (k.x - q.x) + (k.y - q.y) * (k.y - q.y) {near} {distance * distance})) = 0 THEN list_append(w.taken, {{'id': q.id, 'x': q.x, 'y': q.y, 'p': q.p}}) ELSE w.taken END
  FROM walk w JOIN queue q ON q.site_id = w.site_id AND q.n = w.n + 1),
kept AS (SELECT site_id, unnest(taken, recursive := true) FROM (SELECT site_id, arg_max(taken, n) AS taken FROM walk GROUP BY 1))"""


#: Sections of the data-quality figures, over `slopes`, `flow`, `acc`, `ends`, `marks`, `cand`.
METRICS = """m_contour AS (SELECT site_id, count(*) AS contour_count, sum(n)::BIGINT AS coordinate_count, round(avg(e), 6) AS elevation_mean_m FROM marks GROUP BY 1),
m_dem AS (SELECT site_id, any_value(nr)::BIGINT AS dem_rows, any_value(nc)::BIGINT AS dem_columns, (any_value(nr) * any_value(nc))::BIGINT AS dem_cells, 5.0::DOUBLE AS dem_resolution_m, count(z) / (any_value(nr) * any_value(nc))::DOUBLE AS share, min(z) AS lo, max(z) AS hi, round(min(s), 6) AS slope_min_degrees, round(max(s), 6) AS slope_max_degrees, round(avg(s), 6) AS slope_mean_degrees FROM slopes GROUP BY 1),
m_flow AS (SELECT f.site_id, count(*) AS hydrology_valid_cells, round(100 * (count(*) FILTER (flow_dir >= 0)) / count(*)::DOUBLE, 6) AS valid_flow_direction_percentage, (count(*) FILTER (flow_dir < 0 AND NOT ring))::BIGINT AS sink_cells, (count(*) FILTER (ring))::BIGINT AS edge_outflow_cells, (count(*) FILTER (accumulation IS NULL))::BIGINT AS unresolved_cycle_cells,
  min(accumulation) AS flow_accumulation_min_cells, max(accumulation) AS flow_accumulation_max_cells, round(avg(accumulation), 6) AS flow_accumulation_mean_cells, quantile_cont(accumulation, 0.5) AS flow_accumulation_median_cells
  FROM flow f LEFT JOIN acc a ON a.site_id = f.site_id AND a.cell = f.cell WHERE z IS NOT NULL GROUP BY 1),
m_main AS (SELECT site_id, 25.0::DOUBLE * accumulation_cells AS area, accumulation_cells::BIGINT AS n FROM ends WHERE rank = 1),
m_cand AS (SELECT site_id, (count(*) FILTER (feas <> 'rejected'))::BIGINT AS accepted, (count(*) FILTER (feas = 'rejected'))::BIGINT AS rejected FROM cand GROUP BY 1),
m_rain AS (SELECT DISTINCT user_id % (SELECT count(*) FROM meta) AS site_id FROM events),
m_land AS (SELECT c_custkey // 100 AS site_id FROM customer UNION SELECT s_suppkey // 7 FROM supplier)"""
METRICS_SELECT = """SELECT d.site_id, contour_count, coordinate_count, round(lo, 6) AS elevation_min_m, round(hi, 6) AS elevation_max_m, elevation_mean_m, round(hi - lo, 6) AS elevation_range_m, dem_rows, dem_columns, dem_cells, dem_resolution_m, slope_min_degrees, slope_max_degrees, slope_mean_degrees,
  round(share, 6) AS valid_cell_fraction, round((1 - share) * 100, 6) AS dem_nan_percentage, g.dem_status, g.dem_score AS dem_quality_score, m_flow.* EXCLUDE (site_id), area AS catchment_area_m2, round(area / 1e4::DOUBLE, 6) AS catchment_area_hectares, round(area / 1e6::DOUBLE, 6) AS catchment_area_km2, m_main.n AS catchment_cell_count,
  accepted AS candidate_count, rejected AS rejected_candidate_count, accepted AS recommendation_count, true AS has_dem, m_rain.site_id IS NOT NULL AS has_rainfall, m_land.site_id IS NOT NULL AS has_land_context
  FROM m_dem d LEFT JOIN m_contour ON m_contour.site_id = d.site_id LEFT JOIN grade g ON g.site_id = d.site_id LEFT JOIN m_flow ON m_flow.site_id = d.site_id LEFT JOIN m_main ON m_main.site_id = d.site_id LEFT JOIN m_cand ON m_cand.site_id = d.site_id LEFT JOIN m_rain ON m_rain.site_id = d.site_id LEFT JOIN m_land ON m_land.site_id = d.site_id"""

#: Points by feasibility over `points`, `dist`: those beyond the first 21 rows of a site are not enriched.
ENRICHED = """nearest AS (SELECT p.site_id, p.id, min(d) FILTER (kind = 'water') AS w, min(d) FILTER (kind = 'road') AS r, min(d) FILTER (kind = 'building') AS b FROM points p LEFT JOIN dist d ON d.site_id = p.site_id AND d.id = p.id GROUP BY 1, 2),
reasoned AS (SELECT site_id, CASE WHEN id // 32 > 20 THEN 'not_enriched_candidate_limit' WHEN w <= 0 THEN 'inside_or_on_water_body' WHEN b < 25 THEN 'insufficient_building_clearance' WHEN r < 25 THEN 'insufficient_road_clearance' END AS why FROM nearest),
judged AS (SELECT site_id, why, CASE WHEN why IS NULL THEN 'feasible' WHEN why = 'not_enriched_candidate_limit' THEN 'unknown' ELSE 'rejected' END AS status FROM reasoned)"""
