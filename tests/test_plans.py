"""Plans on larger tables: rows that explode makes must not be broadcast, as the planner does not count them."""

import re

from terrainflow.operators import contours, stencil
from terrainflow.plans import queries, tables

SMALL = "/root/testdata/sf0.001"
BY_CELL = re.compile(r"BroadcastHashJoin \[[^\]]*(bx|row)#")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_cells_are_not_broadcast(spark, monkeypatch):
    plans = []
    cut = contours.cut_lineage
    monkeypatch.setattr(contours, "cut_lineage", lambda df: plans.append(plan(df)) or cut(df))
    assert queries.grid_nearest(spark, SMALL).count() and plans
    assert not any(BY_CELL.search(p) for p in plans)


def test_grid_cells_of_planes_and_contours_are_not_broadcast(spark, monkeypatch):
    """grid_planar and contour_pipeline go through the same search for near samples."""
    for name in ("grid_planar", "contour_pipeline"):
        plans = []
        cut = contours.cut_lineage
        with monkeypatch.context() as m:
            m.setattr(contours, "cut_lineage", lambda df, cut=cut, plans=plans: plans.append(plan(df)) or cut(df))
            assert getattr(queries, name)(spark, SMALL).count() and plans
        assert not any(BY_CELL.search(p) for p in plans)


def test_all_cells_are_not_broadcast(spark, monkeypatch):
    """Checkpointed cells look small to the planner; joins by cell, candidate or pair of candidates must not send them to the driver."""
    from terrainflow.operators import candidates, hydrology, independent, routing
    from terrainflow.plans import pipelines

    for name in ("candidate_rank", "rejection_counts", "contour_pipeline"):
        plans = []
        with monkeypatch.context() as m:
            for module in (candidates, hydrology, independent, routing, pipelines):
                m.setattr(module, "cut_lineage", lambda df, cut=module.cut_lineage, plans=plans: plans.append(plan(df)) or cut(df))
            assert getattr(queries, name)(spark, SMALL).count() and plans
        assert not [j for p in plans for j in re.findall(r"BroadcastHashJoin \[[^\]]*(?:row|cell|outlet|id#\d+L?, (?:id|other))#[^\]]*\]", p)]


def test_cells_of_boxes_are_not_broadcast(spark):
    """Boxes look at the levels of features only, through a join that sends no exploded cells to the driver."""
    from terrainflow.sources import quadtree

    features = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 0.5), (2, 0.2, 0.2, 0.2001, 0.2001)], "feature_id int, west double, south double, east double, north double")
    boxes = spark.createDataFrame([(7, 0.1, 0.1, 0.6, 0.6)], "request_id int, west double, south double, east double, north double")
    hit = quadtree.features_in_boxes(features, boxes)
    assert sorted((r.request_id, r.feature_id) for r in hit.collect()) == [(7, 1), (7, 2)]
    assert "Broadcast" not in plan(hit)


def test_dense_cells_are_not_broadcast(spark):
    cells = tables.dem_cells(spark, SMALL)
    dense = stencil.dense_grid(cells, tables.dem_meta(cells)).where("elevation is not null").select("site_id", "row")
    assert len(dense.collect()) == cells.where("elevation is not null").count()
    assert not BY_CELL.search(plan(dense))  # the plan as it was run


def test_catchments_route_the_cells_once(spark, monkeypatch):
    from terrainflow.operators import hydrology, routing

    plain = []
    route = routing.route

    def counted(flow, column="elevation", tile=routing.TILE, way=None):
        plain.append(way is None)
        return route(flow, column, tile, way)

    for module in (hydrology, routing):
        monkeypatch.setattr(module, "route", counted)
    assert queries.catchment_vertices(spark, SMALL).count()
    assert sum(plain) == 1  # accumulation and outlets of all cells; the other pass is that of the pre-order numbers


def test_figures_of_near_features_need_no_shuffle_of_pairs(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from terrainflow.operators import spatial

    points, segments = tables.probe_points(spark, SMALL).where("id % 7 = 0").limit(60).cache(), tables.segments(spark, SMALL)
    got = spatial.nearest_figures(points, segments, 90.0, 50.0).cache()
    pairs = spatial.distances(points, segments, 90.0).withColumn("k", F.row_number().over(Window.partitionBy("site_id", "id", "kind").orderBy("distance", "feature_id"))).collect()
    for r in got.collect():
        for kind in spatial.KINDS:
            own = sorted((p for p in pairs if (p.site_id, p.id, p.kind) == (r.site_id, r.id, kind)), key=lambda p: p.k)
            assert [tuple(n) for n in r[f"{kind}_nearest"] or []] == [(p.distance, p.feature_id) for p in own[:3]]
            assert r[f"{kind}_distance_m"] == (own[0].distance if own else None)
            assert r[f"n_{kind}"] == sum(p.distance <= 50 for p in own)
    assert got.count() == 60 and len(pairs) > 60
    ranked = points.withColumn("rank", F.lit(1))
    exchanges = re.findall(r"hashpartitioning\(([^)]*)\)", plan(spatial.enrich(ranked, segments)))
    assert exchanges and not any(re.search(r"\bid#.*kind#.*feature_id#", e) for e in exchanges)


def test_figures_keep_ids_that_are_text(spark):
    from pyspark.sql import functions as F

    from terrainflow.operators import spatial

    points = tables.probe_points(spark, SMALL).limit(5).withColumn("id", F.concat(F.lit("c-"), "id"))
    assert all(r.id.startswith("c-") for r in spatial.nearest_figures(points, tables.segments(spark, SMALL), 90.0, 50.0, 1).collect())
