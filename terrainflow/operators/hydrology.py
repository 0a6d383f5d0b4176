"""Depression filling, D8 routing, accumulation, outlets and catchments on cell tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrainflow.operators.iterate import cut_lineage
from terrainflow.operators.routing import TILE, flow_labels, route
from terrainflow.operators.stencil import DISTANCES, OFFSETS, lowest_neighbour, with_neighbours, with_ring
from terrainflow.operators.tiles import by_tile, tile_starts

EPSILON = 1e-4


# --- depressions ----------------------------------------------------------------------------------


def internal_sinks(cells: DataFrame, meta: DataFrame, column: str = "elevation") -> DataFrame:
    """Dense cells -> site_id, internal_sinks: valid cells off the ring with no lower neighbour."""
    near = with_ring(with_neighbours(cells, column), meta)
    z = F.col(column)
    sink = z.isNotNull() & ~F.col("on_ring") & ~F.coalesce(lowest_neighbour() < z, F.lit(False))
    return near.groupBy("site_id").agg(F.sum(sink.cast("int")).cast("bigint").alias("internal_sinks"))


def _flood(z: np.ndarray, level: np.ndarray, open_: np.ndarray, width: np.ndarray, front: np.ndarray, eps: float) -> np.ndarray:
    """Lower the levels of the open cells to the least that paths from `front` give. Flat arrays of grids with a margin, one after another.

    All cells whose level fell in one step are the front of the next: z above the level that enters keeps z, else a step of eps.
    width: the width of the grid that a cell lies in.
    """
    level = level.copy()
    rows, cols = (np.array(step) for step in zip(*OFFSETS, strict=True))
    while len(front):
        target = (front[:, None] + rows * width[front, None] + cols).ravel()
        enters = np.repeat(level[front], len(OFFSETS))
        use = open_[target]
        target, enters = target[use], enters[use]
        new = np.where(z[target] > enters, z[target], enters + eps)
        use = new < level[target]
        target, new = target[use], new[use]
        np.minimum.at(level, target, new)
        front = np.unique(target)
    return level


def _places(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Flat places of the cells of many tiles, each a grid of its own with a margin, and the width of the grid at each flat place."""
    start = tile_starts(pdf, TILE_KEY)
    row, col = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
    top, left = np.minimum.reduceat(row, start), np.minimum.reduceat(col, start)
    height, width = np.maximum.reduceat(row, start) - top + 3, np.maximum.reduceat(col, start) - left + 3
    first = np.concatenate([[0], np.cumsum(height * width)])
    tile = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(pdf))))
    return first[tile] + (row - top[tile] + 1) * width[tile] + col - left[tile] + 1, np.repeat(width, height * width)


def _solve_tiles(eps: float):
    """Tiles' cells with their levels. Levels that other tiles have sent (halo) are where the water enters; without them the ring is."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        halo = pdf["halo"].to_numpy(bool)
        at, width = _places(pdf)
        elevation, ring, before = pdf["elevation"].to_numpy(float), pdf["on_ring"].to_numpy(bool), pdf["level"].to_numpy(float)
        valid = ~np.isnan(elevation)
        # Ring cells are outlets and keep their elevation; halo cells stand at the level their own tile gave them.
        own = np.where(np.isnan(before), np.where(valid & ring & ~halo, elevation, np.inf), before)
        z, level, open_ = np.full(len(width), np.nan), np.full(len(width), np.inf), np.zeros(len(width), bool)
        z[at], level[at], open_[at] = elevation, own, valid & ~ring & ~halo
        source = valid & (halo | (ring & ~pdf["solved"].to_numpy(bool)))
        front = np.unique(at[source])
        new = _flood(z, level, open_, width, front[np.isfinite(level[front])], eps)[at]
        result = pdf.loc[~halo, ["site_id", "tile_r", "tile_c", "row", "col", "elevation", "on_ring"]].copy()
        result["level"] = np.where(np.isfinite(new), new, np.nan)[~halo]
        old = np.where(np.isnan(before), np.inf, before)
        result["changed"] = (new < old)[~halo]
        return result

    return run


TILE_KEY = ("site_id", "tile_r", "tile_c")
_STATE = "site_id bigint, tile_r int, tile_c int, row int, col int, elevation double, on_ring boolean, level double, changed boolean"


def fill_depressions(cells: DataFrame, meta: DataFrame, eps: float = EPSILON, tile: int = TILE) -> DataFrame:
    """Dense cells -> with filled, modified, reachable.

    Ring cells are outlets and are never raised; a cell z that water enters at level p ends at z if z > p, else p + eps;
    the least level over all paths counts. Cells that no path reaches keep their elevation. Each tile is solved once from its
    own ring; then tiles send the border cells whose level fell to their neighbours, and only tiles that got any go on, from
    those cells alone. So the rounds follow the tiles that a drainage path crosses, the work what changes in them, and a
    site larger than a task is no problem.
    """
    state = with_ring(cells, meta).select(
        F.col("site_id").cast("bigint").alias("site_id"),
        F.floor(F.col("row") / tile).cast("int").alias("tile_r"),
        F.floor(F.col("col") / tile).cast("int").alias("tile_c"),
        F.col("row").cast("int").alias("row"),
        F.col("col").cast("int").alias("col"),
        "elevation",
        "on_ring",
    )
    key = list(TILE_KEY)

    def solved(work: DataFrame) -> DataFrame:
        out = by_tile(work, key, _solve_tiles(eps), _STATE)
        return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("elevation", "level")})

    first = state.withColumns({"level": F.lit(None).cast("double"), "halo": F.lit(False), "solved": F.lit(False)})
    state = cut_lineage(solved(first))
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in OFFSETS])
    border = (F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1)
    place = [F.floor((F.col(c) + F.col(f"o.d{c[0]}")) / tile).cast("int").alias(f"to_{c[0]}") for c in ("row", "col")]
    tiles = state.select(*key).distinct()
    many = not meta.where((F.col("rows") > tile) | (F.col("cols") > tile)).isEmpty()
    while many:  # levels only fall, to the least of finitely many paths
        sent = state.where(F.col("changed") & border).withColumn("o", F.explode(steps)).select("*", *place)
        sent = sent.where((F.col("to_r") != F.col("tile_r")) | (F.col("to_c") != F.col("tile_c"))).drop("tile_r", "tile_c", "o", "changed")
        sent = cut_lineage(sent.withColumnsRenamed({"to_r": "tile_r", "to_c": "tile_c"}).distinct())
        if sent.isEmpty():
            break
        active = sent.select(*key).distinct()
        work = state.drop("changed").join(active.hint("merge"), key, "left_semi").withColumn("halo", F.lit(False)).unionByName(sent.withColumn("halo", F.lit(True)).join(tiles.hint("merge"), key, "left_semi"))
        rest = state.join(active.hint("merge"), key, "left_anti").withColumn("changed", F.lit(False))
        state = cut_lineage(solved(work.withColumn("solved", F.lit(True))).unionByName(rest))
    z, level = F.col("elevation"), F.col("level")
    return state.select(
        "site_id",
        "row",
        "col",
        "elevation",
        "on_ring",
        F.when(z.isNotNull(), F.coalesce(level, z)).alias("filled"),
        F.coalesce(level > z + eps / 2, F.lit(False)).alias("modified"),
        (z.isNotNull() & level.isNotNull()).alias("reachable"),
    )


# --- routing --------------------------------------------------------------------------------------


def d8(cells: DataFrame, meta: DataFrame, column: str = "elevation") -> DataFrame:
    """Dense cells -> with flow_dir (-1: no lower neighbour), has_lower, sink, edge_outflow, downstream (flat index, -1: none), cell.

    The steepest descent wins, the lowest direction on ties. Null elevation: direction -1, never a target.
    """
    res = meta.select("site_id", F.col("resolution_m").alias("_res"), F.col("cols").alias("_cols"))
    near = with_ring(with_neighbours(cells, column), meta) if "on_ring" not in cells.columns else with_neighbours(cells, column)
    near = near.join(res, "site_id")
    z = F.col(column)
    slopes = [(z - F.col(f"n{k}")) / (F.col("_res") * DISTANCES[k]) for k in range(8)]
    out = near.withColumns({f"_s{k}": s for k, s in enumerate(slopes)}).withColumn("_best", F.greatest(*[F.col(f"_s{k}") for k in range(8)]))
    direction = F.when(F.col("_best").isNull() | (F.col("_best") <= 0), -1)
    for k in range(8):
        direction = direction.when(F.col(f"_s{k}") == F.col("_best"), k)
    step = F.lit(None).cast("bigint")
    for k, (dr, dc) in enumerate(OFFSETS):
        step = F.when(F.col("flow_dir") == k, dr * F.col("_cols") + dc).otherwise(step)
    out = out.withColumn("flow_dir", direction.cast("tinyint"))
    cell = F.col("row").cast("bigint") * F.col("_cols") + F.col("col")
    out = out.withColumns({"cell": cell, "downstream": F.when(F.col("flow_dir") >= 0, cell + step).otherwise(F.lit(-1)).cast("bigint")})
    valid = z.isNotNull()
    out = out.withColumns({"has_lower": F.col("flow_dir") >= 0, "sink": valid & (F.col("flow_dir") < 0) & ~F.col("on_ring"), "edge_outflow": valid & F.col("on_ring")})
    return out.drop("_res", "_cols", "_best", *[f"_s{k}" for k in range(8)], *[f"n{k}" for k in range(8)])


def flow_accumulation(flow: DataFrame, column: str = "elevation", tile: int = TILE) -> DataFrame:
    """D8 cells -> site_id, cell, accumulation: valid cells that drain through each cell, itself included; null on a cycle."""
    return route(flow, column, tile).select("site_id", "cell", "accumulation")


def drainage_outlet(flow: DataFrame, column: str = "elevation", tile: int = TILE) -> DataFrame:
    """D8 cells -> site_id, cell, outlet: the terminal cell that each valid cell drains to; null on the way into a cycle."""
    return route(flow, column, tile).select("site_id", "cell", "outlet")


def catchments(flow: DataFrame, outlets: DataFrame, column: str = "elevation", tile: int = TILE, routed: DataFrame | None = None) -> DataFrame:
    """D8 cells, outlets (site_id, outlet) -> site_id, outlet, cell: all cells whose path passes an outlet, itself included.

    Membership is a test of ranges: a cell belongs to an outlet of its tree if its pre-order number is among those of the
    outlet. Outlets that are not valid cells give no rows. Where paths run into a cycle there are no trees; members of
    outlets there are found step by step. routed: the cells of `route`, if they are there already.
    """
    labels = cut_lineage(flow_labels(flow, column, tile, routed))
    asked = outlets.select(F.col("site_id").cast("bigint").alias("site_id"), F.col("outlet").cast("bigint").alias("outlet")).distinct()
    own = asked.hint("merge").join(labels.select("site_id", F.col("cell").alias("outlet"), F.col("outlet").alias("tree"), F.col("first").alias("lo"), F.col("last").alias("hi")), ["site_id", "outlet"])
    cells = labels.where("outlet is not null").select("site_id", F.col("outlet").alias("tree"), "cell", "first")
    found = cells.hint("merge").join(own.where("tree is not null"), ["site_id", "tree"]).where((F.col("first") >= F.col("lo")) & (F.col("first") <= F.col("hi"))).select("site_id", "outlet", "cell")
    looped = own.where("tree is null").select("site_id", "outlet")
    if looped.isEmpty():
        return found
    into = labels.where("outlet is null").select("site_id", "cell")
    links = flow.hint("merge").join(into, ["site_id", "cell"]).select("site_id", "cell", F.col("downstream").alias("to"))
    return found.unionByName(_on_cycles(cut_lineage(links), looped))


def _on_cycles(links: DataFrame, outlets: DataFrame) -> DataFrame:
    """Members of outlets on cells that lead into a cycle, one step upstream each round."""
    members = cut_lineage(outlets.withColumn("cell", F.col("outlet")))
    fresh = members
    while not fresh.isEmpty():
        upstream = fresh.withColumnRenamed("cell", "to").join(links, ["site_id", "to"]).select("site_id", "outlet", "cell")
        fresh = cut_lineage(upstream.join(members, ["site_id", "outlet", "cell"], "left_anti"))
        members = members.unionByName(fresh)
    return members


def outlets(flow: DataFrame, accumulation: DataFrame, n: int = 5, column: str = "elevation") -> DataFrame:
    """Terminal cells by rank: boundary before internal, accumulation (null: 0) falling, then row, column; the first n."""
    ends = flow.where(F.col(column).isNotNull() & (F.col("flow_dir") < 0)).join(accumulation.hint("merge"), ["site_id", "cell"], "left")
    acc = F.coalesce("accumulation", F.lit(0.0))
    ends = ends.select("site_id", "cell", "row", "col", F.when(F.col("on_ring"), "boundary").otherwise("internal").alias("kind"), acc.alias("accumulation_cells"))
    order = Window.partitionBy("site_id").orderBy("kind", F.desc("accumulation_cells"), "row", "col")
    ranked = ends.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, int(n)))
    return ranked.withColumn("selected", F.col("rank") == 1)


def terminal_cells(flow: DataFrame, n: int = 5, column: str = "elevation") -> DataFrame:
    """The first n terminal cells of each site in row-major order."""
    ends = flow.where(F.col(column).isNotNull() & (F.col("flow_dir") < 0)).select("site_id", "row", "col", "cell")
    return ends.withColumn("rank", F.row_number().over(Window.partitionBy("site_id").orderBy("row", "col"))).where(F.col("rank") <= n)


def catchment_area(members: DataFrame, meta: DataFrame) -> DataFrame:
    """site_id, outlet, cells, area_m2, area_ha, area_km2."""
    m2 = F.col("cells") * F.col("resolution_m") * F.col("resolution_m")
    counted = members.groupBy("site_id", "outlet").agg(F.count("*").alias("cells")).join(meta.select("site_id", "resolution_m"), "site_id")
    return counted.select("site_id", "outlet", "cells", m2.alias("area_m2"), (m2 / 1e4).alias("area_ha"), (m2 / 1e6).alias("area_km2"))


def mask_runs(members: DataFrame) -> DataFrame:
    """members (site_id, outlet, row, col) -> horizontal runs: site_id, outlet, row, col_start, col_end."""
    own = Window.partitionBy("site_id", "outlet", "row").orderBy("col")
    grouped = members.withColumn("_g", F.col("col") - F.row_number().over(own))
    return grouped.groupBy("site_id", "outlet", "row", "_g").agg(F.min("col").alias("col_start"), F.max("col").alias("col_end")).drop("_g")


def boundary_edges(members: DataFrame) -> DataFrame:
    """Unit edges of the mask that one of its cells has alone: site_id, outlet, r1, c1, r2, c2 (corners, in cells)."""
    r, c = F.col("row").cast("int"), F.col("col").cast("int")
    sides = ((0, 0, 0, 1), (1, 0, 1, 1), (0, 0, 1, 0), (0, 1, 1, 1))
    each = members.select("site_id", "outlet", F.explode(F.array(*[F.struct((r + a).alias("r1"), (c + b).alias("c1"), (r + d).alias("r2"), (c + e).alias("c2")) for a, b, d, e in sides])).alias("e"))
    return each.groupBy("site_id", "outlet", "e").count().where("count = 1").select("site_id", "outlet", "e.r1", "e.c1", "e.r2", "e.c2")


def hydrology_summary(filled: DataFrame, flow: DataFrame, accumulation: DataFrame, meta: DataFrame) -> DataFrame:
    """One row a site: cells, sinks before and after filling, accumulation, share of routed cells, depression figures."""
    before = internal_sinks(filled.select("site_id", "row", "col", "elevation"), meta).withColumnRenamed("internal_sinks", "sinks_original")
    valid = F.col("filled").isNotNull()
    after = flow.where(valid).groupBy("site_id").agg(
        F.count("*").alias("valid_cells"),
        F.sum(F.col("sink").cast("int")).cast("bigint").alias("sinks_remaining"),
        F.sum((F.col("flow_dir") >= 0).cast("int")).cast("bigint").alias("routed_cells"),
        F.sum(F.col("edge_outflow").cast("int")).cast("bigint").alias("edge_outflow_cells"),
    )
    depth = filled.where(valid).groupBy("site_id").agg(
        F.sum(F.col("modified").cast("int")).cast("bigint").alias("modified_cells"),
        F.max(F.col("filled") - F.col("elevation")).alias("max_fill_depth_m"),
        F.sum((~F.col("reachable")).cast("int")).cast("bigint").alias("unreachable_cells"),
    )
    acc = accumulation.groupBy("site_id").agg(F.max("accumulation").alias("max_accumulation"), F.avg("accumulation").alias("mean_accumulation"), F.sum(F.col("accumulation").isNull().cast("int")).cast("bigint").alias("cycle_cells"))
    out = after.join(before, "site_id").join(depth, "site_id").join(acc, "site_id", "left")
    return out.withColumns({"sinks_resolved": F.greatest(F.col("sinks_original") - F.col("sinks_remaining"), F.lit(0)), "direction_fraction": F.col("routed_cells") / F.col("valid_cells")})
