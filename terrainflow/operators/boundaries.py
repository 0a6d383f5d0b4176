"""Outlines of catchments: directed edges, simple rings, parts with their holes, vertices in map coordinates and WGS84."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrainflow.functions.geo import from_utm

KEY = ["site_id", "outlet"]
_CORNERS = "array<struct<r:int,c:int>>"
RINGS = f"site_id bigint, outlet bigint, ring int, part int, hole boolean, area_cells double, corners {_CORNERS}, enclosed int"
#: From and to corner of a cell's sides, counter-clockwise where rows grow northwards: the cell lies on the left.
_SIDES = (((0, 0), (0, 1)), ((0, 1), (1, 1)), ((1, 1), (1, 0)), ((1, 0), (0, 0)))


def outline_edges(members: DataFrame) -> DataFrame:
    """members (site_id, outlet, row, col) -> directed unit edges that one cell has alone: site_id, outlet, r1, c1, r2, c2.

    Rows that repeat a cell count once.
    """
    r, c = F.col("row").cast("int"), F.col("col").cast("int")
    side = lambda a, b: F.struct((r + a[0]).alias("r1"), (c + a[1]).alias("c1"), (r + b[0]).alias("r2"), (c + b[1]).alias("c2"))
    each = members.select(*KEY, "row", "col").distinct().select(*KEY, F.explode(F.array(*[side(a, b) for a, b in _SIDES])).alias("e"))
    place = [F.least("e.r1", "e.r2").alias("_r"), F.least("e.c1", "e.c2").alias("_c"), (F.col("e.r1") == F.col("e.r2")).alias("_flat")]
    alone = each.groupBy(*KEY, *place).agg(F.count("*").alias("n"), F.min("e").alias("e")).where("n = 1")
    return alone.select(*KEY, "e.*")


def _loops(edges: list[tuple]) -> list[list[tuple]]:
    """Simple closed loops of directed edges ((r1, c1), (r2, c2)); a walk that meets a corner again is cut there."""
    ahead: dict[tuple, list] = {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
    loops = []
    for start in sorted(ahead):
        while ahead.get(start):
            path, at, before = [start], {start: 0}, None
            while True:
                here = path[-1]
                choices = ahead[here]
                if len(choices) > 1 and before is not None:  # two cells meet at this corner: stay with the own one
                    dr, dc = here[0] - before[0], here[1] - before[1]
                    choices.sort(key=lambda p: dr * (p[1] - here[1]) - dc * (p[0] - here[0]))
                before, to = here, choices.pop(0)
                if to not in at:
                    at[to] = len(path)
                    path.append(to)
                    continue
                loop = path[at[to] :]
                loops.append(loop)
                for p in loop[1:]:
                    del at[p]
                del path[at[to] + 1 :]
                if len(path) == 1:
                    break
    return loops


def _area(loop: list[tuple]) -> float:
    return sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(loop, loop[1:] + loop[:1], strict=True)) / 2


def _turns(loop: list[tuple]) -> list[tuple]:
    """The corners where a loop turns, from the least one, closed."""
    n = len(loop)
    kept = [p for i, p in enumerate(loop) if not (loop[i - 1][0] == p[0] == loop[(i + 1) % n][0] or loop[i - 1][1] == p[1] == loop[(i + 1) % n][1])]
    least = kept.index(min(kept))
    kept = kept[least:] + kept[:least]
    return [*kept, kept[0]]


def _enclosed(edges: list[tuple], loops: list[list[tuple]], parts: int) -> int:
    """Pieces of what lies around that the outline encloses, joined along sides: its faces by Euler's formula, less the parts and the outside.

    Parts that meet at corners in a circle enclose a piece that no ring of their own bounds.
    """
    root = list(range(len(loops)))

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    first: dict[tuple, int] = {}
    for k, loop in enumerate(loops):
        for p in loop:
            root[find(k)] = find(first.setdefault(p, k))
    return len(edges) - len(first) + len({find(k) for k in root}) - parts


def _nested(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rings of one outline with their parts. Left of a hole's first cell stands a run of the mask; the ring at that run's left
    end is the hole's shell, or another hole of the same part whose first corner comes earlier."""
    edges = [((a, b), (c, d)) for a, b, c, d in pdf[["r1", "c1", "r2", "c2"]].itertuples(index=False)]
    loops = sorted(_loops(edges), key=min)
    areas = [_area(x) for x in loops]
    upright = sorted((min(a[0], b[0]), a[1], k) for k, loop in enumerate(loops) for a, b in zip(loop, loop[1:] + loop[:1], strict=True) if a[1] == b[1])
    left = {(r, c): before[2] for before, (r, c, _) in zip(upright, upright[1:], strict=False) if before[0] == r}
    shells = {k: n for n, k in enumerate(k for k, a in enumerate(areas) if a > 0)}
    part = []
    for k, loop in enumerate(loops):
        part.append(shells[k] if k in shells else part[left[min(loop)]])
    around = _enclosed(edges, loops, len(shells))
    rows = [(pdf["site_id"].iloc[0], pdf["outlet"].iloc[0], k, part[k] + 1, areas[k] < 0, abs(areas[k]), [{"r": r, "c": c} for r, c in _turns(loop)], around) for k, loop in enumerate(loops)]
    return pd.DataFrame(rows, columns=["site_id", "outlet", "ring", "part", "hole", "area_cells", "corners", "enclosed"])


def nested_rings(members: DataFrame) -> DataFrame:
    """members (site_id, outlet, row, col) -> simple closed rings in cell corners: ring, part (from 1), hole, area_cells, corners, enclosed.

    Cells belong together along sides: cells that meet at a corner only are parts of their own, and holes that meet at a
    corner are holes of their own. enclosed: pieces of what lies around that the whole outline encloses, those between parts that
    meet at corners included. Shells run counter-clockwise where rows grow northwards, holes the other way. Inner edges
    are cancelled by a grouped count; only the outline of a catchment, which one geometry must hold anyway, meets in one task.
    """
    return outline_edges(members).groupBy(*KEY).applyInPandas(_nested, RINGS)


def ring_vertices(rings: DataFrame) -> DataFrame:
    """One row for each corner of each ring (the closing one left out): site_id, outlet, part, ring, hole, seq, r, c."""
    places = F.slice("corners", F.lit(1), F.size("corners") - 1)
    return rings.select(*KEY, "part", "ring", "hole", F.posexplode(places).alias("seq", "p")).select(*KEY, "part", "ring", "hole", "seq", "p.r", "p.c")


def in_wgs84(rings: DataFrame, frames: DataFrame) -> DataFrame:
    """rings with points (array of longitude, latitude). frames: site_id, x0, y0 (centre of cell 0, 0), dx, dy (signed steps), zone, south.

    A corner lies half a step before its cell's centre. Sites without a frame give no rows.
    """
    placed = rings.join(frames.select("site_id", "x0", "y0", "dx", "dy", "zone", "south"), "site_id")
    x = lambda p: F.col("x0") + (p.c - 0.5) * F.col("dx")
    y = lambda p: F.col("y0") + (p.r - 0.5) * F.col("dy")
    points = F.transform("corners", lambda p: from_utm(x(p), y(p), F.col("zone"), F.col("south")))
    return placed.withColumn("points", points).drop("x0", "y0", "dx", "dy", "zone", "south")


def grid_frames(cells: DataFrame, zone: Column, south: Column) -> DataFrame:
    """cells (site_id, row, col, x, y) -> frames: spacing from the extent of columns and rows; 1 where there is only one."""
    box = cells.groupBy("site_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("row", "col") for f in (F.min, F.max)], F.min_by("x", "col").alias("xa"), F.max_by("x", "col").alias("xb"), F.min_by("y", "row").alias("ya"), F.max_by("y", "row").alias("yb"))
    step = lambda a, b, c: F.when(F.col(f"max_{c}") > F.col(f"min_{c}"), (F.col(b) - F.col(a)) / (F.col(f"max_{c}") - F.col(f"min_{c}"))).otherwise(F.lit(1.0))
    box = box.withColumns({"dx": step("xa", "xb", "col"), "dy": step("ya", "yb", "row")})
    return box.select("site_id", (F.col("xa") - F.col("min_col") * F.col("dx")).alias("x0"), (F.col("ya") - F.col("min_row") * F.col("dy")).alias("y0"), "dx", "dy", zone.cast("int").alias("zone"), south.alias("south"))


def multipolygons(rings: DataFrame) -> DataFrame:
    """rings with points -> site_id, outlet, parts, holes, polygons: by part, the shell first, then its holes in order."""
    part = F.array_sort(F.collect_list(F.struct("hole", "ring", "points")))
    one = rings.groupBy(*KEY, "part").agg(part.alias("r"))
    one = one.select(*KEY, "part", (F.size("r") - 1).alias("h"), F.transform("r", lambda x: x.points).alias("rings"))
    every = F.array_sort(F.collect_list(F.struct("part", "rings")))
    out = one.groupBy(*KEY).agg(F.count("*").alias("parts"), F.sum("h").cast("bigint").alias("holes"), every.alias("p"))
    return out.select(*KEY, "parts", "holes", F.transform("p", lambda x: x.rings).alias("polygons"))
