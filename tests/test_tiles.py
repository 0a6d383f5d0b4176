"""Many tiles share a call, whole and apart from each other."""

import numpy as np
import pandas as pd

from terrainflow.operators import hydrology as h
from terrainflow.operators.tiles import by_tile


def counted(pdf):
    sizes = pdf.groupby(["site_id", "tile"]).size().reset_index(name="n")
    return sizes.assign(tiles=len(sizes))


def test_small_tiles_share_a_call_and_large_ones_stay_whole(spark):
    """Sites of 1 to 60 tiles of three rows, and one tile larger than a lot and than a batch."""
    rows = spark.range(60 * 60 * 3).selectExpr("id div 180 as site_id", "(id div 3) % 60 as tile", "id % 3 as x").where("tile <= site_id")
    rows = rows.unionByName(spark.range(25_000).selectExpr("99L as site_id", "0L as tile", "id as x")).coalesce(1)
    got = by_tile(rows, ["site_id", "tile"], counted, "site_id bigint, tile bigint, n bigint, tiles bigint", 500).collect()
    assert len(got) == 60 * 61 // 2 + 1
    assert all(r.n == (25_000 if r.site_id == 99 else 3) for r in got)
    assert max(r.tiles for r in got) > 50
    assert by_tile(rows.limit(0), ["site_id", "tile"], counted, "site_id bigint, tile bigint, n bigint, tiles bigint").count() == 0


def test_tiles_of_one_call_do_not_meet():
    """Tiles of different shapes solved at once have the levels that each has alone."""
    rng, parts = np.random.default_rng(3), []
    for site, (rows, cols) in enumerate([(7, 5), (1, 1), (4, 9), (2, 3)]):
        row, col = (a.ravel() for a in np.mgrid[0:rows, 0:cols])
        ring = (row == 0) | (col == 0) | (row == rows - 1) | (col == cols - 1)
        z = np.where(rng.random(rows * cols) < 0.1, np.nan, rng.random(rows * cols) * 10)
        parts.append(pd.DataFrame({"site_id": site, "tile_r": 0, "tile_c": 0, "row": row + 3 * site, "col": col, "elevation": z, "on_ring": ring, "level": np.nan, "halo": False, "solved": False}))
    solve = h._solve_tiles(1e-4)
    at_once = solve(pd.concat(parts, ignore_index=True))
    apart = pd.concat([solve(p) for p in parts], ignore_index=True)
    pd.testing.assert_frame_equal(at_once.reset_index(drop=True), apart)
    assert (at_once["level"] > at_once["elevation"]).any()


def test_tiles_of_a_union_of_joined_rows_are_whole(spark):
    """Both sides are dealt by the key already, in unlike amounts, as in the rounds of fill_depressions."""
    key = ["site_id", "tile"]
    rows = spark.range(200_000).selectExpr("id div 900 as site_id", "(id div 9) % 100 as tile", "id as x", "repeat(cast(id as string), 20) as pad")
    tiles = rows.select(*key).distinct()
    few = rows.where("x % 9 = 0").drop("pad").selectExpr("*", "'' as pad")
    both = rows.join(tiles.hint("merge"), key, "left_semi").unionByName(few.join(tiles.hint("merge"), key, "left_semi"))
    got = by_tile(both, key, counted, "site_id bigint, tile bigint, n bigint, tiles bigint")
    assert "Union" in got._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[1].split("Exchange hashpartitioning(struct")[1]
    assert got.count() == tiles.count()
