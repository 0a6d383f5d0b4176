"""Grid stencils: dense grids, neighbours, slope. Windows are keyed by (site, row) and (site, column), never by site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Offsets (row, column) of the directions 0 to 7, clockwise from north.
OFFSETS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
DIAGONAL = 2.0**0.5
DISTANCES = tuple(DIAGONAL if r and c else 1.0 for r, c in OFFSETS)


def clean_elevation(cells: DataFrame, column: str = "elevation", nodata: float | None = None) -> DataFrame:
    """NaN, infinities and the nodata value become null, once, at ingest."""
    z = F.col(column).cast("double")
    bad = F.isnan(z) | (F.abs(z) == float("inf"))
    if nodata is not None:
        bad = bad | (z == nodata)
    return cells.withColumn(column, F.when(~bad, z))


def dense_grid(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Every (row, col) of every site; cells that the table lacks have null values.

    The join asks for a merge: the planner takes the exploded cells for as many rows as meta has and would broadcast them.
    """
    grid = meta.select("site_id", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    grid = grid.select("site_id", "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    return grid.hint("merge").join(cells, ["site_id", "row", "col"], "left")


def with_ring(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Adds on_ring: the first or last row or column of the grid, whatever the data there. Meta rows are few (one a site)."""
    ends = meta.select("site_id", (F.col("rows") - 1).alias("_r"), (F.col("cols") - 1).alias("_c"))
    return cells.join(ends, "site_id").withColumn("on_ring", (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == F.col("_r")) | (F.col("col") == F.col("_c"))).drop("_r", "_c")


def with_neighbours(cells: DataFrame, column: str = "elevation", prefix: str = "n") -> DataFrame:
    """Adds n0 to n7, the value of the cell in each direction (null: outside, no data). Needs a dense grid.

    A window along the row joins west, own and east to one struct; one along the column fetches that of the rows above
    and below. So two shuffles bring all eight.
    """
    along = Window.partitionBy("site_id", "row").orderBy("col")
    across = Window.partitionBy("site_id", "col").orderBy("row")
    three = F.struct(F.lag(column).over(along).alias("w"), F.col(column).alias("c"), F.lead(column).over(along).alias("e"))
    out = cells.withColumn("_m", three)
    out = out.withColumns({"_u": F.lag("_m").over(across), "_d": F.lead("_m").over(across)})
    part = {(-1, 0): "_u.c", (-1, 1): "_u.e", (0, 1): "_m.e", (1, 1): "_d.e", (1, 0): "_d.c", (1, -1): "_d.w", (0, -1): "_m.w", (-1, -1): "_u.w"}
    return out.withColumns({f"{prefix}{k}": F.col(part[o]) for k, o in enumerate(OFFSETS)}).drop("_m", "_u", "_d")


def lowest_neighbour(prefix: str = "n") -> Column:
    """Least value of the eight; null where there is none."""
    return F.least(*[F.col(f"{prefix}{k}") for k in range(8)])


def with_slope(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Adds gradient and slope (degrees): central differences inside, one-sided at the edges of the grid.

    A missing neighbour that the difference needs makes both null, and so does a grid of one row or column.
    """
    along = Window.partitionBy("site_id", "row").orderBy("col")
    across = Window.partitionBy("site_id", "col").orderBy("row")
    z, res = F.col("elevation"), F.col("_res")
    cells = cells.join(meta.select("site_id", F.col("rows").alias("_rows"), F.col("cols").alias("_cols"), F.col("resolution_m").alias("_res")), "site_id")

    def difference(before, after, place, size):
        inner = (after - before) / (2 * res)
        return F.when(size < 2, F.lit(None)).when(place == 0, (after - z) / res).when(place == size - 1, (z - before) / res).otherwise(inner)

    out = cells.withColumn("_gx", difference(F.lag("elevation").over(along), F.lead("elevation").over(along), F.col("col"), F.col("_cols")))
    out = out.withColumn("_gy", difference(F.lag("elevation").over(across), F.lead("elevation").over(across), F.col("row"), F.col("_rows")))
    gradient = F.when(z.isNotNull(), F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")))
    out = out.withColumn("gradient", gradient).withColumn("slope", F.degrees(F.atan("gradient")))
    return out.drop("_gx", "_gy", "_rows", "_cols", "_res")


def valid_mask() -> Column:
    """Elevation, slope and gradient are all there."""
    return F.col("elevation").isNotNull() & F.col("slope").isNotNull() & F.col("gradient").isNotNull()
