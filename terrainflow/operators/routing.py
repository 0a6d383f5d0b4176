"""Routing on a border graph: tiles are solved in one vectorised pass each and meet on the few cells where flow enters them.

Inside a tile, pointers are doubled in memory. Between tiles, an entry (a cell that another tile drains to) leads to the
entry that its way through the tile ends at. Those entries are a graph of their own, some cells of a tile's border, and only
they are joined round by round; a second pass brings what they say back to all cells. The cells themselves are shuffled
twice, whatever the length of a path, and not at all where a site is one tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrainflow.operators.iterate import cut_lineage
from terrainflow.operators.stencil import OFFSETS
from terrainflow.operators.tiles import by_tile, tile_starts

#: Cells on a side of a tile; where only flat indices are known, as many cells in a row as a tile has.
TILE = 256
#: Kinds of rows of a tile: its cells, where flow enters it, where flow leaves it.
CELL, ENTRY, EXIT = 0, 1, 2
_ROWS = "site_id bigint, block bigint, kind int, cell bigint, target bigint, amount double, way double, last bigint"
TILE_KEY = ("site_id", "block")
_COLUMNS = [part.split()[0] for part in _ROWS.split(", ")]


def _local(cell: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each cell's target in the tile (-1: none), and of the last cell of its way through it (-1: into a cycle)."""
    order = np.argsort(cell, kind="stable")
    at = np.minimum(np.searchsorted(cell[order], down), len(cell) - 1)
    at = order[at]
    following = np.where((down >= 0) & (cell[at] == down), at, -1)
    last = np.where(following < 0, np.arange(len(cell)), following)
    for _ in range(len(cell).bit_length() + 1):
        last = last[last]
    return following, np.where(following[last] < 0, last, -1)


def _upstream(following: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of `own` over each cell and all that lead to it, and which cells lie on a cycle (their sums say nothing)."""
    total, ptr, n = own.astype(float), following.copy(), len(own)
    for _ in range(n.bit_length() + 1):
        live = ptr >= 0
        if not live.any():
            return total, np.zeros(n, bool)
        total += np.bincount(ptr[live], weights=total[live], minlength=n)
        ptr = np.where(live, ptr[ptr], -1)
    cycle = np.zeros(n, bool)
    cycle[ptr[ptr >= 0]] = True
    return total, cycle


def _downstream(following: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sum of `own` over each cell and all that it leads to in the tile."""
    total, ptr = own.astype(float), following.copy()
    for _ in range(len(own).bit_length() + 1):
        live = ptr >= 0
        if not live.any():
            break
        total += np.where(live, total[ptr], 0)
        ptr = np.where(live, ptr[ptr], -1)
    return total


def _apart(pdf: pd.DataFrame) -> pd.DataFrame:
    """Adds key, a number for each cell of each tile in the rows, and key_down, that of its target in its own tile (-1: none)."""
    start = tile_starts(pdf, TILE_KEY)
    tile = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(pdf))))
    cell, down = pdf["cell"].to_numpy(np.int64), pdf["target"].fillna(-1).to_numpy(np.int64)
    span = max(cell.max(), down.max()) + 1
    return pdf.assign(key=tile * span + cell, key_down=np.where(down >= 0, tile * span + down, -1))


def _border(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entries of tiles with the entry or the cell that their way ends at, and exits with the cells that leave there."""
    pdf = _apart(pdf)
    own = pdf[pdf["kind"] == CELL]
    cell, down = own["cell"].to_numpy(np.int64), own["target"].to_numpy(np.int64)
    if not len(cell):
        return pd.DataFrame({name: [] for name in _COLUMNS})
    key = own["key"].to_numpy()
    following, last = _local(key, own["key_down"].to_numpy())
    leaves = (own["leaves"].to_numpy(bool)) & (following < 0)
    amount, _ = _upstream(following, np.ones(len(cell)))
    way = _downstream(following, own["way"].to_numpy(float))
    order = np.argsort(key)
    asked = np.unique(pdf.loc[pdf["kind"] == ENTRY, "key"].to_numpy())
    at = order[np.minimum(np.searchsorted(key[order], asked), len(key) - 1)]
    at = at[key[at] == asked]
    end = last[at]
    out = np.flatnonzero(leaves)
    goes = (end >= 0) & leaves[end]
    entries = pd.DataFrame({"kind": ENTRY, "cell": cell[at], "target": pd.array(np.where(goes, down[end], 0), "Int64"), "amount": 0.0, "way": way[at], "last": pd.array(cell[end], "Int64")})
    entries.loc[~goes, "target"] = pd.NA
    entries.loc[end < 0, "last"] = pd.NA
    exits = pd.DataFrame({"kind": EXIT, "cell": cell[out], "target": pd.array(down[out], "Int64"), "amount": amount[out], "way": 0.0, "last": pd.array(cell[out], "Int64")})
    result = pd.concat([entries, exits])
    of = np.concatenate([at, out])
    result.insert(0, "block", own["block"].to_numpy()[of])
    result.insert(0, "site_id", own["site_id"].to_numpy()[of])
    return result


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    """All cells of tiles with accumulation, outlet and the sum of `way` down to the outlet; null where cycles rule."""
    pdf = _apart(pdf)
    own = pdf[pdf["kind"] == CELL]
    cell, key = own["cell"].to_numpy(np.int64), own["key"].to_numpy()
    if not len(cell):
        return pd.DataFrame({"site_id": [], "cell": [], "accumulation": [], "outlet": [], "way": []})
    following, last = _local(key, own["key_down"].to_numpy())
    order = np.argsort(key)
    weight, ends, ahead, on_cycle = np.ones(len(cell)), cell.copy(), np.zeros(len(cell)), np.zeros(len(cell))
    lost = np.zeros(len(cell), bool)
    for kind in (ENTRY, EXIT):
        told = pdf[pdf["kind"] == kind]
        at = order[np.searchsorted(key[order], told["key"].to_numpy())]
        if kind == ENTRY:
            amount = told["amount"].to_numpy(float)
            weight[at] += np.nan_to_num(amount)
            on_cycle[at] = np.isnan(amount)
        else:
            lost[at] = told["last"].isna()
            ends[at] = told["last"].fillna(-1).to_numpy(np.int64)
            ahead[at] = told["way"].fillna(0).to_numpy(float)
    total, cycle = _upstream(following, weight)
    if on_cycle.any():
        cycle |= _upstream(following, on_cycle)[0] > 0
    way = _downstream(following, own["way"].to_numpy(float)) + ahead[last]
    none = (last < 0) | lost[last]
    return pd.DataFrame({"site_id": own["site_id"].to_numpy(), "cell": cell, "accumulation": pd.array(np.where(cycle, np.nan, total)), "outlet": pd.array(np.where(none, 0, ends[last]), "Int64").copy(), "way": np.where(none, np.nan, way)}).assign(outlet=lambda d: d["outlet"].mask(none))


def _graph(border: DataFrame) -> DataFrame:
    """Entries and exits -> the entries (site_id, cell) with amount (what enters there; null on a cycle), last (null into one), way.

    Pointer doubling on the entries alone: amounts go down, ways and ends come up.
    """
    entries = border.where(F.col("kind") == ENTRY)
    there = entries.select("site_id", F.col("cell").alias("target"), F.lit(True).alias("_there"))
    enters = border.where(F.col("kind") == EXIT).groupBy("site_id", F.col("target").alias("cell")).agg(F.sum("amount").alias("enters"))
    # A target that is no valid cell ends the way at the last cell before it.
    state = entries.join(there, ["site_id", "target"], "left").join(enters, ["site_id", "cell"], "left")
    state = cut_lineage(state.select("site_id", "cell", F.when(F.col("_there"), F.col("target")).alias("ptr"), F.coalesce("enters", F.lit(0.0)).alias("amount"), "last", "way"))
    rounds = state.count().bit_length() + 1
    for _ in range(rounds):
        if state.where("ptr is not null").isEmpty():
            break
        gain = state.where("ptr is not null").groupBy("site_id", F.col("ptr").alias("cell")).agg(F.sum("amount").alias("gain"))
        jump = state.select("site_id", F.col("cell").alias("ptr"), F.col("ptr").alias("next"), F.col("last").alias("_last"), F.col("way").alias("_way"))
        moved = state.join(gain, ["site_id", "cell"], "left").join(jump, ["site_id", "ptr"], "left")
        far = F.col("ptr").isNotNull()
        state = cut_lineage(moved.select("site_id", "cell", F.col("next").alias("ptr"), (F.col("amount") + F.coalesce("gain", F.lit(0.0))).alias("amount"), F.when(far, F.col("_last")).otherwise(F.col("last")).alias("last"), (F.col("way") + F.coalesce("_way", F.lit(0.0))).alias("way")))
    on_cycle = state.where("ptr is not null").select("site_id", F.col("ptr").alias("cell")).distinct().withColumn("_cycle", F.lit(True))
    out = state.join(on_cycle, ["site_id", "cell"], "left")
    return out.select("site_id", "cell", F.when(F.col("_cycle").isNull(), F.col("amount")).alias("amount"), F.when(F.col("ptr").isNull(), F.col("last")).alias("last"), "way")


def _blocks(flow: DataFrame, tile: int) -> tuple[Column, Column]:
    """The tile of a cell and that of its target."""
    if not {"row", "col", "flow_dir"} <= set(flow.columns):
        block = lambda c: F.floor(F.col(c) / (tile * tile))
        return block("cell"), block("downstream")
    steps = [F.element_at(F.array(*[F.lit(o[k]) for o in OFFSETS]), F.greatest(F.col("flow_dir"), F.lit(0)).cast("int") + 1) for k in (0, 1)]
    block = lambda r, c: F.floor(r / tile) * (1 << 31) + F.floor(c / tile)
    return block(F.col("row"), F.col("col")), block(F.col("row") + steps[0], F.col("col") + steps[1])


def route(flow: DataFrame, column: str = "elevation", tile: int = TILE, way: Column | None = None) -> DataFrame:
    """D8 cells -> site_id, cell, accumulation, outlet, way for every valid cell.

    accumulation: valid cells that drain through the cell, itself included; null for the cells of a cycle. outlet: the terminal
    cell that it drains to; null on the way into a cycle. way: sum of the column `way` over the cells from it to its outlet.
    A target that is no valid cell ends the flow. flow is read two times, so it should be a table or a checkpoint.
    """
    block, to = _blocks(flow, tile)
    cells = flow.where(F.col(column).isNotNull()).select(
        F.col("site_id").cast("bigint").alias("site_id"),
        block.cast("bigint").alias("block"),
        F.lit(CELL).alias("kind"),
        F.col("cell").cast("bigint").alias("cell"),
        F.col("downstream").cast("bigint").alias("target"),
        F.lit(None).cast("double").alias("amount"),
        (F.lit(0.0) if way is None else way.cast("double")).alias("way"),
        F.lit(None).cast("bigint").alias("last"),
        ((F.col("downstream") >= 0) & (block != to)).alias("leaves"),
        to.cast("bigint").alias("to"),
    )
    work = cells.drop("leaves", "to")
    if not cells.where("leaves").isEmpty():
        asked = cells.where("leaves").groupBy("site_id", F.col("to").alias("block"), F.col("target").alias("cell")).agg(F.lit(ENTRY).alias("kind"))
        border = cells.drop("to").unionByName(asked, allowMissingColumns=True)
        border = cut_lineage(by_tile(border, TILE_KEY, _border, _ROWS))
        graph = cut_lineage(_graph(border))
        where = border.where(F.col("kind") == ENTRY).select("site_id", "block", "cell")
        entries = where.join(graph, ["site_id", "cell"]).select("site_id", "block", F.lit(ENTRY).alias("kind"), "cell", "amount")
        target = graph.select("site_id", F.col("cell").alias("target"), F.col("last").alias("_last"), F.col("way").alias("_way"), F.lit(True).alias("_there"))
        exits = border.where(F.col("kind") == EXIT).join(target, ["site_id", "target"], "left")
        exits = exits.select("site_id", "block", "kind", "cell", F.when(F.col("_there"), F.col("_last")).otherwise(F.col("cell")).alias("last"), F.coalesce("_way", F.lit(0.0)).alias("way"))
        work = work.unionByName(entries, allowMissingColumns=True).unionByName(exits, allowMissingColumns=True)
    out = by_tile(work, TILE_KEY, _finish, "site_id bigint, cell bigint, accumulation double, outlet bigint, way double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("accumulation", "way")})


def flow_labels(flow: DataFrame, column: str = "elevation", tile: int = TILE, routed: DataFrame | None = None) -> DataFrame:
    """D8 cells -> site_id, cell, outlet, first, last: pre-order numbers of the tree of each outlet.

    The cells that drain through a cell have the numbers from its own, `first`, to its `last`: children stand one after
    another behind their parent, each with as many numbers as cells drain through it. Null on the way into a cycle.
    routed: what `route` gave for these cells, if a caller has it (a table or a checkpoint).
    """
    if routed is None:
        routed = cut_lineage(route(flow, column, tile).select("site_id", "cell", "accumulation", "outlet"))
    routed = routed.select("site_id", "cell", "accumulation", "outlet")
    each = flow.where(F.col(column).isNotNull()).join(routed.hint("merge"), ["site_id", "cell"])
    siblings = Window.partitionBy("site_id", "downstream").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # eight at most
    under = (F.col("cell") != F.col("outlet")) & F.col("accumulation").isNotNull()
    before = F.coalesce(F.sum("accumulation").over(siblings), F.lit(0.0))
    parted = each.where(under).withColumn("_way", before + 1)
    each = cut_lineage(parted.unionByName(each.where(~F.coalesce(under, F.lit(False))).withColumn("_way", F.lit(0.0))))
    way = route(each, column, tile, F.col("_way")).select("site_id", "cell", "way")
    told = each.select("site_id", "cell", "outlet", "accumulation").join(way.hint("merge"), ["site_id", "cell"])
    return told.select("site_id", "cell", "outlet", F.when(F.col("outlet").isNotNull(), F.col("way")).cast("bigint").alias("first"), (F.col("way") + F.col("accumulation") - 1).cast("bigint").alias("last"))
