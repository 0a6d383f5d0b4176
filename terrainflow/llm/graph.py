"""Connected components of an edge table: blocks of edges are contracted where they lie, and large-star and small-star rounds join them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainflow.llm.common import shared_checkpoint

MAX_ROUNDS = 60
#: Edges of a node from which its minimum is sent to all tasks instead of its edges to one, and how many such nodes at most.
CROWDED, SENT = 50_000, 200_000
#: Edges for each partition of a checkpoint, and of a block that one task contracts at once.
PART = 100_000


def _contract(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges (a, b) -> edges (a, b) from each node to the smallest one that these edges reach from it."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(ids)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        up[max(x, y)] = min(x, y)
    root = np.array(up, np.int64)
    while (root[root] != root).any():
        root = root[root]
    far = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], names=["a", "b"])


def _contracted(block: int):
    def run(batches):
        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                if n and n + part.num_rows > block:
                    yield _contract(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
                    held, n = [], 0
                held.append([np.asarray(part.column(k)) for k in (0, 1)])
                n += part.num_rows
        if n:
            yield _contract(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))

    return run


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def _with_lowest(edges: DataFrame, lowest: DataFrame, size: int) -> DataFrame:
    """edges (a, b), `size` in all, joined with m of their a. Edges of a crowded node stay where they are.

    Crowded nodes are at most the edges divided by CROWDED; beyond SENT of them the plain join takes over.
    """
    crowded = lowest.where(F.col("n") > CROWDED).select("a", "m")
    found = crowded.limit(SENT + 1).count() if size > CROWDED else 0
    if not 0 < found <= SENT:
        return edges.join(lowest.select("a", "m"), "a")
    rest = edges.join(F.broadcast(crowded.select("a")), "a", "left_anti").join(lowest.where(F.col("n") <= CROWDED).select("a", "m"), "a")
    return edges.join(F.broadcast(crowded), "a").unionByName(rest)


def components(edges: DataFrame, part: int = PART) -> DataFrame:
    """edges (a, b), either way round -> (node, root): root is the smallest node that can be reached.

    Only nodes with an edge to another node are returned. Tasks contract blocks of `part` edges at most; what fits one
    block is done with that. Beyond it each round replaces the edges by edges to local minima: minima are pre-aggregated,
    and the edges of a node with very many are not gathered. No link is held on the driver; each round is cut by a checkpoint.
    """
    contract = lambda df, n: shared_checkpoint(df.coalesce(1 + n // part).mapInArrow(_contracted(part), "a bigint, b bigint"))
    edges = edges.where("a <> b").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    edges = shared_checkpoint(edges.mapInArrow(_contracted(part), "a bigint, b bigint"))
    n = edges.count()
    edges = contract(edges, n)
    state = _state(edges) if n >= part else (0, 0)  # less was one block
    for _ in range(MAX_ROUNDS if state[0] else 0):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = _with_lowest(both, lowest, 2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lowest, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
        edges = shared_checkpoint(small.distinct().coalesce(1 + state[0] // part))  # rounds never add edges
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
