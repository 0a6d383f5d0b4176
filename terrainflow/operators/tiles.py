"""Tiles in tasks: rows are dealt and sorted by tile, and a call gets many whole tiles at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a call: as many whole tiles as reach this number, or one tile alone where it is larger.
LOT = 65_536


def tile_starts(pdf: pd.DataFrame, key: Sequence[str]) -> np.ndarray:
    """The first row of each tile in rows that are sorted by tile."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for name in key:
        column = pdf[name].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def by_tile(rows: DataFrame, key: Sequence[str], solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str, lot: int = LOT) -> DataFrame:
    """`solve` over whole tiles, which it may get any number of in one frame, sorted by key.

    A call for each tile costs more than a small tile's work; so a task hands on the tiles it has as soon as their rows reach
    `lot`, and keeps back the last, which may go on. A task holds `lot` rows, a batch and one tile, whatever its share.

    Rows are dealt by a struct of the key: a union of inputs that are dealt by the key's columns already counts as dealt by them,
    so Spark leaves out the shuffle, while its inputs are coalesced apart and a tile can end up in two tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, wanted = 0, lot
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < wanted:
                continue
            pdf = pd.concat(held, ignore_index=True)
            cut = tile_starts(pdf, key)[-1] if len(pdf) else 0
            if cut:
                yield solve(pdf.iloc[:cut])
            held, size = [pdf.iloc[cut:]], len(pdf) - cut
            wanted = max(lot, 2 * size)
        if size:
            yield solve(pd.concat(held, ignore_index=True))

    return rows.repartition(F.struct(*key)).sortWithinPartitions(*key).mapInPandas(run, schema)
