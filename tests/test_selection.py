"""Exact percentiles against numpy, with brackets small enough that several passes are needed."""

import random

import numpy as np
import pytest

from terrainflow.operators.selection import exact_quantiles

SHARES = (0.0, 0.01, 0.25, 0.5, 0.951, 1.0)


@pytest.mark.parametrize("most", [4, 10_000])
def test_percentiles_are_those_of_numpy(spark, most):
    rng = random.Random(8)
    groups = {
        1: [rng.gauss(0, 1) for _ in range(4000)],
        2: [float(rng.randrange(3)) for _ in range(3000)],  # ties
        3: [1e300, -1e300, 1e-300, 0.0] + [rng.random() * 1e-9 for _ in range(1000)],  # far apart
        4: [7.5],
        5: [2.0, 1.0],
        6: [5.0] * 2000,
        7: [float(k // 500) for k in range(2000)] + [-1.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [(1, None), (8, None)]
    rng.shuffle(rows)
    got = {r.site_id: list(r.q) for r in exact_quantiles(spark.createDataFrame(rows, "site_id int, z double"), "z", SHARES, most=most).collect()}
    assert sorted(got) == sorted(groups), "a group of nulls gives no row"
    for k, vs in groups.items():
        assert got[k] == pytest.approx(list(np.quantile(vs, SHARES)), rel=1e-12), k


def test_empty_tables_and_other_keys(spark):
    assert exact_quantiles(spark.createDataFrame([], "site_id int, z double"), "z", (0.5,)).count() == 0
    rows = spark.createDataFrame([("a", 1), ("a", 4), (None, 3)], "name string, z int")
    assert {r.name: r.q for r in exact_quantiles(rows.where("name is not null"), "z", (0.5,), by="name").collect()} == {"a": [2.5]}
