"""Nearest vectors by cells, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import nearest as module
from tidemark.operators.nearest import nearest

SCHEMA = "vec_id long, embedding array<double>, label string, cosine string, cell int"


def brute(rows, k, asked):
    """By query (id, group, vector) the list of (other id, cosine)."""
    fine = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    own = sorted({(i, g, tuple(v)) for i, v, g in rows if i is not None and g is not None and fine(v)})
    unit = {v: np.array(v) / max(map(abs, v)) for _, _, v in own}
    unit = {v: u / np.linalg.norm(u) for v, u in unit.items()}
    out = {}
    for i, g, v in own:
        if asked(i):
            near = [(j, float((unit[v] * unit[w]).sum())) for j, h, w in own if h == g and j != i and len(w) == len(v)]
            out[i, g, v] = sorted(near, key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def check(spark, rows, k, **more):
    df = spark.createDataFrame([(i, v, g, "x", 1) for i, v, g in rows], SCHEMA)
    got = nearest(df, F.col("vec_id") % 5 == 0, k, **more).collect()
    want = brute(rows, k, lambda i: i % 5 == 0)
    flat = sorted((i, j, round(c, 9), r) for (i, _, _), near in want.items() for r, (j, c) in enumerate(near, 1))
    assert sorted((r["vec_id"], r["other_id"], round(r["cosine"], 9), r["rank"]) for r in got) == flat
    return got


def clusters(seed, n, width, centres, spread):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, width))
    return [(i, (c[i % centres] + spread * rng.standard_normal(width)).tolist(), "ab"[i % 3 == 0]) for i in range(n)]


@pytest.mark.parametrize("k,pivots,room", [(3, 64, 1 << 19), (1, 3, 200), (10, 16, 1000), (400, 8, 1 << 19)])
def test_equals_all_pairs(spark, monkeypatch, k, pivots, room):
    """Clusters, vectors without any, and two lengths; one part a cell or many; more asked for than there are."""
    monkeypatch.setattr(module, "ROOM", room)
    rows = clusters(1, 250, 16, 12, 0.1) + [(i + 1000, v, g) for i, v, g in clusters(2, 120, 16, 120, 1.0)] + [(i + 2000, v, g) for i, v, g in clusters(3, 40, 3, 4, 0.2)]
    check(spark, rows, k, pivots=pivots)


def test_nulls_ties_repeats_and_odd_vectors(spark):
    v = [1.0, 2.0, -0.5]
    rows = [(i, v, "a") for i in range(12)] + [(5, v, "a")] * 20  # equal vectors: the smallest ids come first
    rows += [(20, [2.0, 4.0, -1.0], "a"), (21, [-1.0, 0.0, 0.0], "a"), (5, [-1.0, 0.5, 0.0], "a"), (25, [1e200, 1e200, 0.0], "a"), (30, [1e-200, 0.0, 0.0], "a")]
    rows += [(35, v, "alone"), (40, v, None), (None, v, "a"), (45, None, "a"), (50, [], "a"), (55, [0.0] * 3, "a"), (60, [None, 1.0, 2.0], "a"), (65, [float("nan"), 1.0, 1.0], "a"), (70, [float("inf"), 1.0, 1.0], "a"), (75, [1.0, 2.0], "a")]
    got = check(spark, rows, 3)
    assert not {r["vec_id"] for r in got} & {35, 40, 45, 50, 55, 60, 65, 70, 75}
    assert [r["other_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["vec_id"] == 10] == [0, 1, 2]


def test_empty_and_none_asked(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert nearest(df, F.lit(True)).count() == 0
    df = spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert nearest(df, F.lit(None).cast("boolean")).count() == 0
    assert [(r["vec_id"], r["other_id"], r["rank"]) for r in nearest(df, F.col("vec_id") == 2).collect()] == [(2, 1, 1)]


def test_a_length_that_no_pivot_has(spark, monkeypatch):
    """Its rows are one cell, cut into parts."""
    monkeypatch.setattr(module, "ROOM", 40)
    rows = clusters(4, 200, 6, 5, 0.2) + [(i + 500, v, g) for i, v, g in clusters(5, 60, 4, 3, 0.2)]
    monkeypatch.setattr(module, "_centres", lambda drawn, n, real=module._centres: {w: c for w, c in real(drawn, n).items() if w == 6})
    check(spark, rows, 4)


def test_cells_are_left_unvisited(spark):
    """Of tight clusters a query sees few rows; a hot group of copies adds k + 1 rows at most."""
    rows = clusters(6, 3000, 32, 30, 0.05)
    rows += [(10_000 + 5 * i, rows[7][1], "a") for i in range(1500)]
    got = nearest(spark.createDataFrame([(i, v, g, "x", 1) for i, v, g in rows], SCHEMA), F.col("vec_id") % 50 == 0, 3, pivots=64)
    seen = {r["vec_id"]: r["compared"] for r in got.collect()}
    label = {g: sum(h == g for _, _, h in rows[:3000]) for g in "ab"}
    assert len(seen) == sum(i % 50 == 0 for i, _, _ in rows)
    assert sum(seen[i] for i, _, _ in rows[:3000:50]) < 0.1 * sum(label[g] for _, _, g in rows[:3000:50])
    assert max(seen.values()) < 400


def test_no_join_of_all_pairs(spark, sf):
    from tidemark.plans.relational import nearest_in_cells

    plan = nearest_in_cells(spark, sf)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
