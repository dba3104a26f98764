"""Operators on small inputs with ties, nulls, gaps and single rows."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine, json_long
from tidemark.operators import bars as B
from tidemark.operators.joins import asof_join, range_join, salted_join
from tidemark.operators.spans import added, framed, ranks, scanned
from tidemark.plans import timeseries
from tidemark.sources.tables import save, table


def at(minutes: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "b", 10), (4, "a", None), (5, None, 7), (6, "a", 0)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 1, 1.0), ("a", 5, 2.0), ("a", 5, 3.0), ("b", 11, 4.0), ("a", None, 9.0), (None, 6, 8.0)], "k string, at int, v double")
    assert rows(asof_join(left, right, "t", "at", ["k"], ["v"]).select("id", "v"), "id") == [(1, 3.0), (2, 3.0), (3, None), (4, None), (5, 8.0), (6, None)]
    assert rows(asof_join(left, right, "t", "at", ["k"], ["v"], strict=True).select("id", "v"), "id")[0] == (1, 1.0)


@pytest.mark.parametrize("how,want", [("inner", [(1, "x"), (2, "x"), (2, "y")]), ("left_anti", [(3,), (4,)]), ("left_semi", [(1,), (2,)])])
def test_range_join(spark, how, want):
    points = spark.createDataFrame([(1, -3.0), (2, 4.0), (3, 99.0), (4, None)], "id int, p double")
    ranges = spark.createDataFrame([("x", -5.0, 5.0), ("y", 3.5, 4.5), ("none", 4.0, 4.0)], "name string, low double, high double")
    got = range_join(points, ranges, "p", "low", "high", 2.0, how)
    assert rows(got.select("id", *(["name"] if how == "inner" else [])), "id", *(["name"] if how == "inner" else [])) == want


def test_salted_join_is_a_join(spark):
    large = spark.range(200).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k long, v string")
    assert rows(salted_join(large, small, ["k"], salts=5), "id", "v") == rows(large.join(small, "k"), "id", "v")


def ticks(spark, data):
    return spark.createDataFrame(data, "event_id long, event_type string, ts timestamp_ntz, value double")


def test_bars_ties_gaps_and_nulls(spark):
    data = [(2, "a", at(0), 2.0), (1, "a", at(0), 1.0), (3, "a", at(59), 5.0), (4, "a", at(200), 4.0), (5, "a", None, 9.0), (6, "b", at(5), 7.0)]
    made = B.bars(ticks(spark, data), "1 hour")
    assert rows(made, "event_type", "bar") == [("a", at(0), 1.0, 5.0, 1.0, 5.0, 3), ("a", at(180), 4.0, 4.0, 4.0, 4.0, 1), ("b", at(0), 7.0, 7.0, 7.0, 7.0, 1)]
    full = rows(B.filled(made, "1 hour").where("event_type = 'a'"), "bar")
    assert [r[1] for r in full] == [at(0), at(60), at(120), at(180)]
    assert full[1][2:] == (5.0, 5.0, 5.0, 5.0, 0)


def test_exponential(spark):
    made = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 4.0), ("b", 1, 3.0)], "event_type string, bar int, close double")
    assert rows(B.exponential(made, 0.5), "event_type", "bar") == [("a", 1, 1.0), ("a", 2, 1.5), ("a", 3, 2.75), ("b", 1, 3.0)]


def test_alignment_sees_no_future(spark):
    """Later ticks change no earlier row."""
    data = [(i, "a", at(17 * i), float(i * 7 % 13)) for i in range(300)]
    view = lambda d: {r["bar"]: r["coarse_close"] for r in B.aligned(B.bars(ticks(spark, d), "1 hour"), B.bars(ticks(spark, d), "1 day"), "1 day").collect()}
    cut = at(17 * 150)
    before, after = view(data), view([(i, k, t, -v if t >= cut else v) for i, k, t, v in data])
    assert all(before[b] == after[b] for b in before if b <= cut)
    assert any(v is not None for v in before.values()) and before[at(0)] is None


def test_vectors_and_json(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], '{"k": 3}'), ([0.0, 0.0], [1.0, 1.0], "{bad"), (None, [1.0], '{"j": 1}'), ([1.0], [1.0, 2.0], None)], "a array<double>, b array<double>, j string")
    got = [tuple(r) for r in df.select(cosine(F.col("a"), F.col("b")), json_long(F.col("j"), "$.k")).collect()]
    assert got[0] == (pytest.approx(0.5**0.5), 3)
    assert got[1:] == [(None, None), (None, None), (None, None)]


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "json"])
def test_tables_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "x", 1.5), (2, "a,b", None), (3, None, 2.0)], "id long, s string, v double")
    save(df, str(tmp_path), "t", kind)
    assert rows(table(spark, str(tmp_path), "t", kind, "id long, s string, v double"), "id") == rows(df, "id")
    with pytest.raises(ValueError):
        table(spark, str(tmp_path), "t", "xml")


def test_partitioned_table_prunes(spark, tmp_path, capsys):
    save(spark.range(10).withColumn("k", F.col("id") % 2), str(tmp_path), "t", by=["k"])
    found = table(spark, str(tmp_path), "t").where("k = 1")
    assert found.count() == 5
    found.explain("formatted")
    assert "PartitionFilters: [isnotnull(k" in capsys.readouterr().out


def test_empty_inputs(spark):
    none = ticks(spark, [])
    assert B.filled(B.bars(none, "1 hour"), "1 hour").count() == 0
    assert asof_join(none.drop("value"), none, "ts", "ts", ["event_type"], ["value"]).count() == 0
    assert B.exponential(B.bars(none, "1 hour"), 0.2).count() == 0


def test_asof_join_across_spans(spark):
    """The last right row is carried over many spans, with few rows or none of the right in them."""
    left = [(i, "ab"[i % 2], (i * 37) % 500 if i % 9 else None) for i in range(300)]
    right = [("ab"[i % 2], (i * 91) % 300, float(i)) for i in range(12)] + [("a", None, 5.0)]
    frames = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, at int, v double")
    for strict in (False, True):
        fits = lambda a, t: t is not None and a is not None and (a < t or a == t and not strict)
        want = [(i, max(((a, v) for k2, a, v in right if k2 == k and fits(a, t)), default=(0, None))[1]) for i, k, t in left]
        for span in (1, 7, 1e6):
            assert rows(asof_join(*frames, "t", "at", ["k"], ["v"], strict, span).select("id", "v"), "id") == want
    times = spark.createDataFrame([(1, at(0)), (2, at(60 * 24 * 9))], "id int, t timestamp_ntz")
    marks = spark.createDataFrame([(at(30), 7)], "at timestamp_ntz, v int")
    assert rows(asof_join(times, marks, "t", "at", [], ["v"]).select("id", "v"), "id") == [(1, None), (2, 7)]


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_exponential_across_spans_nulls_and_warm_up(spark, span):
    xs = [None if i in (0, 11, 12, 30) else float(i * 7 % 13) - 4 for i in range(40)]
    want, e = [], None
    for i, x in enumerate(xs):
        e = x if x is None or e is None else 0.3 * x + 0.7 * e
        want.append(e if i >= 4 else None)
    data = [(k, 2 * i, x) for k in ("a", None) for i, x in enumerate(xs)] + [("one", 5, 1.0)]
    made = spark.createDataFrame(data, "event_type string, bar int, close double")
    got = rows(B.exponential(made, 0.3, span=span, warm_up=5), "event_type", "bar")
    assert [r[2] for r in got] == [pytest.approx(w) for w in want] * 2 + [None]
    assert [r[1] for r in got[:40]] == [2 * i for i in range(40)]


def test_scan_of_arrays(spark):
    """Null, empty, shorter and longer than a block, with a state that can be null."""
    df = spark.createDataFrame([(0, None), (1, [])] + [(n, [None if i % 9 == 8 else i for i in range(n)]) for n in (2, 3, 4, 7, 25)], "n int, xs array<int>")
    got = dict(rows(df.select("n", scanned(F.col("xs"), F.lit(1), lambda s, x: F.coalesce(s + x, x), block=3)), "n"))
    for n in (2, 3, 4, 7, 25):
        want, s = [], 1
        for i in range(n):
            x = None if i % 9 == 8 else i
            s = x if x is None or s is None else s + x
            want.append(s)
        assert got[n] == want
    assert got[0] is None and got[1] == []


def test_exponential_of_a_long_span_is_linear(spark):
    """A span of 60,000 rows, which took minutes while each row copied all before it."""
    made = spark.range(60_000).selectExpr("'a' AS event_type", "id AS bar", "double(id % 10) AS close")
    began = time.perf_counter()
    assert B.exponential(made, 0.5, span=1e9).count() == B.exponential(made, 0.5, span=1e9).where("ema BETWEEN 0 AND 9").count() == 60_000
    assert time.perf_counter() - began < 40


def replayed(data, moves, start=0):
    """Brute force: rows (key, at, x) in order of at and moves."""
    out = []
    for key in {k for k, _, _ in data}:
        s = start
        for _, a, to in sorted(((a is not None, a if a is not None else 0, tuple(moves(x))) for k, a, x in data if k == key)):
            s = to[s] if to[s] in range(len(to)) else s
            out.append((key, a if _ else None, s))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [1, 10, 1e9])
def test_positions_across_spans(spark, span):
    """Ties, rows without an order, a null key, null moves and moves to no state."""
    data = [(("a", "b", None)[i % 3] if i % 2 else "a", (i * 37) % 90 if i % 17 else None, i * 11 % 13) for i in range(200)]
    df = spark.createDataFrame(data, "event_type string, bar int, x int")
    moves = [F.when(F.col("x") > 8, 1).when(F.col("x") == 3, 7).otherwise(0), F.when(F.col("x") < 2, 2).when(F.col("x") < 5, 0).otherwise(1), F.when(F.col("x") == 6, 0)]
    python = lambda x: (1 if x > 8 else 0, 2 if x < 2 else 0 if x < 5 else 1, 0 if x == 6 else 2)
    got = sorted(map(tuple, B.positions(df, moves, span=span).collect()), key=str)
    assert got == replayed(data, python)
    assert sorted(map(tuple, B.positions(df, moves, start=2, span=span).collect()), key=str) == replayed(data, python, 2)
    assert B.positions(df.limit(0), moves, span=span).count() == 0
    with pytest.raises(ValueError):
        B.positions(df, moves, start=3)


def test_positions_do_not_look_ahead(spark, sf, tmp_path):
    """What events come later changes no state that is known before."""
    whole = {(r["event_type"], r["bar"]): r["state"] for r in timeseries.bars_strategy(spark, sf).collect()}
    cut = sorted(b for _, b in whole)[len(whole) // 2]
    spark.read.parquet(f"{sf}/events.parquet").where(F.col("ts") < F.lit(cut)).write.parquet(f"{tmp_path}/events.parquet")
    early = {(r["event_type"], r["bar"]): r["state"] for r in timeseries.bars_strategy(spark, str(tmp_path)).collect()}
    assert early and early == {k: s for k, s in whole.items() if k[1] < cut}
    assert set(whole.values()) == {0, 1, 2}


@pytest.mark.parametrize("width", [0.5, 1e9])
def test_ranks_with_ties_nulls_and_nan(spark, width):
    """As Spark's own windows give them, where a key has few rows, a hot value, nulls or NaN."""
    data = [(i, "a" if i % 5 else None, [1.0, 1.0, 1.0, None, float("nan"), i / 7, -float(i)][i % 7]) for i in range(120)] + [(500, "one", 3.0), (501, "two", None), (502, "two", 2.0)]
    df = spark.createDataFrame(data, "id long, k string, v double")
    w, unique = Window.partitionBy("k").orderBy("v"), Window.partitionBy("k").orderBy("v", "id")
    want = df.select("k", "id", F.rank().over(w), F.dense_rank().over(w), F.ntile(4).over(unique), F.percent_rank().over(w), F.cume_dist().over(w))
    got = ranks(df, "k", "v", "id", tiles=4, width=width, tie_width=10)
    assert rows(got.select("k", "id", "r", "d", "quarter", "p", "c"), "id") == rows(want, "id")
    assert ranks(df.limit(0), "k", "v", "id", 4, width, 10).count() == 0


@pytest.mark.parametrize("width", [3, 10, 10_000])
def test_frames_across_spans(spark, width, capsys):
    """As a plain window gives them: one key with most rows, ties, nulls, a reach over many spans; a plan by key and span."""
    data = [(i, "a" if i % 9 else None, (i * 37) % 200 if i % 11 else None, float(i % 13) if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(data, "id int, k string, t int, v double")
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-25, 0)
    sums = {"n": F.count("*"), "s": F.sum("v"), "m": F.max("v"), "v": F.min("v")}
    want = rows(df.select("id", *[c.over(w).alias(n) for n, c in sums.items()]), "id")
    got = framed(df, ["k"], "t", 25, sums, width)
    assert got.columns == ["id", "k", "t", "n", "s", "m", "v"] and rows(got.select("id", *sums), "id") == want
    got.explain()
    assert "hashpartitioning(k#" in (plan := capsys.readouterr().out) and ", _tm_span#" in plan
    assert framed(df.limit(0), ["k"], "t", 25, sums, width).count() == 0


def test_frames_of_times(spark):
    data = [(i, at(i * 7.3) + dt.timedelta(microseconds=i % 3)) for i in range(300)]
    for kind in ("timestamp_ntz", "timestamp"):
        df = spark.createDataFrame(data, "id int, t timestamp_ntz").withColumn("t", F.col("t").cast(kind))
        got = rows(framed(df, [], "t", 3600, {"n": F.count("*")}, 3600).select("id", "n"), "id")
        assert got == [(i, sum(x - dt.timedelta(hours=1) <= y <= x for _, y in data)) for i, x in data]
    with pytest.raises(ValueError):
        framed(df.withColumn("t", F.lit(1.0)), [], "t", 1, {"n": F.count("*")}, 1)


@pytest.mark.parametrize("reach", [1, 25, 10_000])
def test_frames_by_running_aggregates(spark, sf, reach, capsys):
    """The same as a plain window, negative times too, and no frame that slides over all its rows for each row."""
    data = [(i, "a" if i % 9 else None, (i * 37) % 200 - 90 if i % 11 else None, (float(i % 13) if i % 17 else float("nan")) if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(data, "id int, k string, t int, v double")
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-reach, 0)
    sums = {"n": F.count("*"), "s": F.sum(F.nanvl("v", F.lit(50.0))), "m": F.max("v"), "v": F.min("v")}
    want = rows(df.select("id", *[c.over(w).alias(n) for n, c in sums.items()]), "id")
    got = framed(df, ["k"], "t", reach, sums, 10, {"n": added, "s": added, "m": F.greatest, "v": F.least})
    assert got.columns == ["id", "k", "t", "n", "s", "m", "v"] and str(rows(got.select("id", *sums), "id")) == str(want)
    assert framed(df.limit(0), ["k"], "t", reach, sums, 10, {"n": added, "s": added, "m": F.greatest, "v": F.least}).count() == 0
    with pytest.raises(ValueError, match="all aggregates"):
        framed(df, ["k"], "t", reach, sums, 10, {"n": added})
    timeseries.window_frames(spark, sf).explain()
    assert "RangeFrame, unboundedpreceding" in (plan := capsys.readouterr().out) and "RangeFrame, -" not in plan
