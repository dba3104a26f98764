"""Interval joins, and joins with clashing names, hot keys and odd ends, against brute force."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dominance
from tidemark.operators.dominance import dominated
from tidemark.operators.intervals import interval_join
from tidemark.operators.joins import asof_join, range_join, salted_join

NAN, INF = float("nan"), float("inf")


def ranges(rng, n, hot=False):
    rows = []
    for i in range(n):
        low = rng.choice([rng.uniform(0, 100), float(rng.randint(0, 20)), rng.uniform(50, 50.5) if hot else 3.0])
        rows.append((i, rng.choice("aab") if i % 9 else None, low, low + rng.choice([0.0, -1.0, 0.3, 2.0, 5.0, 40.0, 1e4])))
    return [*rows, (n, "a", None, 3.0), (n + 1, "a", 1.0, None), (n + 2, "a", NAN, 5.0), (n + 3, "a", 1.0, NAN), (n + 4, "a", -INF, INF), (n + 5, "b", 7.0, INF), (n + 5, "b", 7.0, INF), (n + 6, "a", -1e300, 1e300)]


def overlap(a, b, c, d):
    fine = lambda x, y: x is not None and y is not None and x == x and y == y and x < y
    return fine(a, b) and fine(c, d) and a < d and c < b


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("by,width", [((), 1.0), (("k",), 3.0)])
def test_interval_join_against_brute_force(spark, how, by, width):
    """Ties, nulls, NaN, empty and endless ranges, repeated rows, one range over everything."""
    rng = random.Random(1)
    left, right = ranges(rng, 120, hot=True), ranges(rng, 90)
    a = spark.createDataFrame(left, "id int, k string, low double, high double")
    b = spark.createDataFrame(right, "other int, k string, c double, d double")
    b = b if by else b.drop("k")
    got = interval_join(a, b, ("low", "high"), ("c", "d"), width, by, how)
    want = Counter()
    for i, k, low, high in left:
        own = [o for o, k2, c, d in right if overlap(low, high, c, d) and (not by or k is not None and k == k2)]
        want.update({"inner": [(i, o) for o in own], "left": [(i, o) for o in own] or [(i, None)], "left_semi": [(i,)] if own else [], "left_anti": [] if own else [(i,)]}[how])
    assert Counter(tuple(r) for r in got.select("id", *(["other"] if how in ("inner", "left") else [])).collect()) == want
    assert got.columns == a.columns + ([c for c in b.columns if c != "k"] if how in ("inner", "left") else [])


def test_interval_join_of_times_dates_and_numbers(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(minutes=17 * i), day + dt.timedelta(minutes=17 * i + (5 if i else 100_000))) for i in range(200)]
    a = spark.createDataFrame(rows, "id int, low timestamp_ntz, high timestamp_ntz")
    b = spark.createDataFrame([(i, x + dt.timedelta(minutes=4), y) for i, x, y in rows], "other int, c timestamp_ntz, d timestamp_ntz")
    want = {(i, o) for i, x, y in rows for o, c, d in ((o, c + dt.timedelta(minutes=4), d) for o, c, d in rows) if x < d and c < y}
    for cast in ("timestamp_ntz", "timestamp"):
        left, right = (f.withColumns({c: F.col(c).cast(cast) for c in f.columns[1:]}) for f in (a, b))
        assert {(r["id"], r["other"]) for r in interval_join(left, right, ("low", "high"), ("c", "d"), 300).select("id", "other").collect()} == want
    dates = spark.sql("SELECT id, date'2024-01-01' + cast(id AS int) AS low, date'2024-01-02' + cast(id AS int) AS high, cast(id AS decimal(9, 2)) AS c, id + 1 AS d FROM range(5)")
    assert interval_join(dates.select("low", "high"), dates.select(F.col("low").alias("c"), F.col("high").alias("d")), ("low", "high"), ("c", "d"), 86400).count() == 5
    assert interval_join(dates.select("c", "d"), dates.select(F.col("id").alias("e"), F.col("d").alias("f")), ("c", "d"), ("e", "f"), 1).count() == 5


def test_interval_join_is_an_equal_join_and_says_what_clashes(spark, capsys):
    a = spark.createDataFrame([(1, 0.0, 1.0)], "id int, low double, high double")
    b = spark.createDataFrame([(1, 0.0, 1.0)], "other int, c double, d double")
    interval_join(a, b, ("low", "high"), ("c", "d"), 1.0).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for bad in ({"how": "full"}, {"by": ()}):
        with pytest.raises(ValueError):
            interval_join(a, b.withColumn("id", F.lit(1)), ("low", "high"), ("c", "d"), 1.0, **bad)
    with pytest.raises(ValueError):
        interval_join(a.withColumn("low", F.lit("x")), b, ("low", "high"), ("c", "d"), 1.0)
    assert interval_join(a.limit(0), b, ("low", "high"), ("c", "d"), 1.0).count() == interval_join(a, b.limit(0), ("low", "high"), ("c", "d"), 1.0).count() == 0
    assert interval_join(a, b.limit(0), ("low", "high"), ("c", "d"), 1.0, how="left").collect()[0]["other"] is None


def test_a_long_range_has_few_copies(spark):
    """As many as there are levels, not as its length over the width."""
    from tidemark.operators import intervals

    rows = spark.createDataFrame([(1, 0.0, 1e12), (2, 0.0, 0.5)], "id int, low double, high double").withColumns({"_low": F.col("low"), "_high": F.col("high")})
    spread = intervals._spread(intervals._levelled(rows, ("low", "high"), 1.0), [0, 3, 9, 14], 1.0)
    assert spread.count() <= 2 * 6


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_range_join_with_odd_ends(spark, how):
    """Null, NaN and infinite points and ends, and ranges of all lengths."""
    rng = random.Random(2)
    points = [(i, rng.choice([rng.uniform(0, 100), float(rng.randint(0, 20))])) for i in range(150)] + [(200, None), (201, NAN), (202, INF), (203, -INF), (204, 1e300), (200, None)]
    held = ranges(rng, 60)
    got = range_join(spark.createDataFrame(points, "id int, p double"), spark.createDataFrame(held, "name int, k string, low double, high double").drop("k"), "p", "low", "high", 2.0, how)
    want = Counter()
    for i, p in points:
        own = [n for n, _, low, high in held if p is not None and p == p and overlap(low, high, low, high) and low <= p < high]
        want.update({"inner": [(i, n) for n in own], "left": [(i, n) for n in own] or [(i, None)], "left_semi": [(i,)] if own else [], "left_anti": [] if own else [(i,)]}[how])
    assert Counter(tuple(r) for r in got.select("id", *(["name"] if how in ("inner", "left") else [])).collect()) == want


def test_clashing_names_are_an_error(spark):
    a = spark.createDataFrame([(1, 2, 3.0)], "t int, v int, p double")
    with pytest.raises(ValueError, match="v"):
        asof_join(a, a, "t", "t", [], ["v"])
    with pytest.raises(ValueError, match="v"):
        range_join(a, a.withColumn("low", F.lit(0.0)), "p", "low", "p", 1.0)


def test_equal_rows_of_a_hot_key_go_to_all_salts(spark):
    large = spark.createDataFrame([(1, "x")] * 1000, "k long, v string").coalesce(1)
    got = salted_join(large, spark.createDataFrame([(1, "small")], "k long, w string"), ["k"], salts=8)
    assert got.count() == 1000 and got.columns == ["k", "v", "w"]
    salts = spark.read.parquet(next(f for f in got.inputFiles() if "salted" in f)).groupBy("_salt").count().collect()
    assert sorted(r["count"] for r in salts) == [125] * 8


def test_dominance_against_brute_force(spark, capsys):
    """One key with most rows, ties in both orders, nulls, NaN, repeated rows, clashing names; no pairs in the plan."""
    rng = random.Random(5)
    data = [(i, "a" if i % 7 else None, rng.choice([rng.randint(0, 300), 7, None]), rng.choice([rng.uniform(0, 9), 3.0, NAN, None]), rng.choice([rng.randint(-9, 9), None])) for i in range(250)]
    data += [data[3], data[3], (999, "alone", 1, 1.0, 5)]
    df = spark.createDataFrame(data, "id int, k string, t int, v double, n_below int")
    less = lambda a, b: a is not None and b is not None and a == a and (b != b or a < b)
    want = Counter()
    for i, k, t, v, _ in data:
        own = [s or 0 for _, k2, t2, v2, s in data if k2 == k and less(t2, t) and less(v2, v)]
        want[i, len(own), sum(own)] += 1
    got = dominated(df.withColumnRenamed("n_below", "s").withColumn("n_below", F.lit("x")), ["k"], "t", "v", "s", 50, 1.0)
    assert Counter(tuple(r) for r in got.select("id", "n_below", "total_below").collect()) == want
    got.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert dominated(df.limit(0), ["k"], "t", "v", "id", 50, 1.0).count() == 0


@pytest.mark.parametrize("large", [1, 40, 1 << 16])
def test_dominance_in_spans_writes_few_rows(spark, monkeypatch, large):
    """With groups cut into spans at different sizes, several keys or none, and no row written for each digit's place."""
    rng = random.Random(6)
    data = [(i, "a" if i % 3 else None, 7 if i % 11 == 0 else rng.randint(0, 9000), rng.choice([rng.uniform(-20, 20), 3.0, NAN, INF, -INF, None]), rng.choice([rng.randint(-9, 9), None])) for i in range(1500)]
    df = spark.createDataFrame(data, "id int, k string, t int, v double, s int")
    less = lambda a, b: a is not None and b is not None and a == a and (b != b or a < b)
    held, plain = [], dominance.kept
    monkeypatch.setattr(dominance, "kept", lambda rows, name: held.append(plain(rows, name)) or held[-1])
    monkeypatch.setattr(dominance, "LARGE", large)
    for keys in (["k"], []):
        held.clear()
        want = Counter()
        for i, k, t, v, _ in data:
            own = [s or 0 for _, k2, t2, v2, s in data if (not keys or k2 == k) and less(t2, t) and less(v2, v)]
            want[i, len(own), sum(own)] += 1
        got = dominated(df, keys, "t", "v", "s", 500, 2.0)
        assert Counter(tuple(r) for r in got.select("id", "n_below", "total_below").collect()) == want
        written = [f.count() for f in held]
        assert sum(written[:2]) <= 2 * len(data) and sum(written) <= (7 if large == 1 else 3) * len(data)
