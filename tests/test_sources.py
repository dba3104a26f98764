"""The Arrow source and bucketed tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.plans import relational
from tidemark.sources import arrow_parts
from tidemark.sources.tables import bucketed, buckets_for


@pytest.fixture
def folder(spark, tmp_path):
    arrow_parts.use(spark)
    return str(tmp_path / "table")


def read(spark, folder):
    return spark.read.format("arrow_parts").load(folder)


def save(df, folder, mode="append"):
    df.write.format("arrow_parts").mode(mode).save(folder)


def test_round_trip_of_types_nulls_and_empty_tables(spark, folder, tmp_path):
    data = [
        (1, "ä" * 400, 1.5, float("nan"), True, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 6), [1, None], {"a": 1}, b"\x00\xff"),
        (None,) * 10,
        (-5, "", -0.0, float("inf"), False, dt.date(1969, 1, 2), dt.datetime(1969, 1, 1), [], {}, b""),
    ]
    schema = "i long, s string, d double, f float, b boolean, day date, t timestamp_ntz, xs array<int>, m map<string,int>, raw binary"
    df = spark.createDataFrame(data, schema).repartition(5)
    save(df, folder)
    text = lambda frame: sorted(map(repr, frame.collect()))
    assert text(read(spark, folder)) == text(df) and read(spark, folder).schema == df.schema
    save(df, folder)
    assert read(spark, folder).count() == 6
    save(df.where("i = 1"), folder, "overwrite")
    assert read(spark, folder).select("i").collect() == [(1,)]
    save(df.limit(0), f"{tmp_path}/none")
    assert read(spark, f"{tmp_path}/none").collect() == [] and read(spark, f"{tmp_path}/none").schema == df.schema
    with pytest.raises(PySparkException, match="no table in"):
        read(spark, f"{tmp_path}/nowhere")
    with pytest.raises(PySparkException, match="other columns"):
        save(df.select("i"), folder)
    assert read(spark, folder).count() == 1


def test_pushed_filters_skip_parts_and_lose_no_rows(spark, folder):
    """20 parts by ranges of id; a column of nulls in some, NaN in others."""
    df = spark.range(0, 2000, 1, 20).selectExpr("id", "CASE WHEN id >= 1000 THEN concat('k', id) END AS k", "CASE WHEN id < 500 THEN double('NaN') ELSE id / 2.0D END AS x", "CASE WHEN id % 2 = 0 THEN int(id) END AS half")
    save(df, folder)
    tests = {"id >= 1900": 1, "id < 100 OR id > 1950": 20, "id = 555": 1, "id IN (5, 7, 1999)": 2, "k IS NULL": 10, "k IS NOT NULL": 10, "k = 'k1500'": 1, "k > 'zz'": 0, "x < 300": 6, "x > 990": 6, "half > 1899": 1, "id > 50 AND id <= 150": 2, "NOT id = 5": 20, "k LIKE 'k15%'": 10, "id > 5000": 0}
    for test, most in tests.items():
        found = read(spark, folder).where(test)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, df.where(test).collect())), test
        assert found.rdd.getNumPartitions() <= max(most, 1), test


def test_a_failed_task_leaves_no_rows(spark, folder):
    save(spark.range(10), folder)
    failing = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") < 900, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("id"))
    with pytest.raises(PySparkException):
        save(failing, folder)
    with pytest.raises(PySparkException):
        save(failing, folder, "overwrite")
    assert sorted(r["id"] for r in read(spark, folder).collect()) == list(range(10))


def test_bucketed_tables_join_without_a_shuffle(spark, sf, capsys):
    found = relational.join_bucketed(spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    found.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan


def test_buckets_of_ties_nulls_and_empty_tables(spark):
    left = spark.createDataFrame([(i % 5 if i % 7 else None, i) for i in range(200)], "k int, a int")
    right = spark.createDataFrame([(1, 10), (1, 11), (None, 12), (9, 13)], "j int, b int")
    with pytest.raises(ValueError, match="not known"):
        buckets_for([left])
    n = buckets_for([spark.range(10)])
    a, b = bucketed(left, "k", n), bucketed(right, "j", n)
    got = a.hint("merge").join(b, a["k"] == b["j"], "full")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, left.join(right, left["k"] == right["j"], "full").collect()))
    assert bucketed(left.limit(0), "k", n).join(b, F.col("k") == F.col("j")).count() == 0
    assert buckets_for([spark.range(10)], bytes_each=1) == 80


def test_buckets_go_by_rows_and_not_by_what_files_take(spark, tmp_path):
    """A million rows that a file holds in next to nothing are as many buckets as others."""
    spark.range(1_000_000).selectExpr("id AS k", "0.0D AS zero", "'always the same' AS s").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t").select("k", "zero")
    assert buckets_for([t.limit(1), t], bytes_each=1_000_000) >= 16
    assert buckets_for([t]) == 8
