"""Window and time-series queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators.dominance import dominated
from tidemark.operators.intervals import interval_join
from tidemark.operators.joins import asof_join
from tidemark.operators.spans import added, framed, ranks
from tidemark.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def _bars_sql(width: str) -> str:
    return f"SELECT event_type, time_bucket(INTERVAL {width}, ts)::TIMESTAMP AS bar, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY ALL"


@query("SELECT event_type, event_id, (rank() OVER w)::INT AS r, (dense_rank() OVER w)::INT AS d, (ntile(4) OVER (PARTITION BY event_type ORDER BY value, event_id))::INT AS quarter, round(percent_rank() OVER w, 10) AS p, round(cume_dist() OVER w, 10) AS c FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)")
def window_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks within five event types, in spans of values so that no type needs one task."""
    found = ranks(_events(spark, sf), "event_type", "value", "event_id", tiles=4, width=1.0, tie_width=1_000_000)
    return found.select("event_type", "event_id", "r", "d", "quarter", F.round("p", 10).alias("p"), F.round("c", 10).alias("c"))


@query("SELECT user_id, event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS after2, first_value(value) OVER w AS first_one, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_one FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_offsets(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return _events(spark, sf).select("user_id", "event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2, -1.0).over(w).alias("after2"), F.first("value").over(w).alias("first_one"), F.last("value").over(whole).alias("last_one"))


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM events")
def window_running_sum(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _events(spark, sf).select("user_id", "event_id", F.round(F.sum("value").over(w), 6).alias("running"))


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def window_time_range(spark: SparkSession, sf: str) -> DataFrame:
    frame = "count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n"
    return _events(spark, sf).selectExpr("user_id", "event_id", frame)


@query("SELECT event_type, event_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS total, min(value) OVER w AS least, max(value) OVER w AS most FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)")
def window_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of six hours within five event types, in spans with a halo, so that no type needs one task, by running
    aggregates, so that frames with many rows cost no more than others."""
    frames = {"n": F.count("*"), "total": F.sum("value"), "least": F.min("value"), "most": F.max("value")}
    found = framed(_events(spark, sf).select("event_type", "event_id", "ts", "value"), ["event_type"], "ts", 6 * 3600, frames, 86_400, {"n": added, "total": added, "least": F.least, "most": F.greatest})
    return found.select("event_type", "event_id", "n", F.round("total", 6).alias("total"), "least", "most")


@query(_bars_sql("1 HOUR"))
def bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return B.bars(_events(spark, sf), "1 hour")


@query(_bars_sql("1 DAY"))
def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return B.bars(_events(spark, sf), "1 day")


@query("""SELECT event_type, start, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 2 HOUR, ts - INTERVAL 4 HOUR), time_bucket(INTERVAL 2 HOUR, ts - INTERVAL 2 HOUR), time_bucket(INTERVAL 2 HOUR, ts)])::TIMESTAMP AS start, ts FROM events)
WHERE ts < start + INTERVAL 6 HOUR AND ts >= start GROUP BY event_type, start""")
def windows_sliding(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).groupBy("event_type", F.window("ts", "6 hours", "2 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return rows.select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("""SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS stop, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def windows_session(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


@query("""SELECT e.event_id, count(p.event_id) AS n_below, coalesce(sum(p.value::DECIMAL(18, 2)), 0)::DOUBLE AS total_below
FROM events e LEFT JOIN events p ON p.event_type = e.event_type AND p.ts < e.ts AND p.value < e.value GROUP BY e.event_id""")
def join_dominance(spark: SparkSession, sf: str) -> DataFrame:
    """For each event the number and sum of earlier, smaller ones of its type, without making the pairs."""
    e = _events(spark, sf).select("event_id", "event_type", "ts", "value", F.col("value").cast("decimal(18, 2)").alias("amount"))
    found = dominated(e, ["event_type"], "ts", "value", "amount", x_width=86_400, y_width=1.0)
    return found.select("event_id", "n_below", F.col("total_below").cast("double").alias("total_below"))


@query("""SELECT p.event_id AS purchase_id, e.event_id AS error_id, p.ts AS bought, e.ts AS failed, e.until FROM events p
JOIN (SELECT event_id, ts, ts + to_microseconds(round(value * 1000000)::BIGINT) AS until FROM events WHERE event_type = 'error' AND value > 0) e ON p.event_type = 'purchase' AND p.ts < e.until AND e.ts < p.ts + INTERVAL 5 MINUTE""")
def join_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases, each of which takes five minutes, with the errors that were open meanwhile, each for its value in seconds."""
    e = _events(spark, sf)
    bought = e.where("event_type = 'purchase'").selectExpr("event_id AS purchase_id", "ts AS bought", "ts + INTERVAL 5 MINUTES AS done")
    failed = e.where("event_type = 'error'").selectExpr("event_id AS error_id", "ts AS failed", "ts + make_dt_interval(0, 0, 0, cast(value AS decimal(18, 6))) AS until")
    return interval_join(bought, failed, ("bought", "done"), ("failed", "until"), 300.0).drop("done")


@query("""SELECT user_id, start, stop, event_id AS error_id FROM (SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS stop FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s)
LEFT JOIN (SELECT user_id AS u, event_id, ts, ts + to_microseconds(round(value * 60000000)::BIGINT) AS until FROM events WHERE event_type = 'error' AND value > 0) e ON u = user_id AND start < until AND e.ts < stop""")
def join_intervals_left(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with the errors of their user that were open meanwhile, each for its value in minutes; nulls without any."""
    failed = _events(spark, sf).where("event_type = 'error'").selectExpr("user_id", "event_id AS error_id", "ts AS failed", "ts + make_dt_interval(0, 0, 0, cast(value * 60 AS decimal(18, 6))) AS until")
    found = interval_join(windows_session(spark, sf).drop("n"), failed, ("start", "stop"), ("failed", "until"), 3600.0, by=["user_id"], how="left")
    return found.select("user_id", "start", "stop", "error_id")


_FILLED = f"""SELECT event_type, bar, coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, coalesce(close, c) AS close, coalesce(n, 0) AS n FROM
(SELECT k.event_type, k.bar, open, high, low, close, n, last_value(close IGNORE NULLS) OVER (PARTITION BY k.event_type ORDER BY k.bar ROWS UNBOUNDED PRECEDING) AS c FROM
 (SELECT event_type, unnest(generate_series(min(bar), max(bar), INTERVAL 1 HOUR))::TIMESTAMP AS bar FROM ({_bars_sql("1 HOUR")}) GROUP BY event_type) k LEFT JOIN ({_bars_sql("1 HOUR")}) b USING (event_type, bar))"""


@query(_FILLED)
def bars_filled(spark: SparkSession, sf: str) -> DataFrame:
    return B.filled(B.bars(_events(spark, sf), "1 hour"), "1 hour")


@query(f"""SELECT event_type, bar, CASE WHEN count(*) OVER w = 24 THEN round(avg(close) OVER w, 8) END AS mean, CASE WHEN count(*) OVER w = 24 THEN min(close) OVER w END AS least, CASE WHEN count(*) OVER w = 24 THEN max(close) OVER w END AS most,
CASE WHEN count(*) OVER w = 24 THEN round(stddev_pop(close) OVER w, 6) END AS deviation FROM ({_FILLED}) WINDOW w AS (PARTITION BY event_type ORDER BY bar ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def bars_moving(spark: SparkSession, sf: str) -> DataFrame:
    made = B.filled(B.bars(_events(spark, sf), "1 hour"), "1 hour")
    m = B.moving("close", 24)
    return made.select("event_type", "bar", F.round(m["mean"], 8).alias("mean"), m["least"].alias("least"), m["most"].alias("most"), F.round(m["deviation"], 6).alias("deviation"))


@query(f"""WITH RECURSIVE b AS (SELECT event_type, bar, close, row_number() OVER (PARTITION BY event_type ORDER BY bar) AS i FROM ({_bars_sql("4 HOUR")})),
e AS (SELECT event_type, bar, i, close AS ema FROM b WHERE i = 1 UNION ALL SELECT b.event_type, b.bar, b.i, 0.2::DOUBLE * b.close + 0.8::DOUBLE * e.ema FROM e JOIN b ON b.event_type = e.event_type AND b.i = e.i + 1)
SELECT event_type, bar, round(ema, 8) AS ema FROM e""")
def bars_exponential(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.exponential(B.bars(_events(spark, sf), "4 hours"), 0.2, span=7 * 86400.0)
    return rows.select("event_type", "bar", F.round("ema", 8).alias("ema"))


@query(f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER w AS i, avg(close) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m, min(low) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS floor FROM ({_bars_sql("4 HOUR")}) WINDOW w AS (PARTITION BY event_type ORDER BY bar)),
p AS (SELECT event_type, i, bar, close, CASE WHEN close > m THEN 1 ELSE 0 END AS state FROM b WHERE i = 1 UNION ALL SELECT b.event_type, b.i, b.bar, b.close, CASE
 WHEN p.state = 0 THEN CASE WHEN b.close > b.m THEN 1 ELSE 0 END WHEN p.state = 1 THEN CASE WHEN b.low < b.floor THEN 2 WHEN b.close < b.m THEN 0 ELSE 1 END ELSE CASE WHEN b.close < b.m THEN 0 ELSE 2 END END FROM p JOIN b ON b.event_type = p.event_type AND b.i = p.i + 1)
SELECT event_type, bar, state::INT AS state FROM p""")
def bars_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """A position over bars: out (0), in (1), or stopped (2). In when a close is above the mean of ten; out when it is below;
    stopped when a bar falls below the five before, and then out again, and free to go in, only below the mean."""
    made = B.bars(_events(spark, sf), "4 hours")
    w = Window.partitionBy("event_type").orderBy("bar")
    ruled = made.withColumn("m", F.avg("close").over(w.rowsBetween(-9, 0))).withColumn("floor", F.min("low").over(w.rowsBetween(-5, -1)))
    close, m = F.col("close"), F.col("m")
    moves = [F.when(close > m, 1).otherwise(0), F.when(F.col("low") < F.col("floor"), 2).when(close < m, 0).otherwise(1), F.when(close < m, 0).otherwise(2)]
    return B.positions(ruled, moves, span=7 * 86400.0)


@query(f"SELECT e.event_id, e.event_type, e.ts, d.close AS close FROM events e ASOF LEFT JOIN (SELECT event_type, bar + INTERVAL 1 DAY AS ended, close FROM ({_bars_sql('1 DAY')})) d ON e.event_type = d.event_type AND e.ts >= d.ended")
def join_asof(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    ended = B.bars(e, "1 day").select("event_type", (F.col("bar") + F.expr("INTERVAL 1 DAY")).alias("ended"), "close")
    return asof_join(e.select("event_id", "event_type", "ts"), ended, "ts", "ended", ["event_type"], ["close"])


_ALIGNED = f"SELECT f.*, d.close AS coarse_close FROM ({_bars_sql('1 HOUR')}) f ASOF LEFT JOIN (SELECT event_type, bar + INTERVAL 1 DAY AS ended, close FROM ({_bars_sql('1 DAY')})) d ON f.event_type = d.event_type AND f.bar >= d.ended"


@query(_ALIGNED)
def bars_aligned(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    return B.aligned(B.bars(e, "1 hour"), B.bars(e, "1 day"), "1 day")


@query(f"""SELECT event_type, bar, (CASE WHEN close > open THEN 1 ELSE 0 END + CASE WHEN close > coarse_close THEN 1 ELSE 0 END + CASE WHEN close > m THEN 1 ELSE 0 END)::INT AS score FROM
(SELECT *, avg(close) OVER (PARTITION BY event_type ORDER BY bar ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM ({_ALIGNED}))""")
def signals_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How many of three signals agree that a bar rises: its own move, the day before, the mean of ten bars."""
    rows = bars_aligned(spark, sf)
    mean = F.avg("close").over(Window.partitionBy("event_type").orderBy("bar").rowsBetween(-9, 0))
    yes = lambda c: F.when(c, 1).otherwise(0)
    return rows.withColumn("m", mean).select("event_type", "bar", (yes(F.col("close") > F.col("open")) + yes(F.col("close") > F.col("coarse_close")) + yes(F.col("close") > F.col("m"))).alias("score"))
