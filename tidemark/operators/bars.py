"""Time bars and indicators over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import asof_join
from tidemark.operators.spans import scanned, span_of

SPAN = {"1 hour": 3600, "4 hours": 4 * 3600, "1 day": 24 * 3600}


def bars(ticks: DataFrame, width: str, key: str = "event_type", at: str = "ts", value: str = "value", order: str = "event_id") -> DataFrame:
    """(key, bar, open, high, low, close, n): the bars that have ticks. bar is the start; ticks at one time are in the
    order of `order`. Ticks without a time are in no bar."""
    first = F.struct(at, order)
    rows = ticks.where(F.col(at).isNotNull()).groupBy(F.col(key), F.window(at, width).alias("w"))
    rows = rows.agg(F.min_by(value, first).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, first).alias("close"), F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("bar"), "open", "high", "low", "close", "n")


def filled(made: DataFrame, width: str, key: str = "event_type") -> DataFrame:
    """A row for each bar from a key's first to its last; bars without ticks have the close before as open, high, low
    and close, and n = 0."""
    ends = made.groupBy(key).agg(F.min("bar").alias("a"), F.max("bar").alias("b"))
    calendar = ends.select(key, F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {width}"))).alias("bar"))
    rows = calendar.join(made, [key, "bar"], "left")
    before = F.last("close", ignorenulls=True).over(Window.partitionBy(key).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_close", before)
    return rows.select(key, "bar", *[F.coalesce(c, "_close").alias(c) for c in ("open", "high", "low", "close")], F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def moving(column: str, bars_back: int, key: str = "event_type", at: str = "bar") -> dict[str, Column]:
    """Mean, smallest, largest and population deviation of the last bars_back bars; null until there are as many."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(1 - bars_back, 0)
    full = F.count("*").over(w) == bars_back
    return {name: F.when(full, f(column).over(w)) for name, f in (("mean", F.avg), ("least", F.min), ("most", F.max), ("deviation", F.stddev_pop))}


def exponential(rows: DataFrame, alpha: float, value: str = "close", key: str = "event_type", order: str = "bar", span: float = 30 * 86400.0, warm_up: int = 1) -> DataFrame:
    """(key, order, ema): e = alpha * x + (1 - alpha) * e before, started with the first value and anew after a null one,
    which has a null mean. The first warm_up - 1 rows of a key have a null mean too.

    A key is cut into spans (`span` seconds, or units of a numeric order). Each is smoothed by itself, as if started
    with its first value x; then e before it adds (1 - alpha) ** i * (e - x) to the i-th row up to the span's first
    null. Of a span only its end goes on, so a task holds a span's rows, and a key's ends are what is in one task."""
    keep = 1.0 - alpha
    at = F.col(order)
    spans = rows.groupBy(F.col(key), span_of(at, rows.schema[order].dataType, span).alias("_span")).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), F.col(value).cast("double").alias("x")))).alias("xs"))
    none = F.lit(None)
    spans = spans.withColumn("own", scanned(F.col("xs"), none.cast("double"), lambda e, p: F.coalesce(alpha * p["x"] + keep * e, p["x"]))).withColumn("n", F.size("xs"))
    spans = spans.withColumn("gap", F.array_position(F.transform("xs", lambda p: p["x"].isNull()), True))  # 0: none
    ends = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_span", "n", "gap", F.col("xs")[0]["x"].alias("x"), F.element_at("own", -1).alias("own")))).alias("ends"))

    def on(before, s):
        e = F.when((s["gap"] > 0) | before["e"].isNull(), s["own"]).otherwise(s["own"] + F.pow(F.lit(keep), s["n"]) * (before["e"] - s["x"]))
        return F.struct(e.alias("e"), (F.coalesce(before["rows"], F.lit(0).cast("long")) + s["n"]).alias("rows"))

    start = none.cast("struct<e:double,rows:bigint>")
    states = scanned(F.col("ends"), start, on)
    heads = ends.select(F.col(key).alias("_key"), F.explode(F.arrays_zip(F.col("ends._span").alias("span"), F.concat(F.array(start), states).alias("before"))).alias("h"))
    heads = heads.where(F.col("h.span").isNotNull()).select("_key", F.col("h.span").alias("_of"), F.col("h.before.e").alias("e"), F.coalesce("h.before.rows", F.lit(0)).alias("before"))
    rows = spans.join(heads, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_of")), "left")
    rows = rows.select(key, "e", "before", "gap", F.col("xs")[0]["x"].alias("x"), F.posexplode(F.arrays_zip(F.col("xs.at").alias("at"), F.col("own"))).alias("i", "r"))
    i = F.col("i") + 1
    carried = F.when((F.col("gap") == 0) | (i < F.col("gap")), F.pow(F.lit(keep), i) * (F.col("e") - F.col("x")))
    ema = F.when(F.coalesce("before", F.lit(0)) + i >= warm_up, F.col("r.own") + F.coalesce(carried, F.lit(0.0)))
    return rows.select(key, F.col("r.at").alias(order), ema.alias("ema"))


def positions(rows: DataFrame, moves: Sequence[Column], key: str = "event_type", order: str = "bar", start: int = 0, span: float = 30 * 86400.0) -> DataFrame:
    """(key, order, state): a strategy as a finite automaton. Its states are 0 to len(moves) - 1; moves[s] is the state that
    a row leads to from state s, as an integer column of that row. A null move, or one to no state, stays where it is. A
    key begins in `start`; a row's state is the one after it, so rules that look back only make states that do so too.

    A key is cut into spans (`span` seconds, or units of a numeric order). What a span does is a function of states, an
    array with the end for each beginning; these functions, one row for each span, are composed in the order of the spans,
    and each span is replayed from the state it begins in. So a task holds a span's rows; only a key's functions are in
    one task. Rows that tie in order come in the order of their moves; those without an order come first."""
    if not moves or not 0 <= start < len(moves):
        raise ValueError(f"start {start} is none of {len(moves)} states")
    at, n = F.col(order), len(moves)
    to = [F.when(m.between(0, n - 1), m.cast("int")).otherwise(F.lit(s)) for s, m in enumerate(moves)]
    line = F.struct(at.alias("at"), F.array(*to).alias("to"))
    spans = rows.groupBy(F.col(key), span_of(at, rows.schema[order].dataType, span).alias("_span")).agg(F.sort_array(F.collect_list(line)).alias("xs"))
    does = F.aggregate("xs", F.array(*map(F.lit, range(n))), lambda f, x: F.transform(f, lambda s: x["to"][s]))
    ends = spans.select(key, "_span", does.alias("does")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_span", "does"))).alias("ends"))
    states = scanned(F.col("ends"), F.lit(start), lambda s, e: e["does"][s])
    begin = F.slice(F.concat(F.array(F.lit(start)), states), 1, F.size("ends"))
    heads = ends.select(F.col(key).alias("_key"), F.explode(F.arrays_zip(F.col("ends._span").alias("of"), begin.alias("s"))).alias("h")).select("_key", F.col("h.of").alias("_of"), F.col("h.s").alias("_s"))
    found = spans.join(heads, F.col(key).eqNullSafe(F.col("_key")) & F.col("_span").eqNullSafe(F.col("_of")))
    replayed = scanned(F.col("xs"), F.col("_s"), lambda s, x: x["to"][s])
    found = found.select(key, F.explode(F.arrays_zip(F.col("xs.at").alias("at"), replayed.alias("state"))).alias("r"))
    return found.select(key, F.col("r.at").alias(order), F.col("r.state").alias("state"))


def aligned(fine: DataFrame, coarse: DataFrame, coarse_width: str, key: str = "event_type") -> DataFrame:
    """fine bars with the close of the last coarse bar that had ended when they began. A coarse bar is known at its end
    only, so nothing of the future shows."""
    ended = coarse.select(key, (F.col("bar") + F.expr(f"INTERVAL {coarse_width}")).alias("ended"), F.col("close").alias("coarse_close"))
    return asof_join(fine, ended, "bar", "ended", [key], ["coarse_close"])
