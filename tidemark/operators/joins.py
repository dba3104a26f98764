"""As-of and range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.spans import span_of
from tidemark.sources.shared import kept

#: Widths of bins for ranges grow by this; from so many powers on a range is in one bin for all.
SPREAD, TOP = 16, 14


def asof_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, by: Sequence[str], values: Sequence[str], strict: bool = False, span: float = 86400.0) -> DataFrame:
    """left with the `values` of the latest right row of the same `by` whose right_at is at or before (strict: before)
    left_at; nulls where there is none. Rows of left with a null time match nothing.

    Both sides are stacked and a window carries the last right row forward, so no pair of rows is ever made that doesn't
    match. A key is cut into spans of time (`span` seconds, or units of a numeric column), each headed by the last right
    row of the spans before: a task holds a span of a key, and one row for each span is what a key has in one task. Of
    right rows at one time the largest values win, so the result doesn't depend on the order of files. Column names of
    right other than these don't matter; a column of left named like one of `values` is an error.
    """
    if clash := sorted(set(left.columns) & set(values)):
        raise ValueError(f"columns of both sides: {', '.join(clash)}")
    keys = [f"_by{i}" for i in range(len(by))]
    named = [F.col(b).alias(k) for b, k in zip(by, keys, strict=True)]
    ours = left.where(F.col(left_at).isNotNull()).select(*named, F.col(left_at).alias("_at"), F.lit(1 - int(strict)).alias("_side"), F.struct(*left.columns).alias("_row"))
    theirs = right.where(F.col(right_at).isNotNull()).select(*named, F.col(right_at).alias("_at"), F.lit(int(strict)).alias("_side"), F.struct(*[F.col(v) for v in values]).alias("_value"))
    both = ours.unionByName(theirs, allowMissingColumns=True)
    both = both.withColumn("_span", span_of(F.col("_at"), both.schema["_at"].dataType, span))
    ends = both.groupBy(*keys, "_span").agg(F.max(F.when(F.col("_value").isNotNull(), F.struct("_at", "_value"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select(*keys, "_span", F.last("_end", ignorenulls=True).over(earlier)["_value"].alias("_value"), F.lit(-1).alias("_side"))
    order = Window.partitionBy(*keys, "_span").orderBy(F.col("_at").asc_nulls_first(), "_side", F.col("_value").asc_nulls_first())
    last = F.last("_value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.unionByName(heads, allowMissingColumns=True).withColumn("_last", last).where(F.col("_row").isNotNull())
    found = found.select("_row.*", *[F.col("_last")[v].alias(v) for v in values])
    kinds = right.schema
    return found.unionByName(left.where(F.col(left_at).isNull()).select("*", *[F.lit(None).cast(kinds[v].dataType).alias(v) for v in values]))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Pairs with low <= point < high, as an equal join on bins of `width`: a range is copied to each bin that it meets,
    so a width near the usual length of a range makes about two copies. Ranges are not compared with points of other
    bins, as a join on inequalities would. how: inner, left, left_semi or left_anti.

    Long ranges stand in wider bins, by powers of SPREAD, so none has more than SPREAD + 1 copies; a point is copied to
    each width that is used. A null or NaN point is in no range; a range with a null or NaN end, or whose low end isn't
    below its high one, holds nothing; an infinite end is an end like others, but such ranges meet all points in one bin.
    Columns of both sides with one name are an error."""
    if how in ("inner", "left") and (clash := sorted(set(points.columns) & set(ranges.columns))):
        raise ValueError(f"columns of both sides: {', '.join(clash)}")
    size = (F.col(high).cast("double") - F.col(low).cast("double")) / float(width)
    level = F.greatest(F.lit(0.0), F.ceil(F.log(F.greatest(size, F.lit(1.0))) / F.log(F.lit(float(SPREAD)))).cast("double"))
    level = F.when(size < float(SPREAD) ** TOP, F.least(level, F.lit(TOP - 1.0))).otherwise(TOP).cast("int")
    bin_of = lambda c, at: F.when(at == TOP, F.lit(0).cast("long")).otherwise(F.floor(c.cast("double") / (float(width) * F.pow(F.lit(float(SPREAD)), at))))
    fine = lambda c: ~F.isnan(F.col(c).cast("double"))
    placed = ranges.where((F.col(low) < F.col(high)) & fine(low) & fine(high)).withColumn("_level", level)
    spread = placed.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(low), F.col("_level")), bin_of(F.col(high), F.col("_level")))))
    used = [r["_level"] for r in placed.select("_level").distinct().collect()]  # TOP + 1 at most
    real = F.col(point).isNotNull() & fine(point)
    binned = points.withColumn("_at", F.explode_outer(F.when(real, F.array(*[F.lit(x) for x in sorted(used)]).cast("array<int>"))))
    binned = binned.withColumn("_point_bin", bin_of(F.col(point), F.col("_at")))
    fits = (F.col("_at") == F.col("_level")) & (F.col("_point_bin") == F.col("_bin")) & (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    if how == "inner" or len(used) <= 1:  # a point has one copy
        return binned.join(spread, fits, how).drop("_bin", "_point_bin", "_at", "_level")
    whole = kept(points.withColumn("_row", F.monotonically_increasing_id()), "points")
    inside = range_join(whole, ranges, point, low, high, width)
    if how == "left":
        return whole.join(inside.select("_row", *ranges.columns), "_row", "left").drop("_row")
    return whole.join(inside.select("_row"), "_row", how).drop("_row")


def salted_join(large: DataFrame, small: DataFrame, on: Sequence[str], salts: int = 16, spread: Column | None = None) -> DataFrame:
    """An inner join for a key with very many rows in large: small's rows are copied `salts` times, and large's rows
    with one key go to that many tasks. Use it where adaptive execution can't split the key's partition. Without `spread`
    (an integer that is even over a key's rows) rows are dealt in turn, so equal rows go to all salts, too; large is then
    written once with its salts, so that a task that runs again finds the same ones."""
    if spread is None:
        large = kept(large.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")), "salted")
    else:
        large = large.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.join(copies, [*on, "_salt"]).drop("_salt")
