"""Sums over what is smaller in two orders at once, without making the pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.spans import running, span_of
from tidemark.sources.shared import kept

#: Ranks are taken apart into digits of so many bits.
BITS = 3

#: Groups of more rows than this are cut into spans.
LARGE = 1 << 16


def dominated(rows: DataFrame, keys: Sequence[str], x: str, y: str, amount: str, x_width: float, y_width: float, n_col: str = "n_below", total_col: str = "total_below") -> DataFrame:
    """rows with the number of rows of the same keys that are less in both x and y, and the sum of their `amount` (0 for
    none, null amounts count as 0): what a join on x < x and y < y with an aggregate gives.

    Of two rows the ranks of x agree down to some digit, where the lesser has the lesser digit. So for each digit's place
    the rows that agree above it are one group in the order of y, and running sums for each digit give what is below; a row
    adds up its sums of all places. That is rows times places (the logarithm of the different values of x, to the base
    2 ** BITS), never pairs, and a place shuffles a row once, with the few columns that it needs. Groups of more than LARGE
    rows are cut into spans of y (`y_width`, and `x_width` for the ranks, in seconds for dates and times, else units), each
    of which starts from the sums of those before it, so no key needs one task.

    Null keys are a key. Rows with a null x or y are less than none and have none below. NaN is the largest number. Equal
    values aren't less than each other; repeated rows are rows of their own. Columns of rows with the two new names are
    replaced."""
    rows = kept(rows.drop(n_col, total_col).withColumn("_row", F.monotonically_increasing_id()), "dominance")
    valid = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    one = F.lit(1).cast("long")
    values = valid.groupBy(*keys, x).agg(F.count("*").alias("_size")).withColumn("_one", one)
    of = [F.col(c).alias(f"_of{i}") for i, c in enumerate([*keys, x])]
    ranks = kept(running(values, keys, [x], {"_rank": "_one"}, x_width).select(*of, (F.col("_rank") - 1).alias("_x"), "_size"), "dominance-ranks")
    top = ranks.agg(F.max("_x")).first()[0] or 0
    places = F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-int(top).bit_length() // BITS)) - 1))).alias("_place")
    above = F.expr(f"shiftright(_x, {BITS} * (_place + 1))").alias("_group")
    same = lambda names: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(names)])
    own = [f"_of{i}" for i in range(len(keys))]
    large = ranks.select(*own, "_x", "_size", places).select(*own, F.col("_place").alias("_at"), above.alias("_in"), "_size")
    large = large.groupBy(*own, "_at", "_in").agg(F.sum("_size").alias("_size")).where(F.col("_size") > LARGE).drop("_size")
    ranked = valid.join(ranks, same([*keys, x])).select("_row", *keys, F.col(y).alias("_y"), F.coalesce(F.col(amount), F.lit(0)).alias("_s"), "_x")
    group = [*keys, "_place", "_group"]
    spread = ranked.select("*", places).select("_row", *group[:-1], above, F.expr(f"shiftright(_x, {BITS} * _place) & {(1 << BITS) - 1}").cast("int").alias("_digit"), "_y", one.alias("_n"), "_s")
    is_large = reduce(lambda a, b: a & b, [F.col("_place") == F.col("_at"), F.col("_group") == F.col("_in")], same(keys) if keys else F.lit(True))
    spread = spread.join(F.broadcast(kept(large, "dominance-large")), is_large, "left")
    spread = spread.withColumn("_span", F.when(F.col("_at").isNotNull(), F.coalesce(span_of(F.col("_y"), rows.schema[y].dataType, y_width), F.lit(0)))).drop(*own, "_at", "_in")

    # a large group's spans, and for each of them what is in those before it, as a row for each digit that sorts first
    digits = range((1 << BITS) - 1)  # nothing is above the last one
    at = lambda d, c: F.sum(F.when(F.col("_digit") == d, F.col(c)))
    sums = {f"{c}{d}": at(d, c) for d in digits for c in ("_n", "_s")}
    spans = spread.where("_span IS NOT NULL").groupBy(*group, "_span").agg(*[c.alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    heads = spans.select(*group, "_span", *[F.sum(n).over(before).alias(n) for n in sums])
    heads = heads.select(*group, "_span", F.inline(F.array(*[F.struct(F.lit(d).alias("_digit"), F.col(f"_n{d}").alias("_n"), F.col(f"_s{d}").alias("_s")) for d in digits]))).where("_n IS NOT NULL")

    # of equal y the larger digit comes first, so what is before a row with a lesser digit has a lesser y
    lines = spread.unionByName(heads, allowMissingColumns=True)
    less = Window.partitionBy(*group, "_span").orderBy(F.col("_row").isNotNull(), "_y", F.desc("_digit")).rowsBetween(Window.unboundedPreceding, -1)
    summed = lines.select("_row", "_digit", *[at(d, c).over(less).alias(f"{c}{d}") for d in digits for c in ("_n", "_s")]).where("_row IS NOT NULL")
    upto = lambda c: reduce(add, [F.when(F.col("_digit") > d, F.coalesce(f"{c}{d}", F.lit(0))).otherwise(F.lit(0)) for d in digits])
    found = summed.select("_row", upto("_n").alias("_n"), upto("_s").alias("_s"))
    totals = found.groupBy("_row").agg(F.sum("_n").alias(n_col), F.sum("_s").alias(total_col))
    return rows.join(totals, "_row", "left").drop("_row").withColumns({n_col: F.coalesce(n_col, F.lit(0).cast("long")), total_col: F.coalesce(total_col, F.lit(0))})
