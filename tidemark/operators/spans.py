"""Ordered work on a key with very many rows: it is cut into spans of its order, and each span starts from one row that
sums up the spans before it. So a task holds a span and not a key, and only the sums of spans meet in one place."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DoubleType, FloatType, IntegralType, TimestampNTZType, TimestampType


def span_of(at: Column, kind: DataType, width: float) -> Column:
    """The number of the span that `at` is in: never less for a later `at`. width is in seconds for dates and times, and
    in units of the column for numbers. Null for null; NaN is in the last span, as it sorts."""
    if isinstance(kind, TimestampNTZType):  # without a time zone, in which clocks could go back
        at = F.unix_date(at.cast("date")) * F.lit(86400).cast("long") + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    elif isinstance(kind, TimestampType):
        at = F.unix_seconds(at)
    elif isinstance(kind, DateType):
        at = F.unix_date(at) * F.lit(86400).cast("long")
    elif isinstance(kind, FloatType | DoubleType):
        return F.when(F.isnan(at), F.lit((1 << 63) - 1)).otherwise(F.floor(at.cast("double") / F.lit(float(width))))
    return F.floor(at.cast("double") / F.lit(float(width)))


def scanned(xs: Column, start: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """The array of states after each element of the array xs: step(state, element), from start on, in the type of start.
    Blocks are scanned one after the other, so a state is copied some `block` times and not as often as xs is long. Null
    for a null xs, empty for an empty one."""
    last = lambda states: F.element_at(states, -1)
    blocks = F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(block)), lambda i: F.slice(xs, i, block))).otherwise(F.slice(F.array(xs), 2, 1))
    on = lambda done, part: F.array_append(done, F.aggregate(part, F.array(last(last(done))), lambda states, x: F.array_append(states, step(last(states), x))))
    nullable = F.slice(F.array(start, F.lit(None)), 1, 1)  # states can be null, whatever start is
    done = F.aggregate(blocks, F.array(nullable), on)  # each block's states follow the one that it starts from
    return F.when(xs.isNotNull(), F.flatten(F.transform(F.slice(done, 2, F.size(blocks)), lambda states: F.slice(states, 2, block))))


def _whole(at: Column, kind: DataType) -> tuple[Column, int]:
    """at as an integer in its order, and how many of those are a second (dates and times) or a unit (integers)."""
    if isinstance(kind, TimestampNTZType):
        minutes = (F.unix_date(at.cast("date")) * F.lit(1440).cast("long") + F.hour(at) * 60 + F.minute(at)) * 60_000_000
        return minutes + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long"), 1_000_000
    if isinstance(kind, TimestampType):
        return F.unix_micros(at), 1_000_000
    if isinstance(kind, DateType):
        return F.unix_date(at) * F.lit(86400).cast("long"), 1
    if isinstance(kind, IntegralType):
        return at.cast("long"), 1
    raise ValueError(f"frames over {kind.simpleString()} aren't exact in integers")


def added(a: Column, b: Column) -> Column:
    """The sum of two counts or sums, of which either can be null."""
    return F.coalesce(a + b, a, b)


def framed(rows: DataFrame, keys: Sequence[str], at: str, reach: int, aggregates: Mapping[str, Column], width: int, merges: Mapping[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """rows with each of aggregates (name: F.sum("x") and the like) over the key's rows from `reach` before a row's `at` up
    to and with it, rows of one time being equal: what a window of RANGE BETWEEN reach PRECEDING AND CURRENT ROW gives.
    reach and width are seconds for dates and times, units for integers.

    A key is cut into spans, and a row stands in its own span and in those that its reach goes on to (the halo), so a key
    with a third of all rows is as many tasks as it has spans, and a task holds the rows of one span and of the reach
    before it.

    merges says how an aggregate of two parts of a frame follows from theirs (added, F.least, F.greatest), for all of
    aggregates. Then spans are as long as the reach: a frame is the end of one span and the start of the next, each of
    which is a running aggregate, so the work of a row doesn't grow with its frame. Without merges spans have `width`
    (of reach or more: two at most for a row), and Spark's sliding frame goes over all of a row's frame for each row.

    Rows without a time see the key's others without one. Columns of rows with the new names are replaced."""
    if merges is not None and (reach <= 0 or set(merges) != set(aggregates)):
        raise ValueError("merges are for a reach above 0, and for all aggregates")
    whole, unit = _whole(F.col(at), rows.schema[at].dataType)
    length = (width if merges is None else reach) * unit
    span = lambda place: F.floor(place / F.lit(length)).cast("long") if merges is None else F.expr(f"(_tm_at - pmod(_tm_at, {length}L)) div {length}L")
    cut = rows.withColumn("_tm_at", whole).withColumn("_tm_own", span(F.col("_tm_at")))
    kept = [c for c in rows.columns if c not in aggregates]
    if merges is None:
        met = F.coalesce(F.sequence("_tm_own", span(F.col("_tm_at") + reach * unit)), F.array(F.lit(None).cast("long")))
        frame = Window.partitionBy(*keys, "_tm_span").orderBy("_tm_at").rangeBetween(-reach * unit, 0)
        found = cut.withColumn("_tm_span", F.explode(met)).select(*kept, "_tm_own", "_tm_span", *[c.over(frame).alias(n) for n, c in aggregates.items()])
        return found.where(F.col("_tm_own").eqNullSafe(F.col("_tm_span"))).drop("_tm_own", "_tm_span")
    met = F.when(F.col("_tm_own").isNull(), F.array("_tm_own")).otherwise(F.array("_tm_own", F.col("_tm_own") + 1))
    both = cut.withColumn("_tm_span", F.explode(met)).withColumn("_tm_halo", ~F.col("_tm_own").eqNullSafe(F.col("_tm_span")))
    # up to a row in its own span, and from a row on to the end of the span before
    so_far = Window.partitionBy(*keys, "_tm_span", "_tm_halo").orderBy(F.when(F.col("_tm_halo"), -F.col("_tm_at")).otherwise(F.col("_tm_at"))).rangeBetween(Window.unboundedPreceding, 0)
    parts = both.select(*kept, "_tm_at", "_tm_span", "_tm_halo", F.struct(*[c.over(so_far).alias(n) for n, c in aggregates.items()]).alias("_tm_part"))
    # the earliest row of the span before that is still within reach
    back = Window.partitionBy(*keys, "_tm_span").orderBy(F.when(F.col("_tm_halo"), -F.col("_tm_at")).otherwise(reach * unit - F.col("_tm_at"))).rangeBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_tm_before", F.last(F.when(F.col("_tm_halo"), F.col("_tm_part")), ignorenulls=True).over(back)).where("not _tm_halo")
    merged = lambda n: F.when(F.col("_tm_before").isNull(), F.col("_tm_part")[n]).otherwise(merges[n](F.col("_tm_part")[n], F.col("_tm_before")[n]))
    return parts.select(*kept, *[merged(n).alias(n) for n in aggregates])


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], amounts: Mapping[str, str], width: float) -> DataFrame:
    """rows with, for each new name: column of amounts, the sum of that column over the key's rows up to and with this
    one, in ascending `order` (nulls first), and as {name}_all that over all of the key's. Spans are those of
    order[0]; its nulls are one span. Rows that are equal in `order` come in any order. Null amounts count as 0.

    The sums of spans, one row for each, are in one task for a key."""
    kind = rows.schema[order[0]].dataType
    cut = rows.withColumn("_tm_span", span_of(F.col(order[0]), kind, width))
    spans = cut.groupBy(*keys, "_tm_span").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in amounts.items()])
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(F.col("_tm_span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    heads = spans.select(*keys, "_tm_span", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in amounts], *[F.sum(n).over(whole).alias(f"{n}_all") for n in amounts])
    lines = cut.select("*", *[F.coalesce(c, F.lit(0)).alias(n) for n, c in amounts.items()], F.lit(1).alias("_tm_line"))
    both = lines.unionByName(heads.withColumn("_tm_line", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "_tm_span").orderBy("_tm_line", *[F.col(o).asc_nulls_first() for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    done = both.select(*rows.columns, "_tm_line", *[F.sum(n).over(so_far).alias(n) for n in amounts], *[F.first(f"{n}_all").over(so_far).alias(f"{n}_all") for n in amounts])
    return done.where("_tm_line = 1").drop("_tm_line")


def ranks(rows: DataFrame, key: str, value: str, tie: str, tiles: int, width: float, tie_width: float) -> DataFrame:
    """rows with r (rank), d (dense rank), p (percent_rank) and c (cume_dist) by value within the key, and quarter (ntile
    by value and tie into `tiles`). Equal values are one row with a count until the last join, and the ones of a value
    are numbered in spans of tie, so neither a key nor a value needs one task. Names of rows other than key, value and
    tie are not carried."""
    rows = rows.select(key, value, tie)
    values = rows.groupBy(key, value).agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1).cast("long"))
    placed = running(values, [key], [value], {"_upto": "_n", "_d": "_one"}, width)
    of = [F.col(c).alias(f"_of_{c}") for c in (key, value)]
    placed = placed.select(*of, (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", F.col("_d").cast("int").alias("d"), F.col("_upto_all").alias("_all"))
    numbered = running(rows.withColumn("_one", F.lit(1).cast("long")), [key, value], [tie], {"_i": "_one"}, tie_width)
    same = F.col(key).eqNullSafe(F.col(f"_of_{key}")) & F.col(value).eqNullSafe(F.col(f"_of_{value}"))
    found = numbered.join(placed, same).withColumn("_at", F.col("_before") + F.col("_i") - 1)
    small, more = F.floor(F.col("_all") / tiles), F.col("_all") % tiles  # the first `more` tiles have one row more
    large = more * (small + 1)
    tile = F.when(F.col("_at") < large, F.floor(F.col("_at") / (small + 1))).otherwise(more + F.floor((F.col("_at") - large) / F.greatest(small, F.lit(1))))
    share = F.when(F.col("_all") > 1, F.col("_before") / (F.col("_all") - 1)).otherwise(0.0)
    return found.select(key, value, tie, (F.col("_before") + 1).cast("int").alias("r"), "d", (tile + 1).cast("int").alias("quarter"), share.alias("p"), (F.col("_upto") / F.col("_all")).alias("c"))
