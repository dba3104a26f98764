"""Joins of ranges that overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType

from tidemark.sources.shared import kept

#: Each level of bins is so many times as wide as the one below; ranges beyond the last level's width are in one bin for all.
FACTOR, LEVELS = 8, 20
TOP = LEVELS + 1


def _place(at: Column, kind: DataType) -> Column:
    """at as a double, never less for a later at: in seconds for dates and times."""
    if isinstance(kind, TimestampNTZType):  # without a time zone, in which clocks could go back
        seconds = F.unix_date(at.cast("date")).cast("double") * 86400.0 + F.hour(at) * 3600 + F.minute(at) * 60
        return seconds + F.extract(F.lit("SECOND"), at).cast("double")
    if isinstance(kind, TimestampType):
        return F.unix_micros(at) / F.lit(1e6)
    if isinstance(kind, DateType):
        return F.unix_date(at).cast("double") * 86400.0
    if isinstance(kind, NumericType):
        return at.cast("double")
    raise ValueError(f"ranges of {kind.simpleString()} have no order to cut into bins")


def _levelled(rows: DataFrame, ends: tuple[str, str], width: float) -> DataFrame:
    """rows that are a range, with places _from and _to and the least level whose bins are no narrower than the range."""
    low, high = ends
    placed = rows.where(F.col(low) < F.col(high)).withColumns({"_from": _place(F.col(low), rows.schema[low].dataType), "_to": _place(F.col(high), rows.schema[high].dataType)})
    placed = placed.where(~F.isnan("_from") & ~F.isnan("_to"))
    size = (F.col("_to") - F.col("_from")) / F.lit(float(width))
    level = F.greatest(F.lit(0.0), F.ceil(F.log(F.greatest(size, F.lit(1.0))) / F.log(F.lit(float(FACTOR)))).cast("double"))
    return placed.withColumn("_level", F.when(size < float(FACTOR) ** LEVELS, F.least(level, F.lit(float(LEVELS)))).otherwise(TOP).cast("int"))


def _bin(place: Column, level: Column, width: float) -> Column:
    return F.when(level == TOP, F.lit(0).cast("long")).otherwise(F.floor(place / (F.lit(float(width)) * F.pow(F.lit(float(FACTOR)), level))))


def _spread(rows: DataFrame, others: list[int], width: float) -> DataFrame:
    """A row for each bin that a range meets, on its own level (_home) and on those above that the other side has."""
    above = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col("_level"))
    found = rows.withColumn("_at", F.explode(F.concat(F.array("_level"), above))).withColumn("_home", F.col("_at") == F.col("_level"))
    return found.withColumn("_bin", F.explode(F.sequence(_bin(F.col("_from"), F.col("_at"), width), _bin(F.col("_to"), F.col("_at"), width)))).drop("_level", "_to")


def interval_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], width: float, by: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Pairs of a range of left and one of right that overlap (low < the other's high, on both sides) and are equal in
    `by`. Ends are columns of numbers, dates or times; a range has its low end and not its high one. how: inner, left,
    left_semi or left_anti. `width`, near the usual length of a range (seconds for dates and times), changes only the cost.

    Both sides are copied to bins, and a pair counts in the bin of the later start only, which both ranges meet; so it is
    an equal join, and each pair comes once. A range stands on the level of bins that are no narrower than itself, in two
    bins or so, and shorter ones of the other side are copied to that level too: the number of a range's copies is bounded
    by the number of levels, however long it is. Bins of a level that one long range shares with a whole table are skewed
    on one side only, which adaptive execution splits.

    A range with a null or NaN end, or whose low end isn't below its high one, overlaps nothing; infinite ends are ends
    like others. Null keys match nothing. Left rows without a pair come once with nulls (left) or alone (left_anti).
    Repeated rows are rows of their own. Columns of right that left has too, other than `by`, are an error.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how is inner, left, left_semi or left_anti, not {how}")
    clash = (set(left.columns) & set(right.columns)) - set(by)
    if clash and how in ("inner", "left"):
        raise ValueError(f"columns of both sides: {', '.join(sorted(clash))}")
    whole = left
    if how != "inner":  # rows are numbered once, so that those with a pair can be told
        whole = kept(left.withColumn("_row", F.monotonically_increasing_id()), "intervals")
    keys = [f"_by{i}" for i in range(len(by))]
    named = {k: F.col(b) for k, b in zip(keys, by, strict=True)}
    sides = [_levelled(side.withColumns({**named, "_low": F.col(e[0]), "_high": F.col(e[1])}), e, width) for side, e in ((whole, left_ends), (right, right_ends))]
    levels = [sorted(r["_level"] for r in side.select("_level").distinct().collect()) for side in sides]  # TOP + 1 at most
    own = ["_from", "_low", "_high", "_home"]
    a = _spread(sides[0], levels[1], width).select(F.struct(*whole.columns).alias("_left"), *keys, "_at", "_bin", *own)
    b = _spread(sides[1], levels[0], width).select(F.struct(*[c for c in right.columns if c not in by] or [F.lit(1).alias("_none")]).alias("_right"), *keys, "_at", "_bin", *[F.col(c).alias(f"{c}2") for c in own])
    later = _bin(F.greatest("_from", "_from2"), F.col("_at"), width)
    fits = (F.col("_home") | F.col("_home2")) & (F.col("_low") < F.col("_high2")) & (F.col("_low2") < F.col("_high")) & (F.col("_bin") == later)
    pairs = a.join(b, [*keys, "_at", "_bin"]).where(fits)
    rest = [c for c in right.columns if c not in by]
    if how == "inner":
        return pairs.select("_left.*", *[F.col("_right")[c].alias(c) for c in rest])
    if how == "left":
        found = pairs.select(F.col("_left._row").alias("_row"), *[F.col("_right")[c].alias(c) for c in rest])
        return whole.join(found, "_row", "left").drop("_row")
    return whole.join(pairs.select(F.col("_left._row").alias("_row")), "_row", how).drop("_row")
