"""Users' own aggregates that merge, a quantile sketch as one, and exact percentiles by selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_
from typing import Generic, Protocol, TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from tidemark.sources.shared import kept

S = TypeVar("S")
#: Keys that a task holds states of at a time; beyond, it gives out what it has and starts anew.
HELD = 4096
#: Parts in which the states of one key are merged before the last merge.
PARTS = 32


class Aggregate(Protocol, Generic[S]):
    """A state that values are added to in bulk and that merges with others; pack and unpack make it bytes and back. The
    result must not depend on the order of values and merges, since tasks end in any order."""

    def zero(self) -> S: ...
    def add(self, state: S, values: np.ndarray) -> S: ...
    def merge(self, a: S, b: S) -> S: ...
    def pack(self, state: S) -> bytes: ...
    def unpack(self, data: bytes) -> S: ...


def states(rows: DataFrame, keys: Sequence[str], value: str, how: Aggregate, state: str = "state") -> DataFrame:
    """(keys, state): the packed state of each key's values, as doubles; nulls aren't added. A key has a state if it has a
    row. Keys are columns of any type that Arrow can compare; nulls are a key.

    Each task adds its rows to states by key and gives those out, so what is shuffled are states. They are merged one
    after the other from sorted partitions, in PARTS parts first, so a task holds two states of a key, however many tasks
    there were; a key with a third of all rows is like others."""
    plain = rows.select(*keys, F.col(value).cast("double").alias("_value"))
    schema = StructType([*plain.schema.fields[:-1], StructField(state, BinaryType())])
    target = to_arrow_schema(schema)

    def given(held: dict[tuple, S]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], target.field(i).type) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([how.pack(s) for s in held.values()], pa.binary())], schema=target)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, S] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch]).append_column("_at", pa.array(np.arange(batch.num_rows)))
            numbered = table.group_by(list(keys), use_threads=False).aggregate([("_at", "list")]) if keys else None
            values = batch.column(len(keys))
            places = numbered.column("_at_list").to_pylist() if keys else [range(batch.num_rows)] * bool(batch.num_rows)
            names = list(zip(*(numbered.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * len(places)
            for name, at in zip(names, places, strict=True):
                own = values.take(pa.array(at, pa.int64())).drop_null().to_numpy(zero_copy_only=False)
                held[name] = how.add(held[name] if name in held else how.zero(), own)
            if len(held) > HELD:
                yield given(held)
                held = {}
        if held:
            yield given(held)

    return merged(plain.mapInArrow(partial, schema), keys, how, state)


def merged(found: DataFrame, keys: Sequence[str], how: Aggregate, state: str = "state") -> DataFrame:
    """(keys, state): the states of found merged by keys, which may be fewer than those they were made for."""
    found = found.select(*keys, F.col(state).alias("_state"))
    schema = StructType([*found.schema.fields[:-1], StructField(state, BinaryType())])
    target = to_arrow_schema(schema)

    def merge(n: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, own = None, None
            for batch in batches:
                for *key, data in zip(*(c.to_pylist() for c in [*batch.columns[: len(keys)], batch.column(n)]), strict=True):
                    if own is not None and key == name:
                        own = how.merge(own, how.unpack(data))
                        continue
                    if own is not None:
                        yield one(name, own)
                    name, own = key, how.unpack(data)
            if own is not None:
                yield one(name, own)

        return work

    def one(name: list, own: S) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([x], target.field(i).type) for i, x in enumerate(name)], pa.array([how.pack(own)], pa.binary())], schema=target)

    parts = found.withColumn("_part", F.pmod(F.xxhash64("_state"), F.lit(PARTS))).select(*keys, "_part", "_state")
    parts = parts.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part").mapInArrow(merge(len(keys) + 1), schema)
    gathered = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.coalesce(1)
    return gathered.mapInArrow(merge(len(keys)), schema)


class Quantiles:
    """A sketch of quantiles: how many values there are in each of `size` ranges at most.

    Doubles are numbered in their order (as Spark's, NaN last), and a range has the numbers that are equal without their
    lowest `level` bits; the level is the least at which there are no more than `size` ranges with values. So a state
    depends on the values alone, not on the order of merges, and is exact while there are no more different values than
    ranges. Any quantile lies in a known range, and the values in it bound the error of its rank."""

    def __init__(self, size: int = 8192) -> None:
        self.size = size

    def zero(self) -> tuple[int, np.ndarray, np.ndarray]:
        return 0, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, state: tuple, values: np.ndarray) -> tuple:
        numbers, counts = np.unique(numbers_of(values), return_counts=True)
        return self.merge(state, (0, numbers, counts.astype(np.int64)))

    def merge(self, a: tuple, b: tuple) -> tuple:
        level = max(a[0], b[0])
        number = np.concatenate([a[1] >> (level - a[0]), b[1] >> (level - b[0])])
        count = np.concatenate([a[2], b[2]])
        while True:
            order = np.argsort(number, kind="stable")
            number, count = number[order], count[order]
            first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.empty(0, np.int64)
            number, count = number[first], np.add.reduceat(count, first) if len(first) else count
            if len(number) <= self.size:
                return level, number, count
            level, number = level + 1, number >> 1

    def pack(self, state: tuple) -> bytes:
        return np.r_[np.int64(state[0]), state[1], state[2]].astype("<i8").tobytes()

    def unpack(self, data: bytes) -> tuple:
        numbers = np.frombuffer(data, "<i8")
        half = len(numbers) // 2
        return int(numbers[0]), numbers[1 : half + 1], numbers[half + 1 :]

    def holding(self, state: tuple, rank: int) -> tuple[float, float, int, int]:
        """(low, high, before, within) of the range that has the value with `rank` (from 0) in order: its least and
        largest possible value, the values before the range, and those in it."""
        level, number, count = state
        ends = np.cumsum(count)
        at = int(np.searchsorted(ends, rank, "right"))
        ends_of_all = numbers_of(np.array([-np.inf, np.nan]))
        low, high = values_of(np.clip([number[at] << level, ((number[at] + 1) << level) - 1], *ends_of_all))
        return float(low), float(high), int(ends[at] - count[at]), int(count[at])


def numbers_of(values: np.ndarray) -> np.ndarray:
    """Integers in the order of doubles, -0.0 and 0.0 being one and NaN the largest."""
    values = np.where(np.isnan(values), np.nan, np.asarray(values, np.float64)) + 0.0
    bits = values.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))


def values_of(numbers: np.ndarray | np.int64) -> np.ndarray:
    numbers = np.asarray(numbers, np.int64)
    return (numbers ^ ((numbers >> 63) & np.int64((1 << 63) - 1))).view(np.float64)


def quantiles(sketches: DataFrame, fractions: dict[str, float], how: Quantiles, state: str = "state") -> DataFrame:
    """sketches with n (long, the number of values) and, for each name in fractions, the least value that so large a share
    of the values is not above, taken as the low end of its range, and {name}_error: the share of values in that range
    less one, which bounds the error of the rank. Nulls and 0 without values."""
    schema = StructType([*sketches.drop(state).schema.fields]).add("n", "long")
    for name in fractions:
        schema = schema.add(name, "double").add(f"{name}_error", "double")
    width = len(sketches.columns) - 1
    target = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in range(1 + 2 * len(fractions))]
            for data in batch.column(width).to_pylist():
                own = how.unpack(data)
                n = int(own[2].sum())
                made[0].append(n)
                for i, share in enumerate(fractions.values()):
                    low, _, _, within = how.holding(own, max(0, int(np.ceil(share * n)) - 1)) if n else (None, None, 0, 1)
                    made[1 + 2 * i].append(low)
                    made[2 + 2 * i].append((within - 1) / n if n else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *[pa.array(m, target.field(width + i).type) for i, m in enumerate(made)]], schema=target)

    return sketches.select(*[c for c in sketches.columns if c != state], state).mapInArrow(work, schema)


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], size: int = 4096) -> DataFrame:
    """(keys, n, and a column for each name in fractions): exact percentiles of a key's values that aren't null, between
    two values in proportion, as SQL's percentile_cont. Null where a key has none.

    Nothing is sorted and no task has a group: counts of `size` ranges of values (Quantiles) say which range a rank is in;
    the values of those ranges alone are counted again, in finer ranges, until each wanted range is one value. That is
    one pass over the table and, for doubles of any kind, up to five over what is left, about a size-th each time. NaN is
    the largest value. `size` is 16 or more, or ranges might not get finer."""
    if size < 16:
        raise ValueError("size must be 16 or more")
    how, shares = Quantiles(size), list(fractions.values())
    names = list(keys) or ["_all"]
    plain = rows.withColumn("_all", F.lit(0)).select(*names, F.col(value).cast("double").alias("_value"))
    first = states(plain, names, "_value", how, "_state").select(*names, "_state", *[F.lit(None).cast(kind).alias(c) for c, kind in _WANTED.items()])
    ranges = kept(_narrowed(first, names, how, shares), "percentile-ranges")
    single = F.col("_low").eqNullSafe(F.col("_high"))
    done, left = ranges.where(single), plain
    of = [F.col(k).alias(f"_of{i}") for i, k in enumerate(names)]
    same = [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(names)]
    while not (ranges := ranges.where(~single)).isEmpty():
        # the ranges of a key don't overlap; the values of one are counted once for all its ranks
        spans = kept(ranges.groupBy(*names, "_low", "_high").agg(F.min("_slot").alias("_span")).select(*of, "_low", "_high", "_span"), "percentile-spans")
        inside = reduce(and_, [*same, F.col("_value") >= F.col("_low"), F.col("_value") <= F.col("_high")])
        left = kept(left.join(spans, inside).select(*names, "_value", "_span"), "percentile-values")
        own = ranges.withColumnsRenamed({"_low": "_low0", "_high": "_high0"}).join(spans, reduce(and_, [*same, F.col("_low0") == F.col("_low"), F.col("_high0") == F.col("_high")]))
        own = own.select(*of, F.col("_span").alias("_of_span"), *_WANTED)
        counted = states(left, [*names, "_span"], "_value", how, "_state").join(own, reduce(and_, [*same, F.col("_span") == F.col("_of_span")]))
        ranges = kept(_narrowed(counted.select(*names, "_state", *_WANTED), names, how, shares), "percentile-ranges")
        done, left = done.unionByName(ranges.where(single)), left.drop("_span")
    wide = done.groupBy(*names).agg(F.max("_n").alias("n"), *[F.max(F.when(F.col("_slot") == k, F.col("_low"))).alias(f"_v{k}") for k in range(2 * len(shares))])

    def between(i: int, share: float) -> Column:
        low, high, place = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}"), F.lit(float(share)) * (F.col("n") - 1)
        return low + F.when(low == high, 0.0).otherwise((place - F.floor(place)) * (high - low))

    return wide.select(*keys, "n", *[between(i, share).alias(name) for i, (name, share) in enumerate(fractions.items())])


#: What is wanted of a state: a rank among its values (from 0), for a slot (two for each fraction) of a key with n values.
_WANTED = {"_slot": "integer", "_n": "long", "_rank": "long"}


def _narrowed(found: DataFrame, names: Sequence[str], how: Quantiles, shares: Sequence[float]) -> DataFrame:
    """(names, _slot, _n, _rank, _low, _high) from found (names, _state, and what is wanted of it; nulls: both neighbours
    of each share's place): the range that holds the rank, and the rank in it. A state without values has one row without
    a range."""
    schema = StructType([f for f in found.schema.fields if f.name in names])
    for name, kind in (*_WANTED.items(), ("_low", "double"), ("_high", "double")):
        schema = schema.add(name, kind)
    target = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            made: list[tuple] = []
            for i, (data, slot, n, rank) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_state", *_WANTED)), strict=True)):
                state = how.unpack(data)
                if slot is not None:
                    wanted = [(slot, n, rank)]
                elif n := int(state[2].sum()):
                    places = [share * (n - 1) for share in shares]
                    wanted = [(2 * k + up, n, int(np.ceil(x) if up else np.floor(x))) for k, x in enumerate(places) for up in (0, 1)]
                else:
                    at.append(i)
                    made.append((-1, 0, 0, None, None))
                    continue
                for slot, n, rank in wanted:
                    low, high, before, _ = how.holding(state, rank)
                    at.append(i)
                    made.append((slot, n, rank - before, low, high))
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([m[k] for m in made], target.field(len(names) + k).type) for k in range(5)]], schema=target)

    return found.mapInArrow(work, schema)
