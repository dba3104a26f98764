"""What several operators of this subpackage use: staged tables, sorted groups inside tasks, tiles of large buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.sources.shared import new_path

#: A word is a run of anything but these ASCII blanks; Python's bytes.split() without arguments cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


#: Rows that go to Python at a time: whole texts are long, and both sides hold a batch or two of them.
_BATCH, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, the session hands few rows at a time to Python; results don't depend on it."""
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= _BATCH_ROWS:
        spark.conf.set(_BATCH, str(_BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back. It cuts the lineage, outlives lost executors, and fixes the
    rows, so that later jobs over the table agree."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a Python worker keeps from task to task.
_TABLES: dict[str, object] = {}


def worker_table(name: str | None = None, make: Callable[[], object] | None = None) -> object:
    """The worker's table of this name, made if there is none. Tables of other names, which earlier tasks of other
    operators left, are dropped; without a name all are."""
    for other in [x for x in _TABLES if x != name]:
        del _TABLES[other]
    if name is None:
        return None
    if name not in _TABLES:
        _TABLES[name] = make()
    return _TABLES[name]


def words(text: Column) -> Column:
    """The words of a text as an array; empty for a null or blank text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def rows_of(batch: pa.RecordBatch, at_once: int = 256) -> Iterator[tuple]:
    """The rows of a batch, with Python objects for a few of them at a time."""
    for k in range(0, batch.num_rows, at_once):
        yield from zip(*(c.to_pylist() for c in batch.slice(k, at_once).columns), strict=True)


def with_python_column(df: DataFrame, name: str, kind: str, columns: list[Column], work: Callable[..., object]) -> DataFrame:
    """df with a column `name` of type `kind`: work of each row's values of `columns`. Python gets few rows at a time as
    objects, and sees each row once, whatever is filtered later. A column of df with that name is replaced."""
    own = df.drop(name)
    inner = own.select("*", *[c.alias(f"_tm_arg{i}") for i, c in enumerate(columns)])
    schema = T.StructType([*own.schema.fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])
    target, n = to_arrow_schema(schema).field(name).type, len(own.columns)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_table()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made = [work(*values) for values in zip(*(c.to_pylist() for c in part.columns[n:]), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(made, target)], names=[*part.schema.names[:n], name])

    return inner.mapInArrow(give, schema)


def numpy_columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Columns as arrays; a list column with equally long lists as one of two dimensions."""
    out = []
    for column in batch.columns:
        if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
            flat = column.flatten().to_numpy(zero_copy_only=False)
            out.append(flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0))
        else:
            out.append(column.to_numpy(zero_copy_only=False))
    return out


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[np.ndarray]]:
    """From batches sorted by their first n_keys columns (integers without nulls), the columns of each key's rows.
    It holds one batch and one group in memory; callers bound the groups."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = numpy_columns(batch)
        keys = np.stack([c.astype(np.int64) for c in columns[:n_keys]], axis=1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], len(keys)]
        for start, end in zip(starts, ends, strict=True):
            part = [c[start:end] for c in columns]
            if held and any(held[-1][i][-1] != part[i][0] for i in range(n_keys)):
                yield [np.concatenate(c) for c in zip(*held, strict=True)] if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)] if len(held) > 1 else held[0]


def in_tiles(members: DataFrame, size: str, keys: list[str], spread: Column, tile: int) -> DataFrame:
    """Cuts buckets into tiles of bounded size, so that all pairs within a bucket meet without one task having it whole.

    members has a row per member, with its bucket's keys and (in `size`) its bucket's number of rows. A bucket of more
    than `tile` rows is dealt into blocks by `spread` (an integer that is even over the members); the result has each
    row once for every pair of blocks (tile_i <= tile_j) that holds its block. A row with `own` = tile_i is on the
    first side, with own = tile_j on the second; a pair of members meets in exactly one tile when callers compare
    first with second side, and on tiles with tile_i = tile_j each pair once. Rows grow by the number of blocks, the
    least that lets all pairs of a bucket meet in tasks of bounded memory.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(float(tile)))).cast("int")
    own = F.pmod(spread, blocks).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"tile_i": F.least("own", "other"), "tile_j": F.greatest("own", "other")}).drop("other", "blocks", size)


class Forest:
    """Union-find over 0..n-1 on arrays: links come in bulk, roots are the smallest members."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while ((up := root[root]) != root).any():
                root[:] = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """A star for each component: the members that are no root, and their roots."""
        own = np.flatnonzero(self.root != np.arange(len(self.root)))
        return own, self.root[own]
