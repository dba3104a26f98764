"""Exact nearest vectors: cells around pivots, of which a query visits only those that can still hold one of its nearest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import kept

#: Angles are bounded by others within this; it covers what rounding does to them.
SLACK = 1e-6
#: A task's side of a comparison holds so many components at most (4 MB), or one vector.
ROOM = 1 << 19
KEYS = ["group", "width", "cell"]


def nearest(rows: DataFrame, asked: Column, k: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", pivots: int | None = None, sample: int = 4096, seed: int = 5) -> DataFrame:
    """(id_col, other_id, cosine, rank, compared): for each row where `asked` holds, the k rows of the same group with
    another id that have the greatest cosine (all, if fewer), by cosine, then by smaller id. `compared` is the number of
    rows that the query was compared with to find them. The result is exact, whatever the pivots are.

    Angles between vectors are a metric. Each row stands in the cell of its nearest pivot, and a cell is known by its
    number of rows and the least and greatest angle to its pivot. A query's angles to the pivots tell how near a cell's
    rows can be at best. It visits its best cells until they hold enough rows; the k-th angle found there bounds what
    other cells must be able to hold to be visited then. Clustered vectors leave most cells unvisited; vectors without
    clusters in many dimensions leave few, which costs comparisons, not rows.

    Cells and their queries are cut into parts of bounded size, and a part gives k rows for each query, so no cell, group
    or number of queries needs one task. `pivots` of at most `sample` vectors (by hash) are chosen on the driver, each the
    farthest from those before. Without a number it is half the root of the number of rows (at most `sample`), so that a
    query's pivots and the rows of a cell grow alike.

    Rows without an id, group or vector, and with a vector that is empty, zero or holds a null or non-finite component take
    no part; nor do vectors of different lengths meet. Rows that repeat id, group and vector are one row, asked if one of
    them is; an id with several vectors is asked with each, may be a neighbour with each, and is none of itself. Of equal
    vectors no more than k + 1 ids are compared, the smallest. Other columns play no part; an empty table gives an empty result."""
    vector, kind = F.col(vector_col), dict(rows.dtypes)[vector_col]
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).alias("group"), (vector if kind == "array<float>" else vector.cast("array<double>")).alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = own.where(F.col("id").isNotNull() & F.col("group").isNotNull() & F.col("vector").isNotNull()).where(~bad & F.exists("vector", lambda x: x != 0))
    own = kept(own.groupBy("group", "vector", "id").agg(F.max("asked").alias("asked")), "nearest-rows")
    drawn = own.orderBy(F.xxhash64("id", "vector", F.lit(seed)), "id").limit(sample).select("vector").toArrow()
    pivots = pivots or max(1, int(own.count() ** 0.5) // 2)
    centres = _centres([np.array(v, float) for v in drawn.column(0).to_pylist()], pivots)

    first = F.row_number().over(Window.partitionBy("group", "vector").orderBy("id"))
    some = own.withColumn("of_equal", first).where(F.col("of_equal") <= k + 1)
    placed = kept(_placed(some.select("id", "group", "vector"), centres), "nearest-cells")
    cells = kept(placed.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most")), "nearest-sizes")
    queries = kept(own.where("asked").select(F.monotonically_increasing_id().alias("q"), "id", "group", "vector").withColumn("width", F.size("vector")), "nearest-queries")

    start = kept(_chosen(queries.withColumn("limit", F.lit(None).cast("double")), cells, centres, k), "nearest-first")
    found = kept(_best(_compared(placed, queries, cells, start, k), k), "nearest-found")
    reach = found.groupBy("q").agg(F.when(F.count("*") == k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("cosine"))))).alias("limit"))
    more = queries.join(reach, "q", "left").withColumn("limit", F.coalesce("limit", F.lit(np.pi)))
    more = kept(_chosen(more, cells, centres, k), "nearest-more")
    found = _best(found.drop("rank").unionByName(_compared(placed, queries, cells, more, k)), k)
    visited = start.unionByName(more).groupBy("q").agg(F.sum("n").alias("compared"))
    return found.join(visited, "q").select(F.col("id").alias(id_col), "other_id", "cosine", "rank", "compared")


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1)[:, None]  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1, 1))


def _centres(drawn: list[np.ndarray], n: int) -> dict[int, np.ndarray]:
    """For each length of the drawn vectors up to n of them, as unit vectors, each the farthest from those before."""
    out = {}
    for width in {len(v) for v in drawn}:
        unit = _unit(np.array([v for v in drawn if len(v) == width]))
        far, picked = np.full(len(unit), np.inf), [0]
        while len(picked) < min(n, len(unit)):
            far = np.minimum(far, _angles(unit, unit[picked[-1:]])[:, 0])
            if far.max() <= SLACK:
                break
            picked.append(int(far.argmax()))
        out[width] = unit[picked]
    return out


def _by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a column of vectors each length, its places, and its vectors as one array."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    widths = np.diff(ends)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        yield int(width), own, values[ends[own][:, None] + np.arange(width)].astype(float)


def _placed(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """rows with their length, the nearest pivot (-1 where their length has none) and the angle to it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, cell, angle = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for width, own, vectors in _by_width(batch.column("vector")):
                widths[own] = width
                if width in centres:
                    angles = _angles(_unit(vectors), centres[width])
                    cell[own], angle[own] = angles.argmin(axis=1), angles.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (widths, cell, angle))], [*batch.schema.names, "width", "cell", "angle"])

    return rows.mapInArrow(place, f"{_ddl(rows)}, width int, cell int, angle double")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)


def _chosen(queries: DataFrame, cells: DataFrame, centres: dict[int, np.ndarray], k: int) -> DataFrame:
    """(q, group, width, cell, n): the cells that a query visits. Without a limit these are the best until they hold more
    than k rows; with one, those of the others that can hold a row within this angle."""
    lists = cells.groupBy("group", "width").agg(F.sort_array(F.collect_list(F.struct("cell", "n", "least", "most"))).alias("cells"))
    # a group has a cell for each pivot at most
    lists = lists.select("group", "width", *[F.col(f"cells.{c}").alias(c) for c in ("cell", "n", "least", "most")])
    rows = queries.select("q", "group", "width", "vector", "limit").join(lists, ["group", "width"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limit = batch.column("limit").to_numpy(zero_copy_only=False)
            lists = {c: (batch.column(c).values.to_numpy(), batch.column(c).offsets.to_numpy()) for c in ("cell", "n", "least", "most")}
            row, cell, n = [], [], []
            for width, own, vectors in _by_width(batch.column("vector")):
                angles = _angles(_unit(vectors), centres[width]) if width in centres else None
                for i, at in enumerate(own):
                    names, sizes, least, most = (values[ends[at] : ends[at + 1]] for values, ends in lists.values())
                    bound = np.zeros(len(names))
                    if angles is not None:
                        to = angles[i][names]
                        # by the ring around the pivot, and by the rows' being nearer to it than to the query's own pivot
                        bound = np.maximum(np.maximum(to - most, least - to), (to - angles[i].min()) / 2)
                    order = np.argsort(bound, kind="stable")
                    start = int(np.searchsorted(np.cumsum(sizes[order]), k + 1)) + 1
                    take = order[:start]
                    if not np.isnan(limit[at]):
                        take = order[start:]
                        take = take[bound[take] <= limit[at] + SLACK]
                    row.append(np.full(len(take), at))
                    cell.append(names[take])
                    n.append(sizes[take])
            if not row:
                continue
            at = pa.array(np.concatenate(row))
            columns = [batch.column(c).take(at) for c in ("q", "group", "width")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(cell)), pa.array(np.concatenate(n))], ["q", *KEYS, "n"])

    group = dict(queries.dtypes)["group"]
    return rows.mapInArrow(choose, f"q long, `group` {group}, width int, cell int, n long")


def _compared(placed: DataFrame, queries: DataFrame, cells: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """(q, id, other_id, cosine): of each part of a visited cell the k best rows for each of its queries."""
    pieces = lambda n: F.greatest(F.lit(1), F.ceil(n * F.col("width") / F.lit(float(ROOM)))).cast("int")
    wanted = visits.groupBy(*KEYS).agg(F.count("*").alias("asking")).join(cells, KEYS)
    wanted = kept(wanted.select(*KEYS, pieces(F.col("n")).alias("parts"), pieces(F.col("asking")).alias("tiles")), "nearest-visits")
    dealt = lambda spread, by: F.pmod(spread, F.col(by)).cast("int")
    every = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    keys = [*KEYS, "part", "tile"]
    left = placed.join(wanted, KEYS).withColumn("part", dealt(F.xxhash64("id", "vector"), "parts")).withColumn("tile", every("tiles")).select(*keys, "id", "vector")
    right = visits.join(wanted, KEYS).withColumn("tile", dealt(F.xxhash64("q"), "tiles")).withColumn("part", every("parts"))
    right = right.select(*keys, "q").join(queries.select("q", "id", "vector"), "q").select(*keys, "q", "id", "vector")

    def best(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, np.int64),) * 3 + (np.empty(0),)]
        if len(rows) and len(asking):
            ids, unit = rows["id"].to_numpy(), _unit(np.stack(rows["vector"]).astype(float))
            q, own, of = asking["q"].to_numpy(), asking["id"].to_numpy(), _unit(np.stack(asking["vector"]).astype(float))
            for a in range(0, len(q), 128):
                close = of[a : a + 128] @ unit.T
                close[own[a : a + 128, None] == ids] = -np.inf
                enough = np.partition(close, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
                for i, (scores, least) in enumerate(zip(close, enough, strict=True), a):
                    c = np.flatnonzero((scores >= least - 1e-9) & (scores > -np.inf))
                    # products added up alike for each row, so that equal vectors have equal cosines
                    cosine = (unit[c] * of[i]).sum(axis=1)
                    o = np.lexsort((ids[c], -cosine))[:k]
                    out.append((np.full(len(o), q[i]), np.full(len(o), own[i]), ids[c][o], cosine[o]))
        return pd.DataFrame(dict(zip(("q", "id", "other_id", "cosine"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "q long, id long, other_id long, cosine double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "other_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
