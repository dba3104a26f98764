"""Hard negatives by product quantisation with stored residual norms.

A vector is stored as codes of its parts and the lengths of what the codes leave. An anchor's score with it lies within a
bound of the sum of looked-up scores, so rows that can't be among the first ones, or in a window, are passed over for
certain; those that can are scored exactly in integers, in the same task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import groups, stage

#: Most different lengths of vectors that get codes of their own; others have one code, zero, and long residuals.
WIDTHS = 16
#: Rows, and anchors, of one tile at most; anchors are scored a few at a time.
ROWS, ANCHORS, AT_ONCE = 1 << 16, 1 << 14, 32
#: Of a sum of products in double precision, so much of the lengths' product at most is lost to rounding.
SLACK = 1e-9


class Quantiser:
    """Codes of parts of `part` components each, fitted by k-means. Whatever the codes are, bounds hold; better ones are
    only tighter."""

    def __init__(self, sample: np.ndarray, part: int, codes: int, rounds: int = 6) -> None:
        width = sample.shape[1]
        self.cuts = [*range(0, width, part), width]
        self.tables = [_k_means(sample[:, a:b], codes, rounds) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, residual lengths), a column for each part."""
        code = np.zeros((len(vectors), len(self.tables)), np.uint8)
        left = np.zeros((len(vectors), len(self.tables)), np.float64)
        for k, (a, b, table) in enumerate(zip(self.cuts, self.cuts[1:], self.tables, strict=False)):
            own = vectors[:, a:b]
            code[:, k] = _nearest(own, table)
            left[:, k] = np.linalg.norm(own - table[code[:, k]], axis=1)
        return code, left

    def intervals(self, anchors: np.ndarray, code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high), a row for each anchor: bounds of its product with each vector. A part's share of the product
        differs from the looked-up one by the product of the anchor's length there and the residual's at most."""
        scores = np.zeros((len(code), len(anchors)))
        bound = np.zeros((len(code), len(anchors)))
        for k, (a, b, table) in enumerate(zip(self.cuts, self.cuts[1:], self.tables, strict=False)):
            scores += (table @ anchors[:, a:b].T)[code[:, k]]
            bound += left[:, k : k + 1] * np.linalg.norm(anchors[:, a:b], axis=1)
        size = np.zeros(len(code))
        for k, table in enumerate(self.tables):
            size += (np.linalg.norm(table, axis=1)[code[:, k]] + left[:, k]) ** 2
        bound += SLACK * np.sqrt(size)[:, None] * np.linalg.norm(anchors, axis=1) + SLACK
        return np.ascontiguousarray((scores - bound).T), np.ascontiguousarray((scores + bound).T)


def _nearest(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    for k in range(0, len(rows), 4096):
        own = rows[k : k + 4096]
        out[k : k + 4096] = ((table * table).sum(axis=1) - 2 * own @ table.T).argmin(axis=1)
    return out


def _k_means(rows: np.ndarray, codes: int, rounds: int) -> np.ndarray:
    table = np.unique(rows, axis=0)
    if len(table) <= codes:
        return table if len(table) else np.zeros((1, rows.shape[1]))
    table = table[np.linspace(0, len(table) - 1, codes).astype(int)]
    for _ in range(rounds):
        own = _nearest(rows, table)
        n = np.bincount(own, minlength=codes)
        sums = np.stack([np.bincount(own, rows[:, d], codes) for d in range(rows.shape[1])], axis=1)
        table = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], table)
    return table


def _first(score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties by smaller name."""
    return np.lexsort((name, -score))[:k]


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, minus infinity if there are fewer."""
    return -np.inf if len(values) < k else np.partition(values, len(values) - k)[len(values) - k]


def _tiled(vectors: DataFrame, anchors: DataFrame, keys: list[str], made: str, work: Callable[[list[np.ndarray], int], list]) -> DataFrame:
    """work of each tile: a block of the anchors and one of the vectors that are equal in `keys`, as columns side (0
    anchor, 1 vector), row, id, label, vector, codes, left and windows. A block has a bounded number of rows, and each
    block of the anchors meets each block of the vectors in one task; nothing else is in a task."""
    blocks = lambda n, most: F.ceil(F.col(n) / F.lit(float(most))).cast("int")
    sizes = vectors.groupBy(*keys).agg(F.count("*").alias("n")).join(anchors.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    sizes = stage(sizes.select(*keys, blocks("n", ROWS).alias("n"), blocks("m", ANCHORS).alias("m")), "tile-sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    carried = ["row", "id", "label", "vector", "codes", "left", "windows"]
    a = anchors.join(sizes, keys).select(*keys, own("m").alias("i"), every("n").alias("j"), F.lit(0).alias("side"), *[F.col(c).alias(f"_{c}") for c in carried])
    v = vectors.join(sizes, keys).select(*keys, every("m").alias("i"), own("n").alias("j"), F.lit(1).alias("side"), *[(F.lit(None).cast("string") if c == "windows" else F.col(c)).alias(f"_{c}") for c in carried])
    tile = [*keys, "i", "j"]
    tiles = a.unionByName(v).repartition(*tile).sortWithinPartitions(*tile)
    width = tile.index("width")

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, len(tile)):
            columns = work(group[len(tile) :], int(group[width][0]))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in made.split(", ")])

    return tiles.mapInArrow(give, made)


def _sides(columns: list[np.ndarray], width: int, quantisers: dict[int, Quantiser]) -> tuple:
    """Of a tile: the anchors as (row, id, label, integers, windows), the vectors as (row, id, label, integers), and
    bounds(k): low and high of anchor k's scores, worked out for a few anchors at a time."""
    side, row, name, label, vector, codes, left, windows = columns
    a, v = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    quantiser, held = quantisers[width] if width in quantisers else _plain(width), {}
    whole = lambda at, own, kind, n: np.frombuffer(b"".join(own[at]), kind).reshape(len(at), n)
    ours, theirs = whole(a, vector, "<i4", width).astype(np.int64), whole(v, vector, "<i4", width).astype(np.int64)
    code, rest = whole(v, codes, "u1", len(quantiser.tables)), whole(v, left, "<f8", len(quantiser.tables))

    def bounds(k: int) -> tuple[np.ndarray, np.ndarray]:
        start = k // AT_ONCE * AT_ONCE
        if start not in held:
            held.clear()
            held[start] = quantiser.intervals(ours[start : start + AT_ONCE].astype(float), code, rest)
        low, high = held[start]
        return low[k - start], high[k - start]

    return (row[a], name[a], label[a], ours, windows[a]), (row[v], name[v], label[v], theirs), bounds


def _plain(width: int) -> Quantiser:
    return Quantiser(np.zeros((1, width)), max(width, 1), 1)


def encoded(rows: DataFrame, part: int = 2, codes: int = 256, sample: int = 8192, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, dict[int, Quantiser]]:
    """(row, id, label, width, vector, codes, left) of the rows that take part (see mine), as a table in the shared
    folder, and the quantisers by length. They are fitted on `sample` rows at most, those with the least hashes; all rows
    get codes."""
    component = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    named = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", fine), F.lit(False)))
    named = named.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < (1 << 30) / float(scale), component(x))))
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.pow(x.cast("double"), F.lit(2)))
    named = named.where(squares < float(1 << 61)).distinct()  # a null component has a null sum
    table = stage(named.withColumns({"row": F.monotonically_increasing_id(), "width": F.size("v")}), "vectors")
    quantisers = {}
    least = table.orderBy(F.xxhash64("id", "label", "v")).limit(sample).select("width", "v").toPandas()
    for width in least["width"].value_counts().index[:WIDTHS]:
        if width:
            quantisers[int(width)] = Quantiser(np.stack(least["v"][least["width"] == width].to_list()).astype(float), part, min(codes, 256))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column(2).to_numpy()
            values = batch.column(3).flatten().to_numpy()
            ends = np.r_[0, np.cumsum(width)]
            packed: list = [None] * batch.num_rows
            for w in set(width.tolist()):
                own = np.flatnonzero(width == w)
                v = values[ends[own][:, None] + np.arange(w)]
                c, left = quantisers.get(w, _plain(w)).encode(v.astype(float))
                ints = v.astype("<i4")
                for k, i in enumerate(own):
                    packed[i] = (ints[k].tobytes(), c[k].tobytes(), left[k].astype("<f8").tobytes())
            made = [pa.array([p[k] for p in packed], pa.binary()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), batch.column(2), *made], ["row", "id", "label", "width", "vector", "codes", "left"])

    coded = table.select("row", "id", "width", "v", "label").mapInArrow(code, "row long, id long, label long, width int, vector binary, codes binary, left binary")
    return stage(coded, "vector-codes"), quantisers


def mine(rows: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, part: int = 2, codes: int = 256, sample: int = 8192, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (rows whose id makes
    `anchor`, a condition on column id, true) and each of its first n_positives rows of the same label, the first
    n_negatives rows of other labels whose score is between `low` and `high` hundredths of the positive's.

    A score is the integer product of two vectors whose components x became floor(scale * x); higher ones come first,
    ties by smaller id. All anchors meet all rows, in tiles of bounded size. Of each tile an anchor gives only its first
    rows there, n_positives or n_negatives for each positive, so a label or cluster with a third of all rows sends no more
    than others, and nothing is left out: rows are passed over only where the bounds prove that enough others are better,
    or that they are outside of the window.

    Rows without an id, without a label, or with a null vector or a null or non-finite component take no part, nor do
    those with a component of 2**30 or more after scaling or a sum of squares of 2**61 or more, whose scores might not fit
    a long. Vectors of different lengths aren't compared; empty ones have score 0. Equal rows count once; rows with one id
    but other labels or vectors are rows of their own, and none is a positive or negative of an anchor with its id. An
    empty table, or no anchor, gives an empty result.
    """
    table, quantisers = encoded(rows, part, codes, sample, scale, id_col, vector_col, label_col)
    anchors = table.where(anchor)

    def nearest(columns: list[np.ndarray], width: int) -> list:
        (row, own, _, ours, _), (_, name, _, theirs), bounds = _sides(columns, width, quantisers)
        out = []
        for k in range(len(row)):
            least, most = bounds(k)
            other = np.flatnonzero(name != own[k])
            other = other[most[other] >= _kth(least[other], n_positives)]
            score = theirs[other] @ ours[k]
            best = _first(score, name[other], n_positives)
            out.append((np.full(len(best), row[k]), name[other[best]], score[best]))
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else []

    found = _tiled(table, anchors.withColumn("windows", F.lit(None).cast("string")), ["label", "width"], "row long, id long, score long", nearest)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "id")
    positives = stage(found.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= n_positives), "positives")
    windows = positives.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "score"))), lambda p: p["score"].cast("string")), ",").alias("windows"))

    def hard(columns: list[np.ndarray], width: int) -> list:
        (row, own, label, ours, windows), (_, name, kind, theirs), bounds = _sides(columns, width, quantisers)
        out = []
        for k in range(len(row)):
            least, most = bounds(k)
            other = (kind != label[k]) & (name != own[k])
            wanted = []
            for score in map(int, windows[k].split(",")):
                a, b = -(-low * score // 100), high * score // 100  # exact: Python's own integers
                can = other & (most >= a) & (least <= b)
                sure = can & (least >= a) & (most <= b)
                wanted.append((a, b, can & (most >= _kth(least[sure], n_negatives))))
            some = np.flatnonzero(np.logical_or.reduce([w for _, _, w in wanted]))
            exact = theirs[some] @ ours[k]
            for slot, (a, b, can) in enumerate(wanted, 1):
                inside = some[can[some] & (exact >= a) & (exact <= b)]
                score = exact[np.searchsorted(some, inside)]
                best = _first(score, name[inside], n_negatives)
                out.append((np.full(len(best), row[k]), np.full(len(best), slot, np.int32), name[inside[best]], score[best]))
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else []

    mined = _tiled(table, anchors.join(windows, "row"), ["width"], "row long, slot int, negative_id long, negative_score long", hard)
    order = Window.partitionBy("row", "slot").orderBy(F.col("negative_score").desc(), "negative_id")
    mined = stage(mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives), "negatives")
    named = positives.select("row", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return mined.join(named, ["row", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle(embeddings: str) -> str:
    """The query over embeddings in one statement, by all scores of the anchors; ids are taken to be distinct."""
    return f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM {embeddings}
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10"""
