"""Embedding near-duplicates by spherical-cap filters with a structured random product code.

A filter is a direction, and a vector is in it if it points that way closely enough. Directions come from a product of
small random codes over the parts of the rotated space, so the filters a vector is in are listed from its few scores
against the parts' codes, not by trying all directions. Near vectors share filters; those who share one are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import Forest, groups, in_tiles, stage


#: Filters that a vector of few components is in, on average.
NARROW = 40


class Code:
    """turns * codes ** parts directions in `width` dimensions: in each of several random rotations, every choice of a
    code for each part. A unit vector is in those directions' filters to which its angle has a cotangent of at least
    deviations / sqrt(width - 1). For wide vectors these are so many standard deviations of a random vector's product;
    for narrow ones the cap stays wide enough that near vectors share it: over a third of a vector's filters are those
    of one at cosine 0.93, whatever the width. Several rotations keep the number of a vector's filters from varying much.

    Vectors of fewer than 8 components a part are cut into no parts. Their caps are large shares of the sphere, so
    there are as many directions as put a vector into NARROW filters on average."""

    def __init__(self, width: int, turns: int, parts: int, codes: int, deviations: float, seed: int) -> None:
        rng = np.random.default_rng([seed, width])
        cotangent = deviations / np.sqrt(max(width - 1, 1))
        self.least = cotangent / np.sqrt(1 + cotangent**2)
        self.parts, self.codes = parts, codes
        if width < 8 * parts:
            self.parts, self.codes = 1, int(np.ceil(NARROW / turns / _share(width, self.least)))
        self.cuts = [width * k // self.parts for k in range(self.parts + 1)]
        self.turns = []
        for _ in range(turns):
            rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
            tables = [rng.standard_normal((self.codes, b - a)) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
            # parts of unequal width weigh by their width, so that every direction has length 1
            self.turns.append((rotation, [t / np.linalg.norm(t, axis=1)[:, None] * np.sqrt(t.shape[1] / width) for t in tables]))

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row of unit vectors the ascending numbers of its filters: choices are made part by part, and left
        when even the best codes for the parts to come can't reach the least product."""
        rows, numbers = [], []
        for turn, (rotation, tables) in enumerate(self.turns):
            turned = unit @ rotation
            scores = [turned[:, a:b] @ t.T for a, b, t in zip(self.cuts, self.cuts[1:], tables, strict=False)]
            most = [s.max(axis=1) for s in scores]
            row, number, total = np.arange(len(unit)), np.full(len(unit), turn, np.int64), np.zeros(len(unit))
            for k, s in enumerate(scores):
                more = sum(most[k + 1 :], np.zeros(len(unit)))
                sums = total[:, None] + s[row]
                i, code = np.nonzero(sums + more[row][:, None] >= self.least)
                row, number, total = row[i], number[i] * self.codes + code, sums[i, code]
            rows.append(row)
            numbers.append(number)
        row, number = np.concatenate(rows), np.concatenate(numbers)
        order = np.lexsort((number, row))
        return np.split(number[order].astype(np.int32), np.cumsum(np.bincount(row, minlength=len(unit)))[:-1])


def _share(width: int, least: float) -> float:
    """The share of the unit sphere whose product with a direction is at least `least`."""
    if width == 1:
        return 0.5
    angle = (np.arange(100_000) + 0.5) / 100_000 * np.pi
    weight = np.sin(angle) ** (width - 2)
    return float(weight[np.cos(angle) >= least].sum() / weight.sum())


def _valid(vector: Column) -> Column:
    """No null or non-finite component, and one that isn't zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def near_vectors(rows: DataFrame, least: float = 0.93, turns: int = 12, parts: int = 2, codes: int = 64, deviations: float = 3.33, tile: int = 512, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of rows.

    Vectors are compared if their labels are equal and not null and their lengths are equal; two are linked if their
    cosine in double precision is at least `least`. n_links counts a vector's links, component_id is the smallest id
    reachable, kept is true for the row that has it. Links are those that share a filter: with the parameters as they
    are a vector of 64 components is in about 36 of 49,152 filters, and one at cosine 0.93 in nearly half of the same
    ones, so fewer than one pair in a hundred at 0.93 is missed, and far fewer above. A link found is never below `least`.

    A filter's size grows with the number of vectors, and its comparisons with the square. For 100 times as many vectors
    take 10 times as many codes (100 times as many directions) and deviations for a cap of a hundredth of the share; a
    cap so small needs more turns for the same recall.

    Equal vectors are one class with a count from the start and never make pairs. Filters with very many vectors are
    compared in tiles of bounded size; a tile gives numbers of links and a spanning forest, not all pairs.

    Null or zero vectors, and those with null or non-finite components, link with nothing, nor do rows without a label:
    they are kept with themselves as component. Ids that repeat are rows like others; a null id is the component's only
    if all ids in it are null. An empty table gives an empty result.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("long").alias("label"))
    rows = rows.withColumn("valid", F.coalesce(F.col("label").isNotNull() & _valid(F.col("vector")), F.lit(False)))
    classes = rows.where("valid").groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = stage(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")

    kind = "<f4" if dict(rows.dtypes)["vector"] == "array<float>" else "<f8"  # as given: nothing is rounded

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Code] = {}
        for batch in batches:
            vectors = [np.array(v, float) for v in batch.column(2).to_pylist()]
            filters: list = [None] * len(vectors)
            for width in {len(v) for v in vectors}:
                own = [i for i, v in enumerate(vectors) if len(v) == width]
                code = made.setdefault(width, Code(width, turns, parts, codes, deviations, seed))
                for k in range(0, len(own), 512):
                    part = own[k : k + 512]
                    for i, f in zip(part, code.filters(_unit(np.array([vectors[j] for j in part]))), strict=True):
                        filters[i] = f
            columns = [batch.column(0), batch.column(1), pa.array([len(v) for v in vectors], pa.int32()), batch.column(3), pa.array([v.astype(kind).tobytes() for v in vectors], pa.binary()), pa.array(filters, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["class", "label", "width", "n", "vector", "filters"])

    found = classes.select("class", "label", "vector", "n").mapInArrow(decode, "class long, label long, width int, n long, vector binary, filters array<int>")
    found = stage(found, "vector-filters")
    keys = ["label", "width", "filter"]
    light = found.select("class", "label", "width", F.explode("filters").alias("filter"))
    sizes = stage(light.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1"), "filter-sizes")
    tiles = in_tiles(light.join(sizes, keys), "size", keys, F.xxhash64("class"), tile)
    heavy = found.select("class", "n", "vector", "filters")
    tiled = [*keys, "tile_i", "tile_j"]
    tiles = tiles.join(heavy, "class").select(*tiled, "own", "class", "n", "vector", "filters").repartition(*tiled).sortWithinPartitions(*tiled)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(_as_bytes(batches), 5):
            link, a, b = _links(group, least, kind)
            if len(link):
                yield pa.RecordBatch.from_arrays([pa.array(link), pa.array(a), pa.array(b)], ["link", "a", "b"])

    links = stage(tiles.mapInArrow(work, "link boolean, a long, b long"), "vector-links")
    counts = links.where("not link").groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("others"))
    component = connected_components(links.where("link").select("a", "b")).select(F.col("node").alias("class"), F.col("component").alias("root"))
    named = classes.select("class", "first", "n").join(component, "class", "left").withColumn("root", F.coalesce("root", "class"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage(named.join(stage(names, "component-names"), "root").join(counts, "class", "left").select("class", "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "vector-components")
    classes = stage(classes.select("class", "label", "vector").join(named, "class").select("label", "vector", "component_id", "n_links"), "classes-named")
    good = rows.where("valid").join(classes, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1)[:, None]  # so that squares neither overflow nor vanish
    return v / np.linalg.norm(v, axis=1)[:, None]


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters as bytes, since their number differs from row to row."""
    for batch in batches:
        lists = batch.column(9)
        values, ends = lists.values.to_numpy().astype(np.int32, copy=False), lists.offsets.to_numpy()
        packed = pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:9], packed], batch.schema.names)


def _links(group: list[np.ndarray], least: float, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile: for each class the number of vectors linked to it (False, class, number), and a spanning forest of
    the links (True, class, class). A pair counts in the smallest filter that both are in, and only there."""
    _, _, number, tile_i, tile_j, own, name, n, vector, filters = group
    left = np.flatnonzero(own == tile_i[0])
    right = np.flatnonzero(own == tile_j[0]) if tile_i[0] != tile_j[0] else left
    unit = _unit(np.frombuffer(b"".join(vector), kind).astype(float).reshape(len(vector), -1))
    close = unit[left] @ unit[right].T >= least
    if tile_i[0] == tile_j[0]:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    empty = np.empty(0, np.int64)
    if not len(i):
        return empty.astype(bool), empty, empty
    a, b = left[i], right[j]
    forest = Forest(len(name))
    forest.link(a, b)
    used, place = np.unique(np.r_[a, b], return_inverse=True)
    lists = [f[f < number[0]] for f in (np.frombuffer(filters[u], np.int32) for u in used)]
    code = np.unique(np.concatenate(lists))
    if len(code):
        member = np.zeros((len(used), len(code)), np.float32)
        member[np.repeat(np.arange(len(used)), [len(f) for f in lists]), np.searchsorted(code, np.concatenate(lists))] = 1
        first = (member @ member.T)[place[: len(a)], place[len(a) :]] == 0
        a, b = a[first], b[first]
    others = np.bincount(np.r_[a, b], np.r_[n[b], n[a]].astype(float), len(name)).astype(np.int64)
    linked = np.flatnonzero(others)
    child, parent = forest.edges()
    return np.r_[np.zeros(len(linked), bool), np.ones(len(child), bool)], np.r_[name[linked], name[child]], np.r_[others[linked], name[parent]]
