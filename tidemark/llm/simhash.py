"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into segments of 32 bits, fewer than a search by equal segments would need: of two fingerprints
with fewer than twice as many differing bits as segments, one segment differs by one bit at most. Every segment value is
indexed under its one-wildcard variants; two values that share a variant differ in that bit alone. The members of such
neighbouring values, and of equal ones, are verified on the whole fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import Forest, groups, in_tiles, numpy_columns, rows_of, stage, worker_table

#: Shingles hashed at a time, so that a very long text needs no more memory than a short one's many times over.
RUN = 1 << 16


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """Other 64 bits for each hash (the finaliser of SplitMix64); turn 0 gives the hashes as they are."""
    if not turn:
        return h
    h = h + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _majority(runs: Iterator[np.ndarray], longs: int) -> list[int]:
    """64 * longs bits, each 1 if set in over half of the hashes."""
    ones, n = np.zeros((longs, 64), np.int64), 0
    for h in runs:
        n += len(h)
        for turn in range(longs):
            bits = np.unpackbits(_mixed(h, turn).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) // 255 * 255  # sums of 255 fit into a byte, which is fast
            ones[turn] += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<i8").ravel().tolist()


def _shingles(parts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles, repeats included, a run at a time; fewer words are one shingle."""
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    width = min(width, len(parts))
    starts, ends = starts[: len(parts) - width + 1], ends[width - 1 :]
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    for k in range(0, len(starts), RUN):
        yield np.array([digest(line[a:b]) for a, b in zip(starts[k : k + RUN].tolist(), ends[k : k + RUN].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of the word shingles (repeats included) of a text, A-Z in lower case: XXH64 with seed 42, and each bit 1
    that is set in over half the hashes. Texts of fewer words than `width` are one shingle; without words it is zero."""
    parts = text.lower().split() if text else []
    return _majority(_shingles(parts, width), 1)[0] if parts else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; other columns are not read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_table()
        for batch in batches:
            found = [fingerprint(t, width) for _, t in rows_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(work, "doc_id long, fp long")


#: Longs of the sketch of similar(), and its candidates' fingerprints: so many, each of so many minima.
CHECK, BANDS, MINIMA = 8, 20, 5
_TURNS = np.random.default_rng(7).integers(1, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bands(h: np.ndarray) -> np.ndarray:
    """BANDS fingerprints of a set of hashes: each is of the set's least hashes in MINIMA random orders. In one order two
    sets have the same least hash with a probability of their Jaccard similarity, whatever the difference looks like."""
    least = np.full(len(_TURNS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 4096):
        least = np.minimum(least, (h[k : k + 4096, None] * _TURNS).min(axis=0))
    least = least.reshape(BANDS, MINIMA)
    out = np.zeros(BANDS, np.uint64)
    for k in range(MINIMA):
        out = _mixed(out ^ least[:, k], k + 1)
    return out.view(np.int64)


def _wide(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, own, high, low, size, check, bands): a hash of the row's text, 128 bits of its words, and of its
    different shingles the number, a sketch whose differing bits measure the similarity, and the fingerprints by which
    near copies are found. Without words there are no fingerprints."""
    names = "doc_id long, own long, high long, low long, size int, check array<long>, bands array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_table()
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for _, _, text in rows_of(batch):
                parts = text.lower().split() if text else []
                word_hash = xxhash.xxh3_128_digest(b" ".join(parts))
                shingles = _once(parts, width)
                row = (*np.frombuffer(word_hash, "<i8").tolist(), len(shingles), _majority(iter([shingles]), CHECK) if parts else [0] * CHECK, _bands(shingles) if parts else [])
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out, kinds)], ["doc_id", "own", "high", "low", "size", "check", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("own"), F.col("text").cast("binary")).mapInArrow(work, names)


def _once(parts: list[bytes], width: int) -> np.ndarray:
    """The hashes of the different shingles, ascending."""
    return np.unique(np.concatenate(list(_shingles(parts, width)))) if parts else np.empty(0, np.uint64)


def near_links(fps: DataFrame, max_bits: int, tile: int = 1024) -> DataFrame:
    """Links (a, b) between the nodes of fps (node long, cut array of longs, check array of longs) that connect, by way
    of others in part, the nodes whose check has max_bits or fewer differing bits and that have a segment of cut with
    one differing bit at most. If cut and check are the same and max_bits is below twice the number of segments, that is
    all of the former. A bucket gives a spanning forest of its links, not all pairs."""
    width = F.lit(2).cast("int") * F.size("cut")
    parts = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.struct(i.alias("seg"), F.when(i % 2 == 0, F.element_at("cut", (i / 2).cast("int") + 1).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(F.element_at("cut", (i / 2).cast("int") + 1), 32)).alias("val")))
    values = fps.select("node", F.explode(parts).alias("p")).select("node", "p.seg", "p.val")
    counts = stage(values.groupBy("seg", "val").agg(F.count("*").alias("n")), "segment-values")
    spread = counts.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "val")
    variants = spread.select("seg", "val", "n", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("pos"))
    mask = F.expr("shiftleft(1L, pos)")
    variants = variants.select("seg", "pos", F.col("val").bitwiseAND(F.bitwise_not(mask)).alias("rest"), "n")
    near = variants.groupBy("seg", "pos", "rest").agg(F.count("*").alias("sides"), F.sum("n").alias("size")).where("sides = 2")
    # a bucket: the members of two neighbouring values, compared across, or those of one value (pos -1), compared among themselves
    across = near.select("seg", "pos", "rest", "size", F.explode(F.array(F.struct(F.col("rest").alias("val"), F.lit(0).alias("side")), F.struct(F.col("rest").bitwiseOR(mask).alias("val"), F.lit(1).alias("side")))).alias("v"))
    buckets = across.select("seg", "v.val", "pos", "rest", "size", "v.side").unionByName(
        counts.where("n > 1").select("seg", "val", F.lit(-1).alias("pos"), F.col("val").alias("rest"), F.col("n").alias("size"), F.lit(0).alias("side"))
    )
    members = values.join(stage(buckets, "buckets"), ["seg", "val"])
    tiles = in_tiles(members, "size", ["seg", "pos", "rest"], F.xxhash64("node"), tile)
    keys = ["seg", "pos", "rest", "tile_i", "tile_j"]
    tiles = stage(tiles.select(*keys, "own", "side", "node"), "tiles").join(fps.select("node", "check"), "node")
    tiles = tiles.select(*keys, "own", "side", "node", "check").repartition(*keys).sortWithinPartitions(*keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pos, _, tile_i, tile_j, own, side, node, check in groups(batches, 5):
            check = np.ascontiguousarray(check).view(np.uint64)
            forest, n = Forest(len(node)), len(node)
            for k in range(1, n):  # each row with the k-th after it
                at = np.arange(n - k)
                if pos[0] >= 0:
                    at = at[side[k:] != side[:-k]]
                if tile_i[0] != tile_j[0]:
                    at = at[own[at + k] != own[at]]
                at = at[forest.root[at] != forest.root[at + k]]
                at = at[np.bitwise_count(check[at] ^ check[at + k]).sum(axis=1, dtype=np.int64) <= max_bits]
                forest.link(at, at + k)
            a, b = forest.edges()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return tiles.mapInArrow(work, "a long, b long")


def _components(found: DataFrame, by: list[str], fps: DataFrame, links: DataFrame) -> DataFrame:
    """found (doc_id and the columns `by`) with component_id. fps has a row for each distinct `by`, named node, which
    links (a, b) connect."""
    component = connected_components(links).select(F.col("node").alias("_node"), F.col("component").alias("root"))
    rooted = fps.join(component, F.col("node") == F.col("_node"), "left").select(*by, "first", F.coalesce("root", "node").alias("root"))
    rooted = stage(rooted, "rooted")
    names = stage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "component-names")
    return found.join(stage(rooted.join(names, "root").select(*by, "component_id"), "components"), by)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3, tile: int = 1024) -> DataFrame:
    """(doc_id, fp long, component_id) of every row of docs; component_id is the smallest id reachable by links between
    fingerprints with max_bits (3 at most) or fewer differing bits.

    Equal fingerprints are one node from the start, so copies of any number cost one row. A null or blank text has the
    fingerprint zero, linked like any other; a component is named null only if all its ids are null. Rows that repeat an
    id are rows like others. An empty table gives an empty result.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments find fingerprints with 3 differing bits at most; similar() goes further")
    found = stage(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "distinct-fingerprints")
    fps = nodes.select("*", F.array("fp").alias("cut"), F.array("fp").alias("check"))
    links = near_links(fps.select("node", "cut", "check"), max_bits, tile)
    return _components(found, ["fp"], fps, links).select("doc_id", "fp", "component_id")


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, tile: int = 256) -> DataFrame:
    """(doc_id, own, component_id, first) of every row of docs (doc_id, text): near copies by the Jaccard similarity of
    their different word shingles. Two are linked if it is `similarity` or more, counted on the shingles' 64-bit hashes.
    own is a hash of the text; first is true for the component's first document, by id (null last) and own.

    Candidates are those of the deletion variants of a SimHash of the shingles, with 3 or fewer differing bits, and, since
    at a similarity of 0.8 some 10 of its 64 bits differ, those that share one of BANDS fingerprints, which depends on
    their similarity J alone: 1 - (1 - J ** MINIMA) ** BANDS of the pairs do, that is all but one in 2,800 at 0.8,
    wherever and however they differ. Rows with the same words are one node. Other cases are those of near_duplicates.
    """
    found = stage(_wide(docs, width), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "own")
    nodes = found.groupBy("high", "low").agg(F.min(order).alias("row"), *(F.first(x).alias(x) for x in ("size", "check", "bands")))
    nodes = stage(nodes.withColumns({"node": F.monotonically_increasing_id(), "first": F.col("row")}), "distinct-fingerprints")
    bits = F.array(F.col("check")[0])
    variants = stage(near_links(nodes.where("size > 0").select("node", bits.alias("cut"), bits.alias("check")), 3), "simhash-candidates")
    members = stage(_members(nodes), "members")
    wanted = members.select("node").unionByName(variants.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    links = _verified(members, variants, _sets(docs, nodes, wanted, width), similarity, tile)
    named = _components(found, ["high", "low"], nodes, links)
    first = F.col("doc_id").eqNullSafe(F.col("component_id.doc_id")) & (F.col("own") == F.col("component_id.own"))
    return named.select("doc_id", "own", F.col("component_id.doc_id").alias("component_id"), first.alias("first"))


def _members(nodes: DataFrame) -> DataFrame:
    """(seg, val, node, size): the nodes of each fingerprint that several have."""
    values = nodes.select("node", F.posexplode("bands").alias("seg", "val"))
    sizes = values.groupBy("seg", "val").agg(F.count("*").alias("size")).where("size > 1")
    return values.join(stage(sizes, "shared-fingerprints"), ["seg", "val"])


def _sets(docs: DataFrame, nodes: DataFrame, among: DataFrame, width: int) -> DataFrame:
    """(node, size, check, grams) of the nodes among those given, one row each; grams are the ascending hashes of its
    different shingles, as bytes.

    Rows that repeat both the id and the text of a node's first document all match it. Tasks give each node out once, and
    of what several tasks gave one row stays, so such rows cost no more than being read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_table()
        given: set[int] = set()
        for batch in batches:
            fresh = [i for i, node in enumerate(batch.column(0).to_pylist()) if not (node in given or given.add(node))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                grams = [_once(text.lower().split(), width).tobytes() for text in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(grams, pa.binary())], ["node", "size", "check", "grams"])

    wanted = nodes.join(among, "node").select("node", "size", "check", F.col("row.doc_id").alias("_id"), F.col("row.own").alias("_own"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("own"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(stage(wanted, "candidates"), (F.col("own") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    made = stage(rows.select("node", "size", "check", "text").mapInArrow(work, "node long, size int, check array<long>, grams binary"), "shingles")
    again = stage(made.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "shingles-again")
    return made.join(again, "node", "left_anti").unionByName(made.join(again, "node").dropDuplicates(["node"]))


#: Shingles of one block of a tile, 8 bytes each.
SHINGLES = 1 << 21


class _Near:
    """Whether rows (size, check, grams) are near: first by what a similarity needs of the sizes and, where there are
    many shingles, by a sketch that is 6 deviations off (one pair in a billion), then by the shingles."""

    def __init__(self, similarity: float) -> None:
        share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
        self.similarity, self.max_bits = similarity, 64 * CHECK * share + 6 * np.sqrt(64 * CHECK * share * (1 - share))

    def likely(self, size_a: np.ndarray, size_b: np.ndarray, check_a: np.ndarray, check_b: np.ndarray) -> np.ndarray:
        least = np.minimum(size_a, size_b)
        bits = np.bitwise_count(check_a.view(np.uint64) ^ check_b.view(np.uint64)).sum(axis=1, dtype=np.int64)
        return (least >= self.similarity * np.maximum(size_a, size_b) - 1e-9) & ((least < 64) | (bits <= self.max_bits))

    def sure(self, a: bytes, b: bytes) -> bool:
        a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        same = len(np.intersect1d(a, b, assume_unique=True))
        return same >= self.similarity * (len(a) + len(b) - same) - 1e-9


def _verified(members: DataFrame, variants: DataFrame, sets: DataFrame, similarity: float, tile: int) -> DataFrame:
    """Links (a, b) between nodes that connect, by way of others in part, all members (seg, val, node, size) of a bucket
    that are near, and the pairs (a, b) of variants that are. Tiles are bounded by rows (twice `tile`) and by shingles (twice SHINGLES, or what one text alone has), so
    long texts make more of them.

    Members are compared with their bucket's hub first, which is as many pairs as members and connects most groups of
    copies. Buckets that are not in one component then are compared in tiles, except within components.
    """
    near = _Near(similarity)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_table()
        for batch in batches:
            a, b, size_a, size_b, check_a, check_b = numpy_columns(batch.select(["a", "b", "size_a", "size_b", "check_a", "check_b"]))
            if not len(a):
                continue
            grams_a, grams_b = batch.column("grams_a"), batch.column("grams_b")
            at = [i for i in np.flatnonzero(near.likely(size_a, size_b, np.ascontiguousarray(check_a), np.ascontiguousarray(check_b))).tolist() if near.sure(grams_a[i].as_py(), grams_b[i].as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(a[at], pa.int64()), pa.array(b[at], pa.int64())], ["a", "b"])

    # the hub is the node with the largest buckets, which is the one most alike the others, so that a group's buckets share it
    reach = members.groupBy("node").agg(F.sum("size").alias("reach"))
    hubs = members.join(stage(reach, "reach"), "node").groupBy("seg", "val").agg(F.max(F.struct("reach", (-F.col("node")).alias("own"))).alias("hub"))
    hubs = stage(hubs.select("seg", "val", (-F.col("hub.own")).alias("hub")), "hubs")
    stars = members.join(hubs, ["seg", "val"]).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    stars = stage(stars.unionByName(variants.select("a", "b")).distinct(), "stars")
    side = lambda x: sets.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("size", "check", "grams")))
    links = stage(stars.join(side("b"), "b").join(side("a"), "a").mapInArrow(pairs, "a long, b long"), "star-links")

    component = connected_components(links)
    named = members.join(component.withColumnRenamed("component", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(sets.select("node", F.col("size").cast("long").alias("shingles")), "node")
    named = stage(named.select("seg", "val", "node", "root", "shingles"), "members-named")
    # buckets with the same members are one
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"mark{i}") for i in (1, 2)]
    apart = named.groupBy("seg", "val").agg(F.count("*").alias("size"), F.min("root").alias("least"), F.max("root").alias("most"), *marks).where("size > 2 and least <> most")
    apart = apart.groupBy("mark1", "mark2", "size").agg(F.min(F.struct("seg", "val")).alias("bucket")).select("bucket.seg", "bucket.val", "size")
    named = stage(named.join(stage(apart, "buckets-apart"), ["seg", "val"]), "members-apart")
    roots = named.groupBy("seg", "val", "size", "root").agg(F.count("*").alias("n"), F.sum("shingles").alias("shingles"))
    large = roots.groupBy("seg", "val", "size").agg(F.max(F.struct("n", "root", "shingles")).alias("large"), F.sum("shingles").alias("shingles"))
    large = large.select("seg", "val", F.col("large.root").alias("large"), F.col("large.n").alias("n_large"), (F.col("size") - F.col("large.n")).alias("n_others"), F.col("large.shingles").alias("s_large"), (F.col("shingles") - F.col("large.shingles")).alias("s_others"))
    keys = ["seg", "val", "tile_i", "tile_j"]
    tiles = _tiles(named.join(stage(large, "largest-components"), ["seg", "val"]), tile)
    tiles = stage(tiles.select(*keys, "own", "root", "node"), "tiles").join(sets, "node")
    tiles = tiles.select(*keys, "own", "root", "node", "size", "check", "grams").repartition(*keys).sortWithinPartitions(*keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_table()
        for _, _, tile_i, tile_j, own, root, node, size, check, grams in groups(batches, 4):
            check, n = np.ascontiguousarray(check), len(node)
            forest = Forest(n)
            _, first, which = np.unique(root, return_index=True, return_inverse=True)
            forest.link(np.arange(n), first[which])
            known = forest.root.copy()
            for k in range(1, n):  # each row with the k-th after it
                at = np.arange(n - k)
                if tile_i[0] != tile_j[0]:
                    at = at[own[at + k] != own[at]]
                at = at[forest.root[at] != forest.root[at + k]]
                at = at[near.likely(size[at], size[at + k], check[at], check[at + k])]
                at = np.array([i for i in at.tolist() if near.sure(grams[i], grams[i + k])], np.int64)
                forest.link(at, at + k)
            a = np.flatnonzero(forest.root != known)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[forest.root[a]])], ["a", "b"])

    return links.unionByName(tiles.mapInArrow(work, "a long, b long"))


def _tiles(members: DataFrame, tile: int) -> DataFrame:
    """Cuts buckets (seg, val) into tiles of bounded size, in which all members of different components meet. A bucket's
    largest component (large, of n_large members) is dealt into blocks of its own, and those meet only the blocks of the
    n_others; so a large group with a few other members costs a row for each member, not one for each pair of blocks. Blocks
    are bounded by rows and, where s_large and s_others say how many, by shingles."""
    bounds = lambda of: {f"n_{of}": tile, f"s_{of}": SHINGLES}.items()
    dealt = lambda of: F.greatest(F.lit(1), F.lit(1), *[F.ceil(F.col(c) / F.lit(float(most))) for c, most in bounds(of) if c in members.columns]).cast("int")
    rows = members.withColumns({"others": dealt("others"), "blocks": dealt("others") + dealt("large"), "is_large": F.col("root") == F.col("large")})
    spread = F.xxhash64("node")
    own = F.when(F.col("is_large"), F.col("others") + F.pmod(spread, F.col("blocks") - F.col("others"))).otherwise(F.pmod(spread, F.col("others")))
    last = F.when(F.col("is_large"), F.col("others")).otherwise(F.col("blocks")) - 1
    rows = rows.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumns({"tile_i": F.least("own", "other"), "tile_j": F.greatest("own", "other")})


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that stay: of each component of similar() the first document, by
    id (null last) and its text's hash. A document is an id with a text: of rows that repeat both one stays, and rows
    with one id and different texts are documents of their own."""
    stay = similar(docs, width, similarity).where("first").groupBy(F.col("doc_id").alias("_tm_id"), F.col("own").alias("_tm_own")).agg(F.count("*").alias("_tm_copies"))
    rows = docs.withColumn("_tm_text", F.xxhash64("text"))
    kept = rows.join(stage(stay, "stays"), F.col("doc_id").eqNullSafe(F.col("_tm_id")) & (F.col("_tm_text") == F.col("_tm_own")))
    once = kept.where("_tm_copies = 1").select(*docs.columns)
    return once.unionByName(kept.where("_tm_copies > 1").dropDuplicates(["doc_id", "_tm_own"]).select(*docs.columns))
