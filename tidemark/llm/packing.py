"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

Which pieces share a sequence depends on lengths only, so the packing is worked out on the table of lengths and counts,
which has at most `capacity` rows however many documents there are. Its result is a bounded list of patterns (lengths
that fill a sequence, and how many sequences are filled so). Pieces then take their places by their number among those
of their length, which Spark counts in parallel. Pieces of the full capacity are sequences already.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import stage
from tidemark.llm.tokens import encoded

#: Rows, one after the other, whose pieces of one length are numbered together.
BLOCK = 1 << 17


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and an end id, documents over the capacity cut.

    Of a cut document the first piece has what the full ones leave over, so that all others fill a sequence alone.
    A null or empty text is the end id alone.
    """

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, bounds in encoded(batches, tokenizer, 1, end_id, special_as_text):
            n = np.diff(bounds)
            pieces = np.maximum(-(-n // capacity), 1)
            own = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            over = (n - (pieces - 1) * capacity)[own]  # what the full pieces leave to the first
            start = np.where(piece > 0, over + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, over)
            at = bounds[:-1][own] + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(own)), *(pa.array(c, t) for c, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64())))], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Left:
    """Lengths not packed yet, with their counts."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.count = {k: v for k, v in counts.items() if v > 0}
        self.sorted = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.sorted.remove(length)

    def put(self, length: int, n: int) -> None:
        if length not in self.count:
            self.count[length] = 0
            self.sorted.insert(bisect_right(self.sorted, length), length)
        self.count[length] += n

    def pair(self, gap: int) -> tuple[int, int] | None:
        """The two lengths left with the largest sum of at most gap (for one length twice, two must be left)."""
        best, low, high = None, 0, bisect_right(self.sorted, gap) - 1
        while low <= high:
            a, b = self.sorted[low], self.sorted[high]
            if a + b > gap or (low == high and self.count[a] < 2):
                high -= 1
            else:
                if best is None or a + b > sum(best):
                    best = (a, b)
                    if a + b == gap:
                        break
                low += 1
        return best


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences) that pack every piece once, by best-two-fit. A pattern is used
    as often as the counts allow, so there are some thousand patterns at most for a capacity of 1024, whatever the counts.

    A small piece that made way may need a sequence of its own at the end, which happens with few pieces. So the
    replacements are kept up to the last one with which no more sequences are needed than without any: all of them if
    that holds, else all but the last one, two, four and so on."""
    used = lambda found: sum(times for _, times in found)
    every, made = _filled(counts, capacity, 1 << 62)
    if not made:
        return every
    least = used(_filled(counts, capacity, 0)[0])
    found, less = every, 1
    while used(found) > least:
        found, _ = _filled(counts, capacity, max(0, made - less))
        less *= 2
    return found


def _filled(counts: dict[int, int], capacity: int, most: int) -> tuple[list[tuple[list[int], int]], int]:
    """Each sequence is filled greedily, the largest piece that fits first. Then its smallest piece makes way for two
    pieces left that fit the gap and its place more tightly, if there are such; the first `most` times this happens.
    The patterns, and how often it happened."""
    left, out, made = _Left(counts), [], 0
    while left.sorted:
        bag: dict[int, int] = {}
        gap = capacity
        at = bisect_right(left.sorted, gap) - 1
        while at >= 0:
            length = left.sorted[at]
            if n := min(left.count[length] - bag.get(length, 0), gap // length):
                bag[length] = bag.get(length, 0) + n
                gap -= n * length
            at = min(at - 1, bisect_right(left.sorted, gap) - 1)
        times = min(left.count[x] // n for x, n in bag.items())
        for x, n in bag.items():
            left.take(x, n * times)
        if made < most and gap and (pair := left.pair(gap + min(bag))) and sum(pair) > (small := min(bag)):
            a, b = pair
            made += 1
            swaps = min(times, left.count[a] // 2 if a == b else min(left.count[a], left.count[b]))
            for x in pair:
                left.take(x, swaps)
            left.put(small, swaps)
            tight = [x for x, n in bag.items() for _ in range(n)]
            tight.remove(small)
            out.append(([*tight, a, b], swaps))
            times -= swaps
        if times:
            out.append(([x for x, n in bag.items() for _ in range(n)], times))
    return out, made


def _places(found: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the runs of its pieces by number: first number of a run, first sequence, pieces in a sequence,
    and their offsets' place in the list of all offsets."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    offsets: list[int] = []
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, times in found:
        at, own = 0, {}
        for x in lengths:
            own.setdefault(x, []).append(at)
            at += x
        for x, places in own.items():
            runs.setdefault(x, []).append((taken.get(x, 0), sequence, len(places), len(offsets)))
            offsets += places
            taken[x] = taken.get(x, 0) + times * len(places)
        sequence += times
    every = np.array(offsets, np.int64)
    return {x: (*map(np.array, zip(*r, strict=True)), every) for x, r in runs.items()}


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces (length long from 1 to capacity, and any other columns) with sequence_id and offset, in sequences without
    gaps between pieces. Columns of pieces with these names are replaced. Rows that repeat are pieces like others; a
    length that is null or out of bounds is an error; an empty table gives an empty result.

    pieces are written to the shared folder once. Those of the full capacity are sequences as they are and move no
    more. Of the others only the number of each length comes to the driver, for the packing. They are numbered within
    their length in blocks of BLOCK rows at most, so that no length is one task's work and none grows with the table.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row = F.monotonically_increasing_id()
    blocked = pieces.select(*names).withColumns({"_tm_row": row, "_tm_block": F.floor(row / F.lit(BLOCK)).cast("long")})
    blocked = stage(blocked, "pieces")
    length = F.col("length")
    full, others = blocked.where(length == capacity), blocked.where((length != capacity) | length.isNull())
    sizes = stage(others.groupBy("length", "_tm_block").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).where(length.isNull() | length.between(1, capacity - 1)).collect()}
    if None in counts or sizes.where(~length.between(1, capacity - 1)).take(1):
        raise ValueError("lengths are 1 to the capacity")
    places = _places(patterns(counts, capacity))
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast(places)  # bounded by the capacity, not by the rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_tm_block").rowsBetween(Window.unboundedPreceding, -1))
    before = stage(sizes.select(F.col("length").alias("_tm_length"), F.col("_tm_block").alias("_tm_of"), F.coalesce(before, F.lit(0)).alias("_tm_before")), "numbers-before")
    number = F.row_number().over(Window.partitionBy("length", "_tm_block").orderBy("_tm_row"))
    rows = others.withColumn("_tm_number", number).join(before, (length == F.col("_tm_length")) & (F.col("_tm_block") == F.col("_tm_of")))
    rows = rows.select(*names, (F.col("_tm_before") + F.col("_tm_number") - 1).alias("_tm_rank"))
    at = names.index("length")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                starts, base, each, first, offsets = places[length[own[0]]]
                run = np.searchsorted(starts, rank[own], "right") - 1
                inside = rank[own] - starts[run]
                sequence[own] = base[run] + inside // each[run]
                offset[own] = offsets[first[run] + inside % each[run]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = T.StructType([*pieces.select(*names).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    alone = full.select(*names, (-1 - F.col("_tm_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rows.mapInArrow(work, schema).unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, special_as_text: bool = False) -> DataFrame:
    """Packs the tokens of whole documents: a row for each piece with its sequence and its place there. Rows that repeat
    an id, null ids and null texts are packed like others."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity, special_as_text=special_as_text), capacity)
