"""Token ids in ORC: integer run-length encoding, row indexes, and Bloom filters on document ids.

A table of (doc_id, part, first, n_tokens, ids): rows ascend by doc_id within a part, and parts by number; `first` is the
number of ids before the document in its part. ORC keeps smallest and largest doc_id for each file, stripe and row
group, so readers of a range skip the rest; the Bloom filters let a lookup of single ids skip row groups inside the
range. Stripes are read in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import small_batches
from tidemark.llm.tokens import encoded

SCHEMA = "doc_id long, part int, first long, n_tokens long, ids array<int>"
#: ORC's settings: stripes small enough that a file has several readers; an index entry for each 1000 documents.
WRITER = {"compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> None:
    """Encodes every whole text (null: empty), appends end_id, and writes path/data, ascending by id (null first, equal
    ids by the text's hash), and path/parts, the ids in each part. Rows that repeat an id are documents like others; an
    empty table gives empty ones. A part is a task's rows, in whatever number of files; rows that repeat both id and
    text, even a third of all, are dealt to several. partitions should grow with the table (default: the session's
    shuffle partitions)."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(n, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        for rows, ids, bounds in encoded(batches, tokenizer, 1, end_id, special_as_text):
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view("<i4")))
            columns = [rows.column(0), pa.array(np.full(rows.num_rows, part, np.int32)), pa.array(first + bounds[:-1]), pa.array(np.diff(bounds)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "first", "n_tokens", "ids"])
            first += int(bounds[-1])

    spark = docs.sparkSession
    with small_batches(spark):
        rows.mapInArrow(work, SCHEMA).write.options(**WRITER).orc(f"{path}/data")
    parts = spark.read.schema(SCHEMA).orc(f"{path}/data").groupBy("part")
    parts.agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("documents"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).write.orc(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; start counts the ids of all documents before it in the whole
    table. Filters on doc_id reach the ORC reader. The running sum is over one row for each part, not over documents."""
    rows = spark.read.schema(SCHEMA).orc(f"{path}/data")
    parts = spark.read.schema("part int, n_tokens long").orc(f"{path}/parts")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    return rows.join(parts, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_tokens gives, from the ids that the files hold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, ends = lists.values.to_numpy().astype("<i4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
