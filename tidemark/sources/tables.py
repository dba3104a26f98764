"""Readers and writers of tables in a folder, in the formats that Spark has."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.sources.shared import new_path

FORMATS = ("parquet", "orc", "csv", "json")


def table(spark: SparkSession, folder: str, name: str, kind: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    """folder/name.kind; csv has a header line. csv and json need a schema, so that no extra pass guesses one."""
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {', '.join(FORMATS)}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(kind).options(**({"header": "true"} if kind == "csv" else {})).load(f"{folder.rstrip('/')}/{name}.{kind}")


def save(df: DataFrame, folder: str, name: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "error") -> str:
    """Writes df as folder/name.kind, in folders by the columns `by` (so that filters on them skip files)."""
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {', '.join(FORMATS)}")
    path = f"{folder.rstrip('/')}/{name}.{kind}"
    writer = df.write.mode(mode).options(**({"header": "true"} if kind == "csv" else {}))
    (writer.partitionBy(*by) if by else writer).format(kind).save(path)
    return path


#: Types whose values take 8 bytes or less of a row.
_FLAT = frozenset("boolean byte short integer long float double date timestamp timestamp_ntz".split())


def buckets_for(frames: Sequence[DataFrame], bytes_each: int = 32 << 20) -> int:
    """A number of buckets that gives the largest of frames some bytes_each in one; 8 at least, and Spark's own most of
    100,000. A row counts 8 bytes for a number or time and 40 for other columns, or what the optimizer estimates if that is
    more: its estimate goes by the size of files, which can be a tenth. A task that sorts holds about four times as much.
    Rows are counted, for tables of Parquet files by their footers. Frames of which nothing is known before they run (rows
    from Python) are an error."""
    sizes = []
    for df in frames:
        estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        if estimate >= 1 << 60:
            raise ValueError("the size of a frame is not known: write it first, or name a number of buckets")
        sizes.append(max(estimate, df.count() * sum(8 if f.dataType.typeName() in _FLAT else 40 for f in df.schema)))
    return min(max(8, -(-max(sizes) // bytes_each)), 100_000)


def bucketed(df: DataFrame, by: str, buckets: int, name: str | None = None) -> DataFrame:
    """df as a table in the shared folder, in `buckets` of its column `by`, each one file sorted by it. Tables with equal
    numbers of buckets are joined and grouped by `by` without a shuffle, as often as they are read. All rows of a key are
    in one bucket, nulls in one too, so keys that hold a large share of the rows are for `salted_join`. The table's name,
    a new one where none is given, is known to this session; a name that is taken is an error."""
    name = name or f"tidemark_{uuid.uuid4().hex}"
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", new_path(df.sparkSession, name)).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)
