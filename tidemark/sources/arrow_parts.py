"""A source and sink that Spark has none of: tables of Arrow files, with a list of parts that a filter can skip.

    use(spark)
    df.write.format("arrow_parts").mode("append").save(folder)
    spark.read.format("arrow_parts").load(folder).where("id > 1000")

Each task writes one part, batch by batch. The folder's list, `_parts.json`, has the schema and, for each part, its name,
number of rows and every column's least and largest value and number of nulls. It is replaced in one move when all tasks
have ended, so rows are there all at once or not at all: what a failed, repeated or lost task leaves is in no list. The
list, a line for each part, is all that the driver holds. One job writes to a folder at a time.

Filters on columns of integers, floats and short strings skip parts; Spark filters the rows of the others again."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

PARTS = "_parts.json"
#: Strings beyond so many characters have no bounds in the list.
SHORT = 256


def use(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrowParts)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    files, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return files, folder.rstrip("/")


def _listed(path: str) -> dict | None:
    """What the folder's list says, or None where there is none."""
    files, folder = _place(path)
    if files.get_file_info(f"{folder}/{PARTS}").type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{folder}/{PARTS}") as f:
        return json.loads(f.read())


@dataclass
class _Bounds:
    """Least and largest of a column's values so far; unknown for good once a value has no place in their order."""

    least: object = None
    most: object = None
    nulls: int = 0
    known: bool = True

    def add(self, column: pa.Array) -> None:
        self.nulls += column.null_count
        kind = column.type
        self.known = self.known and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind) or pa.types.is_large_string(kind))
        if not self.known or column.null_count == len(column):
            return
        if pa.types.is_floating(kind) and pc.any(pc.is_nan(column)).as_py():
            self.known = False
            return
        ends = pc.min_max(column).as_py()
        values = [v for v in (ends["min"], ends["max"], self.least, self.most) if v is not None]
        self.least, self.most = min(values), max(values)
        self.known = not any(isinstance(v, str) and len(v) > SHORT or isinstance(v, float) and math.isinf(v) for v in (self.least, self.most))

    def said(self) -> dict:
        return {"nulls": self.nulls} | ({"least": self.least, "most": self.most} if self.known else {})


def _may_hold(part: dict, test: ds.Filter) -> bool:
    """Whether rows of the part can pass the filter, by the list alone."""
    attribute = getattr(test, "attribute", ())
    column = part["columns"].get(attribute[0]) if len(attribute) == 1 else None
    if column is None:
        return True
    if isinstance(test, ds.IsNull):
        return column["nulls"] > 0
    if column["nulls"] == part["rows"]:  # no other filter below passes a null
        return not isinstance(test, ds.EqualTo | ds.GreaterThan | ds.GreaterThanOrEqual | ds.LessThan | ds.LessThanOrEqual | ds.In | ds.IsNotNull)
    if "least" not in column:
        return True
    low, high = column["least"], column["most"]
    alike = lambda v: isinstance(v, str) == isinstance(low, str) and isinstance(v, str | int | float) and v == v
    if isinstance(test, ds.In):
        return any(not alike(v) or low <= v <= high for v in test.value)
    if not alike(getattr(test, "value", None)):
        return True
    match test:
        case ds.EqualTo():
            return low <= test.value <= high
        case ds.GreaterThan():
            return high > test.value
        case ds.GreaterThanOrEqual():
            return high >= test.value
        case ds.LessThan():
            return low < test.value
        case ds.LessThanOrEqual():
            return low <= test.value
    return True


class ArrowParts(ds.DataSource):
    """The format `arrow_parts`."""

    @classmethod
    def name(cls) -> str:
        return "arrow_parts"

    def schema(self) -> StructType:
        listed = _listed(self.options["path"])
        if listed is None:
            raise ValueError(f"no table in {self.options['path']}")
        return StructType.fromJson(listed["schema"])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        before = None if overwrite else _listed(self.options["path"])
        if before and (columns := StructType.fromJson(before["schema"]).simpleString()) != schema.simpleString():
            raise ValueError(f"the table in {self.options['path']} has other columns: {columns}")
        return Writer(self.options["path"], schema, overwrite)


@dataclass
class Part(ds.InputPartition):
    name: str


@dataclass
class Reader(ds.DataSourceReader):
    path: str
    tests: list = field(default_factory=list)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        self.tests = list(filters)
        yield from filters

    def partitions(self) -> list[Part]:
        listed = _listed(self.path) or {"parts": []}
        return [Part(p["name"]) for p in listed["parts"] if p["rows"] and all(_may_hold(p, t) for t in self.tests)] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.name:
            files, folder = _place(self.path)
            with files.open_input_file(f"{folder}/{partition.name}") as f, pa.ipc.open_file(f) as batches:
                for i in range(batches.num_record_batches):
                    yield batches.get_batch(i)


@dataclass
class Written(ds.WriterCommitMessage):
    part: dict


@dataclass
class Writer(ds.DataSourceArrowWriter):
    path: str
    table: StructType
    overwrite: bool

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _place(self.path)
        name, rows, bounds, out = f"part-{uuid.uuid4().hex}.arrow", 0, {c: _Bounds() for c in self.table.names}, None
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/{name}") as f:
            for batch in iterator:
                out = out or pa.ipc.new_file(f, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                out.write_batch(batch)
                rows += batch.num_rows
                for c, b in bounds.items():
                    b.add(batch.column(c))
            if out:
                out.close()
        return Written({"name": name, "rows": rows, "columns": {c: b.said() for c, b in bounds.items()}})

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _place(self.path)
        before = None if self.overwrite else _listed(self.path)
        parts = (before["parts"] if before else []) + [m.part for m in messages if m]
        files.create_dir(folder, recursive=True)
        new = f"{folder}/{PARTS}-{uuid.uuid4().hex}"
        with files.open_output_stream(new) as f:
            f.write(json.dumps({"schema": self.table.jsonValue(), "parts": parts}).encode())
        files.move(new, f"{folder}/{PARTS}")

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _place(self.path)
        for m in messages:
            if m:
                files.delete_file(f"{folder}/{m.part['name']}")
