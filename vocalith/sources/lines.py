"""Files of JSON lines as Python data sources: strict rows that name the file and line of what is wrong, and the parts both kinds of readers share.

Files are cut by bytes; a line belongs to the part in which it begins. Only a failure counts lines, from its file's start.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a part, and rows of a batch.
PART, BATCH = 32 << 20, 1000


@dataclass
class Part(InputPartition):
    """Bytes ``start`` up to ``end`` of a file."""

    file: str
    start: int
    end: int


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def files_below(path: str, ending: str | tuple[str, ...] = (".jsonl", ".json")) -> list[tuple[str, int]]:
    """(file, bytes) of the files below ``path``, or of itself, by name."""
    system, at = store(path)
    info = system.get_file_info(at)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else []
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((head + f.path, f.size) for f in found if f.is_file and (f.path.endswith(ending) or info.is_file))


def parts(found: Sequence[tuple[str, int]], size: int = PART) -> list[Part]:
    return [Part(name, a, min(a + size, whole)) for name, whole in found for a in range(0, whole, size)]


def lines(part: Part) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin within the part, without their ends; blank ones go."""
    system, at = store(part.file)
    with io.BufferedReader(system.open_input_file(at), 1 << 16) as raw:
        place = part.start
        if place:
            raw.seek(place - 1)
            place += len(raw.readline()) - 1
        while place < part.end and (line := raw.readline()):
            if line.strip():
                yield place, line.rstrip(b"\r\n")
            place += len(line)


def line_number(file: str, place: int) -> int:
    """The number, from 1, of the line that begins at a place."""
    system, at = store(file)
    n, left = 1, place
    with system.open_input_stream(at) as raw:
        while left and (block := raw.read(min(left, 1 << 20))):
            n, left = n + block.count(b"\n"), left - len(block)
    return n


def objects(part: Part, fields: set[str], required: Sequence[str] = ()) -> Iterator[tuple[int, dict]]:
    """(place, object) of each line; one that isn't an object of these fields, or lacks a required one, is refused by file and line."""
    for place, line in lines(part):
        try:
            row = json.loads(line)
            if not isinstance(row, dict):
                raise ValueError("not an object")
            if odd := sorted(set(row) - fields):
                raise ValueError(f"unknown fields {odd}")
            if lost := [f for f in required if row.get(f) is None]:
                raise ValueError(f"missing fields {lost}")
        except ValueError as e:
            raise ValueError(f"{part.file}:{line_number(part.file, place)}: {e}") from None
        yield place, row


def batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class StrictReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, required: list[str], part: int):
        self.path, self.schema, self.required, self.part = path, schema, required, part

    def partitions(self) -> list[Part]:
        return parts(files_below(self.path), self.part)

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        arrow, fields = to_arrow_schema(self.schema), set(self.schema.names)
        if part is None or part.file is None:
            return
        for place, row in objects(part, fields, self.required):
            try:
                yield pa.RecordBatch.from_pylist([row], arrow)
            except (pa.ArrowInvalid, pa.ArrowTypeError) as e:
                raise ValueError(f"{part.file}:{line_number(part.file, place)}: {e}") from None


class StrictJson(DataSource):
    """``format("strict_json")``: options ``path``, ``required`` (names by comma) and ``part_bytes``; the read schema must be given.

    Unknown fields, missing ones and values of another type fail with file and line, where Spark's reader would make nulls.
    """

    @classmethod
    def name(cls) -> str:
        return "strict_json"

    def schema(self) -> StructType:
        raise ValueError("strict_json needs a schema")

    def reader(self, schema: StructType) -> StrictReader:
        required = [f for f in self.options.get("required", "").split(",") if f]
        return StrictReader(self.options["path"], schema, required, int(self.options.get("part_bytes", PART)))


def read_strict(spark: SparkSession, path: str, schema: str, required: Sequence[str] = (), part_bytes: int = PART):
    """Rows of JSON lines by ``schema``; the first bad line fails the query by its file and number."""
    spark.dataSource.register(StrictJson)
    return spark.read.format("strict_json").schema(schema).option("required", ",".join(required)).option("part_bytes", part_bytes).load(path)
