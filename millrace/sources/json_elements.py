"""Elements of large JSON arrays as a data source: one file is read by many tasks, whatever its elements are.

A chunk of a file can't tell whether it begins within a string, nor how deep. So chunks are first scanned under both
assumptions, which gives each a few numbers; chained up, these tell every chunk's true beginning. The data source then
has a partition for each chunk, which gives the elements that begin in it and reads on to the end of the last one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import listed

CHUNK = 16 << 20
#: What each byte adds to the depth outside strings.
STEPS = np.zeros(256, np.int8)
STEPS[list(b"[{")], STEPS[list(b"]}")] = 1, -1
_QUOTE, _BACKSLASH, _COMMA = b'"\\,'
SCHEMA = "path string, section string, at long, element string"


def _read(path: str, at: int, n: int) -> bytes:
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        return f.read_at(n, at)


@dataclass
class Marks:
    """For each byte of a chunk: whether it is in a string, and how deep what follows it is."""

    within: np.ndarray
    depth: np.ndarray


def marks(data: bytes, escaped: bool, within: bool, depth: int) -> Marks:
    """``escaped``: the first byte follows a backslash that escapes it."""
    b = np.frombuffer(data, np.uint8)
    plain = np.maximum.accumulate(np.where(b != _BACKSLASH, np.arange(len(b), dtype=np.int32), np.int32(-1)))
    quotes = np.flatnonzero(b == _QUOTE)
    before = np.where(quotes > 0, plain[np.maximum(quotes - 1, 0)], -1)
    run = quotes - 1 - before + ((before < 0) & escaped)
    del plain
    real = np.zeros(len(b), bool)
    real[quotes[run % 2 == 0]] = True
    inside = np.logical_xor.accumulate(real) ^ within
    steps = np.where(inside, np.int8(0), STEPS[b])
    return Marks(inside, np.cumsum(steps, dtype=np.int32) + np.int32(depth))


def _escaped(path: str, at: int) -> bool:
    """Whether an odd number of backslashes stands before a place."""
    n = 0
    while at:
        size = min(at, 4096)
        data = _read(path, at - size, size)
        run = len(data) - len(data.rstrip(b"\\"))
        n += run
        if run < size:
            break
        at -= size
    return n % 2 == 1


def _keys(data: bytes, m: Marks) -> list[tuple[int, str]]:
    """Sections that begin in a chunk: the places of arrays that are values of the outermost object, and their keys where the chunk has them whole."""
    b, out = np.frombuffer(data, np.uint8), []
    for at in np.flatnonzero((b == ord("[")) & (m.depth == 2) & ~m.within).tolist():
        head = data[:at].rstrip()
        key = ""
        if head.endswith(b":") and (head := head[:-1].rstrip()).endswith(b'"'):
            begin = head.rfind(b'"', 0, len(head) - 1)
            key = head[begin + 1 : -1].decode() if begin >= 0 else ""
        out.append((at, key))
    return out


def _elements(partition: Chunk, sections: bool) -> Iterator[tuple[str, str | None, int, str]]:
    level = 2 if sections else 1
    at, size, section, begun, held = partition.at, partition.size, partition.section, None, b""
    within, depth, escaped = partition.within, partition.depth, partition.escaped
    open_ = depth >= level and section is not None and partition.array
    first = True
    while True:
        data = _read(partition.path, at, size)
        if not data:
            return
        m = marks(data, escaped, within, depth)
        b = np.frombuffer(data, np.uint8)
        before = np.concatenate([np.array([depth], np.int32), m.depth[:-1]])
        names = dict(_keys(_read(partition.path, max(0, at - 4096), min(at, 4096)) + data, _shifted(m, min(at, 4096)))) if sections and first else {}
        ends = ~m.within & (((b == _COMMA) & (m.depth == level)) | ((m.depth == level) & (before == level - 1)) | ((m.depth == level - 1) & (before == level)))
        for k in np.flatnonzero(ends).tolist():
            if begun is not None:
                text = (held + data[(begun - at if begun >= at else 0) : k]).strip()
                if text:
                    yield partition.path, section if sections else None, begun, text.decode()
                begun, held = None, b""
                if not first:
                    return
            if data[k : k + 1] in b"]}":
                open_ = False
            elif data[k : k + 1] in b"[{":
                open_ = data[k : k + 1] == b"["
                section = names.get(k + min(at, 4096), "") if sections else ""
            if open_ and first:
                begun = at + k + 1
        if begun is None:
            return
        held += data[begun - at :] if begun >= at else data
        within, depth, escaped = bool(m.within[-1]), int(m.depth[-1]), (len(data) - len(data.rstrip(b"\\"))) % 2 == 1
        at, size, first = at + len(data), 1 << 16, False


def _shifted(m: Marks, n: int) -> Marks:
    return Marks(np.concatenate([np.ones(n, bool), m.within]), np.concatenate([np.full(n, -1, np.int32), m.depth]))


@dataclass
class Chunk(InputPartition):
    path: str
    at: int
    size: int
    escaped: bool
    within: bool
    depth: int
    section: str | None
    array: bool


class ElementReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.chunks, self.sections = options["chunks"], options["sections"] == "true"

    def partitions(self) -> list[InputPartition]:
        return [Chunk(*c) for c in json.loads(self.chunks)]

    def read(self, partition: Chunk) -> Iterator[tuple[str, str | None, int, str]]:
        return _elements(partition, self.sections)


class JsonElements(DataSource):
    """``format("json_elements")``: made by elements(), which knows where chunks begin."""

    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ElementReader:
        return ElementReader(dict(self.options))


def elements(spark: SparkSession, path: str, sections: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(path, section, at, element): the elements of a JSON array, or with ``sections`` of the arrays in an object, as texts.

    ``path`` is a file or a folder of files, in any store that Arrow reads. Elements come with the place of their first
    byte; empty arrays, blank files and files that aren't there give none. What a chunk is told takes one row of a few
    numbers, which is all that the driver gets.
    """
    files = [(f, n) for f, n in listed(spark, path) if n]
    places = [(f, at, min(chunk, n - at)) for f, n in files for at in range(0, n, chunk)]
    if not places:
        return spark.createDataFrame([], SCHEMA)
    told = spark.createDataFrame(places, "path string, at long, size long").repartition(min(len(places), 4096), "path", "at")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f, at, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data, escaped = _read(f, at, size), _escaped(f, at)
                both = [(bool(m.within[-1]), int(m.depth[-1])) for m in (marks(data, escaped, w, 0) for w in (False, True))]
                out.append((f, at, size, escaped, *both[0], *both[1]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()))], names=list("pasewdxy"))

    rows = sorted(tuple(r) for r in told.mapInArrow(scanned, "p string, a long, s long, e boolean, w boolean, d long, x boolean, y long").collect())
    chunks, within, depth = [], False, 0
    for f, at, size, escaped, *ends in rows:
        if at == 0:
            within, depth = False, 0
        chunks.append([f, at, size, escaped, within, depth, "", True])
        within, depth = ends[2 * within], depth + ends[2 * within + 1]
    if sections:
        known = {(c[0], c[1]): tuple(c[3:6]) for c in chunks}

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for f, at, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    n = min(at, 4096)
                    data = _read(f, at, size)
                    m = marks(data, *known[f, at])
                    opened = np.flatnonzero((m.depth == 2) & ~m.within & np.isin(np.frombuffer(data, np.uint8), np.frombuffer(b"[{", np.uint8)))
                    if len(opened):
                        names = dict(_keys(_read(f, at - n, n) + data, _shifted(m, n)))
                        out.append((f, at, names.get(int(opened[-1]) + n, ""), data[int(opened[-1]) : int(opened[-1]) + 1] == b"["))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=list("pank"))

        opened = {(r["p"], r["a"]): (r["n"], r["k"]) for r in told.mapInArrow(last, "p string, a long, n string, k boolean").collect()}
        section = ("", False)
        for c in chunks:
            section = ("", False) if c[1] == 0 else section
            c[6], c[7] = section
            section = opened.get((c[0], c[1]), section)
    spark.dataSource.register(JsonElements)
    return spark.read.format("json_elements").option("chunks", json.dumps(chunks)).option("sections", str(sections).lower()).load()


def write_array(rows: DataFrame, column: str, path: str) -> None:
    """Writes texts of JSON documents as files that hold an array each, one a task."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            out = [("[" if i == 0 and mark == "[" else ",") + t for i, t in enumerate(batch.column(0).to_pylist())]
            mark = "," if out else mark
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"], pa.string())], names=["value"])

    rows.select(F.col(column).alias("value")).mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def write_sections(rows: DataFrame, section: str, column: str, path: str) -> None:
    """Writes texts of JSON documents as files that hold an object each, one a task, with an array for each section."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != now:
                    out.append(("{" if now is None else "],") + json.dumps(s) + ":[" + t)
                    now = s
                else:
                    out.append("," + t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["{}" if now is None else "]}"], pa.string())], names=["value"])

    rows.select(section, column).sortWithinPartitions(section).mapInArrow(framed, "value string").write.mode("overwrite").text(path)
