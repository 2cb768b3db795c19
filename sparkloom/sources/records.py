"""Files of fixed-width little-endian records as Spark data sources.

``format("edgerecords")``: uint32 source, uint32 target and, with option ``weighted``, float32 weight.
``format("vertexarray")``: one value per vertex, option ``type`` (uint32, float32 or float64); the place in
the files, taken in order of their names, is the vertex.

Files are split by byte ranges; a trailing partial record is ignored. Writers put one file per task into a
temporary folder of the job's own and move all at commit, so that a task that runs twice leaves one file,
jobs don't meet, and a second job's files stand beside the first's. Values outside a field's range and nulls are errors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sparkloom.plans.graph import Graph

#: Records that one task reads, and records in one batch.
SPLIT_RECORDS = 8_000_000
BATCH_RECORDS = 1 << 20
VALUE_TYPES = {"uint32": ("<u4", "bigint"), "float32": ("<f4", "float"), "float64": ("<f8", "double")}


def edge_dtype(weighted: bool) -> np.dtype:
    return np.dtype([("src", "<u4"), ("dst", "<u4")] + ([("w", "<f4")] if weighted else []))


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    system, inside = open_fs(path)
    return system.get_file_info(inside).type != pafs.FileType.NotFound


def file_size(path: str) -> int:
    system, inside = open_fs(path)
    return system.get_file_info(inside).size


@dataclass
class Split(InputPartition):
    path: str
    start: int
    records: int
    first: int


def splits(path: str, width: int) -> list[Split]:
    system, inside = open_fs(path)
    info = system.get_file_info(inside)
    files = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inside))
    out, first = [], 0
    for one in sorted((f for f in files if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
        records = one.size // width
        for start in range(0, records, SPLIT_RECORDS):
            n = min(SPLIT_RECORDS, records - start)
            out.append(Split(one.path, start * width, n, first + start))
        first += records
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict, dtype: np.dtype):
        self.path, self.dtype = options["path"], dtype

    def partitions(self) -> list[Split]:
        return splits(self.path, self.dtype.itemsize) or [Split("", 0, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.records:
            return
        system, _ = open_fs(self.path)
        with system.open_input_file(split.path) as file:
            file.seek(split.start)
            for at in range(0, split.records, BATCH_RECORDS):
                n = min(BATCH_RECORDS, split.records - at)
                rows = np.frombuffer(file.read(n * self.dtype.itemsize), self.dtype)
                yield self.batch(rows, split.first + at)

    def batch(self, rows: np.ndarray, first: int) -> pa.RecordBatch:
        raise NotImplementedError


class _EdgeReader(_Reader):
    def batch(self, rows: np.ndarray, first: int) -> pa.RecordBatch:
        columns = [pa.array(rows["src"].astype(np.int64)), pa.array(rows["dst"].astype(np.int64))]
        if "w" in rows.dtype.names:
            columns.append(pa.array(np.ascontiguousarray(rows["w"])))
        return pa.RecordBatch.from_arrays(columns, list(rows.dtype.names))


class _ArrayReader(_Reader):
    def batch(self, rows: np.ndarray, first: int) -> pa.RecordBatch:
        value = rows["value"].astype(np.int64) if rows.dtype["value"].kind == "u" else np.ascontiguousarray(rows["value"])
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rows))), pa.array(value)], ["v", "value"])


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    name: str


def field_values(column: pa.Array, name: str, kind: np.dtype) -> np.ndarray:
    """A column as a field of records; nulls and integers that don't fit are errors."""
    if column.null_count:
        raise ValueError(f"{name}: {column.null_count} nulls")
    values = column.to_numpy(zero_copy_only=False)
    if kind.kind == "u" and len(values) and (values.min() < 0 or values.max() > np.iinfo(kind).max):
        raise ValueError(f"{name}: values outside 0 to {np.iinfo(kind).max}")
    return values


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, dtype: np.dtype, overwrite: bool):
        self.path, self.dtype, self.overwrite = options["path"], dtype, overwrite
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, inside = open_fs(self.path)
        task = TaskContext.get().partitionId()
        folder = f"{inside}/_temporary-{self.job}"
        system.create_dir(folder, recursive=True)
        temporary = f"{folder}/{task:06d}-{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as out:
            for batch in batches:
                rows = np.empty(batch.num_rows, self.dtype)
                for name in self.dtype.names:
                    rows[name] = field_values(batch.column(batch.schema.get_field_index(name)), name, self.dtype[name])
                out.write(rows.tobytes())
        return Written(temporary, f"part-{task:06d}-{self.job}.bin")

    def commit(self, messages: list[Written | None]) -> None:
        system, inside = open_fs(self.path)
        system.create_dir(inside, recursive=True)
        before = [f.path for f in system.get_file_info(pafs.FileSelector(inside)) if f.is_file] if self.overwrite else []
        for m in messages:
            if m is not None:
                system.move(m.temporary, f"{inside}/{m.name}")
        for old in before:
            system.delete_file(old)
        self._clear(system, inside)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*open_fs(self.path))

    def _clear(self, system: pafs.FileSystem, inside: str) -> None:
        folder = f"{inside}/_temporary-{self.job}"
        if system.get_file_info(folder).type != pafs.FileType.NotFound:
            system.delete_dir(folder)


class _ArrayWriter(_Writer):
    """Takes (v, value) in the order of v; each task's vertices must follow each other without gap or repetition."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        def checked() -> Iterator[pa.RecordBatch]:
            last = None
            for batch in batches:
                v = batch.column(batch.schema.get_field_index("v")).to_numpy()
                if len(v) and ((last is not None and v[0] != last + 1) or (np.diff(v) != 1).any()):
                    raise ValueError("vertices that don't follow each other: an id is missing or there twice")
                last = v[-1] if len(v) else last
                yield batch

        return super().write(checked())


class EdgeRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edgerecords"

    @property
    def dtype(self) -> np.dtype:
        return edge_dtype(str(self.options.get("weighted", "false")).lower() == "true")

    def schema(self) -> str:
        return "src long, dst long" + (", w float" if "w" in self.dtype.names else "")

    def reader(self, schema) -> DataSourceReader:
        return _EdgeReader(dict(self.options), self.dtype)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), self.dtype, overwrite)


class VertexArray(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vertexarray"

    def schema(self) -> str:
        return f"v long, value {VALUE_TYPES[self.options['type']][1]}"

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([("value", VALUE_TYPES[self.options["type"]][0])])

    def reader(self, schema) -> DataSourceReader:
        return _ArrayReader(dict(self.options), self.dtype)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ArrayWriter(dict(self.options), self.dtype, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EdgeRecords)
    spark.dataSource.register(VertexArray)


def read_edges(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("edgerecords").option("weighted", str(weighted).lower()).load(path)


def write_edges(edges: DataFrame, path: str, weighted: bool = False) -> None:
    register(edges.sparkSession)
    columns = ["src", "dst", *(["w"] if weighted else [])]
    rows = edges.select(*columns)
    rows.write.format("edgerecords").mode("append").option("weighted", str(weighted).lower()).save(path)


def dump_vertex_array(state: DataFrame, value: str, kind: str, path: str) -> None:
    """A dense raw array in a new or empty folder: vertex v's value is the v-th; each of 0..V-1 must be there once.

    The number, least and greatest id are counted first; the write, sorted by ranges of ids, fails where ids don't follow each other within
    a task. Equal ids fall into one task, so both together leave no id out and none twice.
    """
    from pyspark.sql import functions as F

    register(state.sparkSession)
    if exists(path) and splits(path, 1):
        raise ValueError(f"{path} holds files already; their order is the vertices'")
    found = state.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("rows")).first()
    n = found["rows"]
    if n and (found["n"], found["lo"], found["hi"]) != (n, 0, n - 1):
        raise ValueError(f"{n} rows aren't the vertices 0 to {n - 1} once each")
    rows = state.select(F.col("v").cast("long").alias("v"), F.col(value).alias("value")).sort("v")
    rows.write.format("vertexarray").mode("append").option("type", kind).save(path)


def restore_vertex_array(spark: SparkSession, path: str, kind: str, num_vertices: int) -> DataFrame:
    register(spark)
    width = np.dtype(VALUE_TYPES[kind][0]).itemsize
    found = sum(s.records for s in splits(path, width))
    if found != num_vertices:
        raise ValueError(f"{path} holds {found} values, the graph has {num_vertices} vertices")
    return spark.read.format("vertexarray").option("type", kind).load(path)


def load_graph(spark: SparkSession, path: str, num_vertices: int, weighted: bool = False, undirected: bool = False) -> Graph:
    """A graph from binary records, laid out by source; ``undirected`` holds each record in both directions, ``num_edges`` the raw number."""
    edges = read_edges(spark, path, weighted)
    if not undirected:
        return Graph.from_edges(edges, num_vertices)
    raw = sum(s.records for s in splits(path, edge_dtype(weighted).itemsize))
    return Graph(edges, num_vertices, raw).symmetrize().laid_out()
