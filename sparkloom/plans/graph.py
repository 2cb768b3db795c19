"""The graph model: a vertex relation 0..V-1 and a multigraph of directed edges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


SALT = "salt_"
#: Edges of a partition for which the number of partitions follows the number of edges.
PARTITION_EDGES = 4_000_000
#: Edges of one adjacency row; a vertex with more has several rows.
ROW_EDGES = 16_384
#: Values of one array of a vertex column.
BLOCK_VALUES = 65_536
#: A source with more than this share of a partition's mean number of edges is a hub.
HUB_SHARE = 4
#: ... if it has at least so many.
HUB_EDGES = 100_000


@dataclass(frozen=True)
class Graph:
    """``edges`` has src, dst and perhaps w; duplicates and loops count. ``num_vertices`` is the caller's.

    ``num_edges`` counts records as they were read: an undirected load keeps the raw number. Edges are ``laid``
    out by source; those of ``hubs``, sources that would fill a partition by themselves, by source and a salt.
    """

    edges: DataFrame
    num_vertices: int
    num_edges: int
    symmetric: bool = False
    laid: DataFrame | None = None
    hubs: tuple[int, ...] = ()
    partitions: int = 0

    @staticmethod
    def from_edges(edges: DataFrame, num_vertices: int, partitions: int | None = None, num_edges: int | None = None, symmetric: bool = False) -> Graph:
        """Edges are laid out once by ``src``, the key on which every edge map joins them."""
        counts = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
        total = counts.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
        n = partitions or max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total["n"] or 0) // PARTITION_EDGES))
        size, limit = total["n"] or 0, max(HUB_EDGES, HUB_SHARE * (total["n"] or 0) // n)
        if (total["most"] or 0) <= limit:
            heavy, laid = [], _laid(edges, n, "src")
        else:
            heavy = [r["src"] for r in counts.where(F.col("n") > limit).select("src").collect()]  # n / HUB_SHARE at most
            salt = F.when(F.col("src").isin(heavy), F.pmod(F.xxhash64("dst"), F.lit(n))).otherwise(F.lit(0)).cast("int")
            laid = _laid(edges.withColumn(SALT, salt), n, "src", SALT)
        laid.count()
        counts.unpersist()
        shown = laid.drop(SALT) if heavy else laid
        return Graph(shown, num_vertices, size if num_edges is None else num_edges, symmetric, laid, tuple(heavy), n)

    def unpersist(self) -> None:
        if self.laid is not None:
            self.laid.unpersist()
        for kept in ("out_rows", "in_rows", "degrees"):
            if kept in self.__dict__:
                self.__dict__.pop(kept).unpersist()
        if "incoming" in self.__dict__:
            self.__dict__.pop("incoming").unpersist()

    @property
    def spark(self):
        return self.edges.sparkSession

    @cached_property
    def vertex_ids(self) -> DataFrame:
        return self.spark.range(self.num_vertices).withColumnRenamed("id", "v")

    def _degree(self, end: str, name: str) -> DataFrame:
        counted = self.edges.groupBy(F.col(end).alias("v")).agg(F.count(F.lit(1)).alias(name))
        return self.vertex_ids.join(counted, "v", "left").select("v", F.coalesce(name, F.lit(0)).alias(name))

    def out_degrees(self) -> DataFrame:
        return self._degree("src", "out_degree")

    def in_degrees(self) -> DataFrame:
        return self._degree("dst", "in_degree")

    def vertices(self) -> DataFrame:
        """v, out_degree and in_degree, zeros included, by one aggregation over both ends."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
        counted = ends.groupBy("e.v").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
        joined = self.vertex_ids.join(counted, "v", "left")
        return joined.select("v", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("out_degree", "in_degree")])

    def _turned(self) -> DataFrame:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)

    @cached_property
    def degrees(self) -> DataFrame:
        """The out-degrees, dealt by vertex as the edges are, and kept."""
        return kept(self.out_degrees().repartition(self.partitions, "v"))

    @cached_property
    def incoming(self) -> Graph:
        """The transposed graph, laid out: edges by target. Kept with this graph."""
        return self.transpose().laid_out()

    @cached_property
    def out_rows(self) -> DataFrame:
        """Adjacency rows (v, place, others, and weights if there are any), ``others`` ascending; kept with this graph.

        A vertex has one row for ``ROW_EDGES`` edges; a hub's rows lie by its salts. Built where the edges lie, without an exchange.
        """
        return _adjacency(self.laid_out(), [c for c in self.edges.columns if c not in ("src", "dst")])

    @cached_property
    def in_rows(self) -> DataFrame:
        """Adjacency rows (v, place, others) of the in-edges: ``others`` are the sources, ascending."""
        return _adjacency(self.incoming, [])

    def transpose(self) -> Graph:
        """Every edge turned round; its own inverse. Not laid out yet: ``laid_out`` does that for what iterates."""
        return Graph(self._turned(), self.num_vertices, self.num_edges, self.symmetric)

    def symmetrize(self) -> Graph:
        """Every record in both directions; a loop counts twice, ``num_edges`` stays the raw number. Not laid out yet."""
        return Graph(self.edges.unionByName(self._turned()), self.num_vertices, self.num_edges, True)

    def laid_out(self) -> Graph:
        """This graph with its edges laid out by source (of a transposed graph: by target of the first)."""
        if self.laid is not None:
            return self
        return Graph.from_edges(self.edges, self.num_vertices, num_edges=self.num_edges, symmetric=self.symmetric)


def _adjacency(graph: Graph, rest: list[str]) -> DataFrame:
    keys = ["src", SALT] if graph.hubs else ["src"]
    number = F.row_number().over(W.partitionBy(*keys).orderBy("dst", *rest))
    placed = graph.laid.select(*keys, "dst", *rest, F.floor((number - 1) / ROW_EDGES).cast("int").alias("place"))
    rows = placed.groupBy(*keys, "place").agg(F.sort_array(F.collect_list(F.struct("dst", *rest))).alias("e"))  # ROW_EDGES at most
    lists = [F.col("e.dst").alias("others"), *[F.col(f"e.{c}").alias({"w": "weights"}.get(c, c)) for c in rest]]
    return kept(rows.select(F.col("src").alias("v"), *keys[1:], "place", *lists))


def kept(rows: DataFrame) -> DataFrame:
    """Rows persisted and computed: only then do plans know how they lie, and leave exchanges out."""
    out = rows.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def _laid(edges: DataFrame, partitions: int, *keys: str) -> DataFrame:
    return edges.repartition(partitions, *keys).persist(StorageLevel.MEMORY_AND_DISK)


def fixed_chunks(graph: Graph, chunks: int) -> DataFrame:
    """Vertices with degrees and the number of their chunk, chunks being equal ranges of ids."""
    width = -(-graph.num_vertices // chunks)
    return graph.vertices().withColumn("chunk", F.expr(f"v div {width}"))


def balanced_chunks(graph: Graph, chunks: int, page: int = 4096) -> DataFrame:
    """(chunk, first, last): ranges of ids with about equal out-degree plus a charge per vertex.

    Weights are summed per page of ids; one task reads the pages in order and folds them, holding one chunk: it takes
    pages until its share of what is left is reached. A page's row is 16 bytes for ``page`` vertices.
    """
    charge = 8 * (chunks - 1)
    pages = graph.out_degrees().groupBy(F.expr(f"v div {page}").alias("page")).agg(F.sum(F.col("out_degree") + charge).alias("weight"))
    total = pages.agg(F.sum("weight").alias("n")).first()["n"] or 0
    num_vertices = graph.num_vertices

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, first, at, held, chunk, out = total, 0, 0, 0, 0, []
        for batch in batches:
            for weight in batch.column(0).to_pylist():
                while chunk < chunks - 1 and held + weight > left / (chunks - chunk):
                    out.append((chunk, first, at))
                    left, first, held, chunk = left - held, at, 0, chunk + 1
                held, at = held + weight, at + 1
        while chunk < chunks:
            out.append((chunk, first, at))
            first, chunk = at, chunk + 1
        rows = [(c, a * page, min(b * page, num_vertices)) for c, a, b in out]
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["chunk", "first", "last"])

    return pages.repartition(1).sortWithinPartitions("page").select("weight").mapInArrow(fold, "chunk int, first long, last long")


def owner(chunks: DataFrame, vertex: str = "v") -> Column:
    """The chunk that owns a vertex, null for ids outside; ``chunks`` as ``balanced_chunks`` gives them, a row per worker.

    The ends of the ranges are one array; a binary search in it counts those at or below the vertex.
    """
    rows = sorted(chunks.select("chunk", "first", "last").collect(), key=lambda r: (r["first"], r["last"], r["chunk"]))
    steps = max(1, len(rows).bit_length())
    ends = F.split(F.lit(",".join(str(r["last"]) for r in rows)), ",").cast("array<bigint>")
    names = F.split(F.lit(",".join(str(r["chunk"]) for r in rows)), ",").cast("array<int>")
    v = F.col(vertex)
    wider = lambda at, half: F.when(F.coalesce(F.get(ends, at + half - 1), F.lit(1 << 62)) <= v, at + half).otherwise(at)
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])
    place = F.aggregate(halves, F.lit(0), wider)
    return F.when((v >= (rows[0]["first"] if rows else 0)), F.get(names, place))


def by_owner(graph: Graph, chunks: DataFrame, number: int, end: str = "dst") -> DataFrame:
    """The edges with the chunk that owns their ``end``, laid out so that partition i holds the edges of chunk i."""
    placed = graph.edges.withColumn("chunk", owner(chunks, end))
    return placed.repartitionById(number, F.coalesce("chunk", F.lit(0))).persist(StorageLevel.MEMORY_AND_DISK)


def gather(state: DataFrame, column: str, num_vertices: int, most: int = 10_000_000) -> np.ndarray:
    """A vertex column as one array on the driver, vertex v's value at v; refuses more than ``most`` vertices."""
    if num_vertices > most:
        raise ValueError(f"{num_vertices} values are more than the driver takes ({most}); write them instead")
    rows = state.select("v", column).toArrow()
    if rows.num_rows != num_vertices:
        raise ValueError(f"{rows.num_rows} rows for {num_vertices} vertices")
    values = rows.column(1).to_numpy()
    out = np.empty(num_vertices, values.dtype)
    out[rows.column(0).to_numpy()] = values
    return out


def gather_blocks(state: DataFrame, column: str, num_vertices: int, block: int = BLOCK_VALUES) -> DataFrame:
    """(block, values): a vertex column as dense arrays, one for ``block`` ids, vertex v's value at v mod ``block``; nothing passes through the driver.

    Like ``gather`` it refuses a state that lacks a vertex or has one twice: the query that computes the blocks fails.
    """
    held = state.where("v is not null").groupBy(F.expr(f"v div {block}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("v", F.col(column).alias("value")))).alias("rows"))
    every = state.sparkSession.range(-(-num_vertices // block)).withColumnRenamed("id", "block")
    first = F.col("block") * block
    ids = F.sequence(first, F.least(first + block, F.lit(num_vertices)) - 1)
    whole = F.coalesce(F.col("rows.v") == ids, F.lit(False))
    told = F.format_string(f"block %d doesn't have each of the {num_vertices} vertices once", "block")
    return every.join(held, "block", "full").select("block", F.when(whole, F.col("rows.value")).otherwise(F.raise_error(told)).alias("values"))


def given_out(blocks: DataFrame, column: str, block: int = BLOCK_VALUES) -> DataFrame:
    """(v, column): the values of ``gather_blocks`` by their places."""
    return blocks.select("block", F.posexplode("values").alias("place", column)).select((F.col("block") * block + F.col("place")).alias("v"), column)


def running_edges(graph: Graph) -> DataFrame:
    """(v, offset): edges of all smaller ids, the index of a compressed adjacency.

    The sum runs within blocks of ids and over the blocks' totals, never over all rows in one task.
    """
    block = F.expr(f"v div {max(1, graph.num_vertices // 1024)}")
    rows = graph.out_degrees().withColumn("block", block)
    inner = W.partitionBy("block").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("block").agg(F.sum("out_degree").alias("n"))
    before = totals.select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    joined = rows.join(F.broadcast(before), "block")  # about 1024 blocks
    return joined.select("v", (F.col("before") + F.coalesce(F.sum("out_degree").over(inner), F.lit(0))).alias("offset"))
