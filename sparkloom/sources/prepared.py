"""Prepared graphs: edges as bucketed Parquet, which loads without an exchange, beside rows of metadata.

Edges lie in as many buckets as the graph had partitions, by source (and by salt, if there are hubs), sorted. A graph's
metadata is appended after its edges are there, a row for each save, and the latest row holds; edges of a save go into
a folder of their own. So a save that fails leaves the graph before it whole, and a reader never meets half of one.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.graph import SALT, Graph

META = "saved long, edges string, columns string, buckets int, salted boolean, hubs array<long>, num_vertices long, num_edges long, symmetric boolean"


def _keys(salted: bool) -> list[str]:
    return ["src", SALT] if salted else ["src"]


def _table(path: str) -> str:
    """A catalog name for a folder, made of the name's digits."""
    return f"sparkloom_prepared_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"


def save_graph(graph: Graph, path: str) -> None:
    graph = graph.laid_out()
    salted, folder = bool(graph.hubs), f"{path}/edges-{uuid.uuid4().hex}"
    keys, table = _keys(salted), _table(folder)
    writer = graph.laid.write.bucketBy(graph.partitions, *keys).sortBy(*keys).format("parquet").option("path", folder)
    writer.saveAsTable(table)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in graph.laid.schema)
    row = (time.time_ns(), folder, columns, graph.partitions, salted, list(graph.hubs), graph.num_vertices, graph.num_edges, graph.symmetric)
    graph.spark.createDataFrame([row], META).coalesce(1).write.mode("append").json(f"{path}/meta")


def load_graph(spark: SparkSession, path: str) -> Graph | None:
    """The graph saved last, or None where there is none, so that callers can fall back to the edge list."""
    try:
        m = spark.read.schema(META).json(f"{path}/meta").orderBy(F.desc("saved")).first()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if m is None:
        return None
    table = _table(m["edges"])
    if not spark.catalog.tableExists(table):  # saved by another session
        keys, folder = ", ".join(_keys(m["salted"])), m["edges"].replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({m['columns']}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {m['buckets']} BUCKETS LOCATION '{folder}'")
    laid = spark.table(table)
    return Graph(laid.drop(SALT), m["num_vertices"], m["num_edges"], m["symmetric"], laid, tuple(m["hubs"]), m["buckets"])


def save_vertex_column(state: DataFrame, path: str) -> None:
    state.write.mode("overwrite").parquet(path)


def load_vertex_column(spark: SparkSession, path: str, num_vertices: int) -> DataFrame:
    rows = spark.read.parquet(path)
    if rows.count() != num_vertices:
        raise ValueError(f"{path} doesn't hold a value for each of {num_vertices} vertices")
    return rows
