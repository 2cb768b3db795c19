"""Graphs derived from the driver's tables. Their ids are dense from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.plans.graph import Graph

#: Graphs by application, folder and name, so that queries share one layout of the edges; the latest used are last.
_graphs: dict[tuple[str, str, str], Graph] = {}
#: Graphs that are kept; older ones are let go of.
KEPT = 4


def _shared(spark: SparkSession, sf_dir: str, build: Callable[[SparkSession, str], Graph]) -> Graph:
    """The graph as it was laid out before, or anew if its edges aren't persisted any more."""
    key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
    graph = _graphs.pop(key, None)
    if graph is None or not (graph.laid.storageLevel.useMemory or graph.laid.storageLevel.useDisk):
        graph = build(spark, sf_dir)
    _graphs[key] = graph
    while len(_graphs) > KEPT:
        oldest = _graphs.pop(next(iter(_graphs)))
        if oldest.spark.sparkContext.applicationId == spark.sparkContext.applicationId:
            oldest.unpersist()
    return graph


def hop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer to the next by order key inside one order date, weighted by the order's price."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    next_one = F.lead("o_custkey").over(W.partitionBy("o_orderdate").orderBy("o_orderkey"))
    edges = orders.select(F.col("o_custkey").alias("src"), next_one.alias("dst"), F.col("o_totalprice").alias("w"))
    return edges.where("dst is not null")


def customers(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").agg((F.max("c_custkey") + 1).alias("n")).first()["n"]


def hop(spark: SparkSession, sf_dir: str) -> Graph:
    return _shared(spark, sf_dir, _hop)


def hop_sparse(spark: SparkSession, sf_dir: str) -> Graph:
    """The hops that start at every seventh customer: many components, many isolated vertices."""
    return _shared(spark, sf_dir, _hop_sparse)


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers to parts, parts numbered after the suppliers."""
    return _shared(spark, sf_dir, _supply)


def _hop(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_edges(hop_edges(spark, sf_dir), customers(spark, sf_dir))


def _hop_sparse(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_edges(hop_edges(spark, sf_dir).where("src % 7 = 0"), customers(spark, sf_dir))


def _supply(spark: SparkSession, sf_dir: str) -> Graph:
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg((F.max("s_suppkey") + 1).alias("n")).first()["n"]
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").agg((F.max("p_partkey") + 1).alias("n")).first()["n"]
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edges = items.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + suppliers).alias("dst"), F.col("l_quantity").alias("w"))
    return Graph.from_edges(edges, suppliers + parts)


def busiest(graph: Graph) -> int:
    """The vertex of highest out-degree, the lowest id among equals."""
    counted = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "src").first()["src"]
