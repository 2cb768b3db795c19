"""Degree distribution, degrees per chunk, and the sizes of what a graph keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import human_size
from sparkloom.plans.graph import Graph, fixed_chunks, owner


def degree_distribution(graph: Graph) -> DataFrame:
    """One row: vertices, edges, and minimum, maximum, mean, zeros and share of zeros of both degrees."""
    figures = [F.count(F.lit(1)).alias("vertices"), F.sum("out_degree").alias("edges")]
    for side in ("out", "in"):
        d = F.col(f"{side}_degree")
        zero = F.sum((d == 0).cast("long"))
        figures += [
            F.min(d).alias(f"min_{side}"),
            F.max(d).alias(f"max_{side}"),
            F.round(F.avg(d), 6).alias(f"avg_{side}"),
            zero.alias(f"zero_{side}"),
            F.round(100.0 * zero / F.count(F.lit(1)), 6).alias(f"zero_{side}_percent"),
        ]
    return graph.vertices().agg(*figures)


def chunk_degrees(graph: Graph, chunks: int) -> DataFrame:
    """A row per chunk: vertices, edges out and in, means and maxima."""
    return fixed_chunks(graph, chunks).groupBy("chunk").agg(
        F.count(F.lit(1)).alias("vertices"),
        F.sum("out_degree").alias("out_edges"),
        F.sum("in_degree").alias("in_edges"),
        F.round(F.avg("out_degree"), 6).alias("avg_out"),
        F.round(F.avg("in_degree"), 6).alias("avg_in"),
        F.max("out_degree").alias("max_out"),
        F.max("in_degree").alias("max_in"),
    )


def report_lines(graph: Graph, chunks: int = 0) -> DataFrame:
    """(line, value): the degree report as text; with ``chunks``, a line for each chunk too."""
    r = degree_distribution(graph).first()
    lines = [f"vertices: {r['vertices']}", f"edges: {r['edges']}"]
    for side in ("out", "in"):
        share = 100.0 * r[f"zero_{side}"] / r["vertices"] if r["vertices"] else 0.0
        lines += [f"{side}-degree min: {r[f'min_{side}']}", f"{side}-degree max: {r[f'max_{side}']}", f"{side}-degree mean: {r[f'avg_{side}'] or 0:.2f}"]
        lines.append(f"{side}-degree zero: {r[f'zero_{side}']} ({share:.1f}%)")
    if chunks:
        for c in chunk_degrees(graph, chunks).orderBy("chunk").collect():  # a row per worker
            lines.append(
                f"chunk {c['chunk']}: vertices {c['vertices']}, out {c['out_edges']}, in {c['in_edges']}, "
                f"mean out {c['avg_out']:.1f}, mean in {c['avg_in']:.1f}, max out {c['max_out']}, max in {c['max_in']}"
            )
    return graph.spark.createDataFrame(list(enumerate(lines)), "line int, value string")


def write_degree_report(graph: Graph, path: str, chunks: int = 0) -> None:
    report_lines(graph, chunks).orderBy("line").select("value").coalesce(1).write.mode("overwrite").text(path)


#: Bytes of an edge's binary record, without and with a weight.
RECORD_BYTES = {False: 8, True: 12}


def footprint(graph: Graph, chunks: DataFrame, weighted: bool) -> DataFrame:
    """(chunk, vertices, edges, remote, bytes, human): what each chunk of ids holds, its edges being those that leave its vertices.

    ``remote`` edges end in another chunk: what would travel if chunks were workers; ``bytes`` are those of the edges' records.
    """
    placed = graph.edges.select(owner(chunks, "src").alias("chunk"), owner(chunks, "dst").alias("to"))
    counted = placed.groupBy("chunk").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("to") != F.col("chunk")).alias("remote"))
    sizes = chunks.select("chunk", (F.col("last") - F.col("first")).alias("vertices"))
    joined = sizes.join(counted, "chunk", "left").select("chunk", "vertices", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("edges", "remote")])
    joined = joined.withColumn("bytes", F.col("edges") * RECORD_BYTES[weighted])
    return joined.withColumn("human", human_size(F.col("bytes")))


def remote_percent(parts: DataFrame) -> DataFrame:
    """One row: the share of all edges that end in another chunk."""
    return parts.agg(F.round(100.0 * F.sum("remote") / F.sum("edges"), 6).alias("remote_percent"))


def layout_skew(laid: DataFrame) -> DataFrame:
    """(place, edges, chunks): the edges that lie in each partition, and how many chunks own them."""
    return laid.groupBy(F.spark_partition_id().alias("place")).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("chunk").alias("chunks"))
