"""Queries over graphs derived from the driver's tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import algorithms as A
from sparkloom.operators import kernels as K
from sparkloom.operators.bitmaps import VertexSet
from sparkloom.operators.lineage import cut, ensure_checkpoint_dir
from sparkloom.plans import stats, tables
from sparkloom.plans.graph import balanced_chunks, by_owner, gather_blocks, given_out, owner, running_edges
from sparkloom.sources import prepared, records, text

ITERATIONS = 10
#: Chunks and ids of a page, of the queries on chunks.
CHUNKS, PAGE = 4, 64


def rounded(column: str) -> F.Column:
    return F.round(F.col(column), 6).alias(column)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def graph_edges(s: SparkSession, d: str) -> DataFrame:
    return tables.hop_edges(s, d)


def out_degree(s, d):
    return tables.hop(s, d).out_degrees().select("v", F.col("out_degree").alias("deg"))


def in_degree(s, d):
    return tables.hop(s, d).in_degrees().select("v", F.col("in_degree").alias("deg"))


def symmetrize_degree(s, d):
    return tables.hop(s, d).symmetrize().out_degrees().select("v", F.col("out_degree").alias("deg"))


def transpose_out_degree(s, d):
    return tables.hop(s, d).transpose().out_degrees().select("v", F.col("out_degree").alias("deg"))


def supply_degree(s, d):
    return tables.supply(s, d).vertices()


def adjacency_offsets(s, d):
    return running_edges(tables.hop(s, d))


def degree_distribution(s, d):
    return stats.degree_distribution(tables.hop(s, d))


def partition_degree_stats(s, d):
    return stats.chunk_degrees(tables.hop(s, d), 4)


def _chunks(s, d):
    g = tables.hop(s, d)
    return g, balanced_chunks(g, CHUNKS, page=PAGE)


def partition_chunks(s, d):
    return _chunks(s, d)[1]


def vertex_owner(s, d):
    g, chunks = _chunks(s, d)
    return g.vertex_ids.select("v", owner(chunks).alias("chunk"))


def range_layout(s, d):
    """Edges where they lie once they are laid out by the chunks that own their targets: a partition for each chunk."""
    g, chunks = _chunks(s, d)
    return stats.layout_skew(by_owner(g, chunks, CHUNKS))


def footprint(s, d):
    g, chunks = _chunks(s, d)
    return stats.footprint(g, chunks, weighted=True)


def footprint_remote(s, d):
    g, chunks = _chunks(s, d)
    return stats.remote_percent(stats.footprint(g, chunks, weighted=True))


def degree_report(s, d):
    path = scratch(s, "report")
    stats.write_degree_report(tables.hop(s, d), path, chunks=4)
    return s.read.text(path)


def gathered_degrees(s, d):
    """The degrees of all vertices, gathered into dense arrays and given out again by place."""
    g = tables.hop(s, d)
    return given_out(gather_blocks(g.out_degrees(), "out_degree", g.num_vertices), "deg")


def undirected_load(s, d):
    """Records written and loaded in both directions: degrees, and the raw number of records."""
    path = scratch(s, "edges")
    records.write_edges(tables.hop_edges(s, d), path)
    g = records.load_graph(s, path, tables.customers(s, d), undirected=True)
    return g.out_degrees().select("v", F.col("out_degree").alias("deg"), F.lit(g.num_edges).cast("long").alias("records"))


def edge_map_global(s, d):
    """The sum that comes with an edge map's messages."""
    g = tables.hop(s, d)
    message = F.col("x") + F.col("w")
    sent, total = K.edge_map(g, _thirds(g), message, "min", total=message)
    cut(sent)
    return s.createDataFrame([(round(total.value, 2),)], "total double")


def vertex_map_sum(s, d):
    g = tables.hop(s, d)
    state = K.vertex_map(g.vertices(), {"x": F.col("out_degree") * 2 + F.col("in_degree")}, F.col("v") % 3 == 0)
    return state.where(F.col("v") % 3 == 0).agg(F.sum("x").alias("total"))


def _thirds(g):
    return g.vertex_ids.where("v % 3 = 0").withColumn("x", (F.col("v") % 17).cast("double"))


def edge_map_sum(s, d):
    g = tables.hop(s, d)
    return K.edge_map(g, _thirds(g), F.col("x") + F.col("w"), "sum").select("v", rounded("msg"))


def edge_map_rows(s, d):
    """``edge_map_sum`` over adjacency rows."""
    g = tables.hop(s, d)
    return K.edge_map(g, _thirds(g), F.col("x") + F.col("w"), "sum", by="rows").select("v", rounded("msg"))


def adjacency_rows(s, d):
    """Each vertex's neighbours in order, as one string."""
    return tables.hop(s, d).out_rows.orderBy("v", "place").groupBy("v").agg(F.sum(F.size("others")).alias("n"), F.concat_ws(",", F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "others"))), lambda x: x["others"]))).alias("others"))


def visited_bitmap(s, d):
    """Members of a set of vertices by its bitmap: those that it tells again, and those that a scan finds in it."""
    g = tables.hop(s, d)
    held = VertexSet.of(g.out_degrees().where("out_degree % 3 = 1"), g.num_vertices)
    tester = held.tester()
    return g.vertex_ids.join(held.vertices().withColumn("told", F.lit(1)), "v", "left").select("v", tester.has(F.col("v")).alias("found"), F.col("told").isNotNull().alias("told"))


def edge_map_min(s, d):
    g = tables.hop(s, d)
    return K.edge_map(g, _thirds(g), F.col("x") + F.col("w"), "min").select("v", rounded("msg"))


def edge_map_selective(s, d):
    g = tables.hop(s, d)
    seen = g.vertex_ids.where("v % 2 = 0")
    return K.edge_map(g, _thirds(g), F.col("src"), "any", skip=seen)


def active_edges_direction(s, d):
    g = tables.hop(s, d)
    walk = A.breadth_first(g, tables.busiest(g))
    return walk.metrics().select(F.col("step").alias("level"), "active_edges", "mode")


def pagerank(s, d):
    return A.pagerank(tables.hop(s, d), ITERATIONS).select("v", rounded("pr"))


def pagerank_delta(s, d):
    return A.pagerank_changes(tables.hop(s, d), ITERATIONS).select("iter", rounded("delta"))


def pagerank_sum(s, d):
    return A.pagerank(tables.hop(s, d), ITERATIONS).agg(F.round(F.sum("pr"), 6).alias("pr_sum"))


def pagerank_top1(s, d):
    return A.pagerank(tables.hop(s, d), ITERATIONS).orderBy(F.desc("pr"), "v").limit(1).select("v", rounded("pr"))


def cc_labels_all(s, d):
    return A.components(tables.hop(s, d))


def cc_progress(s, d):
    """Vertices that speak in each round of label propagation."""
    return A.label_rounds(tables.hop_sparse(s, d)).metrics().select(F.col("step").alias("round"), "active")


def cc_round_labels(s, d):
    return A.label_rounds(tables.hop_sparse(s, d)).state


def cc_labels(s, d):
    return A.components(tables.hop_sparse(s, d))


def cc_sizes(s, d):
    return A.component_sizes(tables.hop_sparse(s, d))


def cc_count(s, d):
    return A.component_sizes(tables.hop_sparse(s, d)).agg(F.count(F.lit(1)).alias("n"))


def sssp_distance(s, d):
    g = tables.hop(s, d)
    return A.shortest_paths(g, tables.busiest(g)).state.select("v", rounded("dist"))


def sssp_distance_float(s, d):
    """Over 12-byte records, whose weights and distances are single precision."""
    path = scratch(s, "edges")
    records.write_edges(tables.hop_edges(s, d), path, weighted=True)
    g = records.load_graph(s, path, tables.customers(s, d), weighted=True)
    return A.shortest_paths(g, tables.busiest(g)).state.select("v", F.col("dist").cast("double").alias("dist"))


def sssp_farthest(s, d):
    g = tables.hop(s, d)
    root = tables.busiest(g)
    return A.farthest(g, A.shortest_paths(g, root).state, root).select("v", rounded("dist"))


def sssp_steps(s, d):
    """What the super-steps did (their jobs and seconds aren't repeatable)."""
    g = tables.hop(s, d)
    return A.shortest_paths(g, tables.busiest(g)).metrics().select("step", "active", "active_edges", "mode")


def bfs_tree_all(s, d):
    """Over all edges."""
    g = tables.hop(s, d)
    return A.breadth_first_by_blocks(g, tables.busiest(g))


def bfs_pull_reads(s, d):
    """In-edges that each level's pull step looks at: those of unvisited vertices, up to the first parent."""
    g = tables.hop(s, d)
    return A.breadth_first(g, tables.busiest(g), how="pull").metrics().select(F.col("step").alias("level"), "edges_read")


def _walk(s, d):
    g = tables.hop_sparse(s, d)
    return g, A.breadth_first_by_blocks(g, tables.busiest(g))


def bfs_tree(s, d):
    g, tree = _walk(s, d)
    return tree.select("v", F.coalesce("parent", F.lit(g.num_vertices)).alias("parent"), "level")


def bfs_reached(s, d):
    return _walk(s, d)[1].agg(F.count("parent").alias("reached"))


def bfs_frontier_sizes(s, d):
    return _walk(s, d)[1].where("level is not null").groupBy("level").agg(F.count(F.lit(1)).alias("size"))


def _between(s, d):
    g = tables.hop(s, d)
    return A.betweenness(g, tables.busiest(g))


def bc_sigma(s, d):
    return _between(s, d).select("v", rounded("sigma"))


def bc_dependency(s, d):
    return _between(s, d).select("v", F.when(~F.isnan("dep"), F.round("dep", 6)).alias("dep"))  # null where there is none


def top20_bc(s, d):
    """The first twenty ids; no dependency where they aren't reached."""
    return _between(s, d).where("v < 20").select("v", rounded("sigma"), F.when(~F.isnan("dep"), F.round("dep", 6)).alias("dep"))


def edge_roundtrip(s, d):
    path = scratch(s, "edges")
    records.write_edges(tables.hop_edges(s, d).withColumn("w", F.col("w").cast("float")), path, weighted=True)
    return records.read_edges(s, path, weighted=True).select("src", "dst", F.round(F.col("w").cast("double"), 1).alias("w"))


def vertex_array_roundtrip(s, d):
    g = tables.hop(s, d)
    path = scratch(s, "array")
    records.dump_vertex_array(g.out_degrees(), "out_degree", "uint32", path)
    return records.restore_vertex_array(s, path, "uint32", g.num_vertices)


def _prepared(s, d):
    """The graph, saved and loaded again."""
    path = scratch(s, "prepared")
    if prepared.load_graph(s, path) is None:
        prepared.save_graph(tables.hop(s, d), path)
    return prepared.load_graph(s, path)


def prepared_roundtrip(s, d):
    return _prepared(s, d).edges.select("src", "dst", "w")


def prepared_pagerank(s, d):
    """Over a loaded graph, whose edges stay in their buckets."""
    return A.pagerank(_prepared(s, d), ITERATIONS).select("v", rounded("pr"))


def tsv_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws("\t", "src", "dst").alias("value"))


def gr_lines(edges: DataFrame) -> DataFrame:
    """Edge lines with whole weights, each beside a comment."""
    line = F.concat_ws(" ", F.lit("a"), "src", "dst", F.floor("w").cast("long"))
    return edges.select(F.explode(F.array(line, F.concat(F.lit("c "), line))).alias("value"))


def text_edges(s, d):
    """The hops as a tab-separated file, read again."""
    path = scratch(s, "tsv")
    tsv_lines(tables.hop_edges(s, d)).write.text(path)
    return text.read_tsv_edges(s, path)


def dimacs_edges(s, d):
    path = scratch(s, "gr")
    gr_lines(tables.hop_edges(s, d)).write.text(path)
    return text.read_gr_edges(s, path, weighted=True).withColumn("w", F.col("w").cast("double"))


def text_conversion(s, d):
    """The hops as text among lines that are no edges (names of customers), converted to binary records and read again; bad lines counted."""
    path, out = scratch(s, "tsv"), scratch(s, "edges")
    names = s.read.parquet(f"{d}/customer.parquet").select(F.concat_ws("\t", "c_custkey", "c_name").alias("value"))
    tsv_lines(tables.hop_edges(s, d)).unionByName(names).write.text(path)
    edges, bad = text.convert_edges(s, path, out)
    found = records.read_edges(s, out)
    return found.groupBy("src").agg(F.count(F.lit(1)).alias("edges"), F.sum("dst").alias("dst_sum")).withColumns({"all_edges": F.lit(edges).cast("long"), "bad": F.lit(bad).cast("long")})


def log_lines(s, d) -> DataFrame:
    """(file, i, value): a run log in four files, made of the events: a signup starts a run, the others are times of processes or noise."""
    e = s.read.parquet(f"{d}/events.parquet")
    start = F.format_string("run: %d sudo  mpirun -np 4 --map-by socket ./bfs g %d 1", "event_id", "user_id")
    time = F.format_string("partiton_id: %d, total_process_time  =%s(s)", F.col("user_id") % 4, F.col("value").cast("string"))
    line = F.when(F.col("event_type") == "signup", start).when(F.col("event_type") == "error", F.col("props")).otherwise(time)
    return e.select((F.col("event_id") % 4).cast("int").alias("file"), F.col("event_id").alias("i"), line.alias("value"))


def _log(s, d) -> DataFrame:
    path = scratch(s, "log")
    lines = log_lines(s, d).repartition(4, "file").sortWithinPartitions("file", "i")
    lines.select("file", "value").write.partitionBy("file").text(path)
    summary = text.summarise_runs(text.read_log(s, path))
    return summary.withColumn("file", F.regexp_extract("file", r"file=(\d)", 1).cast("int"))


def run_log_summary(s, d):
    return _log(s, d).select("file", "run", "command", "max_time")


def run_log_report(s, d):
    return text.report_lines(_log(s, d)).select("file", "run", F.col("place").cast("int").alias("place"), "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        graph_edges, out_degree, in_degree, symmetrize_degree, transpose_out_degree, supply_degree, adjacency_offsets,
        degree_distribution, partition_degree_stats, partition_chunks, footprint, vertex_map_sum, edge_map_sum, edge_map_min,
        edge_map_selective, active_edges_direction, pagerank, pagerank_delta, pagerank_sum, pagerank_top1, cc_labels,
        cc_sizes, cc_count, sssp_distance, sssp_farthest, bfs_tree, bfs_reached, bfs_frontier_sizes, bc_sigma,
        bc_dependency, top20_bc, edge_roundtrip, vertex_array_roundtrip, prepared_roundtrip, text_edges, dimacs_edges,
        run_log_summary, run_log_report, vertex_owner, footprint_remote, degree_report, gathered_degrees, undirected_load,
        edge_map_global, sssp_distance_float, range_layout, edge_map_rows, adjacency_rows, visited_bitmap, cc_labels_all,
        cc_progress, cc_round_labels, sssp_steps, bfs_tree_all, bfs_pull_reads, prepared_pagerank, text_conversion,
    )
}
