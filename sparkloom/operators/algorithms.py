"""PageRank, components, shortest paths, breadth-first search and betweenness as loops of super-steps.

The driver loops; each super-step is one plan of join, partial aggregation and one shuffle by target, and
the driver reads one small figure from it. Lineage is cut by reliable checkpoints of the vertex state.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import UNREACHED, over
from sparkloom.operators import blocks
from sparkloom.operators.components import connected_components as star_components
from sparkloom.operators.bitmaps import Tester, VertexSet, fits
from sparkloom.operators.kernels import direction, edge_map, pull_step
from sparkloom.operators.lineage import cut, cut_measured, ensure_checkpoint_dir
from sparkloom.operators.steps import StepLog
from sparkloom.plans.graph import PARTITION_EDGES, Graph, kept

DAMPING = 0.85
#: Super-steps between two checkpoints where a step doesn't need to be read back.
CUT_EVERY = 5
#: Levels whose results are kept apart before they are written together.
COMPACT_EVERY = 10


@dataclass
class Traversal:
    state: DataFrame
    log: StepLog

    def metrics(self) -> DataFrame:
        """(step, active, active_edges, mode, edges_read, jobs, tasks, seconds) of each super-step."""
        return self.log.frame()


def _rank_step(graph: Graph, state: DataFrame, damping: float) -> DataFrame:
    """(v, out_degree, old, pr) from (v, out_degree, pr)."""
    out = F.col("out_degree")
    sent = state.where(out > 0).select("v", (F.col("pr") / out).alias("share"))
    got = edge_map(graph, sent, F.col("share"), "sum")
    fresh = (1 - damping) + damping * F.coalesce("msg", F.lit(0.0))
    return state.withColumnRenamed("pr", "old").join(got, "v", "left").select("v", "out_degree", "old", fresh.alias("pr"))


def pagerank(graph: Graph, iterations: int, damping: float = DAMPING) -> DataFrame:
    """(v, pr). Ranks aren't normalised and start at 1; what vertices without out-edges hold goes nowhere.

    With no iteration the state that would be sent is returned: 1/out_degree, or 1 without out-edges.
    """
    graph = graph.laid_out()
    degrees = cut(graph.out_degrees())
    if iterations == 0:
        return degrees.select("v", over(F.lit(1.0), F.col("out_degree"), F.lit(1.0)).alias("pr"))
    state = degrees.withColumn("pr", F.lit(1.0))
    for i in range(iterations):
        state = _rank_step(graph, state, damping).drop("old")
        if (i + 1) % CUT_EVERY == 0 and i + 1 < iterations:
            state = cut(state)
    return state.select("v", "pr")


def pagerank_changes(graph: Graph, iterations: int, damping: float = DAMPING) -> DataFrame:
    """(iter, delta): the change known before each iteration, 1 at first, and 0 after the last.

    The change is the mean |difference| of two states; the states are scaled by the out-degree and weighted
    by it again, so that it cancels.
    """
    graph = graph.laid_out()
    state = cut(graph.out_degrees()).withColumn("pr", F.lit(1.0))
    rows = [(0, 1.0)]
    for i in range(1, iterations):
        stepped, figures = cut_measured(_rank_step(graph, state, damping), moved=F.sum(F.abs(F.col("pr") - F.col("old"))))
        rows.append((i, figures["moved"] / graph.num_vertices))
        state = stepped.drop("old")
    rows.append((iterations, 0.0))
    return graph.spark.createDataFrame(rows, "iter int, delta double")


def components(graph: Graph) -> DataFrame:
    """(v, label): smallest vertex of the weak component; vertices without edges keep their own id."""
    labels = star_components(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return graph.vertex_ids.join(labels, "v", "left").select("v", F.coalesce("label", "v").alias("label"))


def component_sizes(graph: Graph) -> DataFrame:
    return components(graph).groupBy("label").agg(F.count(F.lit(1)).alias("size"))


class Lowest:
    """The least value known of each vertex: a base, dealt by vertex, and the frontiers since.

    Frontiers are written into a new base every ``COMPACT_EVERY`` steps. Messages look their targets up in the base where it lies,
    so a step shuffles messages and frontiers, not what is known.
    """

    def __init__(self, graph: Graph, frontier: DataFrame, column: str):
        self.graph, self.column, self.base, self.since = graph, column, None, [frontier.select("v", column)]

    def known(self) -> DataFrame:
        rows = self.since if self.base is None else [self.base, *self.since]
        out = reduce(DataFrame.unionByName, rows)
        return out.groupBy("v").agg(F.min(self.column).alias(self.column)) if len(rows) > 1 else out

    def beside(self, messages: DataFrame) -> DataFrame:
        """Messages (v, msg) with ``old``, the least value known of v, or null."""
        recent = reduce(DataFrame.unionByName, self.since)
        out = messages.join(recent.groupBy("v").agg(F.min(self.column).alias("recent")), "v", "left")
        if self.base is None:
            return out.withColumnRenamed("recent", "old")
        out = out.hint("shuffle_hash").join(self.base.withColumnRenamed(self.column, "before"), "v", "left")
        return out.withColumn("old", F.least("recent", "before")).drop("recent", "before")

    def add(self, frontier: DataFrame) -> None:
        self.since.append(frontier.select("v", self.column))
        if len(self.since) > COMPACT_EVERY:
            dealt = kept(cut(self.known()).repartition(self.graph.partitions, "v"))
            none = dealt.where("false").select("v", self.column)
            self.close()
            self.base, self.since = dealt, [none]

    def close(self) -> None:
        if self.base is not None:
            self.base.unpersist()


def _extent(frontier: DataFrame) -> tuple[DataFrame, int, int]:
    """A frontier (v, out_degree, ...), written, with its rows and the sum of its out-degrees, by one job."""
    out, r = cut_measured(frontier, rows=F.count(F.lit(1)), n=F.sum("out_degree"))
    return out, r["rows"] or 0, r["n"] or 0


def label_rounds(graph: Graph) -> Traversal:
    """(v, label) as ``components`` gives it, by rounds: each vertex whose label fell tells both ends of its edges.

    Rounds follow the diameter, where ``components`` takes its logarithm; this is the form whose progress is of interest.
    ``active`` is the number of vertices that speak in a round, all in the first.
    """
    both = (graph if graph.symmetric else graph.symmetrize()).laid_out()
    log, step = StepLog(graph.spark), 0
    frontier, rows, n = _extent(both.degrees.select("v", F.col("v").alias("label"), "out_degree"))
    labels = None
    while rows:
        mode = direction(n, both.num_edges)
        with log.step(step, rows, n, mode):
            got = edge_map(both, frontier.select("v", "label"), F.col("label"), "min", how=mode, rows=rows)
            got = got.withColumn("old", F.lit(None).cast("long")) if labels is None else labels.beside(got)
            lower = got.where(F.col("msg") < F.coalesce("old", "v"))
            frontier, rows, n = _extent(lower.select("v", F.col("msg").alias("label")).join(both.degrees, "v"))
        step += 1
        if rows and labels is None:
            labels = Lowest(both, frontier, "label")
        elif rows:
            labels.add(frontier)
    if labels is None:
        return Traversal(graph.vertex_ids.select("v", F.col("v").alias("label")), log)
    return Traversal(graph.vertex_ids.join(labels.known(), "v", "left").select("v", F.coalesce("label", "v").alias("label")), log)


def shortest_paths(graph: Graph, root: int, how: str = "auto", limit: float = UNREACHED) -> Traversal:
    """(v, dist): Bellman-Ford from the frontier of lowered vertices; ``limit`` where nothing arrives.

    A step is one job: it writes the next frontier and measures it.
    """
    graph = graph.laid_out()
    kind = graph.edges.schema["w"].dataType
    log, step = StepLog(graph.spark), 0
    frontier, rows, n = _extent(graph.degrees.where(F.col("v") == root).select("v", F.lit(0).cast(kind).alias("dist"), "out_degree"))
    known = Lowest(graph, frontier, "dist")
    while rows:
        mode = direction(n, graph.num_edges) if how == "auto" else how
        with log.step(step, rows, n, mode):
            got = edge_map(graph, frontier.select("v", "dist"), (F.col("dist") + F.col("w")).cast(kind), "min", how=mode, rows=rows)
            lower = known.beside(got).where(F.col("msg") < F.coalesce("old", F.lit(limit).cast(kind)))
            frontier, rows, n = _extent(lower.select("v", F.col("msg").alias("dist")).join(graph.degrees, "v"))
        step += 1
        if rows:
            known.add(frontier)
    whole = graph.vertex_ids.join(known.known(), "v", "left").select("v", F.coalesce("dist", F.lit(limit).cast(kind)).alias("dist"))
    return Traversal(whole, log)


def farthest(graph: Graph, paths: DataFrame, root: int, limit: float = UNREACHED) -> DataFrame:
    """(v, dist) of the farthest reached vertex; the lowest id among equals, the root if none is farther."""
    reached = paths.where(F.col("dist") < limit)
    first = F.when(F.col("dist") > 0, F.lit(1)).otherwise(F.when(F.col("v") == root, F.lit(1)).otherwise(F.lit(0)))
    return reached.orderBy(F.desc("dist"), F.desc(first), "v").limit(1).select("v", "dist")


class Visited:
    """Vertices that a walk has seen, and its frontier: bitmaps that scans ask while they fit, rows beyond."""

    def __init__(self, graph: Graph, frontier: DataFrame):
        self.graph, self.members, self.added = graph, 1, 0
        self.rows = [frontier.select("v")]
        self.newest = self.all = self._tester(frontier)

    def _tester(self, frontier: DataFrame) -> Tester | None:
        n = self.graph.num_vertices
        return VertexSet.of(frontier, n).tester() if fits(n, self.members) else None

    def skip(self) -> Tester | DataFrame:
        """What an edge map leaves out: a tester, or rows."""
        return reduce(DataFrame.unionByName, self.rows) if self.all is None else self.all

    def add(self, frontier: DataFrame, members: int) -> None:
        before, newest = self.all, self.newest
        self.members, self.added = self.members + members, self.added + 1
        self.rows.append(frontier.select("v"))
        self.newest = self._tester(frontier)
        self.all = before.union(self.newest) if before and self.newest else None
        for old in {before, newest}:
            if old is not None:
                old.drop()
        if self.all is None and self.added % COMPACT_EVERY == 0:
            self.rows = [cut(self.skip())]

    def close(self) -> None:
        for old in {self.all, self.newest}:
            if old is not None:
                old.drop()


def breadth_first(graph: Graph, root: int, how: str = "auto") -> Traversal:
    """(v, parent, level); the smallest frontier neighbour becomes the parent; null where unreached.

    A push step joins the frontier with its out-edges, those to visited vertices left out in their scan. A pull step reads the in-edges of unvisited
    vertices and stops at a vertex's first parent; it has no exchange but that of ``in_rows``, once. Where the bitmaps don't fit, a
    pull step joins as a push step does. A step is one job, and a
    small one for the frontier's bitmap.
    """
    graph = graph.laid_out()
    log, level = StepLog(graph.spark), 0
    frontier, rows, n = _extent(graph.degrees.where(F.col("v") == root).select("v", F.col("v").alias("parent"), F.lit(0).alias("level"), "out_degree"))
    tree, visited = frontier.drop("out_degree"), Visited(graph, frontier)
    while rows:
        mode = direction(n, graph.num_edges) if how == "auto" else how
        with log.step(level, rows, n, mode) as row:
            looked = None
            if mode == "pull" and visited.newest is not None:
                got, looked = pull_step(graph, visited.newest, visited.all)
            else:
                got = edge_map(graph, frontier.select("v"), F.col("src"), "any", skip=visited.skip(), how=mode, rows=rows)
            found = got.select("v", F.col("msg").alias("parent"), F.lit(level + 1).alias("level"))
            frontier, rows, n = _extent(found.join(graph.degrees, "v"))
            row["edges_read"] = row["active_edges"] if looked is None else int(looked.value)
        if rows:
            tree = tree.unionByName(frontier.drop("out_degree"))
            visited.add(frontier, rows)
            if (level + 1) % COMPACT_EVERY == 0:
                tree = cut(tree)
        level += 1
    visited.close()
    return Traversal(graph.vertex_ids.join(tree, "v", "left").select("v", "parent", "level"), log)


def breadth_first_by_blocks(graph: Graph, root: int) -> DataFrame:
    """(v, parent, level) as ``breadth_first`` gives it, where steps of the walk aren't of interest: rounds of blocks instead of a job a level.

    Parents come from the levels, by one pass over the edges. A graph with hubs, whose edges would fill a block by themselves, is walked level by level.
    """
    graph = graph.laid_out()
    if graph.hubs:
        return breadth_first(graph, root).state
    reached, _ = blocks.levels(graph, root)
    sent = graph.edges.select("src", "dst").join(reached.withColumnRenamed("v", "src"), "src").where(F.col("dst") != root)
    found = sent.groupBy(F.col("dst").alias("v")).agg(F.min(F.struct("level", "src")).alias("least"))
    tree = found.select("v", F.col("least.src").alias("parent"), (F.col("least.level") + 1).alias("level"))
    first = graph.vertex_ids.where(F.col("v") == root).select("v", F.col("v").alias("parent"), F.lit(0).alias("level"))
    return graph.vertex_ids.join(cut(tree.unionByName(first)), "v", "left").select("v", "parent", "level")


def betweenness(graph: Graph, root: int) -> DataFrame:
    """(v, sigma, dep, level): paths from the root and its dependency on each vertex.

    Unreached vertices have sigma 0 and dep NaN; the root's own dependency is the number it reaches less one.
    The walk outwards counts paths as it finds levels, one job each. Edges from a level to the next are written by level,
    once, in files of as many edges as a partition has, so that the way back reads each level's own, one job each.
    """
    graph = graph.laid_out()
    frontier, rows, n = _extent(graph.degrees.where(F.col("v") == root).select("v", F.lit(1.0).alias("sigma"), F.lit(0).alias("level"), "out_degree"))
    known, visited, level = frontier.drop("out_degree"), Visited(graph, frontier), 0
    while rows:
        got = edge_map(graph, frontier.select("v", "sigma"), F.col("sigma"), "sum", skip=visited.skip(), how=direction(n, graph.num_edges), rows=rows)
        found = got.select("v", F.col("msg").alias("sigma"), F.lit(level + 1).alias("level"))
        frontier, rows, n = _extent(found.join(graph.degrees, "v"))
        if rows:
            known = known.unionByName(frontier.drop("out_degree"))
            visited.add(frontier, rows)
            if (level + 1) % COMPACT_EVERY == 0:
                known = cut(known)
            level += 1
    visited.close()
    deepest, known = level, cut(known)
    near = known.select(F.col("v").alias("src"), F.col("level").alias("ls"))
    far = known.select(F.col("v").alias("dst"), F.col("level").alias("ld"))
    forward = graph.edges.select("src", "dst").join(near, "src").join(far, "dst").where("ld = ls + 1").select("src", "dst", "ls")
    path = f"{ensure_checkpoint_dir(graph.spark)}/levels-{uuid.uuid4().hex}"
    forward.repartition("ls", F.pmod(F.xxhash64("src"), F.lit(graph.partitions))).write.option("maxRecordsPerFile", PARTITION_EDGES).partitionBy("ls").parquet(path)
    forward = graph.spark.read.schema("src long, dst long, ls int").parquet(path)
    below = known.where(F.col("level") == deepest).select("v", (1 / F.col("sigma")).alias("dep"))
    dep = below
    for level in range(deepest - 1, -1, -1):
        between = forward.where(F.col("ls") == level).select("src", F.col("dst").alias("v"))
        got = between.join(below, "v").groupBy(F.col("src").alias("v")).agg(F.sum("dep").alias("got"))
        own = known.where(F.col("level") == level).join(got, "v", "left")
        below = cut(own.select("v", (1 / F.col("sigma") + F.coalesce("got", F.lit(0.0))).alias("dep")))
        dep = dep.unionByName(below)
        dep = cut(dep) if (level + 1) % COMPACT_EVERY == 0 else dep
    done = known.join(dep, "v").select("v", "sigma", ((F.col("dep") - 1 / F.col("sigma")) * F.col("sigma")).alias("dep"), "level")
    return graph.vertex_ids.join(done, "v", "left").select(
        "v", F.coalesce("sigma", F.lit(0.0)).alias("sigma"), F.coalesce("dep", F.lit(float("nan"))).alias("dep"), "level"
    )
