"""The two kernels. Lambdas are Column expressions, so Catalyst sees the whole super-step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sparkloom.functions import combiner
from sparkloom.operators.bitmaps import Tester
from sparkloom.plans.graph import SALT, Graph

#: A frontier is pushed if its edges are fewer than one in so many of all edges.
PUSH_SHARE = 20
#: A pushed frontier is broadcast up to this number of rows, and joined by a shuffle beyond it.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Total:
    """A global sum that comes with the rows beside it: ``value`` is there once these have been computed."""

    seen: Observation

    @property
    def value(self) -> float:
        return self.seen.get.get("total") or 0


def vertex_map(state: DataFrame, columns: dict[str, Column], active: Column | None = None, total: Column | None = None) -> DataFrame | tuple[DataFrame, Total]:
    """New values of columns for the active vertices; the others keep theirs.

    With ``total``, an expression over the new values, also its sum over the active vertices, by the pass that computes the state.
    """
    if active is None:
        out = state.withColumns(columns)
    else:
        kept = {k: F.when(active, c).otherwise(F.col(k)) if k in state.columns else F.when(active, c) for k, c in columns.items()}
        out = state.withColumns(kept)
    if total is None:
        return out
    seen = Observation()
    return out.observe(seen, F.sum(total if active is None else F.when(active, total)).alias("total")), Total(seen)


def vertex_sum(state: DataFrame, value: Column, active: Column | None = None) -> float:
    """Global sum of an expression over the active vertices of a state that is there already."""
    rows = state if active is None else state.where(active)
    return rows.agg(F.sum(value).alias("s")).first()["s"] or 0


def active_edges(frontier: DataFrame, degrees: DataFrame) -> int:
    """Sum of the out-degrees of the frontier's vertices."""
    joined = frontier.select("v").join(degrees, "v")
    return joined.agg(F.sum("out_degree").alias("n")).first()["n"] or 0


def direction(active: int, num_edges: int) -> str:
    return "push" if active < num_edges // PUSH_SHARE else "pull"


def edge_map(
    graph: Graph,
    frontier: DataFrame,
    message: Column,
    combine: str,
    skip: DataFrame | Tester | None = None,
    how: str = "pull",
    rows: int | None = None,
    by: str = "edges",
    total: Column | None = None,
) -> DataFrame | tuple[DataFrame, Total]:
    """(v, msg): what the out-edges of the frontier bring to their targets, combined per target.

    ``frontier`` has v and whatever ``message`` uses beside src, dst and w. ``skip`` are targets that want nothing: a ``Tester`` is asked in
    the scan of the edges, so their messages aren't made; vertices as rows (v) are taken out of the result. ``push`` broadcasts a frontier whose row number was
    counted (``rows``) and is small; then edges stay where they lie and only combined messages travel. ``pull`` joins both
    sides by key; a hub's row is repeated for each salt of its edges. ``by`` rows the frontier meets adjacency rows, one for
    ``ROW_EDGES`` edges, and only those of its vertices are unfolded into edges.

    With ``total``, an expression like ``message``, also its sum over all edges met, by the same pass: partial sums travel with the messages.
    """
    wanted = ~skip.has(F.col("dst")) if isinstance(skip, Tester) else None
    edges, key = (graph.out_rows, "v") if by == "rows" else (graph.edges if not graph.hubs else graph.laid, "src")
    if wanted is not None and by == "edges":
        edges = edges.where(wanted)
    near = frontier if by == "rows" else frontier.withColumnRenamed("v", "src")
    if how == "push" and rows is not None and rows <= BROADCAST_ROWS:
        met = edges.join(F.broadcast(near), key)
    elif graph.hubs:
        salts = F.when(F.col(key).isin(list(graph.hubs)), F.sequence(F.lit(0), F.lit(graph.partitions - 1))).otherwise(F.array(F.lit(0)))
        met = edges.join(near.withColumn(SALT, F.explode(salts)), [key, SALT])
    else:
        met = edges.join(near, key)
    if by == "rows":
        met = unfolded(met.withColumnRenamed("v", "src"))
        met = met if wanted is None else met.where(wanted)
    sent = met.select(F.col("dst").alias("v"), message.alias("msg"), *([total.alias("part")] if total is not None else []))
    shares = [F.sum("part").alias("part")] if total is not None else []
    out = sent.groupBy("v").agg(combiner(combine)("msg").alias("msg"), *shares)
    seen = Observation()
    if total is not None:  # before others are taken out: they were met
        out = out.observe(seen, F.sum("part").alias("total")).drop("part")
    if isinstance(skip, DataFrame):
        out = out.join(skip.select("v"), "v", "left_anti")
    return out if total is None else (out, Total(seen))


def unfolded(rows: DataFrame) -> DataFrame:
    """Edges (src, dst, w, ...) of adjacency rows whose vertex is ``src``."""
    rest = [c for c in rows.columns if c not in ("others", "weights", "place")]
    if "weights" not in rows.columns:
        return rows.select(*rest, F.explode("others").alias("dst"))
    return rows.select(*rest, F.explode(F.arrays_zip("others", "weights")).alias("e")).select(*rest, F.col("e.others").alias("dst"), F.col("e.weights").alias("w"))


#: Lengths of the stretches of a row in which a step looks for its first parent, each only if the one before had none.
STRETCHES = (8, 64, 512, 1 << 30)


def first_in(others: Column, frontier: Tester) -> Column:
    """The first of ascending vertices that is in the frontier, or null; what lies behind its stretch isn't looked at."""
    found, start = [], 1
    for length in STRETCHES:
        found.append(F.get(F.filter(F.slice(others, start, length), frontier.has), 0))
        start += length
    return F.coalesce(*found)


def pull_step(graph: Graph, frontier: Tester, visited: Tester) -> tuple[DataFrame, Total]:
    """(v, msg): unvisited vertices that have an in-edge from the frontier, with their smallest such neighbour; no exchange.

    Vertices look for a parent among their own in-edges, in order, and stop at the first. The sum beside it is the number of
    in-edges up to there, of unvisited vertices alone (of a vertex with several adjacency rows, in each).
    """
    others = F.col("others")
    rows = graph.in_rows.where(~visited.has(F.col("v"))).select("v", "others", first_in(others, frontier).alias("msg"))
    seen = Observation()
    looked = F.when(F.col("msg").isNull(), F.size(others)).otherwise(F.array_position(others, F.col("msg")))
    rows = rows.observe(seen, F.sum(looked).alias("total")).where("msg is not null")
    return rows.groupBy("v").agg(F.min("msg").alias("msg")), Total(seen)
