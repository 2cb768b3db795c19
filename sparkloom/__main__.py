"""``python -m sparkloom pagerank|cc|sssp|bfs|bc FILE VERTICES ITERATIONS-OR-ROOT [--out PATH]`` over a file of edges.

FILE holds binary records (12 bytes with a weight for sssp, else 8) or text (``.gr``; ``.tsv`` and ``.txt`` tab-separated). ``cc`` takes no last argument.
The result, a value for each vertex, is written as Parquet to ``--out``; its figures and the super-steps are printed.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import algorithms as A
from sparkloom.plans.graph import Graph
from sparkloom.sources import records, text

APPLICATIONS = ("pagerank", "cc", "sssp", "bfs", "bc")


def load(spark: SparkSession, path: str, vertices: int, weighted: bool) -> Graph:
    if path.endswith((".gr", ".tsv", ".txt")):
        return Graph.from_edges(text.read_text_edges(spark, path, weighted), vertices)
    return records.load_graph(spark, path, vertices, weighted)


def run(spark: SparkSession, application: str, path: str, vertices: int, last: int = 0) -> tuple[DataFrame, list[str]]:
    """The result and lines to print."""
    if application not in APPLICATIONS:
        raise ValueError(f"{application!r} is none of {APPLICATIONS}")
    graph = load(spark, path, vertices, application == "sssp")
    if application in ("sssp", "bfs", "bc") and not 0 <= last < vertices:
        raise ValueError(f"root {last} is none of {vertices} vertices")
    if application == "pagerank":
        state = A.pagerank(graph, last)
        return state, [f"sum: {state.agg(F.round(F.sum('pr'), 6).alias('s')).first()['s']}"]
    if application == "bc":
        state = A.betweenness(graph, last)
        return state, [f"reached: {state.where('level is not null').count()}"]
    walk = {"cc": lambda: A.label_rounds(graph), "sssp": lambda: A.shortest_paths(graph, last), "bfs": lambda: A.breadth_first(graph, last)}[application]()
    lines = [f"step {r['step']}: active {r['active']}, edges {r['active_edges']}, {r['mode']}, {r['jobs']} jobs, {r['tasks']} tasks, {r['seconds']:.2f} s" for r in walk.log.rows]
    if application == "sssp":
        v, far = A.farthest(graph, walk.state, last).first()
        lines.append(f"farthest: {v} at {far}")
    elif application == "bfs":
        lines.append(f"reached: {walk.state.where('parent is not null').count()}")
    else:
        lines.append(f"components: {walk.state.select('label').distinct().count()}")
    return walk.state, lines


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sparkloom", description=__doc__.splitlines()[0])
    parser.add_argument("application", choices=APPLICATIONS)
    parser.add_argument("file")
    parser.add_argument("vertices", type=int)
    parser.add_argument("last", type=int, nargs="?", default=0, help="iterations of pagerank, root of sssp, bfs and bc")
    parser.add_argument("--out", help="where the result is written")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("sparkloom").getOrCreate()
    state, lines = run(spark, given.application, given.file, given.vertices, given.last)
    if given.out:
        state.write.parquet(given.out)
    print("\n".join(lines))


if __name__ == "__main__":
    main()
