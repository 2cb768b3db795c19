"""Golden values of a hand-made graph, properties, directions and round trips."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom.functions import combiner
from sparkloom.operators import algorithms as A
from sparkloom.operators import kernels as K
from sparkloom.operators.components import _state, connected_components
from sparkloom.plans import graph as graphs
from sparkloom.plans import stats
from sparkloom.plans.graph import Graph, balanced_chunks, gather, owner, running_edges
from sparkloom.sources import prepared, records, text

EDGES = [(0, 1, 1.0), (0, 1, 4.0), (0, 2, 5.0), (1, 3, 2.0), (2, 3, 1.0), (3, 3, 1.0), (3, 4, 3.0), (4, 0, 1.0), (6, 5, 2.0)]


def make(spark, edges, v, kind="float"):
    return Graph.from_edges(spark.createDataFrame(edges, f"src long, dst long, w {kind}"), v)


@pytest.fixture(scope="module")
def micro(spark):
    return make(spark, EDGES, 8)


def column(df, name):
    return [r[name] for r in df.orderBy("v").collect()]


def test_degrees(micro):
    assert column(micro.out_degrees(), "out_degree") == [3, 1, 1, 2, 1, 0, 1, 0]
    assert column(micro.in_degrees(), "in_degree") == [1, 2, 1, 3, 1, 1, 0, 0]
    assert column(micro.symmetrize().out_degrees(), "out_degree") == [4, 3, 2, 5, 2, 1, 1, 0]
    assert column(micro.transpose().out_degrees(), "out_degree") == column(micro.in_degrees(), "in_degree")
    assert column(micro.vertices(), "in_degree") == [1, 2, 1, 3, 1, 1, 0, 0]
    assert column(running_edges(micro), "offset") == [0, 3, 4, 5, 7, 8, 8, 9]
    assert sorted(micro.transpose().transpose().edges.collect()) == sorted(micro.edges.collect())


@pytest.mark.parametrize(
    ("iterations", "want"),
    [
        (0, [0.333333, 1, 1, 0.5, 1, 1, 1, 1]),
        (1, [1, 0.716667, 0.433333, 2.275, 0.575, 1, 0.15, 0.15]),
        (10, [0.96135, 0.710672, 0.430336, 1.934076, 0.963566, 0.2775, 0.15, 0.15]),
    ],
)
def test_pagerank(micro, iterations, want):
    assert [round(x, 6) for x in column(A.pagerank(micro, iterations), "pr")] == pytest.approx(want, abs=1e-6)


def test_pagerank_changes(micro):
    got = [r["delta"] for r in A.pagerank_changes(micro, 10).orderBy("iter").collect()]
    assert got == pytest.approx([1, 0.53125, 0.225781, 0.115148, 0.097876, 0.051997, 0.032411, 0.023167, 0.019692, 0.008482, 0], abs=1e-6)


@pytest.mark.parametrize("how", ["auto", "push", "pull"])
def test_traversals(micro, how):
    paths = A.shortest_paths(micro, 0, how)
    assert column(paths.state, "dist") == [0, 1, 5, 3, 6, 1e9, 1e9, 1e9]
    assert A.farthest(micro, paths.state, 0).collect() == [(4, 6.0)]
    walk = A.breadth_first(micro, 0, how)
    assert column(walk.state, "level") == [0, 1, 1, 2, 3, None, None, None]
    assert column(walk.state, "parent") == [0, 0, 0, 1, 3, None, None, None]


def test_farthest_is_root_when_alone(micro):
    paths = A.shortest_paths(micro, 7)
    assert A.farthest(micro, paths.state, 7).collect() == [(7, 0.0)]


def test_components(micro):
    assert column(A.components(micro), "label") == [0, 0, 0, 0, 0, 5, 5, 7]
    assert sorted(A.component_sizes(micro).collect()) == [(0, 5), (5, 2), (7, 1)]


def test_betweenness(micro):
    rows = A.betweenness(micro, 0).orderBy("v").collect()
    assert [r["sigma"] for r in rows] == [1, 2, 1, 3, 3, 0, 0, 0]
    assert [r["dep"] for r in rows[:5]] == pytest.approx([4, 4 / 3, 2 / 3, 1, 0])
    assert all(math.isnan(r["dep"]) for r in rows[5:])


def test_direction():
    assert K.direction(89, 1816) == "push" and K.direction(90, 1816) == "pull"
    with pytest.raises(ValueError):
        combiner("median")


def test_vertex_map(micro):
    state = K.vertex_map(micro.out_degrees(), {"out_degree": F.col("out_degree") + 10}, F.col("v") < 2)
    assert column(state, "out_degree") == [13, 11, 1, 2, 1, 0, 1, 0]
    assert K.vertex_sum(state, F.col("out_degree"), F.col("v") < 2) == 24


def test_empty_graph(spark):
    g = make(spark, [], 3)
    assert column(A.pagerank(g, 2), "pr") == pytest.approx([0.15] * 3)
    assert column(A.components(g), "label") == [0, 1, 2]
    assert column(A.shortest_paths(g, 1).state, "dist") == [1e9, 0, 1e9]


def test_random_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got.get(v, v) == find(v) for v in range(300))


def test_gathered_blocks(spark, sf, micro):
    """All vertices, in blocks; the query gives each vertex of the graph (it gave the thousand of the greatest degrees)."""
    blocks = graphs.gather_blocks(micro.out_degrees(), "out_degree", 8, block=3)
    assert sorted(map(tuple, blocks.collect())) == [(0, [3, 1, 1]), (1, [2, 1, 0]), (2, [1, 0])]
    assert column(graphs.given_out(blocks, "deg", block=3), "deg") == [3, 1, 1, 2, 1, 0, 1, 0]
    for wrong in (micro.out_degrees().where("v < 6"), micro.out_degrees().where("v <> 4"), micro.out_degrees().union(micro.out_degrees().where("v = 7")), spark.range(9).selectExpr("id v", "id out_degree"), spark.range(10).selectExpr("id v", "id out_degree")):
        with pytest.raises(Exception, match="once"):
            graphs.gather_blocks(wrong, "out_degree", 8, block=3).collect()
    few = make(spark, [(i, 0, 1.0) for i in range(0, 1_500, 3)], 1_500)
    whole = graphs.given_out(graphs.gather_blocks(few.out_degrees(), "out_degree", 1_500, block=64), "deg", block=64)
    assert column(whole, "deg") == [int(i % 3 == 0) for i in range(1_500)]
    few.unpersist()
    assert "limit" not in entry.oracle_sql()["gathered_degrees"].lower()
    assert entry.queries()["gathered_degrees"](spark, sf).count() == spark.read.parquet(f"{sf}/customer.parquet").agg(F.max("c_custkey") + 1).first()[0]


def test_random_walk_properties(spark):
    r = random.Random(7)
    edges = [(r.randrange(60), r.randrange(60), float(r.randrange(1, 9))) for _ in range(150)]
    g = make(spark, edges, 60, "double")
    level = {x["v"]: x for x in A.breadth_first(g, 3).state.collect()}
    dist = dict(A.shortest_paths(g, 3).state.collect())
    pairs = {(a, b) for a, b, _ in edges}
    for v, x in level.items():
        if x["level"]:
            assert (x["parent"], v) in pairs and level[x["parent"]]["level"] == x["level"] - 1
    for a, b, w in edges:
        assert dist[b] <= dist[a] + w
    rank = dict(A.betweenness(g, 3).select("v", "dep").collect())
    assert rank[3] == pytest.approx(sum(x["level"] is not None for x in level.values()) - 1)


def test_chunks_cover_all_ids(micro):
    rows = balanced_chunks(micro, 3, page=2).orderBy("chunk").collect()
    assert rows[0]["first"] == 0 and rows[-1]["last"] == 8
    assert all(a["last"] == b["first"] for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("weighted", [False, True])
def test_edge_records(spark, tmp_path, weighted):
    path = str(tmp_path / "edges")
    rows = [(0, 1, 1.5), (0, 1, 1.5), (3, 3, 0.25), (4_000_000_000, 2, 7.0)]
    records.write_edges(spark.createDataFrame(rows, "src long, dst long, w float"), path, weighted)
    got = sorted(tuple(r) for r in records.read_edges(spark, path, weighted).collect())
    assert got == sorted(r if weighted else r[:2] for r in rows)


def test_partial_record_and_empty_file(spark, tmp_path):
    whole = tmp_path / "cut.bin"
    whole.write_bytes((5).to_bytes(4, "little") + (6).to_bytes(4, "little") + b"\x01\x02\x03")
    assert [tuple(r) for r in records.read_edges(spark, str(whole)).collect()] == [(5, 6)]
    none = tmp_path / "none.bin"
    none.write_bytes(b"")
    assert records.read_edges(spark, str(none)).collect() == []
    assert records.exists(str(none)) and records.file_size(str(whole)) == 11


def test_vertex_arrays(spark, tmp_path, micro):
    path = str(tmp_path / "array")
    state = A.pagerank(micro, 2)
    records.dump_vertex_array(state, "pr", "float64", path)
    got = records.restore_vertex_array(spark, path, "float64", 8)
    assert column(got, "value") == column(state, "pr")
    with pytest.raises(ValueError):
        records.restore_vertex_array(spark, path, "float64", 9)


def test_prepared(spark, tmp_path, micro):
    path = str(tmp_path / "graph")
    assert prepared.load_graph(spark, path) is None
    prepared.save_graph(micro, path)
    again = prepared.load_graph(spark, path)
    assert (again.num_vertices, again.num_edges) == (8, 9)
    assert sorted(again.edges.collect()) == sorted(micro.edges.collect())
    prepared.save_vertex_column(micro.out_degrees(), str(tmp_path / "col"))
    with pytest.raises(ValueError):
        prepared.load_vertex_column(spark, str(tmp_path / "col"), 9)


def test_bad_lines_are_told(spark, tmp_path):
    tsv = tmp_path / "g.txt"
    tsv.write_text("1\t2\n3\nx\t4\n\n5\t6\t7\n-1\t2\n 8\t9\n10\t11\r\n")
    assert sorted(r["line"] for r in text.bad_lines(spark, str(tsv)).collect()) == [" 8\t9", "-1\t2", "3", "x\t4"]
    with pytest.raises(Exception, match="no edge"):
        text.read_text_edges(spark, str(tsv)).collect()
    out = str(tmp_path / "out")
    assert text.convert_edges(spark, str(tsv), out) == (3, 4)
    assert sorted(tuple(r) for r in records.read_edges(spark, out).collect()) == [(1, 2), (5, 6), (10, 11)]
    gr = tmp_path / "g.gr"
    gr.write_text("c x\na 1 2 9\na 3 4\na 5\na 6 7 1.5e1\n")
    assert sorted(r["line"] for r in text.bad_lines(spark, str(gr), weighted=True).collect()) == ["a 3 4", "a 5"]
    assert text.convert_edges(spark, str(gr), str(tmp_path / "w"), weighted=True) == (2, 2)
    assert sorted(tuple(r) for r in records.read_edges(spark, str(tmp_path / "w"), weighted=True).collect()) == [(1, 2, 9.0), (6, 7, 15.0)]


def test_logs_are_read_in_ranges(spark, tmp_path):
    """Runs that go over several byte ranges of several files."""
    r, want = random.Random(1), {}
    (tmp_path / "logs").mkdir()
    for f in range(3):
        lines, run = [], 0
        for i in range(400):
            kind = r.random()
            if kind < 0.03:
                run += 1
                want[f, run] = (f"./bfs g{i} {f}", 0.0)
                lines.append(f"run: {i} sudo  mpirun -np 4 --map-by socket ./bfs g{i} {f}")
            elif kind < 0.7:
                x = r.randrange(10_000) / 8
                lines.append(f"partiton_id: {i % 4}, total_process_time  ={x}(s)")
                if run:
                    want[f, run] = (want[f, run][0], max(want[f, run][1], x))
            else:
                lines.append("noise total_process_time  =1.2.3(s)" if i % 2 else "")
        (tmp_path / "logs" / f"{f}.log").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", "2000", "1g"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            log = text.read_log(spark, str(tmp_path / "logs"))
            assert size == "1g" or log.select("file", "block").distinct().count() > 6
            got = {(int(x["file"][-5]), x["run"]): (x["command"], x["max_time"]) for x in text.summarise_runs(log).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_text_sources(spark, tmp_path):
    gr = tmp_path / "g.gr"
    gr.write_text("c x\np sp 3 2\na 1 2 9\na  2 3 4\nz 1 1\n")
    assert sorted(text.read_text_edges(spark, str(gr)).collect()) == [(1, 2), (2, 3)]
    tsv = tmp_path / "g.txt"
    tsv.write_text("1\t2\n2\t2\n")
    assert sorted(text.read_text_edges(spark, str(tsv)).collect()) == [(1, 2), (2, 2)]
    log = tmp_path / "log"
    log.write_text("noise\ntotal_process_time  =9(s)\nrun: 1 sudo  mpirun -np 4 --map-by socket ./bfs g 5 1\npartiton_id: 0, total_process_time  =1.5(s)\nx, total_process_time  =0.5(s)\n")
    got = text.summarise_runs(text.read_log(spark, str(log)))
    assert [tuple(r)[1:] for r in got.collect()] == [(1, "./bfs g 5 1", 1.5)]
    text.write_report(got, str(tmp_path / "report"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["Run: ./bfs g 5 1", "Max Total Process Time: 1.5(s)", ""]
    log.write_text("run: 1 sudo  mpirun --map-by socket   ./cc g --map-by socket 1\n")  # a run without a time; the first marker counts
    assert [tuple(r)[1:] for r in text.summarise_runs(text.read_log(spark, str(log))).collect()] == [(1, "./cc g --map-by socket 1", 0.0)]


def test_state_of_many_edges(spark):
    """The digest that ends the components' loop, over more edges than a sum of hashes can take."""
    edges = spark.range(30_000_000).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    first = _state(edges)
    assert first[0] == 30_000_000 and first == _state(edges.repartition(3)) != _state(edges.withColumn("b", F.col("b") + (F.col("a") == 77).cast("int")))


def test_writers_lose_nothing(spark, tmp_path, micro):
    path = str(tmp_path / "edges")
    for row in ((1, 2), (3, 4)):
        records.write_edges(spark.createDataFrame([row], "src long, dst long"), path)
    assert sorted(tuple(r) for r in records.read_edges(spark, path).collect()) == [(1, 2), (3, 4)]
    for row in ((1 << 32, 0), (-1, 0), (None, 0)):
        with pytest.raises(Exception, match="values outside|nulls"):
            records.write_edges(spark.createDataFrame([row], "src long, dst long"), path)
    assert records.read_edges(spark, path).count() == 2
    array = str(tmp_path / "array")
    for vertices in ([0, 1, 1], [0, 2], [1, 2, 3], [0, 0, 3, 3], [0, None]):
        with pytest.raises(Exception, match="vertices"):
            records.dump_vertex_array(spark.createDataFrame([(v, 1) for v in vertices], "v long, x long"), "x", "uint32", array)
    records.dump_vertex_array(micro.out_degrees(), "out_degree", "uint32", array)
    with pytest.raises(ValueError):
        records.dump_vertex_array(micro.out_degrees(), "out_degree", "uint32", array)


def test_undirected_load(spark, tmp_path):
    path = str(tmp_path / "edges")
    records.write_edges(spark.createDataFrame(EDGES, "src long, dst long, w float"), path, weighted=True)
    g = records.load_graph(spark, path, 8, weighted=True, undirected=True)
    assert (g.num_edges, g.symmetric, g.edges.count()) == (9, True, 18)
    assert column(g.out_degrees(), "out_degree") == [4, 3, 2, 5, 2, 1, 1, 0]
    assert records.load_graph(spark, path, 8).num_edges == 13  # 108 bytes read as 8-byte records
    assert len(records.splits(path, 12)) >= 1


def test_hubs_lie_apart(spark, monkeypatch):
    monkeypatch.setattr(graphs, "HUB_EDGES", 50)
    monkeypatch.setattr(graphs, "HUB_SHARE", 1)
    r = random.Random(3)
    edges = [(0, r.randrange(1, 200), float(r.randrange(1, 9))) for _ in range(300)] + [(r.randrange(200), r.randrange(200), 1.0) for _ in range(200)]
    g, plain = make(spark, edges, 200, "double"), Graph(spark.createDataFrame(edges, "src long, dst long, w double"), 200, len(edges))
    assert g.hubs == (0,) and g.num_edges == len(edges) and g.edges.columns == ["src", "dst", "w"]
    spread = g.laid.where("src = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 1
    assert sorted(g.edges.collect()) == sorted(plain.edges.collect())
    monkeypatch.setattr(graphs, "HUB_EDGES", 10_000)
    for of in (lambda x: A.shortest_paths(x, 0, "pull").state, lambda x: A.breadth_first(x, 5).state, lambda x: A.pagerank(x, 2).select("v", F.round("pr", 9))):
        assert sorted(of(g).collect()) == sorted(of(plain).collect())
    g.unpersist()


def test_layouts(micro):
    back = micro.transpose().laid_out()
    assert back.laid is not None and back.num_edges == 9 and micro.laid_out() is micro
    plan = back.edges.groupBy("src").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(src" in plan


def test_gather_and_owner(micro):
    assert gather(micro.out_degrees(), "out_degree", 8).tolist() == [3, 1, 1, 2, 1, 0, 1, 0]
    with pytest.raises(ValueError):
        gather(micro.out_degrees(), "out_degree", 8, most=7)
    with pytest.raises(ValueError):
        gather(micro.out_degrees().where("v < 3"), "out_degree", 8)
    chunks = balanced_chunks(micro, 3, page=2)
    of = {r["chunk"]: (r["first"], r["last"]) for r in chunks.collect()}
    rows = micro.vertex_ids.select("v", owner(chunks).alias("c")).collect()
    assert all(of[r["c"]][0] <= r["v"] < of[r["c"]][1] for r in rows) and len(rows) == 8


def test_degree_report(spark, tmp_path, micro):
    stats.write_degree_report(micro, str(tmp_path / "report"), chunks=2)
    lines = [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines[:3] == ["vertices: 8", "edges: 9", "out-degree min: 0"] and lines[-1].startswith("chunk 1: vertices 4, out 2")
    chunks = spark.createDataFrame([(0, 0, 3), (1, 3, 3), (2, 3, 8)], "chunk int, first long, last long")
    parts = stats.footprint(micro, chunks, weighted=True)
    assert [tuple(r)[:5] for r in parts.orderBy("chunk").collect()] == [(0, 3, 5, 2, 60), (1, 0, 0, 0, 0), (2, 5, 4, 1, 48)]
    assert stats.remote_percent(parts).first()[0] == pytest.approx(100 / 3, abs=1e-6)


def test_sums_of_the_same_pass(micro):
    for by in ("edges", "rows"):
        got, total = K.edge_map(micro, micro.vertex_ids.where("v = 0"), F.col("w"), "min", total=F.col("w"), by=by)
        assert sorted(tuple(r) for r in got.collect()) == [(1, 1.0), (2, 5.0)] and total.value == 10
    state, total = K.vertex_map(micro.out_degrees(), {"x": F.col("out_degree") + 1}, F.col("v") < 2, total=F.col("x"))
    assert column(state, "x")[:3] == [4, 2, None] and total.value == 6


def test_shared_folder_is_asked_for():
    from types import SimpleNamespace

    from sparkloom.operators.lineage import ensure_checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda _: None)
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vertex_sets(spark):
    from sparkloom.operators.bitmaps import VertexSet, bytes_of, fits

    n, r = 100_000, random.Random(2)
    a, b = ({r.randrange(n) for _ in range(k)} | edge for k, edge in ((3000, {0, 32_767, 32_768, n - 1}), (5, {63, 64})))
    frame = lambda vs: spark.createDataFrame([(v,) for v in vs], "v long")
    one, two = VertexSet.of(frame(a), n), VertexSet.of(frame(b), n)
    assert {x[0] for x in one.vertices().collect()} == a and {x[0] for x in one.union(two).vertices().collect()} == a | b
    assert one.buckets.agg(one.size()).first()[0] == len(a)
    testers = one.tester(), two.tester()
    both = testers[0].union(testers[1])
    rows = spark.range(n).select("id", *[t.has(F.col("id")) for t in (*testers, both)], both.has(F.lit(None).cast("long"))).collect()
    for t in (*testers, both):
        t.drop()
    assert all((x[1], x[2], x[3], x[4]) == (x[0] in a, x[0] in b, x[0] in a | b, False) for x in rows)
    none = VertexSet.of(frame(a).where("false"), n).tester()
    assert spark.range(n).where(none.has(F.col("id"))).count() == 0
    assert bytes_of(1 << 40, 3) == 3 * 4096 and bytes_of(100, 1 << 30) == 4096 and not fits(1 << 40, 1 << 30)


def test_pull_step_reads_in_edges_of_unvisited_vertices(spark):
    """The plan has no exchange; what is read are the in-edges of unvisited vertices up to the first parent."""
    from sparkloom.operators.bitmaps import VertexSet

    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200), 1.0) for _ in range(4_000)]
    g = make(spark, edges, 200, "double")
    frontier, seen = set(range(20)), set(range(60))
    tester = lambda vs: VertexSet.of(spark.createDataFrame([(v,) for v in vs], "v long"), 200).tester()
    got, looked = K.pull_step(g, tester(frontier), tester(seen))
    above = plan_of(got).split("InMemoryTableScan")[0]  # what reads the adjacency rows as they lie
    assert "Exchange" not in above and "Join" not in above and "CollectMetrics" in above
    sources = {v: sorted(a for a, b, _ in edges if b == v) for v in range(200) if v not in seen}
    first = {v: next((i for i, a in enumerate(s) if a in frontier), None) for v, s in sources.items()}
    assert dict(tuple(x) for x in got.collect()) == {v: sources[v][i] for v, i in first.items() if i is not None}
    assert looked.value == sum(len(sources[v]) if i is None else i + 1 for v, i in first.items())
    g.unpersist()


def test_walks_without_bitmaps(spark, micro, monkeypatch):
    """Sets that don't fit are joined, with the same result."""
    from sparkloom.operators import bitmaps

    monkeypatch.setattr(bitmaps, "BITMAP_BYTES", 0)
    for how in ("push", "pull"):
        assert column(A.breadth_first(micro, 0, how).state, "parent") == [0, 0, 0, 1, 3, None, None, None]
    assert [x["sigma"] for x in A.betweenness(micro, 0).orderBy("v").collect()] == [1, 2, 1, 3, 3, 0, 0, 0]


def test_walk_by_blocks(spark, micro, monkeypatch):
    """The same trees by rounds of blocks, whose number doesn't follow the length of the walk."""
    from sparkloom.operators import blocks

    for root in (0, 6):
        assert sorted(A.breadth_first_by_blocks(micro, root).collect(), key=str) == sorted(A.breadth_first(micro, root, "push").state.collect(), key=str)
    assert column(A.breadth_first_by_blocks(micro, 9).select("v", "level"), "level") == [None] * 8
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 40)
    r = random.Random(11)
    edges = [(i, i + 1, 1.0) for i in range(199)] + [(i + 1, i, 1.0) for i in range(0, 199, 3)] + [(7, 7, 1.0), (150, 3, 1.0), (150, 3, 1.0)]
    path = make(spark, edges, 210)
    assert len(blocks.ranges(path)) > 8
    found, rounds = blocks.levels(path, 0)
    assert sorted(map(tuple, found.collect())) == [(i, i) for i in range(200)] and rounds < 20  # a job for each of 200 levels before
    path.unpersist()
    for seed, page in ((1, 16_384), (3, 10)):
        monkeypatch.setattr(blocks, "PAGES", page)
        r.seed(seed)
        g = make(spark, [(r.randrange(120), r.randrange(125), 1.0) for _ in range(170)], 120)
        root = r.randrange(120)
        level, parent = {root: 0}, {root: root}
        near, far = {root}, 0
        rows = [(x["src"], x["dst"]) for x in g.edges.collect()]
        while near:
            far, new = far + 1, {}
            for a, b in rows:
                if a in near and b not in level and b < 120:
                    new[b] = min(a, new.get(b, a))
            level.update(dict.fromkeys(new, far))
            parent.update(new)
            near = set(new)
        assert sorted(map(tuple, A.breadth_first_by_blocks(g, root).where("level is not null").collect())) == sorted((v, parent[v], level[v]) for v in level)
        assert A.breadth_first_by_blocks(g, root).count() == 120
        g.unpersist()


def test_adjacency_rows(spark, monkeypatch):
    monkeypatch.setattr(graphs, "ROW_EDGES", 7)
    r = random.Random(6)
    edges = [(r.randrange(30), r.randrange(30), float(r.randrange(1, 9))) for _ in range(900)]
    g = make(spark, edges, 30, "double")
    rows = g.out_rows.collect()
    assert max(len(x["others"]) for x in rows) == 7 and all(x["others"] == sorted(x["others"]) for x in rows)
    assert sorted(tuple(x) for x in K.unfolded(g.out_rows.withColumnRenamed("v", "src")).collect()) == sorted(edges)
    few = g.vertex_ids.where("v < 3")
    for combine in ("sum", "min"):
        by_edges, by_rows = (sorted(tuple(x) for x in K.edge_map(g, few, F.col("w") + F.col("src"), combine, by=by).collect()) for by in ("edges", "rows"))
        assert by_edges == by_rows
    assert "Exchange" not in plan_of(g.out_rows).split("InMemoryRelation")[1].split("InMemoryTableScan")[0]  # built where the edges lie
    assert len(plan_of(K.edge_map(g, few, F.col("w"), "sum", by="rows"))) > 0
    g.unpersist()


def test_label_rounds(spark, micro):
    walk = A.label_rounds(micro)
    assert column(walk.state, "label") == [0, 0, 0, 0, 0, 5, 5, 7]
    assert [x["active"] for x in walk.log.rows][:2] == [8, 5]
    path = make(spark, [(i, i + 1, 1.0) for i in range(13)], 14)  # rounds follow the length; bases are written on the way
    walk = A.label_rounds(path)
    assert column(walk.state, "label") == [0] * 14 and [x["active"] for x in walk.log.rows] == [14, *range(13, 0, -1)]
    assert column(A.shortest_paths(path, 0).state, "dist") == list(range(14))
    assert column(A.breadth_first(path, 0).state, "level") == list(range(14))
    assert [x["sigma"] for x in A.betweenness(path, 0).orderBy("v").collect()] == [1.0] * 14
    assert column(A.label_rounds(make(spark, [], 2)).state, "label") == [0, 1]


def test_steps_are_one_execution(spark, micro):
    """A step's figures come with the job that writes it: an iteration of the changes writes one checkpoint, and nothing else runs."""
    from sparkloom.operators.steps import figures

    def jobs(tag, iterations):
        spark.sparkContext.addJobTag(tag)
        try:
            A.pagerank_changes(micro, iterations)
        finally:
            spark.sparkContext.removeJobTag(tag)
        return figures(spark, tag)[0]

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a job for each action, not for each stage
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert jobs("many", 8) - jobs("few", 3) == 5
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    walk = A.shortest_paths(micro, 0)
    assert [(x["step"], x["active"], x["active_edges"]) for x in walk.log.rows] == [(0, 1, 3), (1, 2, 2), (2, 1, 2), (3, 1, 1)]
    assert all(x["jobs"] > 0 and x["tasks"] > 0 and x["seconds"] > 0 for x in walk.metrics().collect())


def test_prepared_graph_loads_without_exchange(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    edges = [(r.randrange(50), r.randrange(50), 1.0) for _ in range(500)] + [(0, r.randrange(50), 2.0) for _ in range(300)]
    for hubs in (False, True):
        monkeypatch.setattr(graphs, "HUB_EDGES", 100 if hubs else 10_000)
        monkeypatch.setattr(graphs, "HUB_SHARE", 1)
        g = make(spark, edges, 50, "double")
        path = str(tmp_path / f"graph{hubs}")
        prepared.save_graph(g, path)
        from sparkloom.sources.prepared import META, _table

        table = _table(spark.read.schema(META).json(f"{path}/meta").first()["edges"])
        spark.sql(f"DROP TABLE {table}")  # as another session finds it
        again = prepared.load_graph(spark, path)
        assert again.hubs == g.hubs == ((0,) if hubs else ())
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            step = K.edge_map(again, again.vertex_ids.withColumn("x", F.lit(1.0)), F.col("x"), "sum")
            plan = step._jdf.queryExecution().executedPlan().toString()
            scan = next(i for i, x in enumerate(plan.splitlines()) if "FileScan" in x)
            above = [x for x in plan.splitlines()[:scan] if "Exchange" in x]
            assert "Bucketed: true" in plan.splitlines()[scan] and len(above) - ("Range" in "".join(plan.splitlines()[:scan])) == 1, plan  # that of the messages
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert column(A.pagerank(again, 3), "pr") == pytest.approx(column(A.pagerank(g, 3), "pr"))
        prepared.save_graph(make(spark, edges[:5], 50, "double"), path)  # the latest holds
        assert prepared.load_graph(spark, path).num_edges == 5


def test_owners_of_many_chunks(spark, micro):
    chunks = spark.range(10_000).select(F.col("id").cast("int").alias("chunk"), (F.col("id") * 3).alias("first"), (F.col("id") * 3 + 3).alias("last"))
    rows = spark.range(-5, 30_005).select("id", owner(chunks, "id").alias("c"))
    assert rows.where("c is distinct from case when id between 0 and 29999 then cast(id div 3 as int) end").count() == 0
    few = balanced_chunks(micro, 5, page=1)
    laid = graphs.by_owner(micro, few, 5)
    assert laid.where(F.spark_partition_id() != F.col("chunk")).count() == 0 and laid.count() == 9
    assert stats.layout_skew(laid).agg(F.max("chunks")).first()[0] == 1
    laid.unpersist()


def test_command_line(spark, tmp_path):
    from sparkloom.__main__ import run

    path = str(tmp_path / "e")
    records.write_edges(spark.createDataFrame(EDGES, "src long, dst long, w float"), path)
    tsv = tmp_path / "e.tsv"
    tsv.write_text("".join(f"{a}\t{b}\t{w}\n" for a, b, w in EDGES))
    assert column(run(spark, "pagerank", path, 8, 2)[0], "pr")[0] == pytest.approx(0.63875)
    assert run(spark, "cc", path, 8)[1][-1] == "components: 3"
    assert run(spark, "sssp", str(tsv), 8, 0)[1][-1] == "farthest: 4 at 6.0"
    assert run(spark, "bfs", path, 8, 0)[1][-1] == run(spark, "bc", path, 8, 0)[1][-1] == "reached: 5"
    for bad in (("bfs", 8), ("nope", 0)):
        with pytest.raises(ValueError):
            run(spark, bad[0], path, 8, bad[1])
