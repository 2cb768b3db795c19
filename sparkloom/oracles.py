"""The same results as SQL for DuckDB, over the base tables alone."""

from __future__ import annotations

from sparkloom.queries import ITERATIONS

HOP = """select o_custkey::bigint src, (lead(o_custkey) over (partition by o_orderdate order by o_orderkey))::bigint dst,
 o_totalprice::double w from orders qualify dst is not null"""
SPARSE = f"select * from ({HOP}) where src % 7 = 0"
V = "(select max(c_custkey)+1 from customer)"
VS = f"vs as materialized (select v::bigint v from range(0, {V}) t(v))"


def root(edges: str) -> str:
    return f"(select src from ({edges}) group by 1 order by count(*) desc, src limit 1)"


def degree(edges: str, end: str) -> str:
    return f"""with e as ({edges}), {VS}
 select vs.v, coalesce(n, 0)::bigint deg from vs left join (select {end} v, count(*) n from e group by 1) using (v)"""


def ranks(iterations: int) -> str:
    """CTEs up to p(i, v, pr)."""
    return f"""with recursive e as materialized ({HOP}), od as materialized (select src v, count(*) od from e group by 1), {VS},
 p(i, v, pr) as (select 0, v, 1.0::double from vs union all
  select i+1, vs.v, 0.15 + 0.85*coalesce(m.s, 0)
  from (select any_value(i) i from p) it, vs
  left join (select e.dst, sum(p.pr/od.od) s from p join e on e.src=p.v join od on od.v=p.v group by 1) m on m.dst=vs.v
  where it.i < {iterations})"""


def walk(edges: str) -> str:
    """CTEs up to b(v, par, l) of reached vertices."""
    return f"""with recursive e as materialized ({edges}), {VS}, b(v, par, l) using key (v) as (select {root(edges)}::bigint, {root(edges)}::bigint, 0
 union (select e.dst, min(e.src), any_value(b.l)+1 from b join e on e.src=b.v
        where not exists (select 1 from recurring.b x where x.v=e.dst) group by e.dst))"""


PATHS = f"""with recursive e as materialized ({HOP}), {VS}, s(v, d) using key (v) as (select {root(HOP)}::bigint, 0.0::double
 union (select e.dst, min(s.d+e.w) from s join e on e.src=s.v left join recurring.s r on r.v=e.dst
        group by e.dst having min(s.d+e.w) < coalesce(min(r.d), 1e9)))"""


def labels(edges: str) -> str:
    """CTEs up to l(v, label)."""
    return f"""with recursive u as materialized (select src, dst from ({edges}) union all select dst, src from ({edges})), {VS},
 l(v, label) using key (v) as (select v, v from vs
 union (select u.dst, min(l.label) from l join u on u.src=l.v join recurring.l r on r.v=u.dst
        group by u.dst having min(l.label) < min(r.label)))"""


LABELS = labels(SPARSE)

#: CTE p(i, v, label, ch): labels of all vertices by round, and whether they fell in it.
LABEL_ROUNDS = f"""with recursive u as materialized (select src, dst from ({SPARSE}) union all select dst, src from ({SPARSE})), {VS},
 p(i, v, label, ch) as (select 0, v, v, true from vs union all
  select it.i + 1, p.v, least(p.label, coalesce(m.x, p.label)), coalesce(m.x < p.label, false) from p
  left join (select u.dst v, min(p.label) x from p join u on u.src=p.v where p.ch group by 1) m on m.v=p.v, (select any_value(i) i, bool_or(ch) going from p) it
  where it.going)"""

#: CTE p(i, v, d, ch): distances of all vertices by step, and whether they fell in it.
PATH_STEPS = f"""with recursive e as materialized ({HOP}), od as materialized (select src v, count(*) od from e group by 1), {VS},
 p(i, v, d, ch) as (select 0, v, case when v = {root(HOP)} then 0.0::double else 1e9::double end, v = {root(HOP)} from vs union all
  select it.i + 1, p.v, least(p.d, coalesce(m.x, p.d)), coalesce(m.x < p.d, false) from p
  left join (select e.dst v, min(p.d+e.w) x from p join e on e.src=p.v where p.ch group by 1) m on m.v=p.v, (select any_value(i) i, bool_or(ch) going from p) it
  where it.going)"""

BETWEEN = f"""with recursive e as materialized ({HOP}), {VS},
 b(v, l) using key (v) as (select {root(HOP)}::bigint, 0
   union (select distinct e.dst, b.l+1 from b join e on e.src=b.v where not exists (select 1 from recurring.b x where x.v=e.dst))),
 bl as materialized (select * from b),
 de as materialized (select e.src, e.dst from e join bl x on x.v=e.src join bl y on y.v=e.dst where y.l=x.l+1),
 s(v, l, sg) as (select v, 0, 1.0::double from bl where l=0
   union all select de.dst, max(s.l)+1, sum(s.sg) from s join de on de.src=s.v group by de.dst),
 sm as materialized (select * from s),
 dp(v, l, dp) as (select v, l, 1/sg from sm where l=(select max(l) from bl)
   union all select sm.v, sm.l, 1/sm.sg+coalesce(a.x, 0)
     from sm left join (select de.src, sum(dp.dp) x from dp join de on de.dst=dp.v group by 1) a on a.src=sm.v
     where sm.l=(select max(l)-1 from dp)),
 done as (select dp.v, sm.sg sigma, (dp.dp-1/sm.sg)*sm.sg dep from dp join sm using (v))"""

SENT = f"e as ({HOP}), f as (select v, (v % 17)::double x from range(0, {V}) t(v) where v % 3 = 0)"
BOTH = f"""e as ({HOP}), {VS}, g as (select vs.v, coalesce(o.n, 0) o, coalesce(i.n, 0) i from vs
 left join (select src v, count(*) n from e group by 1) o using (v) left join (select dst v, count(*) n from e group by 1) i using (v))"""


def _report(side: str) -> str:
    return f"""min({side[0]})::bigint min_{side}, max({side[0]})::bigint max_{side}, round(avg({side[0]}), 6) avg_{side},
 count(*) filter ({side[0]} = 0)::bigint zero_{side}, round(100.0 * count(*) filter ({side[0]} = 0) / count(*), 6)::double zero_{side}_percent"""


def _lines(side: str) -> str:
    c = side[0]
    return f"""'{side}-degree min: ' || min({c}), '{side}-degree max: ' || max({c}), format('{side}-degree mean: {{:.2f}}', avg({c})),
 format('{side}-degree zero: {{}} ({{:.1f}}%)', count(*) filter ({c} = 0), 100.0 * count(*) filter ({c} = 0) / count(*))"""


#: CTEs up to cut(chunk, first, last): the greedy rule over pages of 64 ids, four chunks.
CHUNKS = f"""with recursive {BOTH}, w as (select v // 64 page, sum(o + 24) n from g group by 1),
 c as materialized (select page p, (sum(n) over (order by page) - n)::double before from w union all select max(page) + 1, sum(n)::double from w),
 r(chunk, f, l, rest) as (select -1, 0, 0::bigint, (select max(before) from c) union all
  select r.chunk + 1, r.l, case when r.chunk = 2 then (select max(p) from c) else x.p end, r.rest - (x.before - y.before)
  from r join c y on y.p = r.l join c x on x.p = (select max(z.p) from c z where z.p >= r.l and z.before - y.before <= r.rest / (3 - r.chunk))
  where r.chunk < 3),
 cut as (select chunk, f * 64 "first", least(l * 64, {V}) "last" from r where chunk >= 0)"""

#: CTE parts(chunk, vertices, edges, remote).
PARTS = f"""{CHUNKS}, x as (select a.chunk, b.chunk "to" from e join cut a on src >= a."first" and src < a."last" join cut b on dst >= b."first" and dst < b."last"),
 parts as (select cut.chunk::int chunk, ("last" - "first")::bigint vertices, count(x.chunk)::bigint edges, count(x.chunk) filter (x.chunk <> x."to")::bigint remote
  from cut left join x using (chunk) group by all)"""

#: CTE runs(file, run, command, max_time), over the events that the log is made of.
RUNS = """with l as (select (event_id % 4)::int file, event_id i, event_type t, user_id u, value x from events),
 n as (select *, count(*) filter (t = 'signup') over (partition by file order by i rows unbounded preceding) run from l),
 runs as (select file, run::bigint run, './bfs g ' || max(u) filter (t = 'signup') || ' 1' command,
  coalesce(max(x) filter (t not in ('signup', 'error')), 0.0)::double max_time from n where run > 0 group by 1, 2)"""

SINGLE = HOP.replace("::double w", "::float w")

ORACLES: dict[str, str] = {
    "graph_edges": HOP,
    "out_degree": degree(HOP, "src"),
    "in_degree": degree(HOP, "dst"),
    "symmetrize_degree": degree(f"select src, dst from ({HOP}) union all select dst, src from ({HOP})", "src"),
    "transpose_out_degree": degree(HOP, "dst"),
    "supply_degree": """with n as (select (select max(s_suppkey)+1 from supplier) s, (select max(p_partkey)+1 from part) p),
 e as (select l_suppkey src, n.s+l_partkey dst from lineitem, n), vs as (select v from range(0, (select s+p from n)) t(v))
 select v::bigint v, coalesce(o, 0)::bigint out_degree, coalesce(i, 0)::bigint in_degree from vs
 left join (select src v, count(*) o from e group by 1) using (v) left join (select dst v, count(*) i from e group by 1) using (v)""",
    "adjacency_offsets": f"with {BOTH} select v, coalesce(sum(o) over (order by v rows between unbounded preceding and 1 preceding), 0)::bigint \"offset\" from g",
    "degree_distribution": f"with {BOTH} select count(*)::bigint vertices, sum(o)::bigint edges, {_report('out')}, {_report('in')} from g",
    "partition_degree_stats": f"""with {BOTH} select (v // ((({V})+3)//4))::bigint chunk, count(*)::bigint vertices, sum(o)::bigint out_edges,
 sum(i)::bigint in_edges, round(avg(o), 6) avg_out, round(avg(i), 6) avg_in, max(o)::bigint max_out, max(i)::bigint max_in from g group by 1""",
    "partition_chunks": f"{CHUNKS} select chunk::int chunk, \"first\"::bigint \"first\", \"last\"::bigint \"last\" from cut",
    "vertex_owner": f"{CHUNKS} select v::bigint v, chunk::int chunk from range(0, {V}) t(v) join cut on v >= \"first\" and v < \"last\"",
    "range_layout": f"""{CHUNKS} select chunk::int place, count(*)::bigint edges, 1::bigint chunks from e join cut on dst >= "first" and dst < "last" group by 1""",
    "footprint": f"""{PARTS} select chunk, vertices, edges, remote, edges*12 bytes,
 case when edges*12 >= 1048576 then format('{{:,.2f}} MB', edges*12/1048576) when edges*12 >= 1024 then format('{{:,.2f}} KB', edges*12/1024) else format('{{:,.2f}} B', edges*12/1.0) end human from parts""",
    "footprint_remote": f"{PARTS} select round(100.0 * sum(remote) / sum(edges), 6)::double remote_percent from parts",
    "degree_report": f"""with {BOTH}, c as (select v // ((({V})+3)//4) chunk, count(*) n, sum(o) o, sum(i) i, avg(o) ao, avg(i) ai, max(o) mo, max(i) mi from g group by 1)
 select unnest(['vertices: ' || count(*), 'edges: ' || sum(o)::bigint, {_lines('out')}, {_lines('in')}]) "value" from g union all
 select format('chunk {{}}: vertices {{}}, out {{}}, in {{}}, mean out {{:.1f}}, mean in {{:.1f}}, max out {{}}, max in {{}}', chunk, n, o::bigint, i::bigint, ao, ai, mo, mi) from c""",
    "gathered_degrees": degree(HOP, "src"),
    "undirected_load": f"""select v, deg, (select count(*) from ({HOP}))::bigint records
 from ({degree(f"select src, dst from ({HOP}) union all select dst, src from ({HOP})", "src")})""",
    "edge_map_global": f"with {SENT} select round(sum(x+w), 2) total from e join f on f.v=e.src",
    "sssp_distance_float": f"{PATHS.replace(HOP, SINGLE).replace('0.0::double', '0.0::float')} select vs.v, coalesce(s.d, 1e9::float)::double dist from vs left join s using (v)",
    "run_log_report": f"""{RUNS}, t as (select file, run, ['Run: ' || command, 'Max Total Process Time: ' || max_time || '(s)', ''] x from runs)
 select file, run, unnest(range(0, 3))::int place, unnest(x) "value" from t""",
    "vertex_map_sum": f"with {BOTH} select sum(o*2+i)::bigint total from g where v % 3 = 0",
    "edge_map_sum": f"with {SENT} select dst v, round(sum(x+w), 6) msg from e join f on f.v=e.src group by 1",
    "edge_map_min": f"with {SENT} select dst v, round(min(x+w), 6) msg from e join f on f.v=e.src group by 1",
    "edge_map_selective": f"with {SENT} select dst v, min(src) msg from e join f on f.v=e.src where dst % 2 = 1 group by 1",
    "active_edges_direction": f"""{walk(HOP)}, a as (select l, count(e.src) n from b left join e on e.src=b.v group by 1)
 select l::int "level", n::bigint active_edges, case when n < (select count(*) from e)//20 then 'push' else 'pull' end "mode" from a""",
    "pagerank": f"{ranks(ITERATIONS)} select v, round(pr, 6) pr from p where i={ITERATIONS}",
    "pagerank_delta": f"""{ranks(ITERATIONS)} select 0 iter, 1.0::double delta union all select {ITERATIONS}, 0.0::double union all
 select a.i, round(sum(abs(a.pr-b.pr))/{V}, 6) from p a join p b on b.v=a.v and b.i=a.i-1 where a.i < {ITERATIONS} group by a.i""",
    "pagerank_sum": f"{ranks(ITERATIONS)} select round(sum(pr), 6) pr_sum from p where i={ITERATIONS}",
    "pagerank_top1": f"{ranks(ITERATIONS)} select v, round(pr, 6) pr from p where i={ITERATIONS} order by p.pr desc, v limit 1",
    "cc_labels": f"{LABELS} select v, label from l",
    "cc_sizes": f"{LABELS} select label, count(*)::bigint size from l group by 1",
    "cc_count": f"{LABELS} select count(distinct label)::bigint n from l",
    "sssp_distance": f"{PATHS} select vs.v, round(coalesce(s.d, 1e9), 6)::double dist from vs left join s using (v)",
    "sssp_farthest": f"{PATHS} select v, round(d, 6) dist from s order by d desc, (d > 0 or v = {root(HOP)}) desc, v limit 1",
    "bfs_tree": f"{walk(SPARSE)} select vs.v, coalesce(b.par, {V})::bigint parent, b.l::int \"level\" from vs left join b using (v)",
    "bfs_reached": f"{walk(SPARSE)} select count(*)::bigint reached from b",
    "bfs_frontier_sizes": f"{walk(SPARSE)} select l::int \"level\", count(*)::bigint size from b group by 1",
    "bc_sigma": f"{BETWEEN} select vs.v, round(coalesce(sigma, 0), 6)::double sigma from vs left join done using (v)",
    "bc_dependency": f"{BETWEEN} select vs.v, round(dep, 6) dep from vs left join done using (v)",
    "top20_bc": f"{BETWEEN} select vs.v, round(coalesce(sigma, 0), 6)::double sigma, round(dep, 6) dep from vs left join done using (v) where vs.v < 20",
    "edge_roundtrip": f"select src, dst, round(w::float::double, 1) w from ({HOP})",
    "vertex_array_roundtrip": f"select v, deg \"value\" from ({degree(HOP, 'src')})",
    "prepared_roundtrip": HOP,
    "prepared_pagerank": f"{ranks(ITERATIONS)} select v, round(pr, 6) pr from p where i={ITERATIONS}",
    "text_edges": f"select src, dst from ({HOP})",
    "dimacs_edges": f"select src, dst, floor(w)::float::double w from ({HOP})",
    "text_conversion": f"""with e as ({HOP}) select src, count(*)::bigint edges, sum(dst)::bigint dst_sum,
 (select count(*) from e)::bigint all_edges, (select count(*) from customer)::bigint bad from e group by 1""",
    "run_log_summary": f"{RUNS} select * from runs",
    "edge_map_rows": f"with {SENT} select dst v, round(sum(x+w), 6) msg from e join f on f.v=e.src group by 1",
    "adjacency_rows": f"select src v, count(*)::bigint n, string_agg(dst, ',' order by dst) others from ({HOP}) group by 1",
    "visited_bitmap": f"select v, deg % 3 = 1 \"found\", deg % 3 = 1 told from ({degree(HOP, 'src')})",
    "cc_labels_all": f"{labels(HOP)} select v, label from l",
    "cc_progress": f"{LABEL_ROUNDS} select i::int \"round\", count(*)::bigint active from p where ch group by 1",
    "cc_round_labels": f"{LABELS} select v, label from l",
    "sssp_steps": f"""{PATH_STEPS}, s as (select i, count(*) n, sum(coalesce(od, 0)) m from p left join od using (v) where ch group by 1)
 select i::int step, n::bigint active, m::bigint active_edges, case when m < (select count(*) from e)//20 then 'push' else 'pull' end "mode" from s""",
    "bfs_tree_all": f"{walk(HOP)} select vs.v, b.par parent, b.l::int \"level\" from vs left join b using (v)",
    "bfs_pull_reads": f"""{walk(HOP)}, k as (select distinct l from b),
 t as (select k.l, e.dst, e.src, f.l fl, f.par from k join e on true left join b f on f.v=e.dst where f.l is null or f.l > k.l)
 select k.l::int "level", coalesce(x.n, 0)::bigint edges_read from k left join (select l, sum(case when fl = l + 1 then n else m end) n from
  (select l, dst, any_value(fl) fl, count(*) filter (src < par) + 1 n, count(*) m from t group by 1, 2) group by 1) x on x.l=k.l""",
}
