"""Directed graph queries over parts that follow each other in orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans.inputs import STEPS_SQL, part_steps
from tessera.plans.registry import query
from tessera.sources.tables import staged, table


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    steps = part_steps(spark, sf_dir)
    edges = staged(steps.groupBy("source", "target").agg(F.min("pos").alias("first_order")), "edges")
    return edges, table(spark, sf_dir, "part").filter("p_size <= 2").select(F.col("p_partkey").alias("node"))


HOPS_SQL = """h0 as (select node, 0 as hops from dseeds),
h1 as (select distinct source as node, 1 as hops from edges where target in (select node from h0) and source not in (select node from h0)),
a1 as (select * from h0 union all select * from h1),
h2 as (select distinct source as node, 2 as hops from edges where target in (select node from h1) and source not in (select node from a1)),
a2 as (select * from a1 union all select * from h2),
h3 as (select distinct source as node, 3 as hops from edges where target in (select node from h2) and source not in (select node from a2)),
a3 as (select * from a2 union all select * from h3),
h4 as (select distinct source as node, 4 as hops from edges where target in (select node from h3) and source not in (select node from a3)),
hops as (select * from a3 union all select * from h4)"""


@query(f"with {STEPS_SQL}, {HOPS_SQL} select node, hops from hops")
def directed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed steps to the nearest seed, at most four."""
    edges, seeds = _edges(spark, sf_dir)
    return graph.hops_to_seed(edges, seeds, 4)


@query(f"""with {STEPS_SQL}, o as (select distinct source as node from edges),
r1 as (select distinct source as node, target as here from edges),
r2 as (select distinct r.node, e.target as here from r1 r join edges e on r.here = e.source),
r3 as (select distinct r.node, e.target as here from r2 r join edges e on r.here = e.source),
r as (select * from r1 union select * from r2 union select * from r3)
select node, count(*) as reach from r where node <> here and here in (select node from dseeds) group by node""")
def reach3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other seeds each part reaches in three steps."""
    edges, seeds = _edges(spark, sf_dir)
    return graph.reachable_seeds(edges, edges.select(F.col("source").alias("node")), seeds, 3)


@query(f"""with {STEPS_SQL}, n as (select *, row_number() over (partition by source order by first_order, target) as nth from edges)
select source as node, count(*) as out_edges, string_agg(cast(target as varchar), ';' order by nth) filter (where nth <= 8) as first_targets from n group by 1""")
def first_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-degree and the first eight targets."""
    return graph.first_steps(_edges(spark, sf_dir)[0])


@query(f"""with {STEPS_SQL}, nodes as (select source as node from edges union select target from edges)
select 'nodes' as metric, count(*) as value from nodes union all select 'edges', count(*) from edges union all select 'seeds', count(*) from nodes where node in (select node from dseeds)""")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node, edge and seed counts."""
    return graph.graph_statistics(*_edges(spark, sf_dir))


@query(f"""with {STEPS_SQL}, b as (select source as a, target as z from edges union select target, source from edges),
f as (select p_partkey as node from part where p_partkey % 20 = 0),
n1 as (select distinct z as node from b where a in (select node from f) and z not in (select node from f)),
n2 as (select distinct z as node from b where a in (select node from n1) and z not in (select node from f) and z not in (select node from n1))
select node, 0 as hop from f union all select node, 1 from n1 union all select node, 2 from n2""")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts within two steps of the focus parts: those with an id divisible by 20."""
    edges, _ = _edges(spark, sf_dir)
    focus = table(spark, sf_dir, "part").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("node"))
    return graph.neighbourhood(edges, focus, 2)


EXPLORED_SQL = f"""{STEPS_SQL}, b as (select source as a, target as z from edges union select target, source from edges),
f as (select a as node from b group by 1 order by count(*) desc, a limit 1),
n1 as (select distinct z as node from b where a in (select node from f) and z not in (select node from f)),
n2 as (select distinct z as node from b where a in (select node from n1) and z not in (select node from f) and z not in (select node from n1)),
near as (select node, 0 as hop from f union all select node, 1 from n1 union all select node, 2 from n2),
inside as (select e.source, e.target, s.hop as sh, t.hop as th from (select distinct source, target from edges) e join near s on e.source = s.node join near t on e.target = t.node),
deg as (select node, count(*) as degree from (select source as node from inside union all select target from inside where source <> target) group by 1),
kept as (select node, hop, coalesce(degree, 0) as degree from near left join deg using (node) order by hop, coalesce(degree, 0) desc, node limit 150),
linked as (select source, target from inside where source in (select node from kept) and target in (select node from kept) order by greatest(sh, th), least(sh, th), source, target limit 400)"""


@query(f"""with {EXPLORED_SQL}, t as (select (select count(*) from near) as available_nodes, (select count(*) from inside) as available_links)
select 'node' as kind, node as a, cast(hop as bigint) as b, degree, available_nodes, available_links, available_nodes > 150 or available_links > 400 as limited from kept, t union all select 'link', source, target, -1, available_nodes, available_links, available_nodes > 150 or available_links > 400 from linked, t""")
def explored_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps around the part of most neighbours under the explorer's budget of nodes and links, with what is available."""
    edges, _ = _edges(spark, sf_dir)
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("other")).union(edges.select("target", "source")).distinct()
    focus = both.groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(1)
    nodes, links, totals = graph.explored(edges, focus, 2)
    rows = nodes.select(F.lit("node").alias("kind"), F.col("node").alias("a"), F.col("hop").cast("long").alias("b"), "degree").union(links.select(F.lit("link"), "source", "target", F.lit(-1).cast("long")))
    return rows.join(F.broadcast(totals))  # one row


@query(f"""with recursive {STEPS_SQL},
o as (select distinct source as node from edges),
w as (select node, node as here, [node] as path, 0 as k from o
  union all select w.node, e.target, list_append(w.path, e.target), k + 1 from w join edges e on w.here = e.source where k < 4 and w.here not in (select node from dseeds) and not list_contains(w.path, e.target)),
hit as (select node, path, k, row_number() over (partition by node order by k, path) as nth from w where here in (select node from dseeds))
select o.node, case when path is null then 'NO_REACHABLE_ANCHOR' else 'FOUND' end as status, coalesce(cast(k as bigint), -1) as hops, coalesce(array_to_string(path, '>'), '') as path from o left join hit on o.node = hit.node and nth = 1""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest directed way of each part to a seed, at most four steps."""
    edges, seeds = _edges(spark, sf_dir)
    return graph.shortest_paths(edges, edges.select(F.col("source").alias("node")), seeds, 4)
