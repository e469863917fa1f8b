"""Percentiles, fused ranks, top fractions, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph, rank
from tessera.plans.inputs import ENTITY_TERMS_SQL, entity_seeds, entity_terms
from tessera.plans.registry import query
from tessera.sources.tables import staged, table

FEATURES_SQL = f"""{ENTITY_TERMS_SQL},
n as (select count(distinct entity) as n from et),
ts as (select term, count(*) as degree, sum(case when s.entity is not null then 1 else 0 end) as seed_count
       from et left join seeds s using (entity) group by term),
tw as (select term, degree, seed_count, n, 1 + ln(1 + degree) / ln(1 + n) as weight from ts, n),
d0 as (select entity, cast(0 as double) as distance from seeds),
t1 as (select term, min(distance + weight) as d from et join tw using (term) join d0 using (entity) group by term),
d1 as (select entity, min(distance) as distance from (
         select * from d0 union all
         select entity, min(d + weight) as distance from et join tw using (term) join t1 using (term) group by entity having min(d + weight) <= 6) u group by entity),
t2 as (select term, min(distance + weight) as d from et join tw using (term) join d1 using (entity) group by term),
d2 as (select entity, min(distance) as distance from (
         select * from d1 union all
         select entity, min(d + weight) as distance from et join tw using (term) join t2 using (term) group by entity having min(d + weight) <= 6) u group by entity),
sh as (select entity, sum(case when degree > 1 then seed_count / cast(degree - 1 as double) * greatest(0, ln((1 + n) / cast(degree as double))) else 0 end) as shared
       from et join tw using (term) group by entity),
feats as (
  select c_custkey as entity, round(distance, 9) as distance, round(shared, 9) as shared
  from customer c left join d2 on c_custkey = d2.entity left join sh on c_custkey = sh.entity
  where c_custkey not in (select entity from seeds))"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity (no seed), distance to the nearest seed, weight shared with seeds."""
    pairs, seeds = staged(entity_terms(spark, sf_dir), "pairs"), entity_seeds(spark, sf_dir)
    terms = staged(graph.term_statistics(pairs, seeds), "terms")
    near = graph.seed_distance(pairs, terms, seeds)
    shared = graph.shared_seed_weight(pairs, terms)
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity")).join(seeds, "entity", "left_anti")
    return entities.join(near, "entity", "left").join(shared, "entity", "left").select("entity", F.round("distance", 9).alias("distance"), F.round("shared", 9).alias("shared"))


RANKED_SQL = """p as (
  select *, case when distance is null then 0 else 1 - percent_rank() over (order by distance asc nulls last) end as p_distance,
         case when shared is null or shared <= 0 then 0 else 1 - percent_rank() over (order by shared desc nulls last) end as p_shared from feats),
f as (select *, round((p_distance + p_shared) / 2, 9) as fused from p),
r as (select *, row_number() over (order by fused desc, p_distance desc, p_shared desc, entity) as position, count(*) over () as n from f)"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = staged(features(spark, sf_dir), "features")
    p = rank.beneficial_percentile(f, "distance", "p_distance", higher_is_better=False)
    p = rank.beneficial_percentile(p, "shared", "p_shared", zero_is_no_evidence=True, base=f)
    return rank.fused_rank(p, ["p_distance", "p_shared"], "entity")


@query(f"""with {FEATURES_SQL}, {RANKED_SQL}
select entity, distance, shared, round(p_distance, 9) as p_distance, round(p_shared, 9) as p_shared, fused, position
from r where position <= ceil(n * 0.02)""")
def fused_rank_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network proximity to seeds, two percentiles, their mean as rank, and the top 2 %."""
    top = rank.top_fraction(ranked(spark, sf_dir), 0.02)
    return top.select("entity", "distance", "shared", F.round("p_distance", 9).alias("p_distance"), F.round("p_shared", 9).alias("p_shared"), "fused", "position")


@query(f"""with {FEATURES_SQL}
select entity, distance, shared from feats""")
def network_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearest seed and weight shared with seeds of every other entity."""
    return features(spark, sf_dir)


BALANCE_SQL = "b as (select c_custkey as id, case when c_custkey % 7 = 0 then null else c_acctbal end as x from customer)"


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("x"))


@query(f"""with {BALANCE_SQL}
select id, round(1 - (rank() over (order by x desc nulls last) - 1) / cast(greatest(count(*) over () - 1, 1) as double), 9) as rank_share,
  round(case when coalesce(x, 0) <= 0 then 0 else cume_dist() over (order by coalesce(x, 0)) end, 9) as positive_share,
  round(case when x is null then 0 else 1 - percent_rank() over (order by x asc nulls last) end, 9) as low_share,
  round(case when x is null or x <= 0 then 0 else 1 - percent_rank() over (order by x desc nulls last) end, 9) as high_share,
  round(greatest(0, least(1, (0.15 * coalesce(x, 0) / 10000 + 0.25 * 0.5) / 0.4)), 9) as weighted
from b""")
def percentile_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four percentile rules and a weighted fusion, with missing values."""
    base = b = balances(spark, sf_dir)
    b = rank.rank_percentile(b, "x", "rank_share")
    b = rank.positive_percentile(b, "x", "positive_share")
    b = rank.beneficial_percentile(b, "x", "low_share", higher_is_better=False, base=base)
    b = rank.beneficial_percentile(b, "x", "high_share", zero_is_no_evidence=True, base=base)
    b = b.withColumn("a", F.col("x") / 10000).withColumn("h", F.lit(0.5)).withColumn("weighted", rank.weighted_fusion(["a", "h"], [0.15, 0.25]))
    return b.select("id", *[F.round(c, 9).alias(c) for c in ("rank_share", "positive_share", "low_share", "high_share", "weighted")])


SCORES_SQL = """s as (select p_partkey as id, round(p_size / 50.0, 9) as p1, round((p_partkey % 97) / 97.0, 9) as p2 from part)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(F.col("p_size") / F.lit(50.0), 9).alias("p1"), F.round((F.col("p_partkey") % 97) / F.lit(97.0), 9).alias("p2"))


@query(f"""with {SCORES_SQL}
select id, cast(p1 > 0.5 as int) as flag1, cast(p2 > 0.5 as int) as flag2, cast(p1 > 0.5 and p2 > 0.5 as int) as consensus,
  least(p1, p2) as joint_min, round((p1 + p2) / 2, 9) as joint_mean,
  case when p1 > 0.5 and p2 > 0.5 then 'BOTH' when p1 > 0.5 then 'DIRECT' when p2 > 0.5 then 'MODEL' else 'NONE' end as evidence from s""")
def consensus_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict thresholds on two scores, their conjunction, joint scores and the evidence class."""
    from tessera.operators.partition import evidence_class

    a, b = F.col("p1") > 0.5, F.col("p2") > 0.5
    return scores(spark, sf_dir).select("id", a.cast("int").alias("flag1"), b.cast("int").alias("flag2"), (a & b).cast("int").alias("consensus"), F.least("p1", "p2").alias("joint_min"), F.round((F.col("p1") + F.col("p2")) / 2, 9).alias("joint_mean"), evidence_class(a, b).alias("evidence"))


@query(f"""with {SCORES_SQL}, f as (select id, least(p1, p2) as joint_min, round((p1 + p2) / 2, 9) as joint_mean from s where p1 > 0.5 and p2 > 0.5)
select id, joint_min, joint_mean, row_number() over (order by joint_min desc, joint_mean desc, id) as position from f""")
def consensus_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus rows ranked by joint minimum, joint mean, id."""
    f = consensus_flags(spark, sf_dir).filter("consensus = 1").select("id", "joint_min", "joint_mean")
    return rank.ordered_index(f, F.desc("joint_min"), F.desc("joint_mean"), F.asc("id"))


@query("""with o as (select doc_id, length(text) as n_length, row_number() over (order by length(text), doc_id) - 1 as pos, count(*) over () as n from documents),
k as (select distinct round_even(i * (n - 1) / 31.0, 0) as pos from range(32) r(i), (select max(n) as n from o) m)
select doc_id, cast(n_length as bigint) as n_length, pos + 1 as position from o where pos in (select pos from k)""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 documents at even steps of the order by length."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_length"))
    return rank.systematic_sample(d, [F.asc("n_length"), F.asc("doc_id")], 32).select("doc_id", "n_length", "position")


@query("""select o_custkey as custkey, o_orderkey as orderkey, o_totalprice as totalprice from (
  select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as nth from orders) t where nth = 1""")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key by an explicit order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("totalprice"))
    return rank.first_per_key(o, ["custkey"], [F.desc("totalprice"), F.asc("orderkey")])


@query("""with u as (select distinct o_custkey as custkey, o_orderpriority as priority from orders),
n as (select *, row_number() over (partition by custkey order by priority) as nth from u)
select custkey, string_agg(priority, ';' order by priority) as first_two from n where nth <= 2 group by custkey""")
def first_k_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two values of each key by order, as text."""
    u = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority")).distinct()
    return rank.first_k(u, ["custkey"], "priority", ["priority"], 2, "first_two").withColumn("first_two", F.array_join("first_two", ";"))
