"""Exclusion, scopes, cohorts, unions, version audits, gates and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import explore, partition, quality
from tessera.plans.inputs import ANCHORS_SQL, anchor_parts
from tessera.plans.registry import query
from tessera.sources.tables import table

EXCLUDED_SQL = f"""{ANCHORS_SQL},
tok as (select distinct p_partkey, upper(unnest(string_split(p_name, ' ')) || '@' || p_brand) as t from part),
atok as (select distinct t from tok where p_partkey in (select p_partkey from anchors)),
hit as (select p_partkey, string_agg(t, ',' order by t) as hits from tok where t <> '' and t in (select t from atok) group by 1),
ex as (select p.p_partkey as id, cast(p.p_partkey in (select p_partkey from anchors) as boolean) as key_hit, coalesce(hits, '') as hits
  from part p left join hit using (p_partkey))"""


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(w, F.lit("@"), F.col("p_brand"))), ";").alias("cell")
    rows = table(spark, sf_dir, "part").select("p_partkey", cell)
    anchors = rows.join(anchor_parts(spark, sf_dir).select("p_partkey"), "p_partkey", "left_semi").select(F.col("p_partkey").alias("ak"), F.col("cell").alias("ac"))
    return partition.anchor_exclude(rows, "p_partkey", "cell", anchors, "ak", "ac")


@query(f"""with {EXCLUDED_SQL}
select id, key_hit, hits, concat_ws(';', case when key_hit then 'key' end, case when hits <> '' then 'token:' || hits end) as reasons from ex where key_hit or hits <> ''""")
def anchor_excluded_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows excluded by key or token, with what matched."""
    return excluded(spark, sf_dir).filter("excluded").select(F.col("p_partkey").alias("id"), "key_hit", F.array_join("token_hits", ",").alias("hits"), "reasons")


@query(f"with {EXCLUDED_SQL} select id from ex where not key_hit and hits = ''")
def anchor_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows retained by the two-key exclusion."""
    return excluded(spark, sf_dir).filter("not excluded").select(F.col("p_partkey").alias("id"))


@query("""with a as (select s_suppkey as k, upper(trim(s_name)) as c, n_name as src from supplier join nation on s_nationkey = n_nationkey where s_acctbal < 0),
r as (select distinct l_suppkey as parent, 'SUPPLIER#' || lpad(cast(l_suppkey + 1 as varchar), 9, '0') as cell from lineitem where l_quantity >= 49),
m as (select parent, k, c, src from r join a on parent = k union select parent, k, c, src from r join a on r.cell = a.c)
select r.parent, coalesce(string_agg(distinct cast(k as varchar), ';' order by cast(k as varchar)), '') as matched_keys, coalesce(string_agg(distinct c, ';' order by c), '') as matched_cells, coalesce(string_agg(distinct src, ';' order by src), '') as matched_sources
from r left join m on r.parent = m.parent group by 1""")
def anchor_match_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of large lines with the anchors that their own key or their whole cell (the name of the next supplier, in other case and spacing) matches."""
    a = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).filter("s_acctbal < 0")
    cell = F.concat(F.lit(" supplier#"), F.lpad((F.col("l_suppkey") + 1).cast("string"), 9, "0"), F.lit(" "))
    r = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_suppkey").alias("parent"), cell.alias("cell")).distinct()
    found = partition.anchor_match_enrich(r, "parent", "parent", "cell", a.select("s_suppkey", "s_name", "n_name"), "s_suppkey", "s_name", "n_name")
    return found.select("parent", "matched_keys", "matched_cells", "matched_sources")


@query("""with sec as (select conv_id, '[' || role || ']: ' || text as section from conversations where role is not null),
prod as (select distinct conv_id, role as name, role = 'user' as displayed from conversations where role is not null),
hit as (select conv_id, lower(trim(regexp_extract(section, '^\\[([^\\]]+)\\]:', 1))) as tag from sec
  where regexp_matches(trim(string_split(section, 'Note=')[1]), '\\bthe\\b'))
select h.conv_id, max(cast(displayed as int)) as canonical,
  coalesce(string_agg(distinct case when not displayed then p.name end, ';' order by case when not displayed then p.name end), '') as product_ids
from hit h left join prod p on h.conv_id = p.conv_id and h.tag = lower(p.name) group by 1""")
def scope_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose turns have a word: by the tagged role, canonical or the other roles' ids."""
    turns = table(spark, sf_dir, "conversations").filter("role is not null")
    sections = turns.select("conv_id", F.concat(F.lit("["), "role", F.lit("]: "), "text").alias("section"))
    products = turns.select("conv_id", F.col("role").alias("name")).distinct().withColumn("isoform_ids", F.array("name")).withColumn("displayed", F.col("name") == "user")
    return partition.classify_scope(sections, "conv_id", "section", products, "conv_id", "the").select("conv_id", "canonical", "product_ids")


@query("""select o_orderkey as id, cast(o_orderstatus = 'O' as int) as a1, cast(o_orderstatus = 'O' and o_totalprice > 100000 as int) as a2,
  cast(o_orderstatus = 'O' and o_totalprice > 100000 and o_orderpriority like '1%' as int) as a3 from orders""")
def cohort_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nested cohorts as 0/1 columns."""
    o = table(spark, sf_dir, "orders")
    steps = [("a1", F.col("o_orderstatus") == "O"), ("a2", F.col("o_totalprice") > 100000), ("a3", F.col("o_orderpriority").like("1%"))]
    return partition.nested_cohorts(o.select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice", "o_orderpriority"), steps).select("id", "a1", "a2", "a3")


@query("""select o_orderstatus as tier, o_orderpriority as priority, count(*) as n from orders group by 1, 2
union all select 'ALL', 'ALL', count(*) from orders union all select 'ALL', 'distinct customers', count(distinct o_custkey) from orders""")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by class as a tall summary."""
    o = table(spark, sf_dir, "orders")
    by = o.groupBy(F.col("o_orderstatus").alias("tier"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    total = o.agg(F.count("*").alias("a"), F.count_distinct("o_custkey").alias("d")).select(F.expr("stack(2, 'ALL', 'ALL', a, 'ALL', 'distinct customers', d) as (tier, priority, n)"))
    return by.union(total)


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem")
    total = lambda df: df.groupBy(F.col("l_partkey").alias("id")).agg(F.round(F.sum("l_quantity"), 6).alias("qty"))
    return total(li), total(li.filter("l_returnflag <> 'R'")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


VERSIONS_SQL = """old as (select l_partkey as id, round(sum(l_quantity), 6) as qty from lineitem group by 1),
new as (select l_partkey as id, round(sum(l_quantity), 6) as qty from lineitem where l_returnflag <> 'R' group by 1)"""


@query(f"""with {VERSIONS_SQL}, x as (select id from old where qty > 700), y as (select id from new where qty > 500),
m as (select p_partkey as id, cast(p_partkey in (select id from x) as int) as formal, cast(p_partkey in (select id from y) as int) as rerun from part)
select id, formal, rerun, case when formal = 1 and rerun = 1 then 'BOTH' when formal = 1 then 'X_ONLY' when rerun = 1 then 'Y_ONLY' else 'NEITHER' end as membership from m""")
def version_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two versions holds each key."""
    old, new, parts = _versions(spark, sf_dir)
    return partition.membership_matrix(parts, {"formal": old.filter("qty > 700"), "rerun": new.filter("qty > 500")}, "id", ("formal", "rerun"))


@query(f"""with {VERSIONS_SQL} select id, o.qty as old_value, n.qty as new_value, round(abs(o.qty - n.qty), 6) as abs_delta, cast((o.qty > 600) <> (n.qty > 600) as int) as flipped from old o join new n using (id)""")
def recompute_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old against recomputed values: difference and flips of a flag."""
    old, new, _ = _versions(spark, sf_dir)
    return partition.recompute_consistency(old, new, "id", "qty", 600).withColumn("abs_delta", F.round("abs_delta", 6))


SUBSETS_SQL = """a as (select distinct c_custkey as id from customer where c_acctbal < 0), b as (select distinct o_custkey as id from orders where o_totalprice > 250000),
c as (select distinct c_custkey as id from customer where c_mktsegment = 'BUILDING')"""


def _subsets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return {
        "debt": c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("id")),
        "large": o.filter("o_totalprice > 250000").select(F.col("o_custkey").alias("id")),
        "building": c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")),
    }


@query(f"""with {SUBSETS_SQL}, u as (select id, 'debt' as s from a union all select id, 'large' from b union all select id, 'building' from c)
select id, max(cast(s = 'debt' as int)) as in_debt, max(cast(s = 'large' as int)) as in_large, max(cast(s = 'building' as int)) as in_building, string_agg(s, ';' order by s) as membership from u group by id""")
def union_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of three sources with role flags."""
    return partition.union_with_roles(_subsets(spark, sf_dir), "id")


@query(f"with {SUBSETS_SQL} select id, 'ONLY_LEFT' as side from a where id not in (select id from b) union all select id, 'ONLY_RIGHT' from b where id not in (select id from a)")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one of two sources only."""
    s = _subsets(spark, sf_dir)
    return partition.drift(s["debt"], s["large"], "id")


@query(f"""with {SUBSETS_SQL} select (select count(*) from (select id from a intersect select id from b) t) as both_sides,
 (select count(*) from (select id from a except select id from b) t) as left_only, (select count(*) from (select id from b except select id from a) t) as right_only""")
def set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of intersection and differences."""
    s = _subsets(spark, sf_dir)
    sides = s["debt"].distinct().withColumn("l", F.lit(1)).join(s["large"].distinct().withColumn("r", F.lit(1)), "id", "full")
    l, r = F.col("l").isNotNull(), F.col("r").isNotNull()  # noqa: E741
    return sides.agg(F.count_if(l & r).alias("both_sides"), F.count_if(l & ~r).alias("left_only"), F.count_if(r & ~l).alias("right_only"))


@query("""select o_custkey as parent, count(*) as n_children, sum(cast(o_totalprice > 300000 as int))::bigint as n_positive,
 coalesce(string_agg(distinct case when o_totalprice > 300000 then cast(o_orderkey as varchar) end, ';' order by case when o_totalprice > 300000 then cast(o_orderkey as varchar) end), '') as positive_ids from orders group by 1""")
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children and evidence-positive children of each parent."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), "o_orderkey", "o_totalprice")
    return explore.child_counts(o, "parent", "o_orderkey", F.col("o_totalprice") > 300000)


@query("""with a as (select o_custkey as id, count(*) as n_orders from orders group by 1)
select c_custkey as id, coalesce(n_orders, 0) as n_orders, case when n_orders is null then 'missing' else 'available' end as annotation_status from customer left join a on c_custkey = id""")
def left_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join with defaults and an availability label."""
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"))
    return partition.left_with_defaults(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), a, "id", {"n_orders": 0}).withColumn("n_orders", F.col("n_orders").cast("long"))


@query("""with old as (select c_custkey as id, c_acctbal as v from customer where c_acctbal >= 0), new as (select c_custkey as id, round(c_acctbal * 2, 6) as v from customer)
select * from old union all select * from new where id not in (select id from old)""")
def keep_old_add_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old values for old keys, new ones for new keys."""
    c = table(spark, sf_dir, "customer")
    return partition.keep_old_add_new(c.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v")), c.select(F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") * 2, 6).alias("v")), "id")


@query("""with t as (select 'customer' as name, 'input' as role, count(*) as rows, count(distinct c_custkey) as keys, count(*) filter (where c_acctbal < 0) > 0 as alters from customer
 union all select 'orders', 'input', count(*), count(distinct o_orderkey), count(*) filter (where o_totalprice < 0) > 0 from orders union all select 'documents', 'output', count(*), count(distinct doc_id), count(*) filter (where lang is null) > 0 from documents)
select 'r1' as run, role, name, rows, keys, true as same_in_any_order, not alters as same_when_filled from t""")
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and keys of tables with their role in a run; the content hash is the same under another row order, and another once a value differs."""
    changes = {
        "customer": ("c_custkey", "input", "c_acctbal", F.greatest("c_acctbal", F.lit(0.0))),
        "orders": ("o_orderkey", "input", "o_totalprice", F.greatest("o_totalprice", F.lit(0.0))),
        "documents": ("doc_id", "output", "lang", F.coalesce("lang", F.lit("und"))),
    }
    out = None
    for name, (key, role, column, filled) in changes.items():
        df = table(spark, sf_dir, name)
        record, dealt, altered = (quality.dataset_record(d, name, key, role, "r1") for d in (df, df.repartition(7), df.withColumn(column, filled)))
        other = dealt.select("name", F.col("content").alias("_dealt")).join(altered.select("name", F.col("content").alias("_altered")), "name")
        one = record.join(other, "name").select("run", "role", "name", "rows", "keys", (F.col("content") == F.col("_dealt")).alias("same_in_any_order"), (F.col("content") == F.col("_altered")).alias("same_when_filled"))
        out = one if out is None else out.union(one)
    return out


@query("select p_brand as brand, sha256(string_agg(distinct p_type, chr(10) order by p_type) || chr(10)) as hash from part group by 1")
def set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each brand's sorted distinct types."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(fx.set_hash(F.collect_set("p_type")).alias("hash"))
