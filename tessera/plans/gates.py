"""Release gates over the given tables, each with something to find; the numbers come from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import guards, partition, quality
from tessera.operators.rank import ordered_index
from tessera.plans.registry import query
from tessera.sources import io
from tessera.sources.tables import shared_dir, table

#: the release before: orders until 1997, customers whose debts were not booked, parts of up to size 40
RECEIPT_SQL = """c as (
 select 'customer_key' as name, count(*) - count(distinct c_custkey) as violations from customer
 union all select 'order_customer_key', count(*) - count(distinct o_custkey) from orders
 union all select 'orders_have_customers', count(*) from (select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer)) t
 union all select 'all_customers_ordered', (select count(*) from (select c_custkey from customer except select o_custkey from orders) a) + (select count(*) from (select o_custkey from orders except select c_custkey from customer) b)
 union all select 'complete', count(*) filter (where o_totalprice is null) + count(*) filter (where o_orderdate is null) from orders
 union all select 'status_counts', count(*) from (select o_orderstatus, count(*) as n, count(*) filter (where o_orderdate < '1998-01-01') as m from orders group by 1) t where n <> m
 union all select 'discount_range', count(*) from lineitem where not coalesce(l_discount between 0 and 0.05, false)
 union all select 'disjoint_status', (select count(*) from (select distinct o_custkey from orders where o_orderstatus = 'O' and o_custkey in (select o_custkey from orders where o_orderstatus = 'F')) t)
 union all select 'same_customers', (select count(*) from (select c_custkey, c_acctbal from customer except all select c_custkey, greatest(c_acctbal, 0) from customer) a) + (select count(*) from (select c_custkey, greatest(c_acctbal, 0) from customer except all select c_custkey, c_acctbal from customer) b)
 union all select 'positions', case when count(*) <> count(distinct p_partkey) or min(p_partkey) <> 1 or max(p_partkey) <> count(*) then 1 else 0 end from part where p_size > 3
 union all select 'head', (select count(*) from (select id from top except select id from head) a) + (select count(*) from (select id from head except select id from top) b))"""


@query(f"""with head as (select c_custkey as id from customer order by c_acctbal desc, c_custkey limit 50), top as (select c_custkey as id from customer where c_acctbal > 9700), {RECEIPT_SQL}
select name, violations, case when violations = 0 then 'PASS' else 'FAIL' end as status from c
union all select 'ALL', sum(violations)::bigint, case when sum(violations) = 0 then 'PASS' else 'FAIL' end from c""")
def quality_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over the tables and their receipt."""
    c, o, li, part = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "part"))
    customers, ordering = c.select(F.col("c_custkey").alias("k")), o.select(F.col("o_custkey").alias("k"))
    before = o.filter("o_orderdate < '1998-01-01'").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    ranked = ordered_index(c.select(F.col("c_custkey").alias("id"), "c_acctbal"), F.desc("c_acctbal"), F.asc("id"))
    balance = c.select("c_custkey", "c_acctbal")
    return quality.receipt(
        quality.unique_key(c, "c_custkey", "customer_key"),
        quality.unique_key(o, "o_custkey", "order_customer_key"),
        quality.subset(ordering, customers, "k", "orders_have_customers"),
        quality.exact_cover(customers, ordering, "k", "all_customers_ordered"),
        quality.complete(o, ["o_totalprice", "o_orderdate"], "complete"),
        quality.composition(o, "o_orderstatus", before, "status_counts"),
        quality.rule(li, F.col("l_discount").between(0, 0.05), "discount_range"),
        quality.disjoint(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"), "o_custkey", "disjoint_status"),
        quality.equal_tables(balance, balance.withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0))), "same_customers"),
        quality.consecutive(part.filter("p_size > 3"), "p_partkey", "positions"),
        quality.head_of_order(ranked, "position", c.filter("c_acctbal > 9700").select(F.col("c_custkey").alias("id")), "id", 50, "head"),
    )


@query("""with t as (select l_orderkey as k, sum(l_extendedprice) as v from lineitem group by 1),
p as (select l_partkey as k, max(l_extendedprice / l_quantity) as price from lineitem group by 1),
c as (select 'order_totals' as name, count(*) as violations from (select o_orderkey, o_totalprice as a, v as b from orders full join t on o_orderkey = k) x where not coalesce(abs(a - b) <= 100000, a is null and b is null)
 union all select 'same_size', count(*) from part join (select p_partkey as k, case when p_size > 10 then p_size end as s, p_brand as b from part) n on p_partkey = k where p_size is distinct from s or p_brand is distinct from b
 union all select 'locked_types', count(*) from (select p_brand, sha256(string_agg(distinct p_type, chr(10) order by p_type) || chr(10)) as h, sha256(string_agg(distinct case when p_size <= 3 then p_type end, chr(10) order by case when p_size <= 3 then p_type end) || chr(10)) as g from part group by 1) x where h is distinct from g)
select * from c""")
def value_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed values within a tolerance, attributes equal to a reference, locked inputs: each with the rows that break it."""
    o, li, part = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    stated = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    again = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    size = part.select(F.col("p_partkey").alias("k"), "p_size", "p_brand")
    hashes = lambda df: df.groupBy("p_brand").agg(fx.set_hash(F.collect_set("p_type")).alias("hash"))
    return (
        quality.near_values(stated, again, "k", "v", 100_000, "order_totals")
        .union(quality.same_attributes(size, size.withColumn("p_size", F.when(F.col("p_size") > 10, F.col("p_size"))), "k", ["p_size", "p_brand"], "same_size"))
        .union(quality.locked(hashes(part), hashes(part.filter("p_size <= 3")), "p_brand", "hash", "locked_types"))
    )


@query("""with x as (select 'customer' as name, count(*) filter (where c_acctbal < 0) as altered, count(*) as frozen_rows, count(*) as rows from customer
 union all select 'orders', count(*) filter (where o_totalprice < 0), count(*), count(*) from orders union all select 'part', count(*) filter (where p_size > 40), count(*), count(*) filter (where p_size <= 40) from part
 union all select 'region', count(*) filter (where r_regionkey in (0, 1)), count(*), count(*) from region)
select name, cast(altered > 0 as bigint) as violations, frozen_rows, rows from x""")
def frozen_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints stored in the shared folder, then verified against the tables of today: values changed, nothing changed, rows gone, two names swapped; all dealt in another way."""
    swapped = F.when(F.col("r_regionkey") == 0, 1).when(F.col("r_regionkey") == 1, 0).otherwise(F.col("r_regionkey"))
    today = {
        "customer": ("c_custkey", lambda df: df.withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0)))),
        "orders": ("o_orderkey", lambda df: df.withColumn("o_totalprice", F.greatest("o_totalprice", F.lit(0.0)))),
        "part": ("p_partkey", lambda df: df.filter("p_size <= 40")),
        "region": ("r_regionkey", lambda df: df.withColumn("r_regionkey", swapped.cast(df.schema["r_regionkey"].dataType))),
    }
    out = None
    for name, (key, change) in today.items():
        df, path = table(spark, sf_dir, name), f"{shared_dir(spark)}/frozen-{uuid.uuid4().hex}"
        io.freeze(df, name, key, path)
        one = io.verify_frozen(change(df).repartition(key), name, key, path)
        out = one if out is None else out.union(one)
    return out


@query("""with s as (select 'customer' as name, count(*) filter (where c_mktsegment = 'BUILDING') as altered from customer union all select 'orders', count(*) filter (where o_totalprice < 0) from orders
 union all select 'documents', count(*) filter (where coalesce(lang, '') = 'en') from documents union all select 'supplier', count(*) filter (where s_acctbal < 0) from supplier)
select 'manifest' as name, sum(case when altered > 0 then 2 else 0 end)::bigint as violations from s""")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of fingerprints against the tables, of which some had other values at the same number of rows: a changed table counts on both sides."""
    stored, now = None, None
    before = {
        "customer": ("c_custkey", ("c_mktsegment", F.when(F.col("c_mktsegment") == "BUILDING", "HOUSES").otherwise(F.col("c_mktsegment")))),
        "orders": ("o_orderkey", ("o_totalprice", F.greatest("o_totalprice", F.lit(0.0)))),
        "documents": ("doc_id", ("lang", F.when(F.col("lang") == "en", F.lit(None)).otherwise(F.col("lang")))),
        "supplier": ("s_suppkey", ("s_acctbal", F.when(F.col("s_acctbal") < 0, -F.col("s_acctbal")).otherwise(F.col("s_acctbal")))),
    }
    for name, (key, (column, then)) in before.items():
        df = table(spark, sf_dir, name)
        a, b = quality.fingerprint(df.withColumn(column, then), name, key), quality.fingerprint(df.repartition(key), name, key)
        stored, now = (a, b) if stored is None else (stored.union(a), now.union(b))
    return quality.changed(stored, now, "manifest")


@query("""with a as (select c_custkey as id, row_number() over (order by c_acctbal desc, c_custkey) as p from customer), b as (select c_custkey as id, row_number() over (order by greatest(c_acctbal, 0) desc, c_custkey) as p from customer)
select 'order_of_balances' as name, count(*) as violations from a full join b using (id) where a.p is distinct from b.p""")
def order_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recomputed order against the one stated: customers by balance, and by balance without debts."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    now = c.withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0)))
    place = lambda df: ordered_index(df, F.desc("c_acctbal"), F.asc("id"))
    return quality.same_order(place(c), place(now), "id", "position", "order_of_balances")


@query("""select 'orders' as name, (count(*) filter (where o_totalprice > 100000 and not o_orderstatus = 'O') + count(*) filter (where o_orderpriority like '1%' and not o_totalprice > 100000)
 + cast(count(*) filter (where o_totalprice > 100000) >= count(*) filter (where o_orderstatus = 'O') as int) + cast(count(*) filter (where o_orderpriority like '1%') >= count(*) filter (where o_totalprice > 100000) as int))::bigint as violations from orders
 union all select 'sizes', cast(count(*) filter (where p_size > 50) >= count(*) filter (where p_size > 20) as bigint) + cast(count(*) filter (where p_size > 20) >= count(*) filter (where p_size > 0) as bigint) from part""")
def nesting_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that should lie strictly inside each other: three rules over orders that do not, three sizes of parts."""
    flags = lambda df, **rules: df.select(*[F.expr(r).cast("int").alias(n) for n, r in rules.items()])
    one = flags(table(spark, sf_dir, "orders"), a="o_orderstatus = 'O'", b="o_totalprice > 100000", c="o_orderpriority like '1%'")
    two = flags(table(spark, sf_dir, "part"), a="p_size > 0", b="p_size > 20", c="p_size > 50")
    return guards.strict_nesting(one, ["a", "b", "c"], "orders").union(guards.strict_nesting(two, ["a", "b", "c"], "sizes"))


@query("select c_custkey as id, c_name as name from customer where c_mktsegment <> 'BUILDING'")
def excluded_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking universe without a set of exclusions, all of which must lie in it."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment")
    return guards.exclude_set(c.select("id", "name"), c.filter("c_mktsegment = 'BUILDING'"), "id")


@query("""select p_partkey as id, cast(p_size > 10 as int) as a1, cast(p_size > 25 as int) as a2, cast(p_size > 45 as int) as a3, upper(replace(p_name, ' ', '')) as sequence from part""")
def guarded_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels computed apart, each row of which must lie inside the level before, and cleaned texts of their declared length."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *[(F.col("p_size") > n).cast("int").alias(f"a{i}") for i, n in enumerate((10, 25, 45), 1)], F.concat(F.lit(" "), F.lower("p_name")).alias("text"), F.length(F.translate("p_name", " ", "")).alias("declared"))
    sequence = guards.of_length(fx.clean_sequence("text"), F.col("declared"), "id")
    return guards.nested(p, ["a1", "a2", "a3"], "id").select("id", "a1", "a2", "a3", sequence.alias("sequence"))


@query("""with old as (select c_custkey as id, c_acctbal as v from customer where c_acctbal >= 0) select c_custkey as id, case when c_acctbal >= 0 then c_acctbal else round(c_acctbal * 2, 6) end as v from customer""")
def checked_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old values for old keys and new ones for the others; each customer exactly once, or the job fails."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return partition.keep_old_add_new(c.filter("v >= 0"), c.withColumn("v", F.round(F.col("v") * 2, 6)), "id", c)


@query("""with a as (select c_custkey as id, c_mktsegment as segment, c_acctbal as balance, c_nationkey as nation from customer where c_mktsegment <> 'MACHINERY'),
b as (select c_custkey as id, case when c_acctbal < 0 then null else c_mktsegment end as segment, round(c_acctbal / 2, 6) as balance, c_nationkey as nation from customer where c_nationkey <> 3),
j as (select a.id as x, b.id as y, a.segment is distinct from b.segment as s, a.balance is distinct from b.balance as v, a.nation is distinct from b.nation as n from a full join b on a.id = b.id)
select 'segment' as field, count(*) filter (where x is not null and y is not null and s) as changed from j union all select 'balance', count(*) filter (where x is not null and y is not null and v) from j
union all select 'nation', count(*) filter (where x is not null and y is not null and n) from j union all select 'RETAINED', count(*) filter (where x is not null and y is not null) from j
union all select 'DROPPED', count(*) filter (where y is null) from j union all select 'ADDED', count(*) filter (where x is null) from j""")
def release_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release against the one before: changed fields of retained keys, and keys that went or came."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    now = c.filter("nation <> 3").withColumn("segment", F.when(F.col("balance") >= 0, F.col("segment"))).withColumn("balance", F.round(F.col("balance") / 2, 6))
    return partition.release_changes(c.filter("segment <> 'MACHINERY'"), now, "id", ["segment", "balance", "nation"])


@query("select c_custkey as id, c_name as name, n_orders, top from customer join (select o_custkey, count(*) as n_orders, max(o_totalprice) as top from orders group by 1) a on c_custkey = o_custkey")
def checked_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join that must be one to one and complete."""
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("top"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return partition.join_one_to_one(c.join(a.select("id"), "id", "left_semi"), a, "id", ["n_orders", "top"]).select("id", "name", "n_orders", "top")
