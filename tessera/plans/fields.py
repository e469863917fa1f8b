"""Projections and text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import audit, explore, partition, rank, sensitivity
from tessera.plans.inputs import PAIRS_SQL, part_pairs
from tessera.plans.registry import query
from tessera.sources.tables import table


@query("select c_mktsegment as segment, c_custkey as id, c_name, c_nationkey, c_acctbal from customer")
def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns renamed, some put in front."""
    return audit.project(table(spark, sf_dir, "customer"), ["segment", "id"], {"c_custkey": "id", "c_mktsegment": "segment"})


@query("""select c_custkey as id, case when coalesce(c_acctbal > 0 and c_nationkey < 15, false) then 'A' else 'B' end as partition_class, cast(coalesce(c_acctbal > 0 and c_nationkey < 15, false) as int) as partition_flag,
 array_to_string(list_sort(list_distinct(list_filter([c_mktsegment, case when c_acctbal > 0 then 'credit' end, case when c_nationkey < 15 then 'near' else ' ' end], lambda x: x is not null and trim(x) <> ''))), ';') as partition_evidence, 'v2' as rule_version from customer""")
def partition_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each row with its evidence and the version of the rule."""
    c = table(spark, sf_dir, "customer")
    evidence = F.array("c_mktsegment", F.when(F.col("c_acctbal") > 0, "credit"), F.when(F.col("c_nationkey") < 15, "near").otherwise(" "))
    out = audit.partition_fields(c, (F.col("c_acctbal") > 0) & (F.col("c_nationkey") < 15), evidence, "v2")
    return out.select(F.col("c_custkey").alias("id"), "partition_class", "partition_flag", "partition_evidence", "rule_version")


@query("""with p as (select *, p_name || ' | ' || p_type || ';' || p_brand || ' ;; ' || p_name as cell, p_name || ', ' || p_type || ';' || p_name || '|' as genes,
 'GO:' || p_partkey || ' PF' || p_size || ' GO:' || p_size || ' GO:' || p_partkey as ids, string_split(p_name || ' ' || upper(p_name) || ' ' || p_type || ' ' || lower(p_type), ' ') as words from part)
select p_partkey as id, array_to_string([p_name, p_type, p_brand], '>') as cell_ids, array_to_string([p_name, p_type, p_name], '>') as genes,
 case when p_partkey = p_size then 'GO:' || p_partkey else 'GO:' || p_partkey || '>GO:' || p_size end as go_ids, 'PF' || p_size as pf_ids,
 array_to_string(list_filter(words, lambda x, i: list_position(list_transform(words, lambda y: lower(y)), lower(x)) = i), '>') as once from p""")
def identifier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a cell, genes with repeats, ids by prefix, and words distinct but for case."""
    p, said = table(spark, sf_dir, "part"), lambda xs: F.array_join(xs, ">")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    cell = F.concat("p_name", F.lit(" | "), "p_type", F.lit(";"), "p_brand", F.lit(" ;; "), "p_name")
    genes = F.concat("p_name", F.lit(", "), "p_type", F.lit(";"), "p_name", F.lit("|"))
    ids = F.concat(F.lit("GO:"), key, F.lit(" PF"), size, F.lit(" GO:"), size, F.lit(" GO:"), key)
    words = F.split(F.concat_ws(" ", "p_name", F.upper("p_name"), "p_type", F.lower("p_type")), " ")
    return p.select(F.col("p_partkey").alias("id"), said(fx.identifiers(cell)).alias("cell_ids"), said(fx.split_genes(genes)).alias("genes"), said(fx.extract_ids(ids, r"GO:\d+")).alias("go_ids"), said(fx.extract_ids(ids, r"PF\d+")).alias("pf_ids"), said(fx.distinct_ignoring_case(words)).alias("once"))


@query("""select p_partkey as id, p_name as name, p_type || ';' || p_brand as synonyms, 'P' || p_partkey || '-1;P' || p_partkey || '-2' as isoforms, p_size > 25 as displayed from part
union all select p_partkey, p_type, '', 'P' || p_partkey || '-3', false from part""")
def alternative_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of alternative products parsed from one cell."""
    key = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    cell = F.concat(
        F.lit("Name="), "p_name", F.lit(" {x}; Synonyms="), "p_type", F.lit(", "), "p_brand", F.lit("; IsoId="), key, F.lit("-1, "), key, F.lit("-2; Sequence="),
        F.when(F.col("p_size") > 25, "Displayed").otherwise("VSP_1"), F.lit("; Name="), "p_type", F.lit("; IsoId="), key, F.lit("-3; Sequence=External;"),
    )
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(fx.parse_products(cell)).alias("p"))
    return r.select("id", "p.name", F.array_join("p.synonyms", ";").alias("synonyms"), F.array_join("p.isoform_ids", ";").alias("isoforms"), "p.displayed")


@query("""select doc_id, 1 as place, coalesce(lang, 'none') as section, coalesce(lang, 'none') as formal from documents union all select doc_id, 2, source || '. Note=' || n_chars, source || '.' from documents""")
def comment_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of a comment cell, and what stands before their notes."""
    head = "SUBCELLULAR LOCATION: "
    cell = F.concat(F.lit(head), F.coalesce("lang", F.lit("none")), F.lit("; " + head), "source", F.lit(". Note="), F.col("n_chars").cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fx.location_sections(cell)).alias("at", "section"))
    return d.select("doc_id", (F.col("at") + 1).alias("place"), "section", fx.formal_part("section").alias("formal"))


@query("""with t as (select p_partkey as id, p_size, lower(p_name) as a, lower(p_type) as b from part)
select id, case when a = b then a else a || ';' || b end as terms,
 case when p_size % 2 = 0 and p_size % 3 = 0 then 'PF+IPR' when p_size % 2 = 0 then 'PF' when p_size % 3 = 0 then 'IPR' else 'NONE' end as basis,
 case when p_size % 2 = 0 and p_size % 3 = 0 then 'PF1;PF' || p_size || '|IPR' || p_size when p_size % 2 = 0 then 'PF1;PF' || p_size when p_size % 3 = 0 then 'IPR' || p_size else '' end as signature from t""")
def terms_and_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation terms of a cell, and the coarse signature of two families of ids."""
    size, none = F.col("p_size").cast("string"), F.array().cast("array<string>")
    terms = fx.annotation_terms(F.concat(F.upper("p_name"), F.lit(" [GO:"), F.col("p_partkey").cast("string"), F.lit("];  "), "p_type", F.lit(" [GO:7]; "), "p_name"))
    first = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("PF"), size), F.lit("PF1"))).otherwise(none)
    second = F.when(F.col("p_size") % 3 == 0, F.array(F.concat(F.lit("IPR"), size))).otherwise(none)
    p = table(spark, sf_dir, "part").withColumn("s", fx.coarse_signature(first, second, ("PF", "IPR")))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(terms, ";").alias("terms"), "s.basis", "s.signature")


@query("""select p_partkey as id, p_name || '/ ' || p_brand as cell, case when p_size > 45 then 0 else greatest(0, 1 - p_size / 30.0) end as near,
 case when p_size > 40 then 'stimulates' when p_size > 30 then 'inhibits' when p_size > 20 then 'directs' else 'linked' end as label, 'P' || p_partkey as bare, 'P' || p_partkey as canonical,
 case when p_size > 25 then p_size / 50.0 end as number, case when p_size > 25 then printf('%.1f%%', p_size / 50.0 * 100) else 'NA' end as percent, p_type || '>' || p_brand as terms from part""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells made safe for lists, proximity, edge labels, ids without version or isoform, and how numbers and terms are shown."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    key = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    cell = F.when(size > 25, (size / F.lit(50.0)).cast("string")).otherwise(F.lit(" "))
    return p.select(
        F.col("p_partkey").alias("id"), fx.cell_text(F.concat(F.lit("\t"), "p_name", F.lit("|\n"), "p_brand", F.lit(" "))).alias("cell"),
        fx.proximity(F.when(size <= 45, size), 30).alias("near"), fx.edge_label(size > 40, size > 30, size > 20).alias("label"),
        fx.strip_version(F.concat(key, F.lit(".2"))).alias("bare"), fx.strip_isoform(F.concat(key, F.lit("-"), size.cast("string"))).alias("canonical"),
        fx.number_or_null(cell).alias("number"), fx.percent_text(cell).alias("percent"), F.array_join(fx.distinct_terms(F.concat("p_type", F.lit(" | "), "p_brand", F.lit("||"), "p_type")), ">").alias("terms"),
    )


@query("""select p_brand as brand, case when count(*) filter (where p_size > 47) = 0 then 'NA' else printf('%.8f', count(*) filter (where p_size > 47 and p_retailprice > 1000) / cast(count(*) filter (where p_size > 47) as double)) end as share from part group by 1""")
def fraction_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares as text with fixed digits, NA where there is nothing to take a share of."""
    by = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count_if(F.expr("p_size > 47 and p_retailprice > 1000")).alias("part"), F.count_if(F.col("p_size") > 47).alias("whole"))
    return by.select("brand", sensitivity.fraction_text(F.col("part"), F.col("whole")).alias("share"))


@query("""select doc_id, case when length(coalesce(text, '')) > 4000 then 'ends' else 'whole' end as route, cast(least(length(coalesce(text, '')), 4000) as bigint) as n,
 sha256(case when length(coalesce(text, '')) > 4000 then left(text, 2000) || right(text, 2000) else coalesce(text, '') end) as sent_sha256 from documents""")
def length_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flag of texts beyond a model's limit carried beside what of them is sent: the whole, or both ends."""
    d = table(spark, sf_dir, "documents").withColumn("sent", fx.limited_ends("text", 4000))
    return d.select("doc_id", F.when(fx.over_limit("text", 4000), "ends").otherwise("whole").alias("route"), F.length("sent").cast("long").alias("n"), F.sha2(F.col("sent").cast("binary"), 256).alias("sent_sha256"))


@query(f"""with {PAIRS_SQL}, e as (select least(p1, p2) as a, greatest(p1, p2) as b, count(*) as n from pairs where qty >= 48 group by 1, 2),
l as (select a as id, b as partner, n from e union all select b, a, n from e), x as (select l.*, p_name || ' ' || p_size as label, p_name, p_size from l join part on partner = p_partkey)
select id, partner, label, row_number() over (partition by id order by p_name, p_size, partner) as place from x""")
def partners_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's partners by their labels, in which numbers count as numbers, then by id."""
    e = explore.pair_graph_edges(part_pairs(spark, sf_dir, 48).withColumn("label", F.col("qty").cast("long")), "p1", "p2", "label")
    two = e.select(F.col("left_id").alias("id"), F.col("right_id").alias("partner")).union(e.select("right_id", "left_id"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partner"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("label"))
    return rank.numbered(two.join(names, "partner"), ["id"], [rank.natural_key(F.col("label")), F.col("partner")], "place").select("id", "partner", "label", "place")


@query("""select o_orderkey as id from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F' and o_totalprice > 200000 and contains(lower(o_orderpriority || ' ' || c_name), 'high')
union all select o_orderkey from orders where o_orderstatus = 'O' and o_orderpriority like '5%' and o_totalprice <= 200000""")
def extension_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended candidates by route, kind of support and a search text."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    dear = F.col("o_totalprice") > 200000
    r = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("route"), "o_orderpriority", "c_name", F.when(dear, "e1").alias("shared_event_ids"), F.lit("").alias("shared_first_ids"), F.when(dear, "event").otherwise("weighted").alias("reason"))
    one = explore.extension_filter(r, "F", "event", "HIGH", ["o_orderpriority", "c_name"])
    two = explore.extension_filter(r, "O", "weighted", "5-", ["o_orderpriority"])
    return one.select("id").union(two.select("id"))


@query("""with r as (select 'R1' as route, o_custkey as id, o_orderpriority as label from orders where o_totalprice > 300000 union all select 'R2', c_custkey, c_mktsegment from customer where c_acctbal < -500 union all select 'R3', o_custkey, o_orderpriority from orders where o_orderstatus = 'P')
select id, string_agg(distinct route, ';' order by route) as routes, count(*) as n_rows, count(distinct label) as n_labels from r group by 1""")
def route_integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of route outputs with provenance and distinct counts."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    pick = lambda df, key, label: df.select(F.col(key).alias("id"), F.col(label).alias("label"))
    routes = {"R1": pick(o.filter("o_totalprice > 300000"), "o_custkey", "o_orderpriority"), "R2": pick(c.filter("c_acctbal < -500"), "c_custkey", "c_mktsegment"), "R3": pick(o.filter("o_orderstatus = 'P'"), "o_custkey", "o_orderpriority")}
    return partition.integrate_routes(routes, "id", "label")


@query("""with e as (select user_id, event_type, 'k' || cast(json_extract_string(props, '$.k') as bigint) as item, value >= 5 as ok from events), u as (select distinct user_id from e)
select user_id, coalesce(string_agg(distinct item, ';' order by item) filter (where ok and event_type = 'purchase'), '') as purchase_items, coalesce(string_agg(distinct item, ';' order by item) filter (where ok and event_type = 'click'), '') as click_items,
 count(distinct item) filter (where ok and event_type = 'purchase') as n_purchase, count(distinct item) filter (where ok and event_type = 'click') as n_click from e group by 1""")
def evidence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's included ids by aspect."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.concat(F.lit("k"), F.from_json("props", "k bigint")["k"].cast("string")).alias("item"))
    return audit.evidence_sets(e, "user_id", "item", "event_type", F.col("value") >= 5, ["purchase", "click"])


@query("""with c as (select case when c_nationkey < 9 then 'A' when c_nationkey < 18 then 'B' else 'C' end as route, c_custkey as k, c_mktsegment || '; ' || n_name || ',' || case when c_acctbal > 0 then 'Plus' else '' end as genes from customer join nation on c_nationkey = n_nationkey),
p as (select case when l_returnflag = 'R' then 'A' when l_returnflag = 'A' then 'B' else 'C' end as route, least(cast(l_partkey as varchar), cast(l_suppkey as varchar)) as a, greatest(cast(l_partkey as varchar), cast(l_suppkey as varchar)) as b from lineitem where l_quantity >= 40),
cc as (select route, k, genes from c union all select 'ALL', k, genes from c), pp as (select route, a, b from p union all select 'ALL', a, b from p),
t as (select route, trim(unnest(string_split_regex(genes, '[;,]'))) as t from cc)
select route, n_rows, n_genes, n_keys, n_pairs, n_unordered from (select route, count(*) as n_rows, count(distinct k) as n_keys from cc group by 1) join (select route, count(distinct t) as n_genes from t where t <> '' group by 1) using (route)
 join (select route, count(*) as n_pairs, count(distinct (a, b)) as n_unordered from pp group by 1) using (route)""")
def release_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three routes and all together: rows, distinct gene tokens, keys, pair rows, and pairs whichever way round."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("c_nationkey", F.col("c_custkey").alias("k"), F.concat("c_mktsegment", F.lit("; "), "n_name", F.lit(","), F.when(F.col("c_acctbal") > 0, "Plus").otherwise("")).alias("genes"))
    p = table(spark, sf_dir, "lineitem").filter("l_quantity >= 40").select("l_returnflag", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    routes = {"A": (c.filter("c_nationkey < 9"), p.filter("l_returnflag = 'R'")), "B": (c.filter("c_nationkey between 9 and 17"), p.filter("l_returnflag = 'A'")), "C": (c.filter("c_nationkey > 17"), p.filter("l_returnflag = 'N'"))}
    return partition.release_totals(routes, "k", "genes", ("a", "b"))


@query("""with t as (select p_brand as brand, p_partkey, unnest(string_split(upper(p_name || ' ' || p_type), ' ')) as t from part)
select brand, count(distinct p_partkey) as n_rows, count(distinct t) as n_tokens from t group by 1 union all select 'ALL', (select count(*) from part), count(distinct t) from t""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of multi-valued cells by brand, and of the whole table."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.translate(F.concat_ws(" ", "p_name", "p_type"), " ", ";").alias("cell"))
    return partition.distinct_tokens(p, ["brand"], "cell").union(partition.distinct_tokens(p, [], "cell").select(F.lit("ALL"), "n_rows", "n_tokens"))
