"""Explorer queries, text functions over the tables, and reader-writer round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import explore, postings, rank, spatial
from tessera.plans.inputs import PAIRS_SQL, part_pairs
from tessera.plans.registry import query
from tessera.sources.tables import shared_dir, table


@query("""with m as (select p_partkey, p_name, p_brand from part where contains(lower(p_partkey || ' ' || p_name || ' ' || p_type), 'bolt') and p_brand = 'Brand#13')
select p_partkey, p_name, (select count(*) from m) as total from m order by p_name, p_partkey limit 25""")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A facet search with its first 25 rows and the total."""
    m = explore.search(table(spark, sf_dir, "part"), "BOLT", ["p_partkey", "p_name", "p_type"], {"p_brand": "Brand#13"})
    return explore.top_with_total(m.select("p_partkey", "p_name"), [F.asc("p_name"), F.asc("p_partkey")], 25)


@query("select c_custkey, c_name from customer order by c_acctbal desc, c_custkey limit 20 offset 40")
def third_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 20 of a stable order."""
    return rank.page(table(spark, sf_dir, "customer"), [F.desc("c_acctbal"), F.asc("c_custkey")], 3, 20).select("c_custkey", "c_name")


@query("""select lang, count(*) as total, count_if(n_chars > 2000)::bigint as long_texts, count_if(source = 'src0')::bigint as first_source, count_if(contains(text, '@'))::bigint as with_at, round(count_if(n_chars > 2000) / cast(count(*) as double), 9) as share_long from documents group by 1""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many conditional counts in one pass."""
    f = explore.facet_counts(table(spark, sf_dir, "documents"), {"long_texts": F.col("n_chars") > 2000, "first_source": F.col("source") == "src0", "with_at": F.col("text").contains("@")}, "lang")
    return f.withColumn("share_long", F.round(F.col("long_texts") / F.col("total"), 9))


@query(f"""with {PAIRS_SQL}, l as (select p1, p2, case when qty >= 45 then 'RF2;HI' else 'HI' end as evidence, case when qty % 2 = 0 then qty end as score from pairs)
select p1, p2, evidence, score from l where contains(evidence, 'RF2') and score >= 46""")
def pair_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by evidence text and by a score that may be missing."""
    rows = part_pairs(spark, sf_dir).select("p1", "p2", F.when(F.col("qty") >= 45, "RF2;HI").otherwise("HI").alias("evidence"), F.when(F.col("qty") % 2 == 0, F.col("qty")).alias("score"))
    return explore.pair_filter(rows, "evidence", "RF2", "score", 46)


GRAPH_SQL = f"""{PAIRS_SQL}, strong as (select * from pairs where qty >= 48),
pe as (select least(p1, p2) as left_id, greatest(p1, p2) as right_id, count(*) as n_rows, string_agg(distinct cast(cast(qty as bigint) as varchar), ';' order by cast(cast(qty as bigint) as varchar)) as labels from strong group by 1, 2),
kn as (select id, max(c) as c, max(a) as a from (select p1 as id, 1 as c, 0 as a from strong union all select p2, 0, 1 from strong) t group by 1),
dg as (select id, count(*) as degree from (select left_id as id from pe union all select right_id from pe) t group by 1),
nd as (select id, case when c = 1 and a = 1 then 'both' when c = 1 then 'candidate' else 'anchor' end as kind, degree from kn join dg using (id))"""


def strong_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_pairs(spark, sf_dir, 48).withColumn("label", F.col("qty").cast("long"))


@query(f"with {GRAPH_SQL} select left_id, right_id, n_rows, labels from pe")
def pair_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the pair graph with their rows and merged labels."""
    return explore.pair_graph_edges(strong_pairs(spark, sf_dir), "p1", "p2", "label")


@query(f"with {GRAPH_SQL} select id, kind, degree from nd")
def pair_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the pair graph: kind and degree over distinct pairs."""
    return explore.pair_graph_nodes(strong_pairs(spark, sf_dir), "p1", "p2")


@query(f"with {GRAPH_SQL} select id, kind, degree from nd where kind <> 'anchor' order by degree desc, id limit 1")
def default_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node to show first."""
    return explore.default_focus(pair_graph_nodes(spark, sf_dir))


@query(f"""with {GRAPH_SQL}, f as (select id from nd where kind <> 'anchor' order by degree desc, id limit 1),
e2 as (select left_id as id, right_id as partner, n_rows, labels from pe union all select right_id, left_id, n_rows, labels from pe)
select id, partner, n_rows, labels from e2 where id in (select id from f)""")
def partner_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the focus with their edges."""
    return explore.partners(pair_graph(spark, sf_dir), default_focus(spark, sf_dir))


@query(f"""with {PAIRS_SQL}, s as (select *, least(p1, p2) as left_id, greatest(p1, p2) as right_id from pairs where qty >= 48)
select left_id, right_id, min_by(p1, pos) as first_a, min_by(p2, pos) as first_b, count(*) as n_rows, string_agg(distinct cast(cast(qty as bigint) as varchar), ';' order by cast(cast(qty as bigint) as varchar)) as aliases from s group by 1, 2""")
def unique_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each unordered pair."""
    return explore.unique_pairs(strong_pairs(spark, sf_dir), "p1", "p2", "pos", "label")


@query("""with s as (select *, max(o_totalprice) over (partition by o_custkey) as top, row_number() over (partition by o_custkey order by o_orderkey) as nth from orders)
select o_custkey as parent, o_orderkey as id, round(o_totalprice / top, 9) as share, nth from s where nth <= 12""")
def sibling_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve children of each parent beside the largest."""
    s = explore.sibling_comparison(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice")
    return s.select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("id"), F.round("share", 9).alias("share"), F.col("nth").cast("long").alias("nth"))


@query("""select cast(floor(embedding[1] / 0.1) as bigint) as cell_x, cast(floor(embedding[2] / 0.1) as bigint) as cell_y, count(*) as total, count_if(label = 0)::bigint as zero, count_if(label <> 0)::bigint as other, max(count(*)) over () as peak from embeddings group by 1, 2""")
def density_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by cell of the first two dimensions, with the largest."""
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")
    return explore.with_peak(explore.density_bins(e, "x", "y", 0.1, {"zero": F.col("label") == 0, "other": F.col("label") != 0}))


@query("""select vec_id from embeddings where embedding[1] between -0.1 and 0.1 and embedding[2] between 0 and 0.2""")
def region_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside a box."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return explore.in_box(e, "x", "y", (-0.1, 0.0, 0.1, 0.2)).select("vec_id")


@query("""with e as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, 'kind' || label as kind, 'node ' || vec_id || '/' || label as name from embeddings),
b as (select * from e where x between -0.1 and 0.15 and y between -0.05 and 0.2 and kind in ('kind1', 'kind2', 'kind3', 'kind5')), f as (select * from b where contains(lower(name), 'e 1'))
select vec_id, kind, name, (select count(*) from b) as available, (select count(*) from f) as total from f order by y desc, vec_id limit 5 offset 5""")
def region_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of what a search finds among some kinds of points inside a box, with totals; the points are stored along a curve."""
    path = f"{shared_dir(spark)}/points-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.concat(F.lit("kind"), F.col("label")).alias("kind"), F.concat(F.lit("node "), F.col("vec_id"), F.lit("/"), F.col("label")).alias("name"))
    spatial.write_points(e, path)
    inside = spatial.in_stored_box(spark, path, (-0.1, -0.05, 0.15, 0.2))
    page = spatial.region_page(inside, [F.desc("y"), F.asc("vec_id")], "kind", ["kind1", "kind2", "kind3", "kind5"], "E 1", ["name"], 2, 5)
    return page.select("vec_id", "kind", "name", "available", "total")


@query("""with h as (select doc_id, lang, lower(concat_ws(' ', cast(doc_id as varchar), source, text)) as h from documents), a as (select 'rc1' as q union all select 'the ' union all select 'Ion' union all select '12' union all select 'zq~x')
select q, doc_id from a, h where contains(h, lower(q)) and coalesce(lang, '') = 'en'""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five searches over whole texts by trigram postings: rare, frequent, in other case, too short for a gram, and without a hit."""
    path, d = f"{shared_dir(spark)}/grams-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    columns, out = ["doc_id", "source", "text"], None
    postings.write_index(d, "doc_id", columns, path)
    for q in ("rc1", "the ", "Ion", "12", "zq~x"):
        one = postings.indexed_search(d, "doc_id", columns, path, q, {"lang": "en"}).select(F.lit(q).alias("q"), "doc_id")
        out = one if out is None else out.union(one)
    return out


@query("""with p as (select a.doc_id as a, b.doc_id as b, string_split(a.text, '') as s, string_split(b.text, '') as t from documents a join documents b on b.doc_id = a.doc_id + 1),
n as (select *, case when a.text is null or b.text is null then null else least(len(p.s), len(p.t)) end as n from p join documents a on p.a = a.doc_id join documents b on p.b = b.doc_id),
h as (select *, coalesce(list_position(list_transform(list_zip(s[:n], t[:n]), lambda x: x[1] = x[2]), false) - 1, n) as prefix from n),
x as (select *, coalesce(list_position(list_transform(list_zip(list_reverse(s[prefix + 1:]), list_reverse(t[prefix + 1:]), true), lambda x: x[1] = x[2]), false) - 1, n - prefix) as suffix from h)
select a, b, cast(prefix as bigint) as prefix, cast(suffix as bigint) as suffix, cast(len(s) - prefix - suffix as bigint) as left_length, cast(len(t) - prefix - suffix as bigint) as right_length,
 sha256(array_to_string(s[prefix + 1:len(s) - suffix], '')) as left_sha256, sha256(array_to_string(t[prefix + 1:len(t) - suffix], '')) as right_sha256 from x""")
def seq_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents: their common head and tail, and the length and hash of all that differs between."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("t"), F.col("doc_id").alias("b"))
    pairs = d.join(nxt, "doc_id").withColumn("x", explore.text_difference(F.col("text"), F.col("t")))
    prefix, suffix = (F.col(f"x.{c}").cast("long").alias(c) for c in ("prefix", "suffix"))
    middle = lambda c: F.substring(c, F.col("x.prefix") + 1, F.length(c) - F.col("x.suffix") - F.col("x.prefix"))
    sides = [f(c).alias(f"{n}_{k}") for n, c in (("left", "text"), ("right", "t")) for k, f in (("length", lambda c: F.length(middle(c)).cast("long")), ("sha256", lambda c: F.sha2(middle(c).cast("binary"), 256)))]
    return pairs.select(F.col("doc_id").alias("a"), "b", prefix, suffix, *sides)


@query("""with e as (select event_id, event_type, props::json as j from events)
select event_id, event_type, cast(json_extract_string(j, '$.k') as bigint) as k from e""")
def json_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a JSON column by an explicit schema."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("j"))
    return e.select("event_id", "event_type", "j.k")


@query("""with h as (select page_id, list_distinct(regexp_extract_all(html, 'href="/([a-z]+)"', 1)) as ids from pages)
select page_id, len(ids) as n, coalesce(array_to_string(list_sort(ids), ';'), '') as ids from h""")
def regex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct identifiers that a pattern finds in each page."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([a-z]+)"'), 1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.array_join(F.array_sort(found), ";").alias("ids"))


@query("""select p_partkey as id, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name || ' ' || p_type, ' '), lambda x: upper(trim(x))))), ';') as tokens,
 upper(regexp_replace(p_name, '\\s', '', 'g')) as clean, lower(trim(regexp_replace(regexp_replace(p_name || '  {x}', '\\{[^}]*\\}', '', 'g'), '\\s+', ' ', 'g'))) as label,
 case when length(p_name) > 10 then left(p_name, 5) || right(p_name, 5) else p_name end as ends,
 concat_ws(' | ', case when p_size > 25 then 'large' end, case when p_retailprice > 1000 then 'dear' end) as path from part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token, label, sequence and description functions over part names."""
    p = table(spark, sf_dir, "part")
    cell = F.translate(F.concat_ws(" ", "p_name", "p_type"), " ", ";")
    return p.select(
        F.col("p_partkey").alias("id"), fx.joined(fx.atomic_tokens(cell)).alias("tokens"), fx.clean_sequence("p_name").alias("clean"),
        fx.normalized_label(F.concat("p_name", F.lit("  {x}"))).alias("label"), fx.limited_ends("p_name", 10).alias("ends"),
        fx.describe_paths(F.when(F.col("p_size") > 25, "large"), F.when(F.col("p_retailprice") > 1000, "dear"), default="").alias("path"),
    )
