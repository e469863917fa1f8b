"""Blocked pair search, alignment, intervals, set similarity, grids over edges, windows and pair scoring."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import similarity as fs
from tessera.functions import text as fx
from tessera.operators import features, scoring, sensitivity, similarity
from tessera.operators.rank import ordered_index
from tessera.plans.registry import query
from tessera.sources.tables import remove, shared_dir, staged, table

#: parts blocked by brand and type, compared by the 4-mers of their name
KMER_SQL = """d as (select p_partkey as id, p_brand || '|' || p_type as signature, length(p_name) as n, p_name as t from part),
k as (select id, signature, n, list_distinct(list_filter(list_transform(range(1, greatest(n - 2, 1)), lambda i: substring(t, i, 4)), lambda m: length(m) = 4 and len(list_distinct(string_split(m, ''))) >= 3)) as ks from d),
edges as (select a.id as left_id, b.id as right_id, a.signature, a.n as left_length, b.n as right_length,
  case when len(a.ks) = 0 or len(b.ks) = 0 then 0 else len(list_intersect(a.ks, b.ks)) / cast(least(len(a.ks), len(b.ks)) as double) end as containment
  from k a join k b on a.signature = b.signature and a.id < b.id where least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)),
kp as (select left_id, right_id, signature, round(containment, 6) as containment, cast(left_length as bigint) as left_length, cast(right_length as bigint) as right_length from edges where containment >= 0.08)"""


def kmer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_brand", "p_type").alias("signature"), F.length("p_name").cast("long").alias("n"), fs.kmer_set("p_name").alias("ks"), F.upper("p_name").alias("name"))


def kmer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.candidate_pairs(kmer_parts(spark, sf_dir), "id", "signature", "n", "ks")
    return pairs.select("left_id", "right_id", "signature", F.round("containment", 6).alias("containment"), "left_length", "right_length")


def kmer_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same edges between classes of parts, with their numbers, and the parts of each class."""
    pairs, members = similarity.candidate_classes(kmer_parts(spark, sf_dir), "id", "signature", "n", "ks")
    edges = similarity.class_edges(pairs.withColumn("containment", F.round("containment", 6)), members)
    return edges, members


@query(f"with {KMER_SQL} select * from kp")
def kmer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one signature, near in length, with shared k-mers."""
    return kmer_edges(spark, sf_dir)


@query(f"""with {KMER_SQL}, ax as (select cast(unnest([0.1, 0.3, 0.5, 0.9]) as double) as least), bx as (select cast(unnest([0.8, 0.9, 1.0]) as double) as ratio),
g as (select least, ratio from ax, bx), m as (select *, round(least(left_length, right_length) / cast(greatest(left_length, right_length) as double), 6) as lr from kp),
h as (select g.least, g.ratio, left_id, right_id from g join m on containment >= g.least and lr >= g.ratio)
select g.least, g.ratio, count(left_id) as n_edges, (select count(distinct id) from (select unnest([left_id, right_id]) as id from h where h.least = g.least and h.ratio = g.ratio) t) as n_ids
from g left join h using (least, ratio) group by 1, 2""")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passing edges and recovered ids in each cell of a threshold grid, empty cells kept."""
    e, members = kmer_classes(spark, sf_dir)
    e = e.withColumn("lr", F.round(fs.length_ratio("length_a", "length_b"), 6))
    cells = sensitivity.grid(spark, least=[0.1, 0.3, 0.5, 0.9], ratio=[0.8, 0.9, 1.0])
    return sensitivity.threshold_grid(e, cells, {"least": "containment", "ratio": "lr"}, members=members)


@query(f"""with {KMER_SQL}, p as (select 'strict' as profile, left_id, right_id from kp where containment >= 0.5 and left_length = right_length
 union all select 'containment', left_id, right_id from kp where containment >= 0.5 union all select 'length', left_id, right_id from kp where left_length = right_length union all select 'none', left_id, right_id from kp where containment > 2),
n as (select unnest(['strict', 'containment', 'length', 'none']) as profile)
select n.profile, count(left_id) as n_edges, (select count(distinct id) from (select unnest([left_id, right_id]) as id from p q where q.profile = n.profile) t) as n_ids from n left join p using (profile) group by 1""")
def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each set of rules lets through."""
    near, same = F.col("containment") >= 0.5, F.col("length_a") == F.col("length_b")
    edges, members = kmer_classes(spark, sf_dir)
    return sensitivity.rule_ablation(edges, {"strict": near & same, "containment": near, "length": same, "none": F.col("containment") > 2}, members=members)


@query(f"""with {KMER_SQL}, b as (select id, max(containment) as best from (select left_id as id, containment from kp union all select right_id, containment from kp) t group by 1),
c as (select case when best >= 0.95 then 0.95 when best >= 0.6 then 0.6 when best >= 0.3 then 0.3 when best >= 0.08 then 0.08 end as bin, count(*) as n from b group by 1)
select cast(x.bin as double) as bin, coalesce(n, 0) as n from (select unnest([0.08, 0.3, 0.6, 0.95]) as bin) x left join c on c.bin = x.bin""")
def identity_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the best score at each id, zero bins kept."""
    ends = similarity.class_ends(*kmer_classes(spark, sf_dir), "containment")
    return sensitivity.fixed_bins(ends.groupBy("id").agg(F.max("containment").alias("best")), "best", [0.08, 0.3, 0.6, 0.95])


@query(f"""with {KMER_SQL}, base as (select distinct left_id as id from kp where containment >= 0.5),
t as (select distinct substring(signature, 1, 8) as cell, left_id as id from kp), n as (select count(*) as n from base),
s as (select cell, count(*) as own, sum(cast(id in (select id from base) as int)) as both_ from t group by 1)
select cell, round(both_ / cast(own + n - both_ as double), 9) as jaccard from s, n""")
def set_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of each brand's candidate set with a baseline set."""
    edges, members = kmer_classes(spark, sf_dir)
    lower = staged(similarity.class_ends(edges.select("*", F.substring("signature", 1, 8).alias("cell"), (F.col("containment") >= 0.5).alias("near")), members, "cell", "near").filter("id < hi"), "lower")
    found = sensitivity.set_jaccard_to(lower.filter("near").select("id"), lower.select("cell", "id"), "cell", "id")
    return found.withColumn("jaccard", F.round("jaccard", 9))


def _aligned_sql() -> str:
    """The alignment of every two different names by the recurrence, a cell of all tables a step.

    A way that ends in a cell is one number, score * 10^9 + matches * 10^6 - columns * 10^3 + residues, and the
    residues of the left name; of equal ways the first stays, and of equal best cells the first by rows.
    """
    first, last = 32, 90
    scores = [int(x) for row in similarity.substitution()[first : last + 1, first : last + 1] for x in row]
    ways = lambda cell, gaps: "list_max(list_filter([" + ", ".join(f"{{'v': {cell}.{k}.v + {g}, 'o': {o}, 'u': {cell}.{k}.u}}" for (k, o), g in zip((("m", 3), ("p", 2), ("q", 1)), gaps, strict=True)) + "], lambda z: z.v is not null))"
    gap = lambda g: g * 10**9 - 999
    opened, on = gap(similarity.GAP_OPEN), gap(similarity.GAP_EXTEND)
    live = lambda w, v, u, dead: f"case when ({w}.{v}) + 1000000 >= 1000000000 then {{'v': ({w}.{v})::bigint, 'u': ({w}.{u})::bigint}} else {dead} end"
    zero, none = "{'v': 0::bigint, 'u': 0::bigint}", "{'v': null::bigint, 'u': null::bigint}"
    start = f"{{'m': {zero}, 'p': {none}, 'q': {none}}}"
    return f"""names as (select distinct upper(x.p_name) as a, upper(y.p_name) as b from kp join part x on left_id = x.p_partkey join part y on right_id = y.p_partkey where containment >= 0.5),
blosum as (select {scores} as s),
cells as (
  select a, b, 0 as k, list_transform(range(length(b) + 1), lambda i: {start}) as up, [{start}] as cur, {{'v': 0::bigint, 'u': 0::bigint}} as best from names
  union all
  select a, b, k + 1, case when j = length(b) then list_append(cur, {{'m': m, 'p': p, 'q': q}}) else up end, case when j = length(b) then [{start}] else list_append(cur, {{'m': m, 'p': p, 'q': q}}) end,
    case when m.v > best.v and m.v >= coalesce(p.v, 0) and m.v >= coalesce(q.v, 0) then m when p.v > best.v and p.v >= coalesce(q.v, 0) then p when q.v > best.v then q else best end
  from (select *, {live("wm", "v + step", "u + 1", zero)} as m, {live("wp", "v", "u", none)} as p, {live("wq", "v", "u + 1", none)} as q
    from (select *, {ways("up[j]", (0, 0, 0))} as wm, {ways("cur[j]", (opened, on, opened))} as wp, {ways("up[j + 1]", (opened, opened, on))} as wq,
      s[(ascii(substring(a, i, 1)) - {first}) * {last - first + 1} + ascii(substring(b, j, 1)) - {first} + 1]::bigint * 1000000000 + case when substring(a, i, 1) = substring(b, j, 1) then 1000000 else 0 end - 998 as step
      from (select *, (k // length(b) + 1)::int as i, (k % length(b) + 1)::int as j from cells, blosum where k < length(a) * length(b)) z) z) z),
ended as (select a, b, best.u as used_a, (best.v + 1000000) // 1000000000 as score, best.v - (best.v + 1000000) // 1000000000 * 1000000000 as rest from cells where k = length(a) * length(b)),
counted as (select a, b, used_a, score, (rest + 999999) // 1000000 as matches, rest - (rest + 999999) // 1000000 * 1000000 as rest from ended),
aligned as (select a, b, score, matches, (999 - rest) // 1000 as columns, used_a, rest + (999 - rest) // 1000 * 1000 - used_a as used_b from counted),
pairs_aligned as (select left_id, right_id, score, matches, columns, case when columns > 0 then matches / columns::double else 0 end as identity, used_a / length(a)::double as left_coverage, used_b / length(b)::double as right_coverage
  from kp join part x on left_id = x.p_partkey join part y on right_id = y.p_partkey join aligned on a = upper(x.p_name) and b = upper(y.p_name) where containment >= 0.5)"""


ALIGNED_SQL = f"recursive {KMER_SQL}, {_aligned_sql()}"
EDGES_SQL = f"""{ALIGNED_SQL}, big as (select l_partkey as id, l_suppkey as supplier, s_nationkey as nation, month(l_shipdate) as month from lineitem join supplier on l_suppkey = s_suppkey where l_quantity >= 30),
sets as (select id, list(distinct supplier) as su, list(distinct nation) as na, list(distinct month) as mo from big group by 1),
x as (select p.*, coalesce(len(list_intersect(l.su, r.su)), 0) as e, coalesce(len(list_intersect(l.na, r.na)), 0) as f, coalesce(len(list_intersect(l.mo, r.mo)), 0) as g, coalesce(len(l.su), 0) + coalesce(len(r.su), 0) as ee, coalesce(len(l.na), 0) + coalesce(len(r.na), 0) as ff, coalesce(len(l.mo), 0) + coalesce(len(r.mo), 0) as gg,
  greatest(0, least(a.p_size, b.p_size) + 31 - greatest(a.p_size, b.p_size)) / (greatest(a.p_size, b.p_size) + 31 - least(a.p_size, b.p_size))::double as min_iou
  from pairs_aligned p join part a on left_id = a.p_partkey join part b on right_id = b.p_partkey left join sets l on l.id = left_id left join sets r on r.id = right_id),
y as (select *, case when min_iou < 0.5 then 'low_overlap' else 'pass' end as architecture, e + f + g as shared_all, case when ee + ff + gg - e - f - g > 0 then (e + f + g) / (ee + ff + gg - e - f - g)::double else 0 end as weighted from x),
z as (select *, case when ee > e and e / (ee - e)::double >= 0.5 and e >= 1 then 'event' when ff > f and f / (ff - f)::double >= 0.5 and f >= 2 then 'first_set' when weighted >= 0.25 and shared_all >= 3 then 'weighted' else 'none' end as function from y),
ed as (select *, identity >= 0.7 and left_coverage >= 0.8 and right_coverage >= 0.8 and architecture = 'pass' and function <> 'none' as edge from z)"""


@query(f"with {ALIGNED_SQL} select left_id, right_id, score, matches, columns, identity, left_coverage, right_coverage from pairs_aligned")
def align_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local alignments of the names of pairs with much in common."""
    found = similarity.member_pairs(*aligned_classes(spark, sf_dir))
    return similarity.directed_alignment(found).select(*[c.split()[0] for c in similarity.ALIGNED.split(", ")])


def aligned_classes(spark: SparkSession, sf_dir: str, *carry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of one name with much in common, with the alignments of their names, and the parts of each class with what ``carry`` (tables by id) has of them."""
    rows = kmer_parts(spark, sf_dir)
    for df in carry:
        rows = rows.join(df, "id", "left")
    more = tuple(c for df in carry for c in df.columns if c != "id")
    pairs, members = similarity.candidate_classes(rows, "id", "signature", "n", "ks", also=("name",), carry=more)
    near = pairs.withColumn("containment", F.round("containment", 6)).filter("containment >= 0.5")
    return similarity.align_classes(near, "name"), members


#: a user's day is an entity, an event of it a feature of 30 minutes in two fragments; cheap ones are of a type that does not count
DAYS_SQL = """f as (select user_id, user_id * 100 + extract(day from ts) as entity, event_type as feature_id, extract(hour from ts) * 60 + extract(minute from ts) + 1 as m, case when value >= 4 then 'domain' else 'site' end as kind from events),
en as (select distinct user_id, entity from f), a as (select entity, list(feature_id order by m, feature_id) as ids, list(m order by m, feature_id) as iv from f where kind = 'domain' group by 1)"""


def day_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entities (user_id, entity), and features flattened from a JSON document for each."""
    minute = F.hour("ts") * 60 + F.minute("ts") + 1
    e = table(spark, sf_dir, "events").select("user_id", (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("entity"), "event_type", minute.alias("m"), F.when(F.col("value") >= 4, "domain").otherwise("site").alias("kind"))
    part = lambda a, b: F.struct((F.col("m") + a).alias("start"), (F.col("m") + b).alias("end"))
    place = F.struct(F.array(part(15, 30), part(0, 10)).alias("fragments"))
    mine = F.struct(F.col("entity").cast("string").alias("accession"), F.lit(1500).alias("protein_length"), F.array(place).alias("entry_protein_locations"))
    other = F.struct(F.lit("0").alias("accession"), F.lit(9).alias("protein_length"), F.array(place).alias("entry_protein_locations"))
    result = F.struct(F.struct(F.col("event_type").alias("accession"), F.upper("event_type").alias("name"), F.col("kind").alias("type")).alias("metadata"), F.array(other, mine).alias("proteins"))
    docs = e.groupBy("user_id", "entity").agg(F.to_json(F.struct(F.collect_list(result).alias("results"))).alias("json"))
    return docs.select("user_id", "entity"), features.flatten_features(docs, "entity", "json", restricted=True)


@query(f"""with {DAYS_SQL} select entity, feature_id, upper(feature_id) as feature_name, kind as feature_type, cast(m as bigint) as start, cast(m + 30 as bigint) as "end", cast(1 as bigint) as location_index, cast(2 as bigint) as fragment_count, cast(1500 as bigint) as entity_length from f where kind = 'domain'""")
def features_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of nested JSON documents: results of counted types, of the entity itself, from first to last fragment."""
    f = day_features(spark, sf_dir)[1]
    return f.select("entity", "feature_id", "feature_name", "feature_type", *[F.col(c).cast("long").alias(c) for c in ("start", "end", "location_index", "fragment_count", "entity_length")])


@query(f"""with {DAYS_SQL}, n as (select entity as left_id, lead(entity) over (partition by user_id order by entity) as right_id from en),
p as (select left_id, right_id, l.ids as lids, r.ids as rids, l.iv as liv, r.iv as riv from n left join a l on left_id = l.entity left join a r on right_id = r.entity where right_id is not null),
i as (select *, case when lids = rids then list_min(list_transform(range(1, len(liv) + 1), lambda i: greatest(0, least(liv[i], riv[i]) + 30 - greatest(liv[i], riv[i]) + 1) / cast(greatest(liv[i], riv[i]) + 30 - least(liv[i], riv[i]) + 1 as double))) end as iou from p)
select left_id, right_id, round(iou, 6) as min_iou, case when lids is null or rids is null then 'missing' when lids <> rids then 'order_or_copy_mismatch' when iou < 0.1 then 'low_overlap' else 'pass' end as reason from i""")
def interval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's days compared with the next day: features in order and their places, with the first reason that fails."""
    entities, found = day_features(spark, sf_dir)
    arch = similarity_inputs(entities, found)
    following = F.lead("entity").over(Window.partitionBy("user_id").orderBy("entity"))
    pairs = entities.select(F.col("entity").alias("left_id"), following.alias("right_id")).filter("right_id is not null")
    side = lambda s: arch.select(F.col("entity").alias(f"{s}_id"), F.col("arch").alias(f"{s}_arch"))
    c = pairs.join(side("left"), "left_id").join(side("right"), "right_id").withColumn("c", fs.compare_architectures("left_arch", "right_arch", 0.1))
    return c.select("left_id", "right_id", F.round("c.min_iou", 6).alias("min_iou"), "c.reason")


def similarity_inputs(entities: DataFrame, found: DataFrame) -> DataFrame:
    """entity and its architecture."""
    return features.architectures(entities, "entity", found, "DAYS")


@query("""with e as (select distinct user_id, extract(day from ts) as d, extract(hour from ts) * 60 + extract(minute from ts) as m from events)
select user_id, cast(d as bigint) as day, string_agg(cast(m as varchar) || '-' || cast(m + 5 as varchar), '|' order by m) as intervals, count(*) as n from e group by 1, 2""")
def interval_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's intervals of a day encoded as text and decoded again."""
    e = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").cast("long").alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("start")).distinct()
    a = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + 5).alias("end")))).alias("i"))
    b = a.withColumn("intervals", fx.encode_intervals("i")).withColumn("back", fx.decode_intervals("intervals"))
    return b.select("user_id", "day", fx.encode_intervals("back").alias("intervals"), F.size("back").cast("long").alias("n"))


#: customers with the parts, brands and suppliers they bought, here at quantity 49 or more, paired within a nation and segment
SETS_SQL = """b as (select distinct o_custkey as id, l_partkey as p, p_brand as br, l_suppkey as s from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_quantity >= 49),
st as (select id, list(distinct p) as ps, list(distinct br) as bs, list(distinct s) as ss from b group by 1),
c as (select c_custkey as id, c_nationkey, c_mktsegment from customer),
pr as (select x.id as left_id, y.id as right_id, xs.ps as lp, ys.ps as rp, xs.bs as lb, ys.bs as rb, xs.ss as ls, ys.ss as rs from c x join c y on x.c_nationkey = y.c_nationkey and x.c_mktsegment = y.c_mktsegment and x.id < y.id
  join st xs on xs.id = x.id join st ys on ys.id = y.id),
m as (select left_id, right_id, len(list_intersect(lp, rp)) as shared_parts, len(list_intersect(lb, rb)) as shared_brands, len(list_intersect(ls, rs)) as shared_suppliers,
  len(list_intersect(lp, rp)) / cast(len(list_distinct(list_concat(lp, rp))) as double) as jaccard_parts,
  len(list_intersect(lb, rb)) / cast(len(list_distinct(list_concat(lb, rb))) as double) as jaccard_brands,
  len(list_intersect(ls, rs)) / cast(len(list_distinct(list_concat(ls, rs))) as double) as jaccard_suppliers from pr),
al as (select *, shared_parts + shared_brands + shared_suppliers as shared_all from m),
nn as (select count(*) as n from st), df as (select 'brands:' || br as member, ln((n + 1) / cast(count(distinct id) + 1 as double)) + 1 as weight from b, nn group by br, n),
mem as (select left_id, right_id, member, count(*) as sides from (
   select left_id, right_id, unnest(list_concat(list_concat(list_transform(lp, lambda x: 'parts:' || x), list_transform(lb, lambda x: 'brands:' || x)), list_transform(ls, lambda x: 'suppliers:' || x))) as member from pr
   union all select left_id, right_id, unnest(list_concat(list_concat(list_transform(rp, lambda x: 'parts:' || x), list_transform(rb, lambda x: 'brands:' || x)), list_transform(rs, lambda x: 'suppliers:' || x))) as member from pr) t group by 1, 2, 3),
w as (select left_id, right_id, sum(case when sides = 2 then coalesce(weight, 1) else 0 end) / sum(coalesce(weight, 1)) as weighted from mem left join df using (member) group by 1, 2),
fm as (select al.*, round(w.weighted, 6) as weighted from al join w using (left_id, right_id)),
fp as (select *, case when jaccard_suppliers >= 0.5 and shared_suppliers >= 1 then 'event' when jaccard_parts >= 0.5 and shared_parts >= 2 then 'first_set' when weighted >= 0.25 and shared_all >= 3 then 'weighted' else 'none' end as reason from fm)"""


#: the same of whatever they bought
BOUGHT_SQL = SETS_SQL.replace(" where l_quantity >= 49", "")


def functional_edges(spark: SparkSession, sf_dir: str, lines: str = "true") -> DataFrame:
    """Measures of pairs of customers that may pass, by the lines that they bought."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    bought = li.filter(lines).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    sets = staged(bought.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("l_partkey").alias("parts"), F.collect_set("p_brand").alias("brands"), F.collect_set("l_suppkey").alias("suppliers")), "sets")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment")
    n = sets.count()
    weights = sets.select(F.explode("brands").alias("b")).groupBy(F.concat(F.lit("brands:"), "b").alias("member")).agg((F.log((n + 1) / (F.count("*") + 1)) + 1).alias("weight"))
    block = ["c_nationkey", "c_mktsegment"]
    pairs = staged(similarity.functional_candidates(sets, "id", c, block, "suppliers", "parts", "brands", weights), "pairs")
    metrics = similarity.pair_set_metrics(pairs, sets, "id", ["parts", "brands", "suppliers"], weights)
    return similarity.with_functional_pass(metrics.withColumn("weighted", F.round("weighted", 6)), "suppliers", "parts")


@query(f"""with {BOUGHT_SQL} select left_id, right_id, shared_parts, shared_brands, shared_suppliers, shared_all, round(jaccard_parts, 6) as jaccard_parts, round(jaccard_brands, 6) as jaccard_brands,
 round(jaccard_suppliers, 6) as jaccard_suppliers, weighted, reason <> 'none' as passed, reason from fp where reason <> 'none'""")
def function_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set similarities of customer pairs and the first rule that passes."""
    f = functional_edges(spark, sf_dir).filter("passed")
    return f.select("left_id", "right_id", "shared_parts", "shared_brands", "shared_suppliers", "shared_all", *[F.round(c, 6).alias(c) for c in ("jaccard_parts", "jaccard_brands", "jaccard_suppliers")], "weighted", "passed", "reason")


@query(f"""with {SETS_SQL}, r as (select *, row_number() over (partition by left_id order by weighted desc, shared_all desc, right_id desc) as nth, count(*) over (partition by left_id) as n_support from fp where reason <> 'none')
select left_id, right_id as best_seed, weighted, shared_all, n_support from r where nth = 1""")
def extend_best_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each candidate the best supporting seed and the number of supports."""
    passed = functional_edges(spark, sf_dir, "l_quantity >= 49").filter("passed")
    failures = passed.select("left_id").distinct()
    return similarity.extend_by_similarity(failures, passed, "left_id", ["weighted", "shared_all"], "right_id").select("left_id", "best_seed", "weighted", "shared_all", "n_support")


def part_edges(spark: SparkSession, sf_dir: str, aligned: bool = False) -> DataFrame:
    """All measures of pairs of parts of one signature with k-mers in common: names as texts, size as the place of the one feature, and the suppliers, nations and months of their large lines; the sizes of the two parts.

    With ``aligned`` only pairs whose alignment is that of an edge are formed.
    """
    part, li, s = (table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier"))
    place = F.array(F.struct(F.col("p_size").alias("start"), (F.col("p_size") + 30).alias("end")))
    arch = F.struct(F.lit("available").alias("status"), F.lit("PART").alias("source"), F.array("p_type").alias("ids"), place.alias("intervals"), F.lit(100).alias("length"))
    own = part.select(F.col("p_partkey").alias("id"), "p_size", arch.alias("arch"))
    large = li.filter("l_quantity >= 30").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    sets = large.groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set("l_suppkey").alias("suppliers"), F.collect_set("s_nationkey").alias("nations"), F.collect_set(F.month("l_shipdate")).alias("months"))
    pairs, members = aligned_classes(spark, sf_dir, own, sets)
    if aligned:
        good = lambda s: similarity.edge_pass(F.col(f"{s}.identity"), F.col(f"{s}.left_coverage"), F.col(f"{s}.right_coverage"), F.lit(True), F.lit(True))
        pairs = pairs.filter(good("aligned_a") | good("aligned_b"))
    found = similarity.member_metrics(similarity.member_pairs(pairs, members), ["suppliers", "nations", "months"], "suppliers", "nations", 0.5)
    first = F.col("row_a.id") < F.col("row_b.id")
    sizes = {f"{n}_size": F.when(first, F.col(f"row_{x}.p_size")).otherwise(F.col(f"row_{y}.p_size")) for n, x, y in (("left", "a", "b"), ("right", "b", "a"))}
    return found.withColumns(sizes)


@query(f"with {EDGES_SQL} select left_id, right_id, identity, left_coverage, right_coverage, min_iou, architecture, weighted, shared_all, function, edge from ed")
def extension_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment, architecture and set similarity of every candidate pair, and whether it is a passing edge."""
    return part_edges(spark, sf_dir).select("left_id", "right_id", "identity", "left_coverage", "right_coverage", "min_iou", "architecture", "weighted", "shared_all", "function", "edge")


@query(f"""with {EDGES_SQL}, t as (select left_id, right_id, identity, weighted from ed where edge union all select right_id, left_id, identity, weighted from ed where edge),
n as (select t.*, row_number() over (partition by left_id order by identity desc, weighted desc, right_id desc) as nth, count(*) over (partition by left_id) as n_support from t join part r on right_id = r.p_partkey and r.p_size <= 20 join part l on left_id = l.p_partkey and l.p_size > 20)
select left_id, 'failure' as label, right_id as best_seed, identity, weighted, n_support from n where nth = 1""")
def extended_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed candidates (parts over size 20) that a passing edge ties to a seed, with the best seed; their label stays."""
    e = part_edges(spark, sf_dir, aligned=True).filter("(left_size > 20 and right_size <= 20 or left_size <= 20 and right_size > 20) and edge")
    turn = lambda x, y: F.when(F.col("left_size") > 20, F.col(x)).otherwise(F.col(y))
    tall = e.select(turn("left_id", "right_id").alias("left_id"), turn("right_id", "left_id").alias("right_id"), "identity", "weighted")
    failures = table(spark, sf_dir, "part").filter("p_size > 20").select(F.col("p_partkey").alias("left_id"), F.lit("failure").alias("label"))
    return similarity.extend_by_similarity(failures, tall, "left_id", ["identity", "weighted"], "right_id").select("left_id", "label", "best_seed", "identity", "weighted", "n_support")


def vowel_share(texts: list[str]) -> np.ndarray:
    """The plug-in model of the queries: the share of vowels in each text."""
    return np.array([round(sum(t.count(v) for v in "aeiou") / max(1, len(t)), 9) for t in texts])


@query("""with w as (select doc_id, unnest(case when length(text) <= 1022 then [0] else range(0, length(text) - 200, 822) end) as start, text from documents where length(text) > 0),
s as (select doc_id, start, length(substring(text, start + 1, 1022)) as n, round(length(regexp_replace(substring(text, start + 1, 1022), '[^aeiou]', '', 'g')) / cast(length(substring(text, start + 1, 1022)) as double), 9) as score from w),
r as (select *, row_number() over (partition by doc_id order by score desc, n, start) as nth, count(*) over (partition by doc_id) as n_windows, avg(score) over (partition by doc_id) as mean_score, max(score) over (partition by doc_id) as max_score from s)
select doc_id as key, n_windows, round(mean_score, 6) as mean_score, round(max_score, 6) as max_score, start as max_start, start + n as max_end from r where nth = 1""")
def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of every whole text scored by a plug-in model and rolled up."""
    scores = scoring.score_windows(table(spark, sf_dir, "documents"), "doc_id", "text", vowel_share)
    return scoring.roll_up_windows(scores).withColumns({c: F.round(c, 6) for c in ("mean_score", "max_score")})


@query("""with l as (select p_partkey as id, p_name, dense_rank() over (order by p_partkey) - 1 as li from part where p_size > 40), r as (select n_nationkey as id, n_name, dense_rank() over (order by n_nationkey) - 1 as ri from nation),
u as (select li * (select count(*) from r) + ri as pair_index, p_name, n_name from l, r), g as (select * from u where length(p_name) + length(n_name) <= 25 and round(least(length(p_name), length(n_name)) / cast(greatest(length(p_name), length(n_name)) as double), 6) > 0.7 and pair_index % 2 = 1)
select pair_index, round(least(length(p_name), length(n_name)) / cast(greatest(length(p_name), length(n_name)) as double), 9) as score, cast(least(length(p_name), length(n_name)) / cast(greatest(length(p_name), length(n_name)) as double) > 0.9 as int) as flag from g""")
def pair_scores_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending pairs of a gated universe scored by a plug-in model; even pairs count as done."""
    parts = table(spark, sf_dir, "part").filter("p_size > 40").select("p_partkey", F.col("p_name").alias("left_text"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("right_text"))
    universe = scoring.pair_universe(parts, "p_partkey", nations, "n_nationkey")
    pairs = universe.join(parts, F.col("left_id") == F.col("p_partkey")).join(nations, F.col("right_id") == F.col("n_nationkey")).withColumn("length_sum", F.length("left_text") + F.length("right_text")).withColumn("prior", F.round(fs.length_ratio(F.length("left_text"), F.length("right_text")), 6))
    gated = scoring.pair_gate(pairs, "prior", "length_sum", 0.7, 25)
    todo = scoring.pending(gated, gated.filter("pair_index % 2 = 0").select("pair_index"))

    def model(a: list[str], b: list[str]) -> np.ndarray:
        return np.array([min(len(x), len(y)) / max(len(x), len(y), 1) for x, y in zip(a, b, strict=True)])

    return scoring.score_pairs(todo.select("pair_index", "left_text", "right_text"), model).withColumn("score", F.round("score", 9))


SHARDED_SQL = """l as (select p_partkey as id, p_name || ' ' || p_type as t, dense_rank() over (order by p_partkey) - 1 as li from part where p_size > 45), r as (select n_nationkey as id, n_name as t, dense_rank() over (order by n_nationkey) - 1 as ri from nation),
u as (select li * (select count(*) from r) + ri as pair_index, l.t as a, r.t as b from l, r), g as (select *, round(least(length(a), length(b)) / cast(greatest(length(a), length(b)) as double), 6) as score from u where length(a) + length(b) <= 28)"""


@query(f"with {SHARDED_SQL} select pair_index, score, cast(score > 0.9 as int) as flag, cast(pair_index % 7 as int) as shard from g where score > 0.4")
def sharded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a gated and checked universe scored shard by shard; the run is stopped after its first shards and then resumed."""
    parts = table(spark, sf_dir, "part").filter("p_size > 45").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("left_text"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("right_text"))
    universe = scoring.pair_universe(parts, "p_partkey", nations, "n_nationkey")
    pairs = universe.join(parts, F.col("left_id") == F.col("p_partkey")).join(nations, F.col("right_id") == F.col("n_nationkey")).withColumn("length_sum", F.length("left_text") + F.length("right_text")).withColumn("prior", F.round(fs.length_ratio(F.length("left_text"), F.length("right_text")), 6))
    gated = staged(scoring.checked_pairs(scoring.pair_gate(pairs, "prior", "length_sum", 0.4, 28), nations.count(), "prior", "length_sum", 0.4, 28), "pairs")
    folder = f"{shared_dir(spark)}/sharded-{uuid.uuid4().hex}"

    def model(a: list[str], b: list[str]) -> np.ndarray:
        return np.array([min(len(x), len(y)) / max(len(x), len(y), 1) for x, y in zip(a, b, strict=True)])

    scoring.score_shards(gated, model, folder, 7, 3)
    remove(spark, f"{folder}/scores/shard=2")  # as if the run had ended before
    return scoring.score_shards(gated, model, folder, 7, 3).withColumn("score", F.round("score", 6))


@query(f"""with {KMER_SQL}, c as (select i, n from (values (0.5::double), (0.7), (0.9), (1.01)) t(i), (values (0.8::double), (0.95)) u(n)),
p as (select i, n, left_id, right_id from c join kp on containment >= i and left_length::double / right_length >= n and right_length::double / left_length >= n),
g as (select i, n, count(*) as n_edges from p group by all), ids as (select i, n, count(distinct id) as n_ids from (select i, n, unnest([left_id, right_id]) as id from p) group by all),
e as (select count(*) as evaluated from part), l as (select count(distinct id) as eligible from (select unnest([left_id, right_id]) as id from kp)), z as (select count(*) as none from part where p_size > 1000)
select i as identity, n as ratio, coalesce(n_edges, 0) as n_edges, coalesce(n_ids, 0) as n_ids, printf('%.8f', coalesce(n_ids, 0) / evaluated::double) as overall, case when eligible = 0 then 'NA' else printf('%.8f', coalesce(n_ids, 0) / eligible::double) end as conditional,
 case when none = 0 then 'NA' else printf('%.8f', coalesce(n_ids, 0) / none::double) end as of_none from c left join g using (i, n) left join ids using (i, n), e, l, z""")
def threshold_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of thresholds: passing edges, recovered ids, and their share of all ids and of those with any edge; NA as share of an empty set."""
    edges, members = kmer_classes(spark, sf_dir)
    edges = edges.withColumn("ratio", fs.length_ratio(F.col("length_a"), F.col("length_b")))
    cells = sensitivity.grid(spark, identity=[0.5, 0.7, 0.9, 1.01], ratio=[0.8, 0.95])
    counts = sensitivity.threshold_grid(edges, cells, {"identity": "containment", "ratio": "ratio"}, members=members)
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    eligible = similarity.class_ends(edges, members).select("id").distinct()
    found = sensitivity.grid_fractions(counts, ids, eligible)
    none = sensitivity.grid_fractions(counts, ids, ids.filter("p_size > 1000")).select("identity", "ratio", F.col("conditional").alias("of_none"))
    return found.join(none, ["identity", "ratio"]).select("identity", "ratio", "n_edges", "n_ids", "overall", "conditional", "of_none")


@query("""with o as (select o_orderkey as id, o_orderstatus as status, count(l_orderkey) as n, list(l_linenumber::bigint order by l_linenumber, l_partkey) as ids, list(l_quantity::bigint order by l_linenumber, l_partkey) as starts, any_value(o_orderpriority) as priority
  from orders left join lineitem on l_orderkey = o_orderkey and l_quantity < 45 group by 1, 2),
n as (select id as left_id, status as ls, priority as lp, n as ln, case when n = 0 then [] else ids end as lids, case when n = 0 then [] when n > 4 then starts[2:] else starts end as lstarts,
  lead(id) over w as right_id, lead(status) over w as rs, lead(priority) over w as rp, lead(n) over w as rn, lead(case when n = 0 then [] else ids end) over w as rids, lead(case when n = 0 then [] when n > 5 then starts[2:] else starts end) over w as rstarts from o window w as (order by id)),
i as (select *, case when ls = 'P' or rs = 'P' then 'missing' when ln = 0 or rn = 0 then 'empty' when left(lp, 1) <> left(rp, 1) and left(lp, 1) = '1' then 'source_mismatch' when lids <> rids then 'order_or_copy_mismatch' when len(lstarts) <> len(rstarts) then 'coordinate_count_mismatch' end as early,
  list_min(list_transform(range(1, least(len(lstarts), len(rstarts)) + 1), lambda k: greatest(0, least(lstarts[k], rstarts[k]) + 10 - greatest(lstarts[k], rstarts[k]) + 1) / (greatest(lstarts[k], rstarts[k]) + 10 - least(lstarts[k], rstarts[k]) + 1)::double)) as iou from n where right_id is not null)
select coalesce(early, case when iou < 0.4 then 'low_overlap' else 'pass' end) as reason, count(*) as n, round(coalesce(sum(case when early is null then iou end), 0), 5) as total_iou from i group by 1""")
def architecture_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason why the architectures of neighbouring orders (their lines, with quantities as places) do not match, with counts."""
    li = table(spark, sf_dir, "lineitem").filter("l_quantity < 45").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("i"), "l_partkey", F.col("l_quantity").cast("long").alias("q")))).alias("lines"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    lines = F.coalesce("lines", F.array().cast("array<struct<i:bigint,l_partkey:bigint,q:bigint>>"))
    status = F.when(F.col("o_orderstatus") != "P", "available").otherwise("absent")

    def side(name: str, shift: int, most: int, source: Column) -> DataFrame:
        places = F.transform(lines, lambda x: F.struct(x["q"].alias("start"), (x["q"] + 10).alias("end")))
        cut = F.when(F.size(lines) > most, F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0)))).otherwise(places)
        arch = F.struct(status.alias("status"), source.alias("source"), F.transform(lines, lambda x: x["i"]).alias("ids"), cut.alias("intervals"), F.lit(1).alias("length"))
        return numbered.select((F.col("position") + shift).alias("position"), F.col("o_orderkey").alias(f"{name}_id"), arch.alias(f"{name}_arch"), F.substring("o_orderpriority", 1, 1).alias(f"{name}_p"))

    numbered = ordered_index(o, F.asc("o_orderkey"))
    p = side("left", 1, 4, F.lit("s")).join(side("right", 0, 5, F.lit("s")), "position")
    other = (F.col("left_p") != F.col("right_p")) & (F.col("left_p") == "1")
    p = p.withColumn("right_arch", F.col("right_arch").withField("source", F.when(other, "t").otherwise("s")))
    found = p.withColumn("c", fs.compare_architectures("left_arch", "right_arch", 0.4))
    return found.groupBy("c.reason").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("c.min_iou"), F.lit(0.0)), 5).alias("total_iou"))
