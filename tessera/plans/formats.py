"""Readers and writers on whole tables: written to the shared folder in each format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import guards, rank, scoring
from tessera.plans.registry import query
from tessera.sources import io
from tessera.sources.tables import shared_dir, table


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, *columns: str, path: str, compression: str = "none") -> None:
    df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value")).write.text(path, compression=compression)


@query("select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey from customer")
def tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as TSV and read back as text; the same content again is left alone."""
    path, fields = _path(spark, "tsv"), ["c_custkey", "c_name", "c_nationkey"]
    io.write_tsv(table(spark, sf_dir, "customer"), path, fields)
    io.write_tsv(table(spark, sf_dir, "customer").repartition(3), path, fields)
    return io.read_unique_tsv(spark, path, fields, "c_custkey")


@query("select cast(o_orderkey as varchar) as id1, cast(o_custkey as varchar) as id2 from orders")
def pairs_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two fields of a headerless file."""
    path = _path(spark, "pairs")
    _lines(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_orderstatus", path=path)
    return io.read_pairs(spark, path).select("id1", "id2")


@query("select cast(p_partkey as varchar) as id, p_type as kind from part where p_size > 10")
def headerless_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by position; lines with too few fields are skipped."""
    path, p = _path(spark, "headerless"), table(spark, sf_dir, "part")
    _lines(p.filter("p_size > 10"), "p_partkey", "p_name", "p_brand", "p_type", path=path)
    short = _path(spark, "headerless")
    _lines(p.filter("p_size <= 10"), "p_partkey", "p_name", path=short)
    return io.read_headerless(spark, [path, short], {"id": 0, "kind": 3}, 4).select("id", "kind")


@query("select cast(l_orderkey as varchar) as id, cast(l_quantity as varchar) as quantity, cast(count(*) as bigint) as n from lineitem where l_returnflag <> 'A' group by 1, 2")
def annotations_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed annotation lines with comments."""
    path, li = _path(spark, "gzip"), table(spark, sf_dir, "lineitem")
    mark = li.withColumn("l_orderkey", F.when(F.col("l_returnflag") == "A", F.concat(F.lit("!"), F.col("l_orderkey").cast("string"))).otherwise(F.col("l_orderkey").cast("string")))
    _lines(mark, *li.columns, *li.columns[:4], path=path, compression="gzip")
    found = io.read_headerless(spark, path, {"id": 0, "quantity": 4}, 15, comment="!")
    return found.groupBy("id", "quantity").agg(F.count("*").alias("n"))


@query("select cast(c_custkey as varchar) as id, row_number() over (order by c_acctbal desc, c_custkey) as position from customer")
def id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written one a line in the order of a table, over many files, and read back in that order."""
    path = _path(spark, "ids")
    io.write_ids(table(spark, sf_dir, "customer").repartition(6), path, "c_custkey", [F.desc("c_acctbal"), F.asc("c_custkey")])
    return rank.ordered_index(io.read_ids(spark, path, place=True), F.asc("place")).select("id", "position")


@query("select cast(s_suppkey as varchar) as id from supplier union all select cast(1000000 + p_partkey as varchar) from part")
def table_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id column of two tables: the only one of known name, and one that is named."""
    one, two = _path(spark, "table"), _path(spark, "table")
    io.write_tsv(table(spark, sf_dir, "supplier").select("s_name", F.col("s_suppkey").alias("candidate_accession")), one, ["s_name", "candidate_accession"])
    io.write_tsv(table(spark, sf_dir, "part").select((F.lit(1_000_000) + F.col("p_partkey")).alias("key"), F.col("p_name").alias("Entry")), two, ["key", "Entry"])
    return io.read_table_ids(spark, one).union(io.read_table_ids(spark, two, "key"))


@query("select cast(p_partkey as varchar) as accession, upper(regexp_replace(p_name || p_type, '\\s', '', 'g')) as sequence, (select count(*) from part) as n from part")
def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as FASTA and read back, with their number and with ids that agree with the reader of ids only."""
    path = _path(spark, "fasta")
    p = table(spark, sf_dir, "part").select("p_partkey", fx.clean_sequence(F.concat("p_name", "p_type")).alias("s"))
    io.write_fasta(p, path, F.concat(F.lit("sp|"), F.col("p_partkey").cast("string"), F.lit("|x part")), "s", 10)
    found = io.read_fasta(spark, path).select("accession", "sequence", F.lit(io.fasta_count(spark, path)).cast("long").alias("n"))
    return found.join(io.read_fasta_ids(spark, path), "accession", "left_semi")


@query("select user_id, max(event_id) as event_id, max_by(event_type, event_id) as event_type from events group by 1")
def json_lines_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines in which the last object of a key wins, by a field that states the order."""
    path = _path(spark, "jsonl")
    table(spark, sf_dir, "events").select(F.to_json(F.struct("user_id", "event_id", "event_type")).alias("value")).repartition(4).write.text(path)
    return io.read_jsonl_last(spark, path, "user_id long, event_id long, event_type string", "user_id", order="event_id")


@query("select cast(s_suppkey as varchar) as id, cast(count(l_orderkey) as bigint) as n, coalesce(max(l_partkey), -1) as top from supplier left join (select * from lineitem where l_quantity = 50) l on s_suppkey = l_suppkey group by 1")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document a file, each with its results."""
    path = _path(spark, "json")
    s, li = table(spark, sf_dir, "supplier").select("s_suppkey"), table(spark, sf_dir, "lineitem").filter("l_quantity = 50")
    results = li.groupBy("l_suppkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"))).alias("results"))
    d = s.join(results, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("id"), F.coalesce("results", F.array().cast("array<struct<part:bigint>>")).alias("results"))).alias("value"))
    io.write_json_documents(d, path)
    schema = spark.createDataFrame([], "id string, results array<struct<part: long>>").schema
    return io.read_json_documents(spark, path, schema).select("id", F.size("results").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("results", lambda r: r["part"])), F.lit(-1)).cast("long").alias("top"))


@query("select cast(doc_id as varchar) as doc_id, coalesce(regexp_replace(lang, '[\\t\\r\\n]', ' ', 'g'), '') as lang, sha256(coalesce(regexp_replace(text, '[\\t\\r\\n]', ' ', 'g'), '')) as text_sha256 from documents")
def exported_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view as text that is safe in a TSV: no tabs and line ends in cells, null as blank."""
    d = io.export_text(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return d.select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("select cast(doc_id as varchar) as doc_id, coalesce(lang, '') as lang, sha256(coalesce(regexp_replace(text, '[\\t\\r\\n]', ' ', 'g'), '')) as text_sha256 from documents")
def exported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view written for spreadsheets and its lines read back: behind the byte order mark and header of each file, three cells a line."""
    path = _path(spark, "export")
    io.write_export(table(spark, sf_dir, "documents").select("doc_id", "lang", "text").repartition("doc_id"), path)
    cells = spark.read.text(path).filter(F.ltrim("value", F.lit(io.BOM)) != "doc_id\tlang\ttext").select(F.split("value", "\t", -1).alias("c"))
    return guards.require(cells, F.size("c") == 3, "not three cells").select(F.col("c")[0].alias("doc_id"), F.col("c")[1].alias("lang"), F.sha2(F.col("c")[2].cast("binary"), 256).alias("text_sha256"))


@query("select o_orderstatus as class, count(*) as n, sum(o_orderkey)::bigint as keys from orders group by 1")
def class_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One output for each class, checked against the expected counts by the job that writes; counts by the folder that rows were read from."""
    path, o = _path(spark, "classes"), table(spark, sf_dir, "orders")
    expected = {r[0]: r[1] for r in o.groupBy("o_orderstatus").count().collect()}  # a row for each class
    io.split_by_class(o, path, "o_orderstatus", expected)
    return spark.read.parquet(path).groupBy(F.col("o_orderstatus").cast("string").alias("class")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""with r as (select 'orders' as d, o_orderstatus as l, o_orderpriority as k from orders union all select 'documents', coalesce(lang, ''), coalesce(source, '') from documents),
c as (select d, l, '{' || string_agg('"' || k || '":' || n, ',' order by k) || '}' as classes, sum(n) as n from (select d, l, k, count(*) as n from r group by all) group by all),
v as (select d, sum(n) as base from c group by 1),
f as (select d, base, string_agg('"' || l || '":{"n":' || n || ',"share":"' || printf('%.8f', n / base::double) || '","classes":' || classes || '}', ',' order by l) as levels from c join v using (d) group by all)
select '{' || string_agg('"' || d || '":{"n":' || base || ',"levels":{' || levels || '}}', ',' order by d) || '}' as json from f""")
def nested_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two data sets by level and class in one nested JSON document, each level with its share of the data set."""
    o = table(spark, sf_dir, "orders").select(F.lit("orders").alias("d"), F.col("o_orderstatus").alias("l"), F.col("o_orderpriority").alias("k"))
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("d"), F.col("lang").alias("l"), F.col("source").alias("k"))
    return io.nested_summary(o.union(d), "d", "l", "k")


@query("""with c as (select 'orders/' || o_orderstatus as k, count(*) as v from orders group by 1 union all select 'customers/' || c_mktsegment, count(*) from customer group by 1)
select '{' || string_agg('"' || k || '":' || v, ',' order by k) || '}' as json from c""")
def json_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by data set and class as one JSON document."""
    o = table(spark, sf_dir, "orders").groupBy(F.lit("orders").alias("name"), F.col("o_orderstatus").alias("class")).agg(F.count("*").alias("value"))
    c = table(spark, sf_dir, "customer").groupBy(F.lit("customers").alias("name"), F.col("c_mktsegment").alias("class")).agg(F.count("*").alias("value"))
    return io.json_summary(o.union(c), ["name", "class"])


@query("select o_orderkey, o_custkey from orders where o_orderkey % 20 = 0")
def sharded_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written by key prefix; the keys searched for are read through the folders of their prefixes."""
    path, o = _path(spark, "shards"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    io.write_shards(o, "o_orderkey", path, 2)
    return io.read_shards(spark, path, "o_orderkey", o.filter("o_orderkey % 20 = 0").select("o_orderkey"), 2).select("o_orderkey", "o_custkey")


@query("""with
f as (select l_partkey as x, l_suppkey as y, sum(l_quantity) as f from lineitem where l_partkey <> l_suppkey group by 1, 2)
select u.x, u.y, round((coalesce(u.f, 0) + coalesce(v.f, 0)) / 2, 6) as score from f u join f v on u.x = v.y and u.y = v.x""")
def symmetric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a directed score and the score of the pair turned round."""
    f = table(spark, sf_dir, "lineitem").filter("l_partkey <> l_suppkey").groupBy(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y")).agg(F.sum("l_quantity").alias("f"))
    back = f.select(F.col("x").alias("y"), F.col("y").alias("x"), F.col("f").alias("g"))
    return f.join(back, ["x", "y"]).select("x", "y", F.round(scoring.symmetric_mean(F.col("f"), F.col("g")), 6).alias("score"))
