"""The roles that the given tables play in the queries, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

#: customer = entity, part bought in a returned line of 45 or more = term, seeds = BUILDING customers in debt
ENTITY_TERMS_SQL = """et as (
  select distinct o_custkey as entity, l_partkey as term from lineitem join orders on l_orderkey = o_orderkey
  where l_returnflag = 'R' and l_quantity >= 45),
seeds as (select c_custkey as entity from customer where c_mktsegment = 'BUILDING' and c_acctbal < 0)"""


def entity_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 45").select("l_orderkey", F.col("l_partkey").alias("term"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("entity", "term").distinct()


def entity_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING' and c_acctbal < 0").select(F.col("c_custkey").alias("entity"))


#: parts of small size are anchors, tokens are the words of their name
ANCHORS_SQL = "anchors as (select p_partkey, p_name from part where p_size <= 2)"


def anchor_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_size <= 2").select("p_partkey", "p_name")


#: directed graph: part -> the next part of the order, from lines returned with 45 or more
STEPS_SQL = """steps as (
  select source, target, pos from (
    select l_partkey as source, lead(l_partkey) over w as target, l_returnflag, l_quantity,
           l_orderkey * 1000000 + row_number() over w as pos
    from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)) t
  where target is not null and l_returnflag = 'R' and l_quantity >= 45),
edges as (select source, target, min(pos) as first_order from steps where source <> target group by 1, 2),
dseeds as (select p_partkey as node from part where p_size <= 2)"""


def part_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, pos: one row for each step between different parts."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    steps = lines.withColumn("target", F.lead("l_partkey").over(w)).withColumn("pos", F.col("l_orderkey") * 1_000_000 + F.row_number().over(w))
    kept = steps.filter("target is not null and l_returnflag = 'R' and l_quantity >= 45 and l_partkey <> target")
    return kept.select(F.col("l_partkey").alias("source"), "target", "pos")


#: pairs of parts that stand next to each other in an order, with quantity as score
PAIRS_SQL = """pairs as (
  select p1, p2, qty, pos from (
    select l_partkey as p1, lead(l_partkey) over w as p2, l_quantity as qty,
           l_orderkey * 1000000 + row_number() over w as pos
    from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)) t
  where p2 is not null and p1 <> p2 and qty >= 30)"""


def part_pairs(spark: SparkSession, sf_dir: str, least: float = 30) -> DataFrame:
    """p1, p2, qty, pos: neighbouring parts of an order."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    steps = lines.withColumn("p2", F.lead("l_partkey").over(w)).withColumn("pos", F.col("l_orderkey") * 1_000_000 + F.row_number().over(w))
    return steps.select(F.col("l_partkey").alias("p1"), "p2", F.col("l_quantity").alias("qty"), "pos").filter((F.col("p2").isNotNull()) & (F.col("p1") != F.col("p2")) & (F.col("qty") >= least))
