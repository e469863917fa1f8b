"""Features flattened from nested JSON documents, and architectures put together from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The feature types that count in the restricted source.
TYPES = ("domain", "repeat", "family", "homologous_superfamily")
#: A document: results, each with what it is and where in which entities it lies.
DOCUMENT = (
    "results array<struct<metadata: struct<accession: string, name: string, type: string>, proteins: array<struct<accession: string, protein_length: int,"
    " entry_protein_locations: array<struct<fragments: array<struct<start: int, end: int>>>>>>>>"
)
FEATURES = ("feature_id", "feature_name", "feature_type", "start", "end", "location_index", "fragment_count")


def flatten_features(docs: DataFrame, entity: str, json: str, restricted: Column | bool = False) -> DataFrame:
    """entity, entity_length and FEATURES: a row for each location of a result in the entity itself.

    A location reaches from its first fragment's start to its last one's end; locations without fragments and other
    entities go. Where ``restricted`` holds, only TYPES count. Nothing is shuffled. Null and broken JSON give no row.
    """
    limited = F.coalesce(restricted if isinstance(restricted, Column) else F.lit(restricted), F.lit(False))
    d = docs.select(F.col(entity).alias("entity"), limited.alias("limited"), F.from_json(json, DOCUMENT).alias("d"))
    d = d.select("entity", "limited", F.explode("d.results").alias("r")).filter(~F.col("limited") | F.col("r.metadata.type").isin(*TYPES))
    d = d.select("entity", "r.metadata", F.explode("r.proteins").alias("p")).filter(F.upper("p.accession") == F.upper(F.col("entity").cast("string")))
    d = d.select("entity", "metadata", F.col("p.protein_length").alias("entity_length"), F.posexplode("p.entry_protein_locations").alias("at", "l"))
    fragments = F.col("l.fragments")
    start, end = F.array_min(F.transform(fragments, lambda x: x["start"])), F.array_max(F.transform(fragments, lambda x: x["end"]))
    return d.filter(F.size(fragments) > 0).select(
        "entity", "entity_length", F.col("metadata.accession").alias("feature_id"), F.coalesce("metadata.name", F.lit("")).alias("feature_name"), F.col("metadata.type").alias("feature_type"),
        start.alias("start"), end.alias("end"), (F.col("at") + 1).alias("location_index"), F.size(fragments).alias("fragment_count"),
    )


def architectures(entities: DataFrame, key: str, features: DataFrame, source: str) -> DataFrame:
    """For each entity an ``arch`` struct (status, source, ids, intervals, length) with features in order of start, end, id and location.

    An entity's features are those of one document, so the list is bounded by it.
    """
    listed = F.array_sort(F.collect_list(F.struct("start", "end", "feature_id", "location_index")))
    by = features.groupBy(F.col("entity").alias("_e")).agg(listed.alias("_f"), F.max("entity_length").alias("_n"))
    joined = entities.select(key).distinct().join(by, F.col(key) == F.col("_e"), "left")
    there = F.col("_f").isNotNull() & (F.coalesce("_n", F.lit(0)) > 0)
    arch = F.struct(
        F.when(there, "available").otherwise("no_coordinate_resolved_features").alias("status"), F.lit(source).alias("source"),
        F.transform("_f", lambda f: f["feature_id"]).alias("ids"), F.transform("_f", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"))).alias("intervals"), F.coalesce("_n", F.lit(0)).alias("length"),
    )
    return joined.select(key, arch.alias("arch"))
