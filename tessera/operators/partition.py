"""Set algebra over keyed tables: exclusion by key or token, enrichment, scopes, unions with roles, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import atomic_tokens, formal_part, has_word, joined, normalized_label, section_tag
from tessera.operators import guards
from tessera.operators.quality import complete, unique_key


def anchor_exclude(rows: DataFrame, key: str, cell: str, anchors: DataFrame, anchor_key: str, anchor_cell: str) -> DataFrame:
    """rows with excluded, key_hit, token_hits (sorted) and reasons; excluded if the key or any token of ``cell`` is an anchor's.

    Two equi joins and one aggregation, never an OR condition. Null keys match nothing.
    """
    keys = anchors.select(F.col(anchor_key).alias("_k")).filter("_k is not null").distinct().withColumn("_key_hit", F.lit(True))
    tokens = anchors.select(F.explode(atomic_tokens(anchor_cell)).alias("_t")).distinct()
    hits = rows.select(F.col(key).alias("_row"), F.explode(atomic_tokens(cell)).alias("_t")).join(tokens, "_t").groupBy("_row").agg(F.array_sort(F.collect_set("_t")).alias("_hits"))
    found = rows.join(keys, F.col(key) == F.col("_k"), "left").join(hits, F.col(key) == F.col("_row"), "left").drop("_k", "_row")
    none = F.array().cast("array<string>")
    return (
        found.withColumn("key_hit", F.coalesce("_key_hit", F.lit(False)))
        .withColumn("token_hits", F.coalesce("_hits", none))
        .withColumn("excluded", F.col("key_hit") | (F.size("token_hits") > 0))
        .withColumn("reasons", F.concat_ws(";", F.when(F.col("key_hit"), "key"), F.when(F.size("token_hits") > 0, F.concat(F.lit("token:"), F.array_join("token_hits", ",")))))
        .drop("_key_hit", "_hits")
    )


def anchor_match_enrich(rows: DataFrame, key: str, parent: str, cell: str, anchors: DataFrame, anchor_key: str, anchor_cell: str, source: str) -> DataFrame:
    """rows with the sorted distinct keys, cells and sources of anchors that match the parent key or the whole cell (upper-cased)."""
    a = anchors.select(F.col(anchor_key).alias("_ak"), F.upper(F.trim(F.col(anchor_cell))).alias("_ac"), F.col(source).alias("_as"))
    r = rows.select(F.col(key).alias("_row"), F.col(parent).alias("_p"), F.upper(F.trim(F.col(cell))).alias("_c"))
    pairs = r.join(a, r["_p"] == a["_ak"]).union(r.join(a, (r["_c"] == a["_ac"]) & (r["_c"] != "")))
    matched = pairs.groupBy("_row").agg(*[joined(F.collect_set(F.col(c).cast("string"))).alias(n) for c, n in (("_ak", "matched_keys"), ("_ac", "matched_cells"), ("_as", "matched_sources"))])
    out = rows.join(matched, F.col(key) == F.col("_row"), "left").drop("_row")
    return out.withColumns({n: F.coalesce(n, F.lit("")) for n in ("matched_keys", "matched_cells", "matched_sources")})


def classify_scope(sections: DataFrame, entity: str, text: str, products: DataFrame, product_entity: str, word: str) -> DataFrame:
    """For each entity with a hit: canonical (0/1), product ids of tagged hits, and tags that no product has.

    sections: a row for each section; products: entity, name, isoform_ids, displayed. A hit counts in the formal
    part only. Untagged hits and tags of a displayed product are canonical; others give their product's ids.
    """
    hits = sections.filter(has_word(formal_part(text), word)).select(F.col(entity).alias("_e"), normalized_label(section_tag(text)).alias("_tag"))
    names = products.select(F.col(product_entity).alias("_e"), normalized_label("name").alias("_tag"), "isoform_ids", "displayed")
    found = hits.join(names, ["_e", "_tag"], "left")
    canonical = (F.col("_tag") == "") | F.coalesce("displayed", F.lit(False))
    ids = F.flatten(F.collect_set(F.when(~canonical, F.col("isoform_ids"))))
    unknown = F.collect_set(F.when((F.col("_tag") != "") & F.col("displayed").isNull(), F.col("_tag")))
    return found.groupBy("_e").agg(F.max(canonical.cast("int")).alias("canonical"), joined(ids).alias("product_ids"), joined(unknown).alias("unknown_tags")).withColumnRenamed("_e", entity)


def nested_cohorts(rows: DataFrame, predicates: list[tuple[str, Column]]) -> DataFrame:
    """rows with one 0/1 column for each predicate, each requiring the ones before."""
    before, out = F.lit(True), rows
    for name, predicate in predicates:
        before = before & F.coalesce(predicate, F.lit(False))
        out = out.withColumn(name, before.cast("int"))
    return out


def union_with_roles(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Every key of any source, a 0/1 flag ``in_<source>`` each, and the sorted membership text."""
    tagged = None
    for name, df in sources.items():
        one = df.select(F.col(key), F.lit(name).alias("_source")).filter(F.col(key).isNotNull()).distinct()
        tagged = one if tagged is None else tagged.union(one)
    flags = [F.max((F.col("_source") == name).cast("int")).alias(f"in_{name}") for name in sources]
    return tagged.groupBy(key).agg(*flags, joined(F.collect_set("_source")).alias("membership"))


def drift(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, labelled ONLY_LEFT or ONLY_RIGHT."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("ONLY_LEFT")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("ONLY_RIGHT")))


def membership_matrix(universe: DataFrame, versions: dict[str, DataFrame], key: str, pair: tuple[str, str]) -> DataFrame:
    """universe keys with a 0/1 column for each version and the class of the pair: BOTH, X_ONLY, Y_ONLY, NEITHER."""
    out = universe.select(key).distinct()
    for name, df in versions.items():
        out = out.join(df.select(key).distinct().withColumn(name, F.lit(1)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    x, y = (F.col(p) == 1 for p in pair)
    return out.withColumn("membership", F.when(x & y, "BOTH").when(x, "X_ONLY").when(y, "Y_ONLY").otherwise("NEITHER"))


def recompute_consistency(old: DataFrame, new: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """Keys of both versions with both values, their absolute difference and whether value > threshold flips."""
    a, b = old.select(key, F.col(value).alias("old_value")), new.select(key, F.col(value).alias("new_value"))
    return a.join(b, key).withColumn("abs_delta", F.abs(F.col("old_value") - F.col("new_value"))).withColumn("flipped", ((F.col("old_value") > threshold) != (F.col("new_value") > threshold)).cast("int"))


def release_changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """field, changed: how many keys of both releases differ in each column (null equals null), and the keys retained, dropped and added."""
    a = old.select(F.col(key).alias("_k"), F.struct(*columns).alias("_a"))
    b = new.select(F.col(key).alias("_j"), F.struct(*columns).alias("_b"))
    both = a.join(b, F.col("_k") == F.col("_j"), "full")
    here, there = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    counts = [F.count_if(here & there & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias(c) for c in columns]
    one = both.agg(*counts, F.count_if(here & there).alias("RETAINED"), F.count_if(here & ~there).alias("DROPPED"), F.count_if(there & ~here).alias("ADDED"))
    names = [*columns, "RETAINED", "DROPPED", "ADDED"]
    return one.select(F.expr(f"stack({len(names)}, {', '.join(f'{n!r}, `{n}`' for n in names)}) as (field, changed)"))


def integrate_routes(routes: dict[str, DataFrame], key: str, label: str) -> DataFrame:
    """The union of route outputs: for each key its routes, rows and distinct labels."""
    rows = None
    for name, df in routes.items():
        one = df.select(F.lit(name).alias("_route"), F.col(key), F.col(label).alias("_label"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key).agg(joined(F.collect_set("_route")).alias("routes"), F.count("*").alias("n_rows"), F.count_distinct("_label").alias("n_labels"))


def distinct_tokens(rows: DataFrame, by: list[str], cell: str) -> DataFrame:
    """by, n_rows, n_tokens: the distinct tokens of a multi-valued cell (``;`` or ``|``, upper-cased) in each group; groups without any stay with 0."""
    n = rows.groupBy(*by).agg(F.count("*").alias("n_rows"))
    tokens = rows.select(*by, F.explode(atomic_tokens(cell)).alias("_t")).groupBy(*by).agg(F.count_distinct("_t").alias("n_tokens"))
    out = n.join(tokens, by, "left") if by else n.join(F.broadcast(tokens))  # without groups: one row each
    return out.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast("long")))


def release_totals(routes: dict[str, tuple[DataFrame, DataFrame]], key: str, genes: str, ends: tuple[str, str]) -> DataFrame:
    """route, n_rows, n_genes, n_keys, n_pairs, n_unordered: each route's release and ALL routes together.

    A route is its candidates (key, multi-valued gene cell) and its pairs (two ends). Genes are distinct tokens of ``;``
    or ``,`` lists as they are written; a pair and the same pair turned round are one unordered pair.
    """
    rows = pairs = None
    for name, (c, p) in routes.items():
        c = c.select(F.lit(name).alias("route"), F.col(key).cast("string").alias("_key"), F.col(genes).alias("_genes"))
        a, b = (F.col(e).cast("string") for e in ends)
        p = p.select(F.lit(name).alias("route"), F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).alias("_pair"))
        rows, pairs = (c, p) if rows is None else (rows.unionByName(c), pairs.unionByName(p))
    both = lambda df: df.withColumn("route", F.explode(F.array("route", F.lit("ALL"))))
    tokens = F.filter(F.transform(F.split(F.coalesce("_genes", F.lit("")), "[;,]"), lambda t: F.trim(t)), lambda t: t != "")
    one = both(rows).groupBy("route").agg(F.count("*").alias("n_rows"), F.count_distinct("_key").alias("n_keys"))
    two = both(rows.select("route", F.explode(tokens).alias("_t")).distinct()).groupBy("route").agg(F.count_distinct("_t").alias("n_genes"))
    three = both(pairs).groupBy("route").agg(F.count("*").alias("n_pairs"), F.count_distinct("_pair").alias("n_unordered"))
    out = one.join(two, "route", "full").join(three, "route", "full")
    return out.select("route", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_rows", "n_genes", "n_keys", "n_pairs", "n_unordered")])


def join_one_to_one(rows: DataFrame, attributes: DataFrame, key: str, required: list[str]) -> DataFrame:
    """rows with the attributes of their key; a repeated key on either side, or a required value that is missing after the join, is an error."""
    for side, df in (("rows", rows), ("attributes", attributes)):
        if bad := unique_key(df, key, side).first()["violations"]:
            raise ValueError(f"{side}: {bad} blank or repeated keys in {key}")
    out = rows.join(attributes, key, "left")
    if bad := complete(out, required, "joined").first()["violations"]:
        raise ValueError(f"{bad} required values are missing after the join on {key}")
    return out


def keep_old_add_new(old: DataFrame, new: DataFrame, key: str, universe: DataFrame | None = None) -> DataFrame:
    """All old rows, and new rows of keys that old lacks. With a universe the result must have each of its keys once, or the job fails."""
    out = old.unionByName(new.join(old.select(key), key, "left_anti"))
    return out if universe is None else guards.cover(guards.unique_rows(out, [key]), universe, key)


def evidence_class(direct: Column, model: Column) -> Column:
    return F.when(direct & model, "BOTH").when(direct, "DIRECT").when(model, "MODEL").otherwise("NONE")


def left_with_defaults(rows: DataFrame, attributes: DataFrame, key: str, defaults: dict[str, object], status: str = "annotation_status") -> DataFrame:
    """Left join; absent attributes take their defaults and the status says available or missing."""
    joined_rows = rows.join(attributes.withColumn("_found", F.lit(True)), key, "left")
    return joined_rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()}).withColumn(status, F.when(F.col("_found"), "available").otherwise("missing")).drop("_found")
