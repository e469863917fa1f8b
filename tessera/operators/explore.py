"""Explorer queries: search, facets, pair graphs, unique pairs, neighbours, density bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import joined


def search(rows: DataFrame, text: str, columns: list[str], facets: dict[str, object] | None = None) -> DataFrame:
    """Rows whose columns, joined by spaces, contain the text in any case, and whose facets equal the given values."""
    hay = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    out = rows.filter(hay.contains(text.lower())) if text else rows
    for c, v in (facets or {}).items():
        out = out.filter(F.col(c) == v)
    return out


def top_with_total(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows by order with the number of all rows as ``total``."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(k).join(F.broadcast(total))  # total: one row


def facet_counts(rows: DataFrame, predicates: dict[str, Column], by: str | None = None) -> DataFrame:
    """One pass: a count for each predicate, for the whole table or by a group."""
    counts = [F.count_if(F.coalesce(p, F.lit(False))).alias(n) for n, p in predicates.items()]
    return (rows.groupBy(by) if by else rows).agg(F.count("*").alias("total"), *counts)


def pair_filter(rows: DataFrame, evidence: str, needs: str | None = None, score: str | None = None, least: float | None = None) -> DataFrame:
    """Rows whose evidence text contains ``needs`` and whose score, where there is one, is at least ``least``; a missing score never passes a score filter."""
    out = rows if needs is None else rows.filter(F.col(evidence).contains(needs))
    return out if score is None or least is None else out.filter(F.col(score).isNotNull() & (F.col(score) >= least))


def extension_filter(rows: DataFrame, route: str | None = None, kind: str | None = None, text: str = "", columns: list[str] | None = None) -> DataFrame:
    """Extended candidates of a route, with a kind of functional support (event, first_set: it has shared ids; weighted: the reason says so), and a search text.

    rows: route, shared_event_ids, shared_first_ids, reason, and the columns searched.
    """
    out = rows if route is None else rows.filter(F.col("route") == route)
    holds = {"event": F.coalesce("shared_event_ids", F.lit("")) != "", "first_set": F.coalesce("shared_first_ids", F.lit("")) != "", "weighted": F.col("reason").contains("weighted")}
    out = out if kind is None else out.filter(holds[kind])
    return search(out, text, columns or [])


def pair_graph_edges(rows: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """One edge for each unordered pair: n_rows and its sorted distinct labels."""
    return rows.groupBy(F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id")).agg(F.count("*").alias("n_rows"), joined(F.collect_set(F.col(label).cast("string"))).alias("labels"))


def pair_graph_nodes(rows: DataFrame, candidate: str, anchor: str) -> DataFrame:
    """id, kind (candidate, anchor or both) and degree over distinct unordered pairs."""
    kinds = rows.select(F.col(candidate).alias("id"), F.lit(1).alias("c"), F.lit(0).alias("a")).union(rows.select(anchor, F.lit(0), F.lit(1)))
    kind = kinds.groupBy("id").agg(F.max("c").alias("c"), F.max("a").alias("a"))
    pairs = rows.select(F.least(candidate, anchor).alias("l"), F.greatest(candidate, anchor).alias("r")).distinct()
    degree = pairs.select(F.explode(F.array_distinct(F.array("l", "r"))).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    said = F.when((F.col("c") == 1) & (F.col("a") == 1), "both").when(F.col("c") == 1, "candidate").otherwise("anchor")
    return kind.join(degree, "id").select("id", said.alias("kind"), "degree")


def unique_pairs(rows: DataFrame, a: str, b: str, order: str, alias: str) -> DataFrame:
    """One row for each unordered pair: its first row's ends, the number of rows, and all aliases sorted."""
    first = F.min_by(F.struct(F.col(a).alias("first_a"), F.col(b).alias("first_b")), order)
    return rows.groupBy(F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id")).agg(first.alias("_f"), F.count("*").alias("n_rows"), joined(F.collect_set(F.col(alias).cast("string"))).alias("aliases")).select("left_id", "right_id", "_f.*", "n_rows", "aliases")


def default_focus(nodes: DataFrame) -> DataFrame:
    """The node of highest degree that is no anchor, the least id of equals."""
    return nodes.filter("kind <> 'anchor'").orderBy(F.desc("degree"), "id").limit(1)


def partners(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """The edges at the focus ids, from their side: focus, partner, n_rows, labels."""
    two = edges.select(F.col("left_id").alias("id"), F.col("right_id").alias("partner"), "n_rows", "labels").union(edges.filter("left_id <> right_id").select("right_id", "left_id", "n_rows", "labels"))
    return two.join(focus.select("id").distinct(), "id", "left_semi")


def evidence_of(rows: DataFrame, keys: DataFrame, key: str, candidate: str, anchor: str) -> DataFrame:
    """(key, candidate, anchor) of every pair in which a key is candidate or anchor; two equi joins, each pair once for a key."""
    k = keys.select(F.col(key).alias("key")).distinct()
    one = rows.join(k, F.col(candidate) == F.col("key"))
    two = rows.filter(F.col(candidate) != F.col(anchor)).join(k, F.col(anchor) == F.col("key"))
    return one.union(two)


def sibling_comparison(rows: DataFrame, parent: str, key: str, size: str, first: int = 12) -> DataFrame:
    """The first rows of each parent by key, with their size as a share of the parent's largest; a parent's children must be bounded."""
    by = W.partitionBy(parent)
    return rows.withColumn("share", F.col(size) / F.max(size).over(by)).withColumn("nth", F.row_number().over(by.orderBy(key))).filter(F.col("nth") <= first)


def child_counts(rows: DataFrame, parent: str, key: str, positive: Column) -> DataFrame:
    """parent, n_children, n_positive, positive_ids (sorted)."""
    return rows.groupBy(parent).agg(F.count("*").alias("n_children"), F.count_if(positive).alias("n_positive"), joined(F.collect_set(F.when(positive, F.col(key).cast("string")))).alias("positive_ids"))


def density_bins(rows: DataFrame, x: str, y: str, size: float, kinds: dict[str, Column]) -> DataFrame:
    """cell_x, cell_y, total and a count for each kind."""
    counts = [F.count_if(p).alias(n) for n, p in kinds.items()]
    return rows.groupBy(F.floor(F.col(x) / size).cast("long").alias("cell_x"), F.floor(F.col(y) / size).cast("long").alias("cell_y")).agg(F.count("*").alias("total"), *counts)


def with_peak(bins: DataFrame, total: str = "total") -> DataFrame:
    """bins with ``peak``, the largest total of any cell: what a colour scale ends at."""
    return bins.join(F.broadcast(bins.agg(F.max(total).alias("peak"))))  # one row


def in_box(rows: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows inside (x0, y0, x1, y1), edges included."""
    return rows.filter(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3]))


def text_difference(a: Column, b: Column) -> Column:
    """Struct (prefix, suffix, left_middle, right_middle): lengths of the longest equal head and non-overlapping tail, and what differs.

    Both are found by bisection on prefix equality, so the cost is a few substring comparisons.
    """
    n = F.least(F.length(a), F.length(b))

    def longest(limit: Column, same) -> Column:  # noqa: ANN001
        start = F.struct(F.lit(0).alias("lo"), limit.alias("hi"))

        def step(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
            ok = same(mid)
            return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(ok, mid).otherwise(s["lo"]).alias("lo"), F.when(ok, s["hi"]).otherwise(mid - 1).alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step, lambda s: s["lo"])

    prefix = longest(n, lambda m: F.substring(a, F.lit(1), m) == F.substring(b, F.lit(1), m))
    return F.transform(
        F.array(F.struct(a.alias("a"), b.alias("b"), prefix.alias("p"))),
        lambda s: F.struct(s["p"].alias("prefix"), longest(F.least(F.length(s["a"]), F.length(s["b"])) - s["p"], lambda m: F.right(s["a"], m) == F.right(s["b"], m)).alias("suffix")),
    )[0]
