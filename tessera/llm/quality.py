"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule measures a text; a document is rejected where the measure lies beyond the rule's cutoff. Cutoffs are
chosen for each stratum (language) on labelled documents: a candidate cutoff is certified if the exact binomial
probability of at most so many false rejections among the stratum's good labelled documents, were the true rate
``alpha`` / rules, is at most ``delta`` / (strata * rules). Candidates of a rule are tested from the most lenient
to the most severe and testing stops at the first that fails (fixed sequence), so only strata and rules need the
Bonferroni correction: with probability 1 - delta no stratum loses more than ``alpha`` of its good documents.
Good are documents that pass the base rule: what ``base_failed`` rejects is fixed by contract and outside the
guarantee. Labelled documents count as independent trials; copies of one text count each.
A rule without a certified cutoff rejects nothing in that stratum, nor does a stratum without labels.

A null text has no words (base_failed). A null language is the stratum 'und'. Rows with equal doc_id share the
label (good only if no label of the id is bad); labels with null id or quality are ignored. An empty table
gives an empty result; a table without labels gets no cutoffs. Further columns are carried through ``measures``
untouched, whatever their names, and ignored by ``quality_rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import staged, table

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: measure and its grid of candidate cutoffs; high values are bad
RULES = {
    "symbol_share": [round(0.01 * i, 2) for i in range(1, 31)],
    "shout_share": [round(0.01 * i, 2) for i in range(1, 31)],
    "upper_share": [round(0.05 * i, 2) for i in range(1, 19)],
    "dup_line_share": [round(0.05 * i, 2) for i in range(1, 20)],
    "repeat_share": [round(0.02 * i, 2) for i in range(1, 31)],
    "stutter_share": [round(0.02 * i, 2) for i in range(1, 31)],
    "word_length": [5.5 + 0.25 * i for i in range(30)],
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _runs(h: Column, step: int, n: Column) -> Column:
    """Hashes of runs twice as long: each hash with the one ``step`` later."""
    left = F.greatest(n - step, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), left), F.slice(h, F.lit(step + 1), left), lambda a, b: F.xxhash64(a, b))


def measures(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, stratum, the base measures and the rules' measures of every whole text; one pass, no shuffle.

    The columns ``carry`` come along as they are, in the struct ``carried``.

    Words in windows found twice: windows are hashed by doubling (1, 2, 4, 8 words). Only texts whose hashes
    repeat are sorted by (hash, place); each place beside an equal hash covers the words up to the next such
    place, eight at most.
    """
    text = F.coalesce("text", F.lit(""))
    along = ["carried"] if carry else []
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("und")).alias("stratum"), text.alias("t"), *([F.struct(*carry).alias("carried")] if carry else []))
    d = d.withColumn("w", F.array_remove(F.split("t", SPACE), ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", "stratum", *along,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("[!?]")).alias("n_shouts"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).alias("n_upper"),
        lines.alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h1"),
    )
    n = F.size("h1")
    d = d.select(
        *BASE[:3], "doc_id", "stratum", *along, "n_shouts", "n_upper",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(F.zip_with(F.slice("h1", 2, F.greatest(n - 1, F.lit(0))), F.slice("h1", F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)).alias("n_stutter"),
        _runs(F.col("h1"), 1, n).alias("h2"),
    )
    d = d.withColumn("h4", _runs(F.col("h2"), 2, F.size("h2"))).drop("h2")
    d = d.withColumn("h8", _runs(F.col("h4"), 4, F.size("h4"))).drop("h4")
    repeats = F.size(F.array_distinct("h8")) < F.size("h8")
    d = d.withColumn("s", F.when(repeats, F.sort_array(F.transform("h8", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("h8")
    beside = F.zip_with(
        F.col("s"),
        F.zip_with(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), "s"), lambda a, b: F.struct(a["h"].alias("after"), b["h"].alias("before"))),
        lambda own, x: F.when(own["h"].eqNullSafe(x["after"]) | own["h"].eqNullSafe(x["before"]), own["i"]),
    )
    d = d.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.filter(beside, lambda x: x.isNotNull())))).drop("s")
    gaps = F.zip_with(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.col("p"), lambda b, a: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.when(F.col("p").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda s, x: s + x)).cast("long")
    d = d.withColumn("n_repeat_words", covered).drop("p")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return d.select(
        "doc_id", "stratum", *along, *BASE,
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_shouts", "word_chars").alias("shout_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_stutter", "n_words").alias("stutter_share"),  # words equal to the one before
        share("word_chars", "n_words").alias("word_length"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, exact to about 1e-12."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    return series - sum((F.log(n + k) for k in range(1, 9)), F.lit(0.0))


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X ~ Bin(n, p) below the mean (1 at or above it): the term at k times the sum of the ratios to the terms before."""
    term = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(p) + (n - k) * F.log(1 - p)
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] * i * (1 - p) / (p * (n - i + 1))
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    below = F.reverse(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")))
    return F.when(k < n * p, F.least(F.exp(term) * F.aggregate(below, start, step, lambda a: a["s"]), F.lit(1.0))).otherwise(1.0)


def cutoffs(found: DataFrame, labels: DataFrame, alpha: float, delta: float, price: float = 5.0) -> DataFrame:
    """stratum, one column ``cut_<rule>`` each (null: none certified). A few rows: one for each stratum with labels.

    Among a rule's certified cutoffs, the one with the highest share of bad documents rejected less ``price``
    times the share of good ones; the more lenient one of equals, and none if that is not above zero.
    """
    spark = found.sparkSession
    judged = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    held = found.filter(~F.col("base_failed")).join(judged, "doc_id").withColumn("good", (F.col("quality") == 1).cast("int"))
    sizes = held.groupBy("stratum").agg(F.sum("good").alias("n"), (F.count("*") - F.sum("good")).alias("bad"))
    # each value falls behind the lenient cutoffs that it does not exceed, and is rejected by all after them
    grids = spark.createDataFrame([(m, sorted(g, reverse=True)) for m, g in RULES.items()], "rule string, grid array<double>")
    tall = held.select("stratum", "good", F.expr(f"stack({len(RULES)}, {', '.join(f'{m!r}, {m}' for m in RULES)}) as (rule, value)"))
    spared = F.size(F.filter("grid", lambda c: ~(F.col("value") > c)))
    counts = tall.join(F.broadcast(grids), "rule").groupBy("stratum", "rule", spared.alias("spared")).agg(F.sum("good").alias("k"), F.sum(1 - F.col("good")).alias("b"))
    cells = grids.select("rule", F.posexplode("grid").alias("at", "cut"))
    strata = sizes.select("stratum", "n", "bad", F.count("*").over(Window.partitionBy(F.lit(0))).alias("strata"))  # a row for each stratum
    every = strata.join(F.broadcast(cells)).join(counts, ["stratum", "rule"], "left")  # cells: the grids, fixed in size
    upto = lambda c: F.coalesce(F.sum(F.when(F.col("spared") <= F.col("at"), F.col(c))), F.lit(0)).alias(c)
    tests = every.groupBy("stratum", "n", "bad", "strata", "rule", "at", "cut").agg(upto("k"), upto("b"))
    passed = binomial_cdf(F.col("k"), F.col("n"), F.lit(alpha / len(RULES))) <= F.lit(delta / len(RULES)) / F.col("strata")
    ends = F.min(F.when(~passed, F.col("at"))).over(Window.partitionBy("stratum", "rule"))
    gain = F.coalesce(F.try_divide(F.col("b"), F.col("bad")), F.lit(0.0)) - price * F.coalesce(F.try_divide(F.col("k"), F.col("n")), F.lit(0.0))
    certified = tests.withColumn("end", ends).filter("end is null or at < end").withColumn("gain", gain).filter("gain > 0")
    best = certified.groupBy("stratum", "rule").agg(F.max_by("cut", F.struct("gain", -F.col("at"))).alias("cut"))
    return best.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cut")).withColumnsRenamed({m: f"cut_{m}" for m in RULES})


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.1, delta: float = 0.05, carry: tuple[str, ...] = ()) -> DataFrame:
    """Measures, base_failed and the verdict ``kept`` of every document, with the columns ``carry`` in the struct ``carried``."""
    found = staged(measures(docs, carry), "measures")
    limits = cutoffs(found, labels, alpha, delta)
    if carry:  # whole texts stay where they are; a row for each stratum with labels
        limits = F.broadcast(limits)
    rejected = F.array_compact(F.array(*[F.when(F.col(m) > F.col(f"cut_{m}"), F.lit(m)) for m in RULES]))
    judged = found.join(limits, "stratum", "left").withColumn("rejected_by", rejected)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop(*[f"cut_{m}" for m in RULES])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def _grid_sql() -> str:
    one = "select '{0}' as rule, {1} as place, unnest(range({2})) as nr, unnest(cast({3} as double[])) as cut"
    return " union all ".join(one.format(m, i, len(g), sorted(g, reverse=True)) for i, (m, g) in enumerate(RULES.items()))


_NAMES = ", ".join(f"'{m}'" for m in RULES)
#: The same rows from DuckDB: measures from their definitions, cutoffs by exact binomial sums.
OP2_SQL = f"""with d as (select doc_id, coalesce(lang, 'und') as stratum, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
starts as (select doc_id, unnest(range(1, len(ws) - 6)) as i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + {WINDOW - 1}], ' '))) as s from w where len(ws) >= {WINDOW}),
windows as (select doc_id, i, count(*) over (partition by doc_id, s) as times from starts),
covered as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + {WINDOW})) as j from windows where times > 1) t group by 1),
m as (select w.doc_id, stratum, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  length(regexp_replace(t, '[^!?]', '', 'g')) as n_shouts, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) as n_upper, len(ls) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
  coalesce(n, 0) as n_repeat_words, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) as n_stutter from w left join covered on w.doc_id = covered.doc_id),
x as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, coalesce(n_symbols / nullif(word_chars, 0), 0.0) as symbol_share, coalesce(n_shouts / nullif(word_chars, 0), 0.0) as shout_share,
  coalesce(n_upper / nullif(word_chars, 0), 0.0) as upper_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0.0) as dup_line_share, coalesce(n_repeat_words / nullif(n_words, 0), 0.0) as repeat_share,
  coalesce(n_stutter / nullif(n_words, 0), 0.0) as stutter_share, coalesce(word_chars / nullif(n_words, 0), 0.0) as word_length from m),
v as (select doc_id, stratum, base_failed, unnest([{_NAMES}]) as rule, unnest([{", ".join(RULES)}]) as value from x),
judged as (select doc_id, cast(min(quality) = 1 as int) as good from labels where doc_id is not null and quality is not null group by 1),
held as (select v.*, good from v join judged using (doc_id) where not base_failed),
sizes as (select stratum, sum(good) as n, count(*) - sum(good) as bad, count(*) over () as strata from (select distinct doc_id, stratum, good from held) t group by 1),
grid as ({_grid_sql()}),
tests as (select stratum, n, bad, strata, rule, place, nr, cut, count(*) filter (where good = 1 and value > cut) as k, count(*) filter (where good = 0 and value > cut) as b from sizes join held using (stratum) join grid using (rule) group by all),
chances as (select *, case when k < n * {0.1 / len(RULES)!r} then list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({0.1 / len(RULES)!r}) + (n - i) * ln(1 - {0.1 / len(RULES)!r})))) else 1.0 end <= {0.05 / len(RULES)!r} / strata as passed from tests),
certified as (select *, min(nr) filter (where not passed) over (partition by stratum, rule) as stop, coalesce(b / nullif(bad, 0), 0) - 5.0 * coalesce(k / nullif(n, 0), 0) as gain from chances),
best as (select stratum, rule, place, cut from (select *, row_number() over (partition by stratum, rule order by gain desc, nr) as nth from certified where (stop is null or nr < stop) and gain > 0) t where nth = 1),
hits as (select doc_id, string_agg(rule, ',' order by place) as rejected_by from v join best using (stratum, rule) where value > cut group by 1)
select x.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rejected_by is null as kept, coalesce(rejected_by, '') as rejected_by from x left join hits on x.doc_id = hits.doc_id"""
