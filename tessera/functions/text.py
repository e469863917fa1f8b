"""Column functions over annotation text: tokens, labels, sections, identifiers, lists. Null input counts as ''."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What full case folding does to letters beyond lower-casing them (sharp s, final sigma, ligatures, long s and so on): by Unicode's rule, not a list.
FOLDED = {c: folded for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and c.lower() == c and (folded := c.casefold()) != c}


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank(x: str | Column) -> Column:
    """Text with null as ''."""
    return F.coalesce(col(x).cast("string"), F.lit(""))


def _pieces(x: str | Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(blank(x), pattern), lambda t: F.trim(t)), lambda t: t != "")


def atomic_tokens(x: str | Column) -> Column:
    """Upper-cased distinct tokens of a cell separated by ';' or '|', in order of first appearance."""
    return F.array_distinct(F.transform(_pieces(x, r"[;|]"), F.upper))


def identifiers(x: str | Column) -> Column:
    """Distinct tokens of a cell separated by ';' or '|', case kept."""
    return F.array_distinct(_pieces(x, r"[;|]"))


def split_genes(x: str | Column) -> Column:
    """Tokens separated by ';', ',' or '|', with case, order and repeats."""
    return _pieces(x, r"[;,|]")


def joined(values: str | Column, sep: str = ";") -> Column:
    """Sorted distinct non-blank values of an array as one text."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(col(values), lambda t: t.isNotNull() & (F.trim(t) != "")))), sep)


def clean_label(x: str | Column) -> Column:
    """Without {...} spans, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(blank(x), r"\{[^}]*\}", ""), r"\s+", " "))


def normalized_label(x: str | Column) -> Column:
    """clean_label with case folded in full: lower case, and the letters whose folding is more than that replaced. Only texts that hold such a letter are looked at letter by letter."""
    low = F.lower(clean_label(x))
    table = F.create_map(*[F.lit(t) for pair in FOLDED.items() for t in pair])
    folded = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(low.rlike(f"[{''.join(FOLDED)}]"), folded).otherwise(low)


def parse_products(x: str | Column, keep_blank_ids: bool = False) -> Column:
    """'Name=..; Synonyms=..; IsoId=..; Sequence=..' records as structs (name, synonyms, isoform_ids, displayed)."""
    records = F.filter(F.split(blank(x), r"(?=Name=)"), lambda r: r.startswith("Name="))

    def field(record: Column, key: str) -> Column:
        return F.trim(F.regexp_extract(record, rf"(?:^|;\s*){key}=([^;]*)", 1))

    def ids(record: Column) -> Column:
        found = F.transform(F.split(field(record, "IsoId"), ","), lambda t: F.trim(t))
        return found if keep_blank_ids else F.filter(found, lambda t: t != "")

    return F.transform(
        records,
        lambda r: F.struct(
            clean_label(field(r, "Name")).alias("name"),
            F.filter(F.transform(F.split(field(r, "Synonyms"), ","), clean_label), lambda t: t != "").alias("synonyms"),
            ids(r).alias("isoform_ids"),
            (F.lower(field(r, "Sequence")) == "displayed").alias("displayed"),
        ),
    )


def location_sections(x: str | Column, heading: str = "SUBCELLULAR LOCATION:") -> Column:
    """The sections of a comment cell, each without its heading."""
    body = F.trim(F.regexp_replace(blank(x), rf"^\s*{heading}\s*", ""))
    return F.filter(F.transform(F.split(body, rf";\s*{heading}\s*"), lambda t: F.trim(t)), lambda t: t != "")


def formal_part(x: str | Column) -> Column:
    """What stands before the first 'Note='."""
    return F.trim(F.substring_index(blank(x), "Note=", 1))


def has_word(x: str | Column, word: str) -> Column:
    """Whether ``word`` stands in the text as a whole word, case-sensitive."""
    return blank(x).rlike(rf"\b{word}\b")


def section_tag(x: str | Column) -> Column:
    """The label of a section that begins with '[label]:', else ''."""
    return F.regexp_extract(blank(x), r"^\[([^\]]+)\]:", 1)


def annotation_terms(x: str | Column, longest: int = 180) -> Column:
    """Lower-cased terms of a ';' list without ' [GO:n]', distinct, cut to ``longest`` and distinct again (cut terms are one node)."""
    bare = F.transform(_pieces(F.regexp_replace(blank(x), r"\s*\[GO:\d+\]", ""), ";"), lambda t: F.lower(F.regexp_replace(t, r"\s+", " ")))
    return F.array_distinct(F.transform(F.array_distinct(bare), lambda t: F.substring(t, 1, longest)))


def extract_ids(x: str | Column, pattern: str) -> Column:
    """Distinct matches of a pattern (PF\\d+, IPR\\d+, GO:\\d+, R-HSA-\\d+ and the like) in order."""
    return F.array_distinct(F.regexp_extract_all(blank(x), F.lit(pattern), 0))


def coarse_signature(first: Column, second: Column, names: tuple[str, str]) -> Column:
    """(basis, signature) from two id families: the first that is not empty, its sorted ids; NONE and '' if both are."""
    text = lambda ids: F.array_join(F.array_sort(F.array_distinct(ids)), ";")
    pair = lambda basis, s: F.struct(basis.alias("basis"), s.alias("signature"))
    return F.when((F.size(first) > 0) & (F.size(second) > 0), pair(F.lit("+".join(names)), F.concat_ws("|", text(first), text(second)))).when(F.size(first) > 0, pair(F.lit(names[0]), text(first))).when(F.size(second) > 0, pair(F.lit(names[1]), text(second))).otherwise(pair(F.lit("NONE"), F.lit("")))


def encode_intervals(intervals: str | Column) -> Column:
    """array<struct<start,end>> as 's-e|s-e'."""
    return F.array_join(F.transform(col(intervals), lambda i: F.concat_ws("-", i["start"].cast("string"), i["end"].cast("string"))), "|")


def decode_intervals(x: str | Column) -> Column:
    """'s-e|s-e' as array<struct<start,end>>."""
    part = lambda t, i: F.try_element_at(F.split(t, "-"), F.lit(i)).try_cast("int")
    return F.transform(F.filter(F.split(blank(x), r"\|"), lambda t: t != ""), lambda t: F.struct(part(t, 1).alias("start"), part(t, 2).alias("end")))


def cell_text(x: str | Column) -> Column:
    """Safe inside a '|' list and a TSV line: '|' becomes '/', tabs and newlines a space, ends trimmed."""
    return F.trim(F.translate(blank(x), "|\t\r\n", "/   "))


def describe_paths(*pieces: Column, default: str) -> Column:
    """Pieces that are not null joined by ' | ', or the default text."""
    text = F.concat_ws(" | ", *pieces)
    return F.when(text == "", default).otherwise(text)


def proximity(distance: str | Column, limit: float) -> Column:
    """1 at distance 0, falling to 0 at ``limit``; 0 where missing."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - col(distance) / limit), F.lit(0.0))


def set_hash(values: str | Column) -> Column:
    """SHA-256 of the sorted distinct values, one to a line (for a bounded set; see quality.fingerprint for tables)."""
    return F.sha2(F.concat(F.array_join(F.array_sort(F.array_distinct(col(values))), "\n"), F.lit("\n")).cast("binary"), 256)


def edge_label(stimulation: Column, inhibition: Column, direction: Column) -> Column:
    """stimulates before inhibits before directs, else linked."""
    return F.when(stimulation, "stimulates").when(inhibition, "inhibits").when(direction, "directs").otherwise("linked")


def clean_sequence(x: str | Column) -> Column:
    """Upper-cased without white space."""
    return F.upper(F.regexp_replace(blank(x), r"\s", ""))


def strip_version(x: str | Column) -> Column:
    return F.substring_index(col(x), ".", 1)


def strip_isoform(x: str | Column) -> Column:
    return F.substring_index(col(x), "-", 1)


def number_or_null(x: str | Column) -> Column:
    """A number, or null where the cell is blank or is no number; never 0 for missing."""
    return F.trim(blank(x)).try_cast("double")


def distinct_ignoring_case(values: str | Column) -> Column:
    """Array values distinct by lower-cased trimmed text, the first spelling kept."""
    trimmed = F.filter(F.transform(col(values), lambda t: F.trim(t)), lambda t: t != "")
    return F.aggregate(
        trimmed,
        F.array().cast("array<string>"),
        lambda kept, t: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(t)), kept).otherwise(F.array_append(kept, t)),
    )


def windows(x: str | Column, size: int = 1022, overlap: int = 200, keep_tail: bool = True) -> Column:
    """Structs (start from 0, window) of a text by stride size - overlap; the last, shorter window is a policy."""
    text, stride = blank(x), size - overlap
    n = F.length(text)
    last = F.greatest(n - (overlap if keep_tail else size), F.lit(0)) if keep_tail else n - size
    starts = F.when(n > 0, F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last - 1 if keep_tail else last, F.lit(stride)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("window")))


def over_limit(x: str | Column, limit: int = 4000) -> Column:
    """Routing flag: whether a text is longer than a model takes, so that only its ends go in."""
    return F.length(blank(x)) > limit


def percent_text(x: str | Column, missing: str = "NA") -> Column:
    """A share as a percentage with one digit; a blank cell is missing, never 0."""
    n = number_or_null(x)
    return F.when(n.isNull(), missing).otherwise(F.format_string("%.1f%%", n * 100))


def distinct_terms(x: str | Column) -> Column:
    """Terms of a '|' list, trimmed and distinct, in order."""
    return F.array_distinct(_pieces(x, r"\|"))


def limited_ends(x: str | Column, limit: int = 4000) -> Column:
    """Texts over ``limit`` characters as their first and last half of it."""
    text, half = blank(x), limit // 2
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, half), F.right(text, F.lit(half)))).otherwise(text)
