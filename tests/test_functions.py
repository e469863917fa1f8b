"""Column functions on small, hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity as fs
from tessera.functions import text as fx


@pytest.fixture(scope="module")
def value(spark):
    row = spark.range(1)
    return lambda column: row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("made", "want"),
    [
        (lambda: fx.atomic_tokens(F.lit(" abc; Def|abc ;; ")), ["ABC", "DEF"]),
        (lambda: fx.atomic_tokens(F.lit(None)), []),
        (lambda: fx.identifiers(F.lit("a;B|a")), ["a", "B"]),
        (lambda: fx.split_genes(F.lit("b, a;b")), ["b", "a", "b"]),
        (lambda: fx.joined(F.array(F.lit("b"), F.lit(""), F.lit("a"), F.lit("b"), F.lit(None))), "a;b"),
        (lambda: fx.clean_label(F.lit("  A {ECO:1}  b ")), "A b"),
        (lambda: fx.normalized_label(F.lit("Isoform  B{x}")), "isoform b"),
        (lambda: fx.location_sections(F.lit("SUBCELLULAR LOCATION: A. Note=x; SUBCELLULAR LOCATION: B")), ["A. Note=x", "B"]),
        (lambda: fx.formal_part(F.lit("Cytoplasm. Note=Nucleus")), "Cytoplasm."),
        (lambda: fx.has_word(F.lit("Nucleus, x"), "Nucleus"), True),
        (lambda: fx.has_word(F.lit("nucleus Nucleuses"), "Nucleus"), False),
        (lambda: fx.section_tag(F.lit("[Isoform 2]: Nucleus")), "Isoform 2"),
        (lambda: fx.annotation_terms(F.lit("DNA  binding [GO:0003677]; dna binding;X")), ["dna binding", "x"]),
        (lambda: fx.annotation_terms(F.lit("aaaa1;aaaa2"), 4), ["aaaa"]),
        (lambda: fx.extract_ids(F.lit("PF1 x PF22;PF1"), r"PF\d+"), ["PF1", "PF22"]),
        (lambda: fx.decode_intervals(F.lit("1-5|7-9")), [(1, 5), (7, 9)]),
        (lambda: fx.encode_intervals(fx.decode_intervals(F.lit("1-5|7-9"))), "1-5|7-9"),
        (lambda: fx.cell_text(F.lit(" a|b\tc ")), "a/b c"),
        (lambda: fx.describe_paths(F.lit(None).cast("string"), F.lit("a"), F.lit("b"), default="none"), "a | b"),
        (lambda: fx.describe_paths(F.lit(None).cast("string"), default="none"), "none"),
        (lambda: fx.proximity(F.lit(3.0), 6), 0.5),
        (lambda: fx.proximity(F.lit(None).cast("double"), 6), 0.0),
        (lambda: fx.edge_label(F.lit(False), F.lit(True), F.lit(True)), "inhibits"),
        (lambda: fx.clean_sequence(F.lit("a b\nC")), "ABC"),
        (lambda: fx.strip_version(F.lit("ENS1.2")), "ENS1"),
        (lambda: fx.strip_isoform(F.lit("P1-2")), "P1"),
        (lambda: fx.number_or_null(F.lit(" ")), None),
        (lambda: fx.number_or_null(F.lit("1.5")), 1.5),
        (lambda: fx.distinct_ignoring_case(F.array(F.lit("Ab"), F.lit("aB "), F.lit("c"))), ["Ab", "c"]),
        (lambda: F.transform(fx.windows(F.lit("abcdefghij"), 4, 1), lambda w: w["window"]), ["abcd", "defg", "ghij"]),
        (lambda: F.transform(fx.windows(F.lit("abcdefghijk"), 4, 1), lambda w: w["window"]), ["abcd", "defg", "ghij", "jk"]),
        (lambda: F.transform(fx.windows(F.lit("ab"), 4, 1), lambda w: w["window"]), ["ab"]),
        (lambda: fx.windows(F.lit(""), 4, 1), []),
        (lambda: fx.limited_ends(F.lit("abcdefgh"), 4), "abgh"),
        (lambda: fs.kmer_set(F.lit("AAAB")), []),
        (lambda: fs.kmer_set(F.lit("ABCD")), ["ABCD"]),
        (lambda: fs.kmer_set(F.lit("ABC")), []),
        (lambda: fs.containment(F.array(F.lit(1)), F.array().cast("array<int>")), 0.0),
        (lambda: fs.jaccard(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))), pytest.approx(1 / 3)),
        (lambda: fs.length_ratio(F.lit(8), F.lit(10)), 0.8),
        (lambda: fs.interval_iou(_i(1, 50), F.lit(100.0), _i(26, 75), F.lit(100.0)), pytest.approx(0.25 / 0.75)),
        (lambda: fs.interval_iou(_i(1, 10), F.lit(100.0), _i(91, 100), F.lit(100.0)), 0.0),
        (lambda: fs.interval_iou(_i(1, 10), F.lit(0.0), _i(91, 100), F.lit(100.0)), 0.0),
        (lambda: fs.functional_pass(F.lit(0.0), F.lit(0), F.lit(1.0), F.lit(2), F.lit(0.62), F.lit(3)), (True, "first_set")),
    ],
)
def test_function(value, made, want):
    got = value(made())
    if isinstance(got, list) and got and isinstance(got[0], tuple):
        got = [tuple(x) for x in got]
    assert got == want


def _i(a, b):
    return F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))


def test_products(value):
    cell = "Name=1; IsoId=P1-1; Sequence=Displayed; Name=2; Synonyms=B {x}; IsoId=P1-2, P1-3; Sequence=VSP_1"
    one, two = value(fx.parse_products(F.lit(cell)))
    assert (one.name, one.synonyms, one.isoform_ids, one.displayed) == ("1", [], ["P1-1"], True)
    assert (two.name, two.synonyms, two.isoform_ids, two.displayed) == ("2", ["B"], ["P1-2", "P1-3"], False)
    assert value(fx.parse_products(F.lit(None))) == []


def test_signature(value):
    ids = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert tuple(value(fx.coarse_signature(ids("b", "a"), ids(), ("X", "Y")))) == ("X", "a;b")
    assert tuple(value(fx.coarse_signature(ids(), ids(), ("X", "Y")))) == ("NONE", "")


def test_architectures(spark):
    arch = "struct<status:string,source:string,ids:array<string>,intervals:array<struct<start:int,end:int>>,length:int>"
    a = ("available", "s", ["d"], [(1, 50)], 100)
    cases = [
        (a, a, "pass"), (a, None, "missing"), (a, ("missing", "s", ["d"], [(1, 50)], 100), "missing"), (a, ("available", "s", [], [], 100), "empty"),
        (a, ("available", "t", ["d"], [(1, 50)], 100), "source_mismatch"), (a, ("available", "s", ["e"], [(1, 50)], 100), "order_or_copy_mismatch"),
        (a, ("available", "s", ["d"], [(1, 50), (60, 70)], 100), "coordinate_count_mismatch"), (a, ("available", "s", ["d"], [(26, 75)], 100), "low_overlap"),
    ]
    df = spark.createDataFrame([(i, x, y) for i, (x, y, _) in enumerate(cases)], f"i int, l {arch}, r {arch}")
    got = {r.i: r.c.reason for r in df.select("i", fs.compare_architectures("l", "r").alias("c")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases)}
