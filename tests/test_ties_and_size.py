"""Ties that the SQL leaves to the order of rows, and steps whose work must not grow with the square of the input."""

import pathlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import plans
from tessera.functions import similarity as fs
from tessera.operators import evidence, sensitivity, similarity
from tessera.plans import catalog
from tessera.sources import io


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_of_mapping_rows_of_one_place_the_first_of_the_table_wins(spark, tmp_path):
    mapping = spark.createDataFrame([(1, 7, 9, 3), (1, 8, 9, 1), (1, 9, 9, 2), (2, 5, 1, 4)], "old long, new long, at long, row long")
    edges = spark.createDataFrame([(1, 2)], "a long, b long")
    assert rows(evidence.map_both_ends(edges, "a", "b", mapping, "old", "new", "at", F.asc("row"))[0]) == [(8, 5)]
    lines = [(0, 1, 6, 16846, 41.0), (0, 2, 6, 6846, 21.0), (1, 1, 2, 7, 50.0), (1, 1, 6, 6846, 50.0), (1, 2, 6, 26846, 30.0)]
    df = spark.createDataFrame(lines, "file int, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double")
    df.repartitionByRange(2, "file").drop("file").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(catalog.QUERIES["map_both_ends"](spark, str(tmp_path)), "a", "b", "pos") == [(6846, 16846, 2), (16846, 6846, 1)]


TEXTS = ["large ring", "large rings", "hot bolt", "hot bolts", "", None]


def parts(spark, copies):
    """Rows of few texts; every ninth id stands twice, once with another text."""
    found = [(i if n == 0 else i - 1, TEXTS[i % 6], "s") for i in range(6 * copies) for n in range(2 if i % 9 == 8 else 1)]
    return spark.createDataFrame(found, "id long, t string, s string").select("*", F.length("t").alias("n"), fs.kmer_set("t").alias("k"))


def listed(df):
    return rows(similarity.candidate_pairs(df, "id", "s", "n", "k"), "left_id", "right_id", "containment", "left_length", "right_length")


def test_edges_of_classes_are_counted_as_if_listed(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    formed = []
    for copies in (4, 12):
        df = parts(spark, copies)
        own = df.collect()
        near = lambda a, b: min(a.n, b.n) >= 0.8 * max(a.n, b.n) and len(set(a.k) & set(b.k)) / min(len(a.k), len(b.k)) >= 0.08
        known = [r for r in own if r.k]
        want = sorted((a.id, b.id) for a in known for b in known if a.id < b.id and near(a, b))
        found = listed(df)
        assert [r[:2] for r in found] == want
        pairs, members = similarity.candidate_classes(df, "id", "s", "n", "k")
        edges = similarity.class_edges(pairs, members)
        formed.append(edges.count())
        assert edges.agg(F.sum("n_edges")).first()[0] == len(want)
        cells = sensitivity.grid(spark, least=[0.1, 0.9, 1.0, 1.1])
        got = rows(sensitivity.threshold_grid(edges, cells, {"least": "containment"}, members=members))
        passing = {t: [r[:2] for r in found if r[2] >= t] for t in (0.1, 0.9, 1.0, 1.1)}
        assert got == sorted((t, len(p), len({i for r in p for i in r})) for t, p in passing.items())
        assert sorted({r[0] for r in rows(similarity.class_ends(edges, members, "containment").filter("id < hi"), "id")}) == sorted({r[0] for r in want})
    assert formed[0] == formed[1]  # pairs of classes, not of rows


def test_a_class_of_one_id_has_no_edge(spark):
    df = spark.createDataFrame([(1, "large ring", "s"), (1, "large ring", "s")], "id long, t string, s string").select("*", F.length("t").alias("n"), fs.kmer_set("t").alias("k"))
    assert listed(df) == []
    edges = similarity.class_edges(*similarity.candidate_classes(df, "id", "s", "n", "k"))
    assert edges.count() == 0


def test_alignments_of_classes_are_those_of_their_rows(spark):
    df = parts(spark, 3).filter("t is not null").dropDuplicates(["id"])
    pairs, members = similarity.candidate_classes(df, "id", "s", "n", "k", also=("t",))
    found = similarity.directed_alignment(similarity.member_pairs(similarity.align_classes(pairs, "t"), members))
    text = lambda s: df.select(F.col("id").alias(f"{s}_id"), F.col("t").alias(f"{s}_text"))
    plain = similarity.candidate_pairs(df, "id", "s", "n", "k").join(text("left"), "left_id").join(text("right"), "right_id")
    names = [c.split()[0] for c in similarity.ALIGNED.split(", ")]
    assert rows(found, *names) == rows(similarity.align_pairs(plain), *names) != []


def test_evidence_is_formed_by_sets_of_tokens(spark, monkeypatch):
    """A candidate whose key brings an anchor that its tokens lack, one without tokens, and one without evidence."""
    monkeypatch.setattr(similarity, "BLOCK", 2)
    tokens = [(c, t) for c, ts in {1: "AB", 2: "AB", 3: "AB", 4: "", 5: "Z", 6: "A", 90: "A", 91: "B"}.items() for t in ts]
    frame = spark.createDataFrame
    cand, t = frame([(c,) for c in (1, 2, 3, 4, 5)], "candidate long"), frame(tokens, "candidate long, token string")
    by_token = frame([("A", 10), ("B", 10), ("B", 11)], "token string, anchor long")
    by_key = frame([(2, 10, 47.0), (4, 12, 48.0), (90, 10, 46.0), (91, 13, 45.0)], "partner long, anchor long, score double")
    found = evidence.class_evidence(cand, t, by_token, by_key)
    pairs = rows(evidence.evidence_pairs(found), "candidate", "anchor", "has_s1", "has_s2", "modes", "scores", "best_score")
    shared = [(10, 1, 1, "PROPAGATED;TOKEN", "46.000000;47.000000", 47.0), (11, 1, 0, "TOKEN", "", None), (13, 0, 1, "PROPAGATED", "45.000000", 45.0)]
    keyed = [(10, 1, 1, "EXACT;PROPAGATED;TOKEN", "46.000000;47.000000", 47.0), *shared[1:]]
    assert pairs == [(1, *r) for r in shared] + [(2, *r) for r in keyed] + [(3, *r) for r in shared] + [(4, 12, 0, 1, "EXACT", "48.000000", 48.0)]
    got = rows(evidence.evidence_candidates(cand, found), "candidate", "n_s1", "n_s2", "n_anchors", "modes", "anchors", "category", "passed")
    both = (2, 2, 3, "PROPAGATED", "10;11;13", "BOTH", "yes")
    assert got == [(1, *both), (2, 2, 2, 3, "EXACT;PROPAGATED", "10;11;13", "BOTH", "yes"), (3, *both), (4, 0, 1, 1, "EXACT", "12", "S2_ONLY", "yes"), (5, 0, 0, 0, "", "", "NONE", "no")]
    assert found.found.count() == 3  # for one set of tokens, not for three candidates
    assert rows(evidence.keyed_candidates(cand, t, by_key)) == [(1,), (2,), (3,), (4,)]


def test_documents_are_dealt_by_their_number_and_read_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "TASK_DOCUMENTS", 5)
    docs = spark.range(40).coalesce(1).select(F.to_json(F.struct("id", F.array(F.col("id")).alias("results"))).alias("value"))
    io.write_json_documents(docs, f"{tmp_path}/json")
    files = [f.name for f in (tmp_path / "json").glob("part-*")]
    assert len(files) == 40 and len({f.split("-")[1] for f in files}) > 4
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("results", T.ArrayType(T.LongType())), T.StructField("missing", T.StringType())])
    assert sorted(r.id for r in io.read_json_documents(spark, f"{tmp_path}/json", schema).collect()) == list(range(40))
    with pytest.raises(Exception, match="lacks missing"):
        io.read_json_documents(spark, f"{tmp_path}/json", schema, "missing").collect()


@pytest.mark.parametrize("module", ["gates", "formats"])
def test_no_table_is_dealt_to_a_fixed_number_of_tasks(module):
    """A share of a table in each of three tasks grows with the table."""
    source = (pathlib.Path(plans.__file__).parent / f"{module}.py").read_text()
    for name in {"gates": ["def frozen_tables", "def manifest_check"], "formats": ["def exported_files"]}[module]:
        assert not re.search(r"repartition\(\d+\)", source.split(name)[1].split("\n@query")[0])


def test_sets_meet_by_as_many_members_as_they_must_share(spark, monkeypatch):
    """Sets up to six members meet by three of them, larger ones by one; no pair is lost, and few others are formed."""
    monkeypatch.setattr(similarity, "WIDE", 6)
    random = np.random.default_rng(8)
    sets = {i: set(random.choice(12, random.integers(1, 9), replace=False).tolist()) for i in range(60)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, s array<long>")
    blocks = spark.createDataFrame([(i, i % 2) for i in sets], "id long, k int")
    got = set(rows(similarity.prefix_pairs(similarity.set_members(df, "id", ["s"]), "id", blocks, ["k"], 0.25, 3)))
    shared = {(i, j): len(sets[i] & sets[j]) for i in sets for j in sets if i < j and i % 2 == j % 2}
    assert {p for p, n in shared.items() if n >= 3 and n >= 0.25 * len(sets[p[0]] | sets[p[1]])} <= got
    assert all(shared[p] >= 3 for p in got if max(len(sets[i]) for i in p) <= 6)


def test_every_part_is_a_candidate(spark, tmp_path):
    """Parts of any size are looked at, not those over 45 alone: 1 is the anchor, 2 its partner, 3 shares a word with 2."""
    parts = [(1, "red bolt", 1), (2, "hot ring", 20), (3, "hot rod", 46), (4, "hot gear", 45), (5, "old plate", 50)]
    spark.createDataFrame([(k, n, "B", s) for k, n, s in parts], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, 1, 1, 7, 50.0), (1, 2, 2, 7, 10.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = rows(catalog.QUERIES["evidence_candidates"](spark, str(tmp_path)), "candidate", "anchors", "category", "modes")
    found = {2: "EXACT;PROPAGATED", 3: "PROPAGATED", 4: "PROPAGATED"}
    assert got == [(k, "1" if k in found else "", "BOTH" if k in found else "NONE", found.get(k, "")) for k in range(1, 6)]


def test_a_link_meets_a_level_by_any_of_its_rows(spark, tmp_path):
    """Part 2 is 1's partner at 40 first and at 50 later, 3 at 30 and then at 46; parts of every size are compared."""
    parts = [(1, "red bolt", 1), (2, "hot ring", 50), (3, "old rod", 50), (4, "old gear", 10), (5, "new plate", 50)]
    spark.createDataFrame([(k, n, "B", s) for k, n, s in parts], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(o, n, p, 7, q) for o, p, first in ((1, 2, 40.0), (2, 2, 50.0), (3, 3, 30.0), (4, 3, 46.0)) for n, p, q in ((1, 1, first), (2, p, 1.0))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = rows(catalog.QUERIES["level_comparison"](spark, str(tmp_path)), "candidate", "level")
    assert got == [(1, "PASS_NEITHER"), (2, "PASS_BOTH"), (3, "PASS_WIDE_ONLY"), (4, "PASS_WIDE_ONLY"), (5, "PASS_NEITHER")]


def test_candidates_by_counts_lose_no_pair_that_passes(spark):
    """Sets with many and few values in common, some by brands alone, against all pairs."""
    random = np.random.default_rng(5)
    draw = lambda most, n: sorted(set(random.choice(most, n).tolist()))
    sets = {i: (draw(30, random.integers(1, 4)), draw(40, random.integers(1, 4)), draw(6, random.integers(1, 6))) for i in range(80)}
    sets |= {80 + i: (draw(60, 25), draw(60, 25), list(range(6))) for i in range(20)}
    df = spark.createDataFrame([(i, *s) for i, s in sets.items()], "id long, suppliers array<long>, parts array<long>, brands array<long>")
    heavy = {b: 1.0 + b / 2 for b in range(6)}
    weights = spark.createDataFrame([(f"brands:{b}", w) for b, w in heavy.items()], "member string, weight double")
    blocks = spark.createDataFrame([(i, i % 2) for i in sets], "id long, k int")
    got = set(rows(similarity.functional_candidates(df, "id", blocks, ["k"], "suppliers", "parts", "brands", weights)))
    jaccard = lambda a, b: len(a & b) / len(a | b)
    want, alone = set(), 0
    for i, j in ((i, j) for i in sets for j in sets if i < j and i % 2 == j % 2):
        (s, p, b), (t, q, c) = (tuple(map(set, sets[x])) for x in (i, j))
        weigh = lambda sp, x: len(sp) + sum(heavy[y] for y in x)
        common = [("s", x) for x in s & t] + [("p", x) for x in p & q]
        every = [("s", x) for x in s | t] + [("p", x) for x in p | q]
        by_weight = weigh(common, b & c) / weigh(every, b | c) >= 0.25 and len(common) + len(b & c) >= 3
        if (jaccard(s, t) >= 0.5) or (jaccard(p, q) >= 0.5 and len(p & q) >= 2) or by_weight:
            want.add((i, j))
            alone += not common
    assert want <= got and alone and len(got) < len(sets) * (len(sets) - 2) / 4
    assert not [p for p in got - want if min(p) >= 80 and len(set(sets[p[0]][0]) & set(sets[p[1]][0])) + len(set(sets[p[0]][1]) & set(sets[p[1]][1])) < 5]


def test_customers_are_compared_by_all_their_lines(spark, tmp_path):
    """Lines of any quantity count, not those of 49 or more alone."""
    write = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(k, 1, "A") for k in (1, 2, 3)], "c_custkey long, c_nationkey int, c_mktsegment string", "customer")
    write([(k, k) for k in (1, 2, 3)], "o_orderkey long, o_custkey long", "orders")
    write([(k, f"B{k}") for k in range(6)], "p_partkey long, p_brand string", "part")
    write([(1, 0, 0, 3.0), (1, 1, 1, 50.0), (2, 0, 0, 48.0), (2, 2, 2, 50.0), (3, 5, 5, 50.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double", "lineitem")
    assert rows(catalog.QUERIES["function_similarity"](spark, str(tmp_path)), "left_id", "right_id", "shared_all") == [(1, 2, 3)]


def counted_stages(monkeypatch, module):
    """The rows of each table that a module stages, by name."""
    found, real = {}, module.staged
    monkeypatch.setattr(module, "staged", lambda df, name: (out := real(df, name), found.update({name: out.count()}))[0])
    return found


def test_units_of_pairs_do_not_grow_with_the_pairs(spark, monkeypatch):
    """With four times the rows there are as many units of two blocks, so rows are sent as often as before; each two rows meet once."""
    monkeypatch.setattr(similarity, "BLOCK", 2)
    found, units = counted_stages(monkeypatch, similarity), []
    for n in (40, 160):
        df = spark.range(2 * n).select((F.col("id") % 2).alias("class"), "id")
        pairs = spark.createDataFrame([(0, 1), (1, 1)], "a long, b long")
        got = rows(similarity.member_pairs(pairs, df), "row_a.id", "row_b.id")
        assert len(got) == n * n + n * (n - 1) // 2 == len({frozenset(r) for r in got})
        units.append(found["units"])
    assert units[1] <= units[0] + 8


def test_a_list_is_sent_once_for_many_candidates(spark, monkeypatch):
    """Twelve candidates of one set of tokens get the list of its anchors by one unit, not one for each block of rows."""
    monkeypatch.setattr(similarity, "BLOCK", 2)
    cand = spark.range(12).select(F.col("id").alias("candidate"))
    t = cand.select("candidate", F.lit("A").alias("token"))
    by_token = spark.createDataFrame([("A", 30), ("A", 31)], "token string, anchor long")
    by_key = spark.createDataFrame([(40, 30, 47.0)], "partner long, anchor long, score double")
    found = counted_stages(monkeypatch, similarity)
    got = rows(evidence.evidence_candidates(cand, evidence.class_evidence(cand, t, by_token, by_key)), "candidate", "anchors")
    assert got == [(i, "30;31") for i in range(12)] and found["units"] == 1
