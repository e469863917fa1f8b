"""Operators on small, hand-computed tables."""

import json
import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import evaluation, evidence, explore, features, graph, partition, quality, rank, scoring, sensitivity, similarity
from tessera.sources import io, tables


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_exclusion(spark):
    r = spark.createDataFrame([("k1", "A;B"), ("k2", "C"), ("k3", "D"), ("k4", None)], "k string, c string")
    a = spark.createDataFrame([("k2", "X"), ("k9", "b")], "k string, c string")
    got = {x.k: x for x in partition.anchor_exclude(r, "k", "c", a, "k", "c").collect()}
    assert {k: v.excluded for k, v in got.items()} == {"k1": True, "k2": True, "k3": False, "k4": False}
    assert got["k1"].token_hits == ["B"] and got["k1"].reasons == "token:B" and got["k2"].reasons == "key"
    assert partition.anchor_exclude(r.limit(0), "k", "c", a, "k", "c").count() == 0


def test_scope(spark):
    s = spark.createDataFrame([("e", "[Isoform 2]: Nucleus. Note=x"), ("f", "Cytoplasm. Note=Nucleus in stress"), ("g", "Nucleus"), ("h", "[Other]: Nucleus")], "e string, t string")
    p = spark.createDataFrame([("e", "isoform 2", ["P1-2", "P1-3"], False), ("e", "1", ["P1-1"], True)], "e string, name string, isoform_ids array<string>, displayed boolean")
    assert rows(partition.classify_scope(s, "e", "t", p, "e", "Nucleus")) == [("e", 0, "P1-2;P1-3", ""), ("g", 1, "", ""), ("h", 0, "", "other")]


VALUES = [3.0, None, 1.0, 3.0, 0.0, 2.0, None]


def test_percentiles(spark):
    df = spark.createDataFrame(list(enumerate(VALUES)), "i int, x double")
    got = lambda d, n: [r[n] for r in sorted(d.collect(), key=lambda r: r.i)]
    assert got(rank.beneficial_percentile(df, "x", "p", True, True), "p") == pytest.approx([1, 0, 0.5, 1, 0, 4 / 6, 0])
    assert got(rank.beneficial_percentile(df, "x", "p", False), "p") == pytest.approx([0.5, 0, 5 / 6, 0.5, 1, 4 / 6, 0])
    assert got(rank.positive_percentile(df, "x", "p"), "p") == pytest.approx([1, 0, 4 / 7, 1, 0, 5 / 7, 0])
    assert got(rank.rank_percentile(df, "x", "p"), "p") == pytest.approx([1, 1 / 6, 0.5, 1, 2 / 6, 4 / 6, 1 / 6])
    one = df.limit(1)
    assert got(rank.beneficial_percentile(one, "x", "p"), "p") == [1.0]
    assert rank.beneficial_percentile(df.limit(0), "x", "p").count() == 0


def test_order_and_top(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("k"))
    got = rank.ordered_index(df, F.desc("k"), F.asc("id")).collect()
    want = {i: n for n, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 7), i)), 1)}
    assert {r.id: r.position for r in got} == want
    assert rank.top_fraction(rank.ordered_index(df, F.asc("id")), 0.0201).count() == 21
    assert math.ceil(13_275 * 0.02) == 266
    assert rank.systematic_sample(df, [F.asc("id")], 32).count() == 32
    assert rank.systematic_sample(df.limit(5), [F.asc("id")], 32).count() == 5
    running = rank.ordered_index(df.groupBy("k").count(), F.asc("k"), name="s", amount=F.col("count"))
    assert max(r.s for r in running.collect()) == 1000


def test_first_and_last_win(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "k string, n int, v string")
    assert rows(rank.first_per_key(df, ["k"], [F.asc("n")]), "k", "v") == [("a", "x"), ("b", "z")]
    assert rows(rank.first_per_key(df, ["k"], [F.desc("n")]), "k", "v") == [("a", "y"), ("b", "z")]


def test_term_graph(spark):
    pairs = spark.createDataFrame([("s", "t1"), ("a", "t1"), ("a", "t2"), ("b", "t2")], "entity string, term string")
    seeds = spark.createDataFrame([("s",)], "entity string")
    terms = graph.term_statistics(pairs, seeds)
    w = 1 + math.log(3) / math.log(4)
    assert {r.term: r.weight for r in terms.collect()} == pytest.approx({"t1": w, "t2": w})
    assert {r.entity: r.distance for r in graph.seed_distance(pairs, terms, seeds).collect()} == pytest.approx({"s": 0, "a": 2 * w})
    many = spark.createDataFrame([("x", "t"), ("s", "t"), ("o1", "t"), ("o2", "t")] + [(f"e{i}", f"u{i}") for i in range(5)], "entity string, term string")
    shared = graph.shared_seed_weight(many, graph.term_statistics(many, seeds)).filter("entity = 'x'").first().shared
    assert shared == pytest.approx(1 / 3 * math.log(10 / 4))


def test_directed_graph(spark):
    steps = spark.createDataFrame([("a", "b", 1), ("b", "s", 2), ("a", "a", 3), ("c", "d", 4), ("a", "b", 9)], "x string, y string, n int")
    edges = graph.directed_edges(steps, "x", "y", "n")
    seeds = spark.createDataFrame([("s",)], "node string")
    assert rows(graph.hops_to_seed(edges, seeds)) == [("a", 2), ("b", 1), ("s", 0)]
    assert rows(graph.reachable_seeds(edges, edges.select(F.col("source").alias("node")), seeds)) == [("a", 1), ("b", 1)]
    assert rows(graph.first_steps(edges), "node", "out_edges", "first_targets") == [("a", 2, "b;a"), ("b", 1, "s"), ("c", 1, "d")]
    paths = graph.shortest_paths(edges, spark.createDataFrame([("a",), ("c",), ("s",)], "node string"), seeds)
    assert rows(paths) == [("a", "FOUND", 2, "a>b>s"), ("c", "NO_REACHABLE_ANCHOR", -1, ""), ("s", "FOUND", 0, "s")]
    assert rows(graph.neighbourhood(edges, seeds, 2)) == [("a", 2), ("b", 1), ("s", 0)]


def test_orient(spark):
    e = spark.createDataFrame([("s", "p", 1), ("p", "s", 2), ("s", "s2", 3), ("p", "q", 4)], "a string, b string, n int")
    anchors = spark.createDataFrame([("s",), ("s2",)], "k string")
    assert rows(evidence.orient_edges(e, "a", "b", anchors, "k", "n"), "anchor", "partner", "n") == [("s", "p", 1)]


def brute_align(a, b):
    """The best way that ends in each cell and state, kept in a table: (score, matches, -columns, residues, used of a)."""
    ways = {}
    best = (0, 0, 0, 0, 0)

    def longer(options, score, match, of_a, of_b):
        options = [w for w in options if w is not None]
        if not options:
            return None
        w = max(options, key=lambda w: w[:4])
        return (w[0] + score, w[1] + match, w[2] - 1, w[3] + of_a + of_b, w[4] + of_a)

    at = lambda i, j, k: ways.get((i, j, k), (0, 0, 0, 0, 0) if k == "m" else None)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            moves = {
                "m": longer([at(i - 1, j - 1, k) for k in "mpq"], int(similarity._SCORES[x.encode("latin-1", "replace")[0], y.encode("latin-1", "replace")[0]]), int(x == y), 1, 1),
                "p": longer([longer([at(i, j - 1, k)], -1 if k == "p" else -10, 0, 0, 1) for k in "mpq"], 0, 0, 0, 0),
                "q": longer([longer([at(i - 1, j, k)], -1 if k == "q" else -10, 0, 1, 0) for k in "mpq"], 0, 0, 0, 0),
            }
            for k, w in moves.items():
                if w is not None and k != "m":
                    w = (w[0], w[1], w[2] + 1, *w[3:])
                if w is not None and w[0] > 0:
                    ways[i, j, k] = w
                    best = max(best, w, key=lambda w: w[:4])
    return best[0], best[1], -best[2], best[4], best[3] - best[4]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.text("ACDEFGHWXa", max_size=18), st.text("ACDEFGHWXa", max_size=18)), max_size=6))
def test_alignment(pairs):
    found = similarity.align_many(pairs)
    for (a, b), got in zip(pairs, found, strict=True):
        assert got == brute_align(a, b)
    short = [p for p in pairs if p[0] and p[1]]
    if short:  # the way for texts of any length gives the same
        assert similarity.Alignments(31, 2).run(short) == [brute_align(*p) for p in short]


def test_alignment_cases(spark):
    assert similarity.align_many([("HEAG", "HEAG"), ("XX", "XX"), ("", "A")]) == [(23, 4, 4, 4, 4), (2, 2, 2, 2, 2), (0, 0, 0, 0, 0)]
    p = spark.createDataFrame([(1, 2, "HEAG", "HEAG"), (1, 3, None, "A")], "left_id long, right_id long, left_text string, right_text string")
    assert rows(similarity.align_pairs(p), "right_id", "score", "identity", "left_coverage") == [(2, 23, 1.0, 1.0), (3, 0, 0.0, 0.0)]


def test_both_ways_to_hold_a_state_give_the_same():
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("ACDEFGHIKLx~é"), n))
    pairs = [(text(rng.integers(1, 60)), text(rng.integers(1, 60))) for _ in range(60)] + [(t := text(300), t[:100] + text(20) + t[120:])]
    assert similarity.Alignments(14, 1).run(pairs) == similarity.Alignments(31, 2).run(pairs)


def test_beyond_short_texts_a_cell_takes_no_longer():
    """A pair of 8,100 letters in all, in two numbers a state, against one of 7,900 in one."""
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("ACDEFGHIKL"), n))
    seconds = []
    for n in (3_950, 4_050):
        start = time.process_time()
        similarity.align_many([(text(n), text(n))])
        seconds.append(time.process_time() - start)
    assert seconds[1] < 3 * seconds[0]  # as whole numbers of Python they took six times as long


def test_long_alignment():
    rng = np.random.default_rng(0)
    a, b = ("".join(rng.choice(list("ACDEFGHIKL"), 600)) for _ in range(2))
    start = time.process_time()
    score, matches, columns, used_a, used_b = similarity.align_many([(a, a[:300] + b[:20] + a[300:])])[0]
    assert (matches, columns, used_a, used_b) == (600, 620, 600, 620)
    assert time.process_time() - start < 5


def test_prefix_pairs_lose_no_similar_pair(spark):
    rng = np.random.default_rng(5)
    weight = {f"s:{m}": float(w) for m, w in enumerate(rng.uniform(0.5, 3, 30))}
    sets = {i: set(rng.choice(30, rng.integers(1, 9), p=np.arange(1, 31) / 465, replace=False).tolist()) for i in range(80)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, s array<long>")
    blocks = spark.createDataFrame([(i, i % 3) for i in sets], "id long, k int")
    members = similarity.set_members(df, "id", ["s"], spark.createDataFrame(list(weight.items())[:20], "member string, weight double"))
    w = lambda ms: sum(weight[f"s:{m}"] if m < 20 else 1.0 for m in ms)
    for share in (0.25, 0.5, 0.9):
        got = set(rows(similarity.prefix_pairs(members, "id", blocks, ["k"], share)))
        want = {(i, j) for i in sets for j in sets if i < j and i % 3 == j % 3 and w(sets[i] & sets[j]) >= share * w(sets[i] | sets[j])}
        assert want <= got
        assert len(got) < 80 * 79 / 6


def test_pair_metrics_and_extension(spark):
    texts = {1: "HEAGAWGHEE", 2: "HEAGAWGHEE", 3: "HEAGAWGHAE", 4: "PAWHEAE", 5: ""}
    spans = {1: [(1, 40)], 2: [(2, 41)], 3: [(1, 40)], 4: [(60, 99)], 5: None}
    sets = {1: ([1, 2], [7]), 2: ([1, 2], [7, 8]), 3: ([2, 1], [9]), 4: ([5], [7]), 5: ([], [])}
    t = spark.createDataFrame(list(texts.items()), "id long, text string")
    arch = "struct<status: string, source: string, ids: array<string>, intervals: array<struct<start: int, end: int>>, length: int>"
    a = spark.createDataFrame([(i, ("available" if s else "none", "X", ["d"], s or [], 100)) for i, s in spans.items()], f"id long, arch {arch}")
    f = spark.createDataFrame([(i, *s) for i, s in sets.items()], "id long, ev array<long>, fi array<long>")
    pairs = spark.createDataFrame([(i, j) for i in texts for j in texts if i < j], "left_id long, right_id long")
    got = {(r.left_id, r.right_id): r for r in similarity.pair_metrics(pairs, t, a, f, ["ev", "fi"], None, "ev", "fi").collect()}
    assert len(got) == 10
    for (i, j), r in got.items():
        score, matches, columns, x, y = brute_align(texts[i], texts[j])
        assert (r.score, r.matches, r.columns) == (score, matches, columns)
        both, union = (len(set(sets[i][k]) & set(sets[j][k])) for k in (0, 1)), (len(set(sets[i][k]) | set(sets[j][k])) for k in (0, 1))
        both, union = list(both), list(union)
        assert (r.shared_ev, r.shared_fi, r.shared_all) == (*both, sum(both))
        assert r.weighted == pytest.approx(sum(both) / sum(union) if sum(union) else 0)
        jac = [b / u if u else 0 for b, u in zip(both, union, strict=True)]
        reason = "event" if jac[0] >= 0.5 and both[0] else "first_set" if jac[1] >= 0.5 and both[1] >= 2 else "weighted" if r.weighted >= 0.25 and sum(both) >= 3 else "none"
        assert r.function == reason
        p, q = spans[i], spans[j]
        iou = max(0, min(p[0][1], q[0][1]) - max(p[0][0], q[0][0]) + 1) / (max(p[0][1], q[0][1]) - min(p[0][0], q[0][0]) + 1) if p and q else None
        assert r.architecture == ("missing" if iou is None else "pass" if iou >= 0.8 else "low_overlap")
        holds = columns and matches / columns >= 0.7 and x / len(texts[i]) >= 0.8 and y / len(texts[j]) >= 0.8 and r.architecture == "pass" and reason != "none"
        assert r.edge == bool(holds)
    assert {k for k, r in got.items() if r.edge} == {(1, 2), (1, 3), (2, 3)}
    edges = spark.createDataFrame([(3, 1, 1.0, 0.2), (3, 2, 0.9, 0.5), (4, 1, 0.8, 0.1)], "left_id long, right_id long, identity double, weighted double")
    failures = spark.createDataFrame([(3, "failure"), (5, "failure")], "left_id long, label string")
    assert rows(similarity.extend_by_similarity(failures, edges, "left_id", ["identity", "weighted"], "right_id"), "left_id", "label", "best_seed", "n_support") == [(3, "failure", 1, 2)]


def test_features_and_architectures(spark):
    doc = {"results": [
        {"metadata": {"accession": "F1", "name": "one", "type": "domain"}, "proteins": [{"accession": "p1", "protein_length": 90, "entry_protein_locations": [{"fragments": [{"start": 30, "end": 40}, {"start": 10, "end": 20}]}, {"fragments": []}]}, {"accession": "other", "protein_length": 5, "entry_protein_locations": [{"fragments": [{"start": 1, "end": 2}]}]}]},
        {"metadata": {"accession": "F0", "type": "site"}, "proteins": [{"accession": "P1", "protein_length": 90, "entry_protein_locations": [{"fragments": [{"start": 5, "end": 7}]}]}]},
    ]}
    d = spark.createDataFrame([("P1", json.dumps(doc)), ("P2", "{}"), ("P3", None), ("P4", "broken")], "acc string, j string")
    want = [("P1", 90, "F0", "", "site", 5, 7, 1, 1), ("P1", 90, "F1", "one", "domain", 10, 40, 1, 2)]
    f = features.flatten_features(d, "acc", "j")
    assert rows(f, "entity", "entity_length", *features.FEATURES) == want
    assert rows(features.flatten_features(d, "acc", "j", restricted=True), "feature_id") == [("F1",)]
    a = {r.acc: r.arch for r in features.architectures(d, "acc", f, "X").collect()}
    assert (a["P1"].status, a["P1"].ids, [tuple(i) for i in a["P1"].intervals], a["P1"].length) == ("available", ["F0", "F1"], [(5, 7), (10, 40)], 90)
    assert {a[k].status for k in ("P2", "P3", "P4")} == {"no_coordinate_resolved_features"}


def test_write_once_again(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, v string")
    io.write_tsv(df, path, ["k", "v"])
    io.write_tsv(df.repartition(2), path, ["k", "v"])  # equal content is left alone
    with pytest.raises(io.InputError):
        io.write_tsv(df.limit(1), path, ["k", "v"])
    assert io.read_tsv(spark, path, ["k", "v"]).count() == 2
    lines = str(tmp_path / "l")
    spark.createDataFrame([('{"k": 1, "n": 5, "v": "new"}',), ("",), ('{"k": 1, "n": 2, "v": "old"}',)], "value string").write.text(lines)
    assert rows(io.read_jsonl_last(spark, lines, "k int, n int, v string", "k", order="n"), "v") == [("new",)]
    io.freeze(df, "t", "k", str(tmp_path / "f"))
    assert rows(io.verify_frozen(df.repartition(3), "t", "k", str(tmp_path / "f"))) == [("t", 0, 2, 2)]
    assert rows(io.verify_frozen(df.limit(1), "t", "k", str(tmp_path / "f"))) == [("t", 1, 2, 1)]


def test_staged_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_dir", lambda _: str(tmp_path / "app"))
    df = tables.staged(spark.range(5).toDF("k"), "five")
    assert df.count() == 5
    assert len(list(tmp_path.glob("app/five-*"))) == 1
    tables.drop_staged(spark)
    assert not list(tmp_path.glob("*"))


class Session:
    """What ``shared_dir`` asks of a session."""

    def __init__(self, master, setting):
        self.sparkContext, self.conf = self, self
        self.master, self.applicationId, self.setting = master, f"app-{master}", setting

    def get(self, _, default):
        return self.setting or default


def test_shared_folder_must_be_named_on_a_cluster():
    assert tables.shared_dir(Session("spark://x", "hdfs:///shared")) == "hdfs:///shared/app-spark://x"
    assert tables.shared_dir(Session("local[4]", None)) == tables.shared_dir(Session("local[4]", None))
    for master in ("spark://x", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            tables.shared_dir(Session(master, None))


def test_checked_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert rows(partition.join_one_to_one(a.select("k"), a, "k", ["v"])) == [(1, "x"), (2, "y")]
    for left, right in ((a.union(a).select("k"), a), (a.select("k"), a.union(a)), (a.select("k"), a.limit(1))):
        with pytest.raises(ValueError):
            partition.join_one_to_one(left, right, "k", ["v"])


def test_natural_order_and_first_k(spark):
    df = spark.createDataFrame([(x,) for x in ("b2", "a10", "A9", "a010b", "b", "a9z")], "x string")
    assert [r.x for r in df.orderBy(rank.natural_key(F.col("x")), "x").collect()] == ["A9", "a9z", "a10", "a010b", "b", "b2"]
    k = spark.createDataFrame([("g", i) for i in (5, 3, 9, 1)] + [("h", 2)], "g string, v int")
    assert rows(rank.first_k(k, ["g"], "v", ["v"], 2, "f")) == [("g", [1, 3]), ("h", [2])]


def test_windows_roll_up(spark):
    s = spark.createDataFrame([("e", 1, 10, 0.7), ("e", 9, 6, 0.7), ("e", 3, 10, 0.1)], "key string, start long, length long, score double")
    r = scoring.roll_up_windows(s).first()
    assert (r.n_windows, r.max_score, r.max_start) == (3, 0.7, 9)


def test_pairs_and_resume(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k string") for v in ("xyz", "pq"))
    u = scoring.pair_universe(a, "k", b, "k")
    assert rows(u, "pair_index", "left_id", "right_id") == [(i, "xyz"[i // 2], "pq"[i % 2]) for i in range(6)]
    assert scoring.pending(u, u.filter("pair_index < 4")).count() == 2
    assert rows(scoring.pair_universe(a, "k", b, "k", block=1), "pair_index", "left_id", "right_id") == rows(u, "pair_index", "left_id", "right_id")
    scored = scoring.score_pairs(u.withColumn("left_text", F.col("left_id")).withColumn("right_text", F.col("right_id")), lambda x, y: np.array([0.95] * len(x)))
    assert rows(scored.groupBy("flag").count()) == [(1, 6)]


def test_grids(spark):
    e = spark.createDataFrame([("a", "b", 0.9, 0.9), ("a", "c", 0.7, 0.8)], "left_id string, right_id string, i double, c double")
    cells = sensitivity.grid(spark, i=[0.7, 0.95], c=[0.8])
    assert rows(sensitivity.threshold_grid(e, cells, {"i": "i", "c": "c"})) == [(0.7, 0.8, 2, 3), (0.95, 0.8, 0, 0)]
    b = spark.createDataFrame([(0.70,), (0.80,), (0.95,)], "v double")
    assert [r.n for r in sensitivity.fixed_bins(b, "v", [0.7, 0.8, 0.9, 1.0]).orderBy("bin").collect()] == [1, 1, 1, 0]
    assert spark.range(1).select(sensitivity.fraction_text(F.lit(21), F.lit(1861))).first()[0] == "0.01128426"
    assert spark.range(1).select(sensitivity.fraction_text(F.lit(21), F.lit(0))).first()[0] == "NA"


def test_pair_graph(spark):
    r = spark.createDataFrame([("c1", "a1", "x"), ("c1", "a1", "y"), ("a1", "c1", "x")], "c string, a string, l string")
    assert rows(explore.pair_graph_edges(r, "c", "a", "l")) == [("a1", "c1", 3, "x;y")]
    assert rows(explore.pair_graph_nodes(r, "c", "a")) == [("a1", "both", 1), ("c1", "both", 1)]


def test_text_difference(spark):
    cases = [("abcXdef", "abcYYdef", 3, 3), ("same", "same", 4, 0), ("", "x", 0, 0), ("aa", "a", 1, 0)]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select("a", "b", explore.text_difference(F.col("a"), F.col("b")).alias("d"))
    got = {(r.a, r.b): (r.d.prefix, r.d.suffix) for r in df.collect()}
    assert got == {c[:2]: c[2:] for c in cases}


def test_folds(spark):
    f = spark.createDataFrame([("m", float(i)) for i in range(1, 6)], "k string, v double")
    r = evaluation.fold_summary(f, ["k"], "v").first()
    assert r["mean"] == 3 and r["std"] == pytest.approx(math.sqrt(2))


def test_gates(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("", 3), (None, 4)], "k string, v int")
    assert quality.unique_key(a, "k", "n").first().violations == 3
    b = a.filter("v > 1")
    got = quality.receipt(quality.subset(b, a.filter("k is not null"), "k", "sub"), quality.equal_tables(a, a.orderBy(F.desc("v")), "same")).collect()
    assert {r.name: r.status for r in got} == {"sub": "FAIL", "same": "PASS", "ALL": "FAIL"}
    one, two = quality.fingerprint(a, "t", "k").first(), quality.fingerprint(a.repartition(3), "t", "k").first()
    assert one == two
    assert quality.fingerprint(a.withColumn("v", F.col("v") + 1), "t", "k").first() != one


def test_files(spark, tmp_path):
    t = spark.createDataFrame([("1", 'a "q"\tb', None), ("2", "", "z")], "k string, v string, w string")
    path = str(tmp_path / "t")
    io.write_tsv(t, path, ["k", "v", "w"])
    io.write_tsv(t, path, ["k", "v", "w"])  # the same again
    with pytest.raises(io.InputError):
        io.write_tsv(t.limit(1), path, ["k", "v", "w"])
    assert rows(io.read_unique_tsv(spark, path, ["k", "v", "w"], "k")) == [("1", 'a "q"\tb', ""), ("2", "", "z")]
    with pytest.raises(io.InputError):
        io.write_tsv(t, str(tmp_path / "u"), ["k"], extra="raise")
    (tmp_path / "f.fa").write_text(">sp|P1|X one\nAC\nDE\n>Q2 two\nFG\n")
    assert rows(io.read_fasta(spark, str(tmp_path / "f.fa")), "accession", "sequence") == [("P1", "ACDE"), ("Q2", "FG")]
    assert io.fasta_count(spark, str(tmp_path / "f.fa")) == 2
    (tmp_path / "p.tsv").write_text("!c\na\tb\tc\n\nd\te\tf\nshort\n")
    assert rows(io.read_headerless(spark, str(tmp_path / "p.tsv"), {"x": 0, "y": 2}, 3, comment="!"), "x", "y") == [("a", "c"), ("d", "f")]
    with pytest.raises(io.InputError):
        io.read_pairs(spark, str(tmp_path / "p.tsv"))
    (tmp_path / "ids").write_text("a\n\n b \n")
    assert rows(io.read_ids(spark, str(tmp_path / "ids"))) == [("a",), ("b",)]
    (tmp_path / "dup").write_text("a\na\n")
    with pytest.raises(io.InputError):
        io.read_ids(spark, str(tmp_path / "dup"))
    (tmp_path / "j").write_text('{"k":1,"v":"x"}\n\n{"k":1,"v":"y"}\n')
    assert rows(io.read_jsonl_last(spark, str(tmp_path / "j"), "k int, v string", "k")) == [(1, "y")]
    io.write_fasta(spark.createDataFrame([("a", "ABCDE")], "k string, s string"), str(tmp_path / "o"), F.col("k"), "s", 2)
    assert "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part*"))) == ">a\nAB\nCD\nE\n"
    assert rows(io.export_text(spark.createDataFrame([("a\tb", None)], "x string, y int"))) == [("a b", "")]


def test_unions_and_versions(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k string")
    u = partition.union_with_roles({"a": ids("x", "y"), "b": ids("y", "y", None)}, "k")
    assert rows(u, "k", "in_a", "in_b", "membership") == [("x", 1, 0, "a"), ("y", 1, 1, "a;b")]
    assert rows(partition.drift(ids("x", "y"), ids("y", "z"), "k")) == [("x", "ONLY_LEFT"), ("z", "ONLY_RIGHT")]
    m = partition.membership_matrix(ids("x", "y", "z", "w"), {"p": ids("x", "y"), "q": ids("y", "z")}, "k", ("p", "q"))
    assert rows(m, "k", "membership") == [("w", "NEITHER"), ("x", "X_ONLY"), ("y", "BOTH"), ("z", "Y_ONLY")]


def test_edge_pass_and_best_support(spark):
    e = spark.createDataFrame([("c", "s1", 0.9, 0.8, 0.8, True, True), ("c", "s2", 0.9, 0.9, 0.8, True, True), ("d", "s1", 0.69, 0.9, 0.9, True, True), ("d", "s2", 0.7, 0.79, 0.9, True, True), ("f", "s1", 0.9, 0.9, 0.9, False, True)], "c string, s string, i double, l double, r double, a boolean, f boolean")
    passed = e.filter(similarity.edge_pass(F.col("i"), F.col("l"), F.col("r"), F.col("a"), F.col("f")))
    assert rows(passed, "c", "s") == [("c", "s1"), ("c", "s2")]
    assert rows(similarity.best_support(passed, "c", ["i", "l"], "s"), "c", "best_seed", "n_support") == [("c", "s2", 2)]


def test_class_pairs_grow_with_the_texts_not_the_rows(spark):
    """Ten times the rows of the same texts form the same pairs of classes, and a hundred times the pairs of rows."""
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ABC"), rng.integers(8, 14))) for _ in range(25)]
    sets = {t: sorted({t[i : i + 4] for i in range(len(t) - 3)}) for t in texts}
    formed, found = [], []
    for times in (1, 10):
        df = spark.createDataFrame([(k * 100 + i, "s" if i % 2 else "t", len(t), sets[t]) for k in range(times) for i, t in enumerate(texts)], "i long, s string, n long, k array<string>")
        formed.append(similarity.class_pairs(similarity.text_classes(df, "s", "n", "k"), 0.8, 0.2).count())
        found.append({(r.left_id, r.right_id): r.containment for r in similarity.candidate_pairs(df, "i", "s", "n", "k", 0.8, 0.2).collect()})
        text, sig = {r.i: tuple(r.k) for r in df.collect()}, {r.i: (r.s, r.n) for r in df.collect()}
        share = lambda a, b: len(set(text[a]) & set(text[b])) / min(len(text[a]), len(text[b]))  # noqa: E731, B023
        want = {(a, b): share(a, b) for a in text for b in text if a < b and sig[a][0] == sig[b][0] and min(sig[a][1], sig[b][1]) >= 0.8 * max(sig[a][1], sig[b][1]) and share(a, b) >= 0.2}
        assert found[-1] == pytest.approx(want)
    assert formed[0] == formed[1] and len(found[1]) > 90 * len(found[0])


@pytest.mark.parametrize("ratio", [0.5, 0.8, 0.95, 1.0])
def test_length_bands_lose_no_pair(spark, ratio):
    df = spark.createDataFrame([(n, "s", n, ["AAAB"]) for n in range(0, 130)], "i long, s string, n long, k array<string>")
    got = {(r.left_id, r.right_id) for r in similarity.candidate_pairs(df, "i", "s", "n", "k", ratio, 0.5).collect()}
    assert got == {(a, b) for a in range(130) for b in range(a + 1, 130) if a >= ratio * b}


def test_candidate_pairs(spark):
    r = spark.createDataFrame([(1, "s", 10, ["ab", "cd"]), (2, "s", 9, ["ab"]), (3, "s", 7, ["ab"]), (4, "", 10, ["ab"]), (5, "t", 10, ["ab"]), (6, "s", 10, ["zz"])], "i long, s string, n int, k array<string>")
    assert rows(similarity.candidate_pairs(r, "i", "s", "n", "k"), "left_id", "right_id") == [(1, 2)]
    other = spark.createDataFrame([(9, "s", 10, ["cd"])], "i long, s string, n int, k array<string>")
    assert rows(similarity.candidate_pairs(r, "i", "s", "n", "k", right=other), "left_id", "right_id") == [(1, 9)]


def test_levels(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k string")
    got = evidence.level_comparison(ids("a", "b", "c"), ids("a", "b"), ids("a"), "k")
    assert rows(got, "k", "level") == [("a", "PASS_BOTH"), ("b", "PASS_WIDE_ONLY"), ("c", "PASS_NEITHER")]
