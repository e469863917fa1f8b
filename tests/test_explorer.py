"""Stored points, trigram postings, budgets, ordered and exported files, nested counts and totals against brute force."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, partition, postings, quality, scoring, sensitivity, spatial
from tessera.operators.explore import search
from tessera.operators.rank import ordered_index
from tessera.sources import io


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 1), rng.gauss(3, 2), "ab"[i % 2], f"Name {i}") for i in range(1500)] + [(2000 + i, 0.25, 0.5, "c", "same") for i in range(300)]
    rows += [(5000, None, 1.0, "a", "x"), (5001, float("nan"), 1.0, "a", "x"), (5002, 1.0, None, "a", None)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, kind string, name string").repartition(6)


def files_read(df):
    """The number of files that the scans of a plan open."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_z_value_and_column(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(1 << 12), rng.randrange(1 << 12)) for _ in range(50)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", spatial.z_column(F.col("a"), F.col("b"), 12).alias("z")).collect()
    assert all(r.z == spatial.z_value(r.a, r.b, 12) == int("".join(q + p for p, q in zip(f"{r.a:012b}", f"{r.b:012b}", strict=True)), 2) for r in got)


def test_boxes(spark, points, tmp_path):
    rows, df = points
    path = str(tmp_path / "points")
    spatial.write_points(df, path)
    rng = random.Random(6)
    boxes = [(0.25, 0.5, 0.25, 0.5), (-9, -99, 9, 99), (50, 50, 60, 60), (1, 1, 0, 0)] + [(x, y, x + rng.random(), y + rng.random() * 2) for x, y in ((rng.gauss(0, 1), rng.gauss(3, 2)) for _ in range(6))]
    for box in boxes:
        got = sorted(r.id for r in spatial.in_stored_box(spark, path, box).collect())
        assert got == sorted(i for i, x, y, *_ in rows if x is not None and y is not None and box[0] <= x <= box[2] and box[1] <= y <= box[3])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        few, every = (files_read(spatial.in_stored_box(spark, path, b)) for b in ((0.1, 2.9, 0.3, 3.1), (-9, -99, 9, 99)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < few < every / 3


def test_no_points(spark, points, tmp_path):
    _, df = points
    for n, none in enumerate((df.limit(0), df.filter("id >= 5000"))):
        spatial.write_points(none, str(tmp_path / f"p{n}"))
        assert spatial.in_stored_box(spark, str(tmp_path / f"p{n}"), (-9, -9, 9, 9)).count() == 0 if n else True


def test_region_page(spark, points):
    rows, df = points
    inside = df.filter("x > 0 and not isnan(x)")
    page = spatial.region_page(inside, [F.asc("id")], "kind", ["a", "c"], "NAME 1", ["name"], 3, 10).collect()
    own = [r for r in rows if r[1] is not None and r[1] > 0 and r[3] in "ac"]
    found = sorted(r[0] for r in own if "name 1" in (r[4] or "").lower())
    assert [r.id for r in page] == found[20:30] and {(r.available, r.total) for r in page} == {(len(own), len(found))}


TEXTS = ["The quick brown fox", "quick", "qu", "", None, "ÄÖÜ äöü ß", "😀😀😀 smile", "aaaaaa", "the the the", "brown bread", "x\ny z"] + [f"row number {i}" for i in range(40)]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    df = spark.createDataFrame([(i, t, f"n{i}", i % 2) for i, t in enumerate(TEXTS)] + [(0, "again quick", "k", 0)], "id long, text string, name string, odd int").repartition(3)
    path = str(tmp_path_factory.mktemp("grams"))
    postings.write_index(df, "id", ["text", "name"], f"{path}/i")
    return df, f"{path}/i"


@pytest.mark.parametrize("pushed", [1000, 0])
@pytest.mark.parametrize("q", ["quick", "QUICK b", "qu", "", "the", "äöü", "Ü ä", "😀😀", "aaa", "aaaaaaaaa", "row number 1", "er 7 n", "zzz", "x\ny", "n4", "fox n0"])
def test_search_by_postings(indexed, monkeypatch, q, pushed):
    monkeypatch.setattr(postings, "PUSHED", pushed)
    df, path = indexed
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert rows(postings.indexed_search(df, "id", ["text", "name"], path, q)) == rows(search(df, q, ["text", "name"]))
    assert rows(postings.indexed_search(df, "id", ["text", "name"], path, q, {"odd": 1})) == rows(search(df, q, ["text", "name"], {"odd": 1}))


def test_rarest_grams_bound_the_rows_read(spark, indexed):
    df, path = indexed
    keys, most = postings.candidates(spark, path, "row number 17", "bigint")
    assert most <= 4 and keys.count() <= most  # "17 n17": its rarest gram is in few rows, "row" in forty
    assert postings.candidates(spark, path, "ro", "bigint") == (None, 0)


def test_postings_are_lists_by_segment(spark, indexed, tmp_path, monkeypatch):
    """A row for each run and segment, not for each run and text; a run that most rows have is no candidate but a scan."""
    df = spark.createDataFrame([(i, f"the same words {'odd' * (i % 2)}") for i in range(200)] + [(200, None), (201, "\0\0\0 é😀ß")], "id long, text string").coalesce(1)
    postings.write_index(df, "id", ["text"], str(tmp_path / "i"))
    stored = [(r.gram, sorted(r["keys"]), r.n) for r in spark.read.parquet(str(tmp_path / "i/postings")).collect()]
    want = {}
    for r in df.collect():
        for g in {(r.text or "")[i : i + 3] for i in range(len(r.text or "") - 2)}:
            want.setdefault(g, []).append(r.id)
    assert {(g, tuple(k)) for g, k, _ in stored} == {("", ()), *((g, tuple(sorted(k))) for g, k in want.items())}
    assert all(n == (202 if g == "" else len(k)) for g, k, n in stored)
    monkeypatch.setattr(postings, "PUSHED", 0)
    assert postings.candidates(spark, str(tmp_path / "i"), "the same", "bigint") == (None, 0)


def budget(rows, key, limit):
    return sorted(rows, key=key)[:limit]


@pytest.mark.parametrize("nodes, links", [(None, None), (1, 5), (7, 3), (12, 1000), (1000, 8)])
def test_explored(spark, nodes, links):
    rng = random.Random(3)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)] + [(4, 4), (0, 1), (0, 1)]
    df = spark.createDataFrame(edges, "source int, target int")
    hop = {0: 0}
    for k in (1, 2):
        for a, b in edges:
            for x, y in ((a, b), (b, a)):
                if hop.get(x) == k - 1 and y not in hop:
                    hop[y] = k
    inside = {(a, b) for a, b in edges if a in hop and b in hop}
    degree = {n: sum(n in e for e in inside) for n in hop}
    kept = budget(hop, lambda n: (hop[n], -degree[n], n), nodes)
    linked = budget([e for e in inside if set(e) <= set(kept)], lambda e: (max(hop[e[0]], hop[e[1]]), min(hop[e[0]], hop[e[1]]), e), links)
    found, shown, totals = graph.explored(df, spark.createDataFrame([(0,)], "node int"), 2, nodes, links)
    assert sorted((r.node, r.hop, r.degree) for r in found.collect()) == sorted((n, hop[n], degree[n]) for n in kept)
    assert sorted(map(tuple, shown.collect())) == sorted(linked)
    t = totals.first()
    assert (t.available_nodes, t.available_links) == (len(hop), len(inside)) and t.limited == bool((nodes and nodes < len(hop)) or (links and links < len(inside)))


def test_ids_keep_the_table_order(spark, tmp_path):
    order = list(range(500))
    random.Random(2).shuffle(order)
    df = spark.createDataFrame([(i, place) for place, i in enumerate(order)], "id int, place int").repartition(7)
    path = str(tmp_path / "ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        io.write_ids(df, path, "id", [F.asc("place")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(glob.glob(f"{path}/part-*"))
    assert len(files) > 1 and [int(x) for f in files for x in open(f)] == order
    back = ordered_index(io.read_ids(spark, path, place=True), F.asc("place")).collect()
    assert [int(r.id) for r in sorted(back, key=lambda r: r.position)] == order


def test_table_ids(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    ids = lambda *a: sorted(r.id for r in io.read_table_ids(spark, *a).collect())
    assert ids(write("a.tsv", "x\tEntry\n1\t P2 \n2\t\n3\tP1\n")) == ["P1", "P2"]
    assert ids(write("b.tsv", "key\tEntry\nk\tP2\n"), "key") == ["k"]
    for name, text in {"none.tsv": "x\ty\n1\t2\n", "two.tsv": "Entry\taccession\nP1\tP1\n", "twice.tsv": "Entry\nP1\nP1 \n", "empty.tsv": "Entry\n"}.items():
        with pytest.raises(io.InputError):
            io.read_table_ids(spark, write(name, text))
    with pytest.raises(io.InputError, match="no column"):
        io.read_table_ids(spark, write("c.tsv", "Entry\nP1\n"), "key")


def test_export_has_a_byte_order_mark(spark, tmp_path):
    rows = [(1, "a\tb\nc", None), (2, 'q"uo\\te', " é ")]
    io.write_export(spark.createDataFrame(rows, "id int, s string, t string").repartition(2), str(tmp_path / "x"))
    lines = set()
    for f in glob.glob(f"{tmp_path}/x/part-*"):
        text = open(f, "rb").read().decode()
        assert text.startswith("﻿id\ts\tt\n")
        lines |= set(text.split("\n")[1:-1])
    assert lines == {"1\ta b c\t", '2\tq"uo\\te\t é '}


def test_nested_summary(spark):
    rows = [("b", "x", "p"), ("b", "x", "q"), ("b", "y", "p"), ("a", None, "q"), ("a", "z", None), ("a", "z", None)]
    got = json.loads(io.nested_summary(spark.createDataFrame(rows, "d string, l string, k string"), "d", "l", "k").first().json)
    assert list(got) == ["a", "b"] and list(got["b"]["levels"]) == ["x", "y"]
    assert got["a"] == {"n": 3, "levels": {"": {"n": 1, "share": "0.33333333", "classes": {"q": 1}}, "z": {"n": 2, "share": "0.66666667", "classes": {"": 2}}}}
    assert io.nested_summary(spark.createDataFrame([], "d string, l string, k string"), "d", "l", "k").first().json == "{}"


def test_totals_and_tokens(spark):
    c = lambda *rows: spark.createDataFrame(rows, "k int, g string")
    p = lambda *rows: spark.createDataFrame(rows, "a string, b string")
    got = partition.release_totals({"A": (c((1, "x; y,z"), (2, None)), p(("1", "2"), ("2", "1"), ("1", "2"))), "B": (c((1, "y ,w"), (1, "")), p(("2", "1")))}, "k", "g", ("a", "b"))
    assert sorted(map(tuple, got.collect())) == [("A", 2, 3, 2, 3, 1), ("ALL", 4, 4, 2, 4, 1), ("B", 2, 2, 1, 1, 1)]
    t = partition.distinct_tokens(spark.createDataFrame([("a", "x;y|X"), ("a", "z"), ("b", None)], "b string, cell string"), ["b"], "cell")
    assert sorted(map(tuple, t.collect())) == [("a", 2, 3), ("b", 1, 0)]


def test_fractions_of_an_empty_set(spark):
    cells = spark.createDataFrame([(0.5, 2), (0.9, 0)], "c double, n_ids long")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    got = sensitivity.grid_fractions(cells, ids, ids.limit(0)).orderBy("c").collect()
    assert [(r.overall, r.conditional) for r in got] == [("0.66666667", "NA"), ("0.00000000", "NA")]


def test_same_order(spark):
    order = lambda *ids: spark.createDataFrame([(k, i) for i, k in enumerate(ids)], "k int, p int")
    n = lambda a, b: quality.same_order(a, b, "k", "p", "o").first().violations
    assert n(order(3, 1, 2), order(3, 1, 2)) == 0 and n(order(3, 1, 2), order(1, 3, 2)) == 2 and n(order(3, 1), order(3)) == 1


def test_fingerprints_see_values(spark):
    """Equal numbers of rows and keys, other values: the content decides."""
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "x")], "k int, v string")
    c = quality.changed(quality.fingerprint(a, "t", "k"), quality.fingerprint(b, "t", "k"), "m").first()
    assert c.violations == 2 and quality.changed(quality.fingerprint(a, "t", "k"), quality.fingerprint(a.repartition(3), "t", "k"), "m").first().violations == 0


@pytest.mark.parametrize("block", [1, 3, 100])
def test_pair_universe_has_many_keys(spark, block):
    left, right = (spark.createDataFrame([(i,) for i in ids], "id int") for ids in (range(20), (5, 3, 9, 7)))
    got = scoring.pair_universe(left, "id", right, "id", block)
    assert sorted((r.left_id, r.right_id, r.pair_index) for r in got.collect()) == sorted((i, j, i * 4 + k) for i in range(20) for k, j in enumerate((3, 5, 7, 9)))
    assert scoring.pair_universe(left, "id", right.limit(0), "id").count() == 0
