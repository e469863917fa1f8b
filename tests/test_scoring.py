"""Length batches, the resumable scorer and guards that fail the job."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import guards, partition, scoring
from tessera.sources import io, tables


@pytest.mark.parametrize("rows, padding", [(1, 0.0), (4, 0.0), (4, 0.2), (100, 1.0)])
def test_padded_slices(rows, padding):
    rng = random.Random(rows)
    lengths = sorted(rng.randint(0, 30) for _ in range(50))
    at = 0
    for a, b in scoring.padded_slices(lengths, rows, padding):
        part = lengths[a:b]
        assert a == at and 1 <= b - a <= rows and max(part) * len(part) - sum(part) <= padding * max(part) * len(part)
        at = b
    assert at == 50 and list(scoring.padded_slices([], rows, padding)) == []


@pytest.mark.parametrize("held", [1, 60, 10**9])
def test_length_batches(held):
    """Every item once; full buckets are of one length; what is held stays bounded."""
    rng = random.Random(held)
    items = [(i, "x" * rng.choice([10, 10, 10, rng.randint(0, 12)])) for i in range(300)]
    taken = []

    def source():
        for item in items:
            taken.append(item)
            yield item

    out, seen = [], 0
    for batch in scoring.length_batches(source(), 8, 0.1, held):
        out.append(batch)
        seen += sum(len(t) for _, t in batch)
        assert len(batch) <= 8
    assert sorted(x for b in out for x in b) == sorted(items)
    if held == 10**9:
        assert sum(len({len(t) for _, t in b}) == 1 for b in out) >= len(out) - 3 and len(out) <= 300 / 8 + 13


def test_window_scores_by_any_partitioning(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abcde ") for _ in range(rng.choice([0, 5, 40, 41, 400])))) for i in range(60)] + [(None, "null id"), (99, None), (3, "again")]
    df = spark.createDataFrame(rows, "id long, text string")
    log = str(tmp_path / "log")

    def model(texts):
        with open(f"{log}-{os.getpid()}", "a") as f:
            f.write(f"{len(texts)} {max(map(len, texts)) * len(texts)} {sum(map(len, texts))}\n")
        return np.array([t.count("a") / len(t) for t in texts])

    found = [sorted(map(tuple, scoring.score_windows(d, "id", "text", model, 40, 10, 16).collect()), key=repr) for d in (df.repartition(1), df.repartition(7))]
    assert found[0] == found[1]
    want = [(i, s, len(w), w.count("a") / len(w)) for i, t in rows if t for s in ([0] if len(t) <= 40 else range(0, len(t) - 10, 30)) for w in [t[s : s + 40]]]
    assert found[0] == sorted(want, key=repr)
    lines = [tuple(map(int, x.split())) for name in os.listdir(tmp_path) for x in open(tmp_path / name)]
    assert sum(n for n, *_ in lines) == 2 * len(want) and len(lines) <= 2 * len(want) / 16 + 8 * 8
    assert all(full - own <= 0.1 * full for _, full, own in lines)


def pairs_of(spark, n=200):
    rng = random.Random(9)
    rows = [(i * 3, "".join(rng.choice("abc") for _ in range(rng.randint(0, 30))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for i in range(n)]
    rows[5] = (rows[5][0], None, "")
    return rows, spark.createDataFrame(rows, "pair_index long, left_text string, right_text string").repartition(5)


def logged(log, stop=None):
    def model(a, b):
        if stop and os.path.exists(stop):
            raise RuntimeError("stopped")
        with open(f"{log}-{os.getpid()}", "a") as f:
            f.write("".join(f"{len(x)} {len(y)}\n" for x, y in zip(a, b, strict=True)))
        return np.array([len(x) / (len(y) + 1) for x, y in zip(a, b, strict=True)])

    return model


def test_resume(spark, tmp_path, monkeypatch):
    """A run stopped half way goes on with the shards that are not in place, and scores no pair twice."""
    rows, df = pairs_of(spark)
    folder, log = str(tmp_path / "out"), str(tmp_path / "log")
    moved, real = [], scoring.move

    def dying(session, source, target):
        if len(moved) == 4:
            raise KeyboardInterrupt
        real(session, source, target)
        moved.append(target)

    monkeypatch.setattr(scoring, "move", dying)
    with pytest.raises(KeyboardInterrupt):  # after the work list and the three shards of the first wave
        scoring.score_shards(df, logged(log), folder, 7, 3)
    assert len(scoring.committed(spark, folder)) == 3
    first = sum(len(open(tmp_path / n).readlines()) for n in os.listdir(tmp_path) if n.startswith("log"))
    monkeypatch.setattr(scoring, "move", real)
    got = scoring.score_shards(df, logged(str(tmp_path / "second")), folder, 7, 3)
    want = {i: len(a or "") / (len(b or "") + 1) for i, a, b in rows}
    assert {r.pair_index: r.score for r in got.collect()} == want and got.count() == len(rows)
    assert all(r.shard == r.pair_index % 7 and r.flag == int(r.score > 0.9) for r in got.collect())
    second = sum(len(open(tmp_path / n).readlines()) for n in os.listdir(tmp_path) if n.startswith("second"))
    in_place = sum(i % 7 in {int(t.rsplit("=", 1)[1]) for t in moved[1:]} for i, *_ in rows)
    assert second == len(rows) - in_place and first >= in_place
    assert scoring.score_shards(df, logged(str(tmp_path / "third")), folder, 7, 3).count() == len(rows)
    assert not [n for n in os.listdir(tmp_path) if n.startswith("third")]
    assert not tables.children(spark, f"{folder}/attempts")


def test_a_task_that_fails_commits_nothing(spark, tmp_path):
    rows, df = pairs_of(spark, 40)
    folder, stop = str(tmp_path / "out"), str(tmp_path / "stop")
    open(stop, "w").close()
    with pytest.raises(Exception, match="stopped"):
        scoring.score_shards(df, logged(str(tmp_path / "a"), stop), folder, 4, 2)
    assert scoring.committed(spark, folder) == []
    os.remove(stop)
    assert scoring.score_shards(df, logged(str(tmp_path / "a"), stop), folder, 4, 2).count() == 40


def test_another_work_list_is_an_error(spark, tmp_path):
    rows, df = pairs_of(spark, 20)
    folder = str(tmp_path / "out")
    scoring.score_shards(df, logged(str(tmp_path / "a")), folder, 4)
    with pytest.raises(ValueError, match="other pairs"):
        scoring.score_shards(df.filter("pair_index > 3"), logged(str(tmp_path / "a")), folder, 4)
    with pytest.raises(ValueError, match="number of shards"):
        scoring.score_shards(df, logged(str(tmp_path / "a")), folder, 5)
    with pytest.raises(Exception, match="repeated pair_index: 0"):
        scoring.score_shards(df.union(df), logged(str(tmp_path / "a")), str(tmp_path / "twice"), 4)
    assert scoring.score_shards(df.limit(0), logged(str(tmp_path / "a")), str(tmp_path / "none"), 4).count() == 0


def fails(df, message):
    with pytest.raises(Exception, match=message):
        df.collect()


def frame(spark, *ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], "id int, v string")


def test_exclude_set(spark):
    u = frame(spark, 1, 2, 3, None)
    assert sorted(r.id or 0 for r in guards.exclude_set(u, frame(spark, 2, 2), "id").collect()) == [0, 1, 3]
    assert guards.exclude_set(u, frame(spark).limit(0), "id").count() == 4
    fails(guards.exclude_set(u, frame(spark, 2, 9), "id"), "excluded but not in the universe: 9")


def test_cover_and_unique(spark):
    assert guards.cover(frame(spark, 1, 2, 2), frame(spark, 2, 1), "id").count() == 3
    fails(guards.cover(frame(spark, 1), frame(spark, 1, 2), "id"), "missing key: 2")
    fails(guards.cover(frame(spark, 1, 2), frame(spark, 1), "id"), "unexpected key: 2")
    assert guards.unique_rows(frame(spark, 1, 2), ["id"]).count() == 2
    fails(guards.unique_rows(frame(spark, 1, 2, 2), ["id"]), "repeated key: 2")
    fails(guards.unique_rows(frame(spark, 1, None), ["id"]), "repeated key")


def test_keep_old_add_new_is_checked(spark):
    old, new = frame(spark, 1, 2), frame(spark, 2, 3)
    got = partition.keep_old_add_new(old, new, "id", frame(spark, 1, 2, 3))
    assert sorted(r.id for r in got.collect()) == [1, 2, 3]
    fails(partition.keep_old_add_new(old, new, "id", frame(spark, 1, 2, 3, 4)), "missing key: 4")
    fails(partition.keep_old_add_new(old, frame(spark, 3, 3), "id", frame(spark, 1, 2, 3)), "repeated key: 3")


def test_nested(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0), (2, 1, 0, 0), (3, 1, 1, 1)], "id int, a int, b int, c int")
    assert guards.nested(rows, ["a", "b", "c"], "id").count() == 3
    assert guards.strict_nesting(rows, ["a", "b", "c"], "n").first().violations == 0
    assert guards.strict_nesting(rows.filter("b = 1"), ["a", "b", "c"], "n").first().violations == 1
    bad = rows.union(spark.createDataFrame([(4, 0, 1, 0)], rows.schema))
    fails(guards.nested(bad, ["a", "b", "c"], "id"), "b outside a: 4")
    assert guards.strict_nesting(bad, ["a", "b", "c"], "n").first().violations == 2  # the row outside, and three in both


def test_declared_length(spark):
    df = spark.createDataFrame([(1, " ab c", 3), (2, None, 0)], "id int, s string, n int")
    assert [r[0] for r in df.select(guards.of_length(fx.clean_sequence("s"), F.col("n"), "id")).collect()] == ["ABC", ""]
    fails(df.withColumn("n", F.lit(3)).select(guards.of_length(fx.clean_sequence("s"), F.col("n"), "id")), "length differs from the declared one: 2")


def test_checked_pairs(spark):
    make = lambda *rows: spark.createDataFrame(rows, "pair_index long, left_index long, right_index long, s double, n int")
    check = lambda df: scoring.checked_pairs(df, 10, "s", "n")
    good = (12, 1, 2, 0.995, 1600)
    assert check(make(good, (13, 1, 3, 0.999, 5))).count() == 2
    fails(check(make(good, (13, 1, 2, 0.999, 5))), "pair index is not that of its ends: 13")
    fails(check(make((22, 1, 12, 0.999, 5))), "pair index is not that of its ends: 22")
    fails(check(make(good, good)), "repeated pair_index: 12")
    fails(check(make((12, 1, 2, 0.99, 5))), "pair outside the gate: 12")
    fails(check(make((12, 1, 2, 0.999, 1601))), "pair outside the gate: 12")


def test_split_by_class(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(7)], "id int, c string")
    io.split_by_class(df, str(tmp_path / "a"), "c", {"a": 4, "b": 3})
    assert spark.read.parquet(str(tmp_path / "a")).groupBy("c").count().count() == 2
    for n, expected in enumerate(({"a": 4, "b": 2}, {"a": 4}, {"a": 4, "b": 3, "x": 1})):
        with pytest.raises(io.InputError, match="class counts differ"):
            io.split_by_class(df, str(tmp_path / f"bad{n}"), "c", expected)
        assert not os.path.exists(tmp_path / f"bad{n}")


def test_labelled_universe(spark):
    from tessera.operators import audit

    screen = lambda *rows: spark.createDataFrame(rows, "id int, passed string")
    ref = frame(spark, 1, 2, 3)
    got = audit.labelled_universe({"A": screen((1, "yes"), (2, "no")), "B": screen((3, "yes"))}, "id", "passed", ref)
    assert sorted((r.id, r.route, r.label, r.v) for r in got.collect()) == [(1, "A", "seed", "v1"), (2, "A", "failure", "v2"), (3, "B", "seed", "v3")]
    fails(audit.labelled_universe({"A": screen((1, "yes")), "B": screen((1, "no"))}, "id", "passed", ref), "in two screens or twice in one: 1")
    fails(audit.labelled_universe({"A": screen((7, "yes"))}, "id", "passed", ref), "not in the reference: 7")




def test_guards_stay_where_they_are(spark):
    """A filter before a guard removes rows first; one after it does not hide them."""
    df = frame(spark, 1, 2, 3).join(frame(spark, 1, 2, 3).withColumnRenamed("v", "w"), "id")
    assert guards.require(df.filter("id < 3"), F.col("id") + F.length("v") < 5, "large: ", "id").count() == 2
    fails(guards.require(df, F.col("id") < 3, "large: ", "id").filter("id < 2 and v = 'v1'"), "large: 3")
