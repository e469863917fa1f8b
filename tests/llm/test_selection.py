"""Resampling, vector codes and the quality classifier against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.llm import language_id, quality_score, resampling, syncmers, vector_codes
from tessera.llm.registry import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def resampled(rows, target):
    """The draw from its definition; rows of (doc_id, text)."""
    own, other = (Counter(zlib.crc32(f.encode()) % 10_000 for t in side for f in features(t)[1]) for side in ([t for _, t in rows], target))
    s, t = sum(own.values()), sum(other.values())
    gain = lambda b: math.floor(1000 * math.log((other[b] + 1) * (s + 10_000) / ((own[b] + 1) * (t + 10_000))))
    out = []
    for i, text in rows:
        words, f = features(text)
        weight = sum(gain(zlib.crc32(x.encode()) % 10_000) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for place, r in enumerate(fit[: 25 * len(fit) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in out]


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_byte_table():
    assert resampling.BYTES[ord("A")] == ord("a") and resampling.BYTES[ord("9")] == ord("9") and resampling.BYTES[ord("_")] == 32 and resampling.BYTES[0xC3] == 0xC3


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
@pytest.mark.parametrize("order", [1, 2, 3])
def test_blocks_change_nothing(monkeypatch, block, order):
    monkeypatch.setattr(resampling, "BLOCK", block)
    text = "Ab c_D é1 x\u0000y ÀB  Z9 q " * 5
    w, _ = features(text)
    want = Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, order + 1) for i in range(len(w) - n + 1))
    got = list(resampling.buckets(text.encode(), order))
    assert Counter(b for _, found in got for b in found.tolist()) == want and sum(n for n, _ in got) == len(w)


def test_resampling(spark, docs, rows):
    target = ["alpha beta the of gamma", None, "", "alpha beta the of gamma"]
    found = resampling.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string")).select("doc_id", "n_features", "weight", "score", "rank")
    assert tuples(found) == sorted(resampled([r[:2] for r in rows], target), key=repr)
    assert sum(r["rank"] is not None for r in found.collect()) > 5


def test_resampling_empty(spark, docs, empty):
    none = empty.select("text")
    assert resampling.resampled(empty, none).count() == 0
    assert {r.weight for r in resampling.resampled(docs, none).filter("n_features = 0").collect()} == {0}


def test_resampling_ties_and_shares(spark):
    rows = [(i % 7, "same words " * 12) for i in range(40)] + [(None, "same words " * 12)] * 3 + [(50, "few")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = resampling.resampled(docs, docs, percent=100).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 44)) and [r["rank"] for r in found if r.doc_id == 50] == [None]
    assert resampling.resampled(docs, docs, percent=100, min_words=0).filter("rank is null").count() == 0
    assert tuples(resampling.resampled(docs, docs).select("doc_id", "n_features", "weight", "score", "rank")) == sorted(resampled(rows, [t for _, t in rows]), key=repr)


def compressed(rows, rounds=6):
    """vec_id, code, error, label_error and the codebooks in Python integers; rows of (vec_id, vector, label)."""
    ok = lambda v: v is not None and len(v) and len(v) % 8 == 0 and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if ok(v)]
    order = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [r for r in whole if len(r[1]) == len(order[0][1])]
    order = [r for r in order if len(r[1]) == len(order[0][1])]
    k = len(order[0][1]) // 8
    cut = lambda v, p: v[p * k : (p + 1) * k]
    books = [[cut(v, p) for _, v, _ in order[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda a, p: min(range(len(books[p])), key=lambda e: (far(a, books[p][e]), e))
    for _ in range(rounds):
        for p in range(8):
            at = [near(cut(v, p), p) for _, v, _ in whole]
            for e in set(at):
                own = [cut(v, p) for (_, v, _), a in zip(whole, at, strict=True) if a == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for i, v, label in whole:
        code = [near(cut(v, p), p) for p in range(8)]
        out.append((i, "".join(f"{c:02x}" for c in code), sum(far(cut(v, p), books[p][c]) for p, c in enumerate(code)), label))
    total: Counter = Counter()
    for *_, e, label in out:
        total[label] += e
    return sorted(((i, c, e, total[label]) for i, c, e, label in out), key=repr), books


VECTORS = "vec_id long, embedding array<float>, label int, v string, codes int, error int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(3)


def result(found):
    return tuples(vector_codes.with_label_sums(found).select("vec_id", "code", "error", "label_error"))


@pytest.fixture(scope="module")
def some():
    rng = random.Random(8)
    centre = [[rng.gauss(0, 0.3) for _ in range(16)] for _ in range(5)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in centre[i % 5]], None if i % 9 == 0 else i % 3) for i in range(3, 150)]
    rows += [rows[4], (rows[5][0], rows[6][1], 1), (None, rows[8][1], None), (0, None, 1), (1, [], 1), (2, [0.5] * 15 + [None], 1), (200, [float("nan")] * 16, 1), (201, [float("inf")] + [0.0] * 15, 2), (202, [0.25] * 8, 2), (203, [0.25] * 9, 2), (204, [-0.0] * 16, 2)]
    return rows


@pytest.mark.parametrize("block", [1, 10, 8192])
def test_vector_codes(spark, monkeypatch, some, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    found, books = vector_codes.compressed(vectors(spark, some))
    want, exact = compressed(some)
    assert books == exact and result(found) == want


def test_vector_codes_of_any_size(spark):
    """Values whose squares exceed 64 bits keep their places; an error beyond a long is null."""
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 10 ** rng.choice([0, 4, 30]))) for _ in range(8)], i % 2) for i in range(40)]
    found, books = vector_codes.compressed(vectors(spark, rows), 3)
    want, exact = compressed(rows, 3)
    assert books == exact
    fit = lambda e: e if e is not None and e < 1 << 63 else None
    assert [(r[0], r[1], r[2]) for r in tuples(found.select("vec_id", "code", "error"))] == sorted(((i, c, fit(e)) for i, c, e, _ in want), key=repr)


@pytest.mark.parametrize("n", [1, 5])
def test_few_vectors(spark, n):
    rows = [(i, [0.1 * i] * 8, 1) for i in range(n)]
    found, books = vector_codes.compressed(vectors(spark, rows))
    assert result(found) == compressed(rows)[0] and len(books[0]) == n


def test_no_vectors(spark):
    found, _ = vector_codes.compressed(vectors(spark, [(1, None, 1)]).filter("vec_id = 1"))
    assert result(found) == []


def test_hot_labels(spark, monkeypatch):
    """Hot labels come by broadcast, the others by a join: the sums are the same."""
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 50, i) for i in range(300)], "vec_id long, label int, error long")
    want = Counter()
    for r in rows.collect():
        want[r.label] += r.error
    for hot in (2, 10, 10_000):
        monkeypatch.setattr(vector_codes, "HOT", hot)
        assert all(r.label_error == want[r.label] for r in vector_codes.with_label_sums(rows).collect())
        assert vector_codes.with_label_sums(rows).count() == 300


def test_limbs():
    for x in (0, 5, -5, 1 << 40, -(1 << 100) - 3):
        assert sum(d << (vector_codes.LIMB * k) for k, d in vector_codes.limbs(x)) == x


def test_op12_sql(spark, tmp_path, some):
    """The registered query and its SQL on vectors with what is dropped and with hot and null labels."""
    rows = [r for r in {r[0]: r for r in some if r[0] is not None}.values() if r[1] is None or len(r[1]) in (0, 16)]
    df = vectors(spark, rows).select("vec_id", "embedding", "label")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = QUERIES["op12_vector_codes"](spark, str(tmp_path))
    assert tuples(got.select("vec_id", "code", "error", "label_error", "codebooks_sha256")) == sorted(con.execute(vector_codes.OP12_SQL).fetchall(), key=repr)


def test_tokens():
    assert list(quality_score.tokens("Der HUND der_der 12!! iPhone Hund hund HUND HUND")) == ["der", "A", "hund", "der", "_", "=", "12", "!!", "aA", "iphone", "hund", "hund", "A", "hund", "="]


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_counted(monkeypatch, block):
    monkeypatch.setattr(quality_score, "BLOCK", block)
    text = "One two, two THREE \ud800 four one two " * 3
    t = [x.encode("utf-8", "surrogatepass") for x in quality_score.tokens(text)]
    place = lambda g: (zlib.crc32(g) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - quality_score.BITS)
    want = Counter(place(b" ".join(t[i : i + n])) for n in (1, 2) for i in range(len(t) - n + 1))
    at, n = quality_score.counted(text)
    assert dict(zip(at.tolist(), n.tolist(), strict=True)) == want


def test_score_is_a_dot_product():
    rng = np.random.default_rng(1)
    model = quality_score.Model(rng.normal(size=1 << quality_score.BITS), -0.4)
    text = "a b a c! a b"
    at, n = quality_score.counted(text)
    z = -0.4 + sum(model.weights[b] * math.sqrt(c / n.sum()) for b, c in zip(at, n, strict=True))
    assert model.score((at, n)) == pytest.approx(1 / (1 + math.exp(-z)))
    assert model.score(quality_score.counted(None)) == model.score(quality_score.counted(" \n")) == pytest.approx(1 / (1 + math.exp(0.4)))


def test_follow_the_leader():
    """Steps against the recurrences coordinate by coordinate."""
    rows = [(np.array([1, 5]), np.array([0.6, 0.8]), 1), (np.array([5, 9]), np.array([0.6, 0.8]), 0), (np.array([1]), np.array([1.0]), 1)]
    alpha, l1, l2, beta, bias = 2.0, 0.05, 0.1, 1.0, 0.3
    z, n = Counter(), Counter()
    w = lambda b: 0.0 if abs(z[b]) <= l1 else (math.copysign(l1, z[b]) - z[b]) / ((beta + math.sqrt(n[b])) / alpha + l2)
    order = np.random.default_rng(0)
    for _ in range(3):
        for i in order.permutation(3):
            at, x, y = rows[i]
            now = {b: w(b) for b in at.tolist()}
            p = 1 / (1 + math.exp(-bias - sum(now[b] * v for b, v in zip(at.tolist(), x, strict=True))))
            for b, v in zip(at.tolist(), x, strict=True):
                g = (p - y) * v
                z[b] += g - (math.sqrt(n[b] + g * g) - math.sqrt(n[b])) / alpha * now[b]
                n[b] += g * g
    model = quality_score.follow_the_leader(rows, bias, alpha, l1, l2)
    assert model.weights[[1, 5, 9]] == pytest.approx([w(1), w(5), w(9)], rel=1e-5) and np.count_nonzero(model.weights) == 3


def labelled(n, seed=4):
    rng = random.Random(seed)
    words = "the of and with from other being where light stone river".split()
    rows = []
    for i in range(n):
        bad = i % 6 == 0
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))
        rows.append((i, text.upper() if bad and i % 12 else re.sub(" ", "$$ ", text) if bad else text, int(not bad)))
    return rows


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = labelled(900)
    path = str(tmp_path_factory.mktemp("labelled"))
    docs = [r[:2] for r in rows] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "word " * 200_000), (None, "null id"), rows[7][:2], (8, "the same id again")]
    spark.createDataFrame([(*d, 9, "clash", 1) for d in docs], "doc_id long, text string, score int, y string, h int").repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(i, q, 0) for i, _, q in rows if i % 7] + [(None, 1, 0), (5, None, 0), (10, 0, 0), (99_999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, docs, labels


def test_op13(spark, corpus):
    path, rows, docs, _ = corpus
    got = QUERIES["op13_quality_classifier"](spark, path).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    assert sorted(((r.doc_id, r.held_out) for r in got), key=repr) == sorted(((i, held(i)) for i, _ in docs), key=repr)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    mark = {i: q for i, _, q in rows}
    out = [(r.predicted, mark[r.doc_id]) for r in got if r.held_out and r.doc_id in mark]
    assert len(out) > 150 and sum(a == b for a, b in out) / len(out) > 0.97
    assert len({r.score for r in got if r.doc_id in (2000, 2001, 2002)}) == 1
    again = QUERIES["op13_quality_classifier"](spark, path).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_labels_of_held_out_documents_are_not_read(spark, corpus, tmp_path):
    path, _, _, labels = corpus
    spark.read.parquet(f"{path}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    turned = [(i, 1 - q if q is not None and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    spark.createDataFrame(turned, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    name = "op13_quality_classifier"
    assert tuples(QUERIES[name](spark, path)) == tuples(QUERIES[name](spark, str(tmp_path)))


def test_sample_bounds(spark, corpus):
    """Both bounds hold, and copies of a row count as one."""
    path, *_ = corpus
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    many = docs.unionByName(docs).unionByName(docs)
    rows, counts = quality_score.sample(many, labels, 200, 10**9)
    found = rows.collect()
    assert len(found) == 200 and len({r.h for r in found}) == 200 and set(counts) == {0, 1}
    small = quality_score.sample(many, labels, 200, 20_000)[0].collect()
    assert 0 < len(small) < 200 and sum(len(r["at"]) + len(r["n"]) for r in small) <= 20_000


def test_without_labels(spark, corpus, empty):
    path, *_ = corpus
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_score.train(docs, labels.filter("false"))
    assert {r.score for r in quality_score.scored(docs, model).collect()} == {0.5}
    one = quality_score.train(docs, labels.filter("quality = 1"))
    assert min(r.score for r in quality_score.scored(docs, one).collect()) > 0.9
    assert quality_score.scored(empty, model).count() == 0 and quality_score.train(empty, labels).score(quality_score.counted("x")) == 0.5


def test_language_sample_in_bytes(spark, docs):
    """The sample's features stay within the bound; a language keeps its first row."""
    usable = language_id.with_fold(docs).filter("fold <> 0 and lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    whole = language_id.sample(usable, counts, 1_000, 10**9).collect()
    weight = lambda rows: sum(len(r["at"]) + len(r["n"]) for r in rows)
    some = language_id.sample(usable, counts, 1_000, weight(whole) // 3).collect()
    assert 0 < len(some) < len(whole) and weight(some) <= weight(whole) // 3
    assert {r["lang"] for r in language_id.sample(usable, counts, 1_000, 1).collect()} == set(counts)


def test_language_prediction_by_hand():
    """The score is the softmax of the mean weight of all n-grams, over the temperature."""
    rng = np.random.default_rng(3)
    model = language_id.Model(["de", "en", "fr"], rng.normal(size=(1 << language_id.BITS, 3)).astype(np.float32), 0.4)
    for text in ("a", "Ab a", "straße 12", "x" * 70_000):
        low, total, n = text.lower(), np.zeros(3), 0
        for size in (1, 2, 3):
            for i in range(len(low) - size + 1):
                total += model.weights[gram(low[i : i + size])]
                n += 1
        p = np.exp(total / n / 0.4)
        lang, score = model.predict(text)
        assert lang == model.classes[int(p.argmax())] and score == pytest.approx(float(p.max() / p.sum()), rel=1e-4)
    assert model.predict("12 !") == model.predict(None) == ("und", 0.0)


def gram(s):
    """The bucket of an n-gram from its definition, in Python integers."""
    m, mask, run = 0x9E3779B97F4A7C15, (1 << 64) - 1, 0
    for n, c in enumerate(s, 1):
        run = (run + ord(c) + n) * m & mask
    return ((run ^ run >> 29) * m & mask) >> (64 - language_id.BITS)


@pytest.mark.parametrize("hot", [2, 5, 10**9])
@pytest.mark.parametrize("part", [3, 10**6])
def test_equal_rows_are_counted_apart(spark, monkeypatch, hot, part):
    """Fingerprints beside the next document: the same rows whether hot equal rows are counted or not."""
    monkeypatch.setattr(syncmers, "HOT", hot)
    monkeypatch.setattr(syncmers, "PART", part)
    rng = random.Random(1)
    make = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(40))
    texts = [make() for _ in range(12)]
    rows = [(i % 9, texts[i]) for i in range(12)] + [(4, texts[4])] * 13 + [(None, None)] * 9 + [(None, texts[0])] * 4 + [(8, "")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is not None, r[0] or 0, hashes(spark, r[1]), r[1]))
    want = [syncmers.compared(i, t, syncmers.sketch(t), n, syncmers.sketch(n)) for (i, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True)]
    assert tuples(syncmers.compare_with_next(docs)) == sorted(want, key=repr)


_hash: dict = {}


def hashes(spark, text):
    if text not in _hash:
        _hash[text] = spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0]
    return _hash[text]
