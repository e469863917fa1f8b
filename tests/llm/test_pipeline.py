"""The pipeline against a brute-force version on a small folder of tables, and its stages one by one."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import language_id, near_copies, simhash
from tessera.sources import tables
from tests.llm.test_documents import SPACE

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    english = "the of and with from other being where light stone river under people winter garden letter".split()
    german = "der und mit auf nicht eine haus wasser straße winter garten leute unter fluss stein brief".split()
    make = lambda ws, n: " ".join(rng.choice(ws) + rng.choice(["", "", ".", ","]) for _ in range(n))
    texts = [(make(english if i % 2 else german, rng.randint(25, 300)), "en" if i % 2 else "de") for i in range(80)]
    texts += [texts[3], texts[3], (texts[10][0] + " end", "de"), ("too short", "en"), (None, "en"), ("", "en"), ("again and again it is said here " * 30, "en")]
    texts += [("mail me at x.y@example.org or +1 (415) 555-0000 " + make(english, 60), "en"), ("1 2 3 4 5 " * 10 + "6", "en"), (make(english, 5000), None)]
    rows = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def masked(text):
    """The base kinds that the texts hold, by the rules of the task; kinds that they do not hold are left out."""
    text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<email>", text)
    return re.sub(r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: "<phone>" if 8 <= sum(c.isdigit() for c in m[0]) <= 15 else m[0], text)


def test_against_brute_force(spark, folder):
    path, rows = folder
    kept = []
    for row in rows:
        w = SPACE.findall(row[1] or "")
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        if len(w) >= 20 and 100 * len(covered) <= 30 * len(w) and any(c.isalpha() for c in row[1]):
            kept.append(row)
    label = plain_groups([shingled(r[1]) for r in kept])
    first = {}
    for g, r in zip(label, kept, strict=True):
        first[g] = min(first.get(g, r), r)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for r in first.values():
        ids = [*tokenizer.encode(masked(r[1]), add_special_tokens=False).ids, 0]
        end, at = len(ids) % 2048 or 2048, 0
        while at < len(ids):
            part = ids[at:end]
            want[r[0]].append((at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
            at, end = end, end + 2048
    have = defaultdict(list)
    for r in corpus_pipeline.run(spark, path).collect():
        have[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == dict(want)


def test_stages(spark, folder, tmp_path):
    path, _ = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "PII", "best-fit packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, path)
        assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.filter("text like '%@example.org%'").count() == 0
    assert docs.filter("text like '%<email>%<phone>%'").count() == 1


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty(spark, folder, stage):
    assert stage(spark, spark.createDataFrame([], COLUMNS), folder[0]).count() == 0


def test_nulls_and_repeats(spark, folder):
    """Texts without words fail the rules and have no language; they are copies of each other; each is a piece of one token."""
    docs = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(1, None, None, None, None), (1, "", "en", None, 0)], COLUMNS)
    found = [sorted(map(tuple, stage(spark, docs, folder[0]).collect()), key=repr) for _, stage in corpus_pipeline.STAGES]
    assert found[:2] == [[], []] and found[2] == [(1, None, None, None, None)]
    assert [r[:2] for r in found[3]] == [(1, ""), (1, None), (None, None), (None, None)] or sorted(r[0] is None for r in found[3]) == [False, False, True, True]
    assert len(found[4]) == 4 and {r[3] for r in found[4]} == {1}


def test_language_stage_rejects_below_its_threshold(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    scores = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, language_id.train(language_id.with_fold(docs))).collect()}
    cut = sorted(s for _, s in scores.values())[len(scores) // 2]
    for least in (0.5, cut):
        monkeypatch.setattr(corpus_pipeline, "LANGUAGE_SCORE", least)
        got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs, folder[0]).collect()}
        assert got == {i: lang for i, (lang, s) in scores.items() if lang != "und" and s >= least}
    assert 0 < len(got) < len(scores)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def shingled(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_at_similarity(spark, folder):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(100, 200))) for _ in range(40)]
    for t in texts[:30]:  # a few words changed: similarity on both sides of 0.8
        for edits in (1, 2, 3, 6):
            w = t.split()
            for at in rng.sample(range(len(w)), edits):
                w[at] = "changed"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    sets = [shingled(t) for t in texts]
    label = list(range(len(texts)))
    while True:
        new = [min(label[j] for j in range(len(texts)) if jaccard(sets[i], sets[j]) >= 0.8) for i in range(len(texts))]
        if new == label:
            break
        label = new
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)
    got = {r.doc_id for r in corpus_pipeline.near_duplicate(spark, docs, folder[0]).collect()}
    assert got == set(label)
    assert len(set(label)) < len(texts)


def test_verdicts_by_row(spark, folder):
    rng = random.Random(13)
    good = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(60))
    a, b, c = good(), good(), good()
    row = lambda i, t: (i, t, "en", "s", len(t or ""))
    rows = [row(1, a), row(1, "too short"), row(None, b), row(None, "junk"), row(None, None), row(2, c)]
    collected = lambda stage, rs: sorted(map(tuple, stage(spark, spark.createDataFrame(rs, COLUMNS), folder[0]).collect()), key=repr)
    assert collected(corpus_pipeline.quality, rows) == sorted([row(1, a), row(None, b), row(2, c)], key=repr)
    copies = [row(4, a), row(3, a + " x"), row(3, a), row(3, a), row(None, a), row(None, b), row(None, b), row(3, c), row(3, None), row(5, "")]
    assert collected(corpus_pipeline.near_duplicate, copies) == sorted([row(3, a), row(None, b), row(3, c), row(3, None)], key=repr)


def plain_groups(sets):
    label = list(range(len(sets)))
    while True:
        new = [min(label[j] for j in range(len(sets)) if i == j or (sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8)) for i in range(len(sets))]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("block, size", [(5, 10**9), (17, 10**9), (60, 10**9), (1000, 10**9), (1000, 4_000)])
def test_large_groups_in_blocks(spark, block, size):
    """Provisional groups of chains, dense clusters and strangers, cut into blocks, keep every link."""
    rng = random.Random(block)
    rows = []
    for root in range(3):
        base = {rng.randrange(1 << 40) for _ in range(40)}
        for _ in range(50):  # a dense cluster
            rows.append((root, (base - set(rng.sample(sorted(base), 2))) | {rng.randrange(1 << 40)}))
        chain = {rng.randrange(1 << 40) for _ in range(40)}
        for _ in range(25):  # each like the one before, the ends unlike
            chain = (chain - set(rng.sample(sorted(chain), 3))) | {rng.randrange(1 << 40) for _ in range(3)}
            rows.append((root, set(chain)))
        rows += [(root, {rng.randrange(1 << 40) for _ in range(40)}) for _ in range(10)]
    keyed = [(root, i, np.array(sorted(s), np.uint64).tobytes()) for i, (root, s) in enumerate(rows)]
    sets = spark.createDataFrame(keyed, "root long, key long, shingles binary").repartition(3).cache()
    got = {r.fp: r.root for r in simhash.components(near_copies.exact_links(sets, 0.8, block, size)).collect()}
    want = plain_groups([s for _, s in rows])
    assert [got.get(i, i) for i in range(len(rows))] == want


def test_texts_move_once(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    rows = near_copies.by_row(docs, corpus_pipeline.COLUMNS)
    few = spark.createDataFrame([(1,)], "row long").hint("merge")
    plan = rows.join(few, "row", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # of the short side


def chain(n, keep=34):
    """One provisional group of sets of 40 in which neighbours share ``keep`` (similarity 0.74): nothing is similar."""
    return [(0, i, np.arange(i * (40 - keep), i * (40 - keep) + 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for i in range(n)]


def test_pairs_formed_grow_in_proportion(spark, monkeypatch):
    """Unlike nodes of one chained group: candidates grow with the nodes, not with their square; so do all staged rows."""
    formed = {}
    for n in (500, 4_000):
        sizes = {}
        real = tables.staged
        monkeypatch.setattr(near_copies, "staged", lambda df, name, sizes=sizes: (out := real(df, name), sizes.update({name: out.count()}))[0])
        sets = spark.createDataFrame([(r, k, np.sort(s).tobytes()) for r, k, s in chain(n)], "root long, key long, shingles binary").cache()
        assert near_copies.exact_links(sets, 0.8, 50).count() == 0
        monkeypatch.setattr(near_copies, "staged", real)
        formed[n] = sizes
    assert formed[4_000]["candidates"] <= 9 * max(formed[500]["candidates"], 500)
    assert all(formed[4_000][k] <= 9 * formed[500][k] + 100 for k in formed[500])


def test_a_common_template_forms_no_pairs(spark):
    """Sets that share 85 % of their shingles (similarity 0.74) meet in no prefix."""
    base = np.arange(1, 86, dtype=np.uint64)
    rows = [(0, i, 1 if i else 0, 0, np.sort(np.concatenate([base, np.arange(15, dtype=np.uint64) + np.uint64(1000 + 15 * i)])).tobytes()) for i in range(300)]
    nodes = spark.createDataFrame([(r, k, k, 0, s) for r, k, _, _, s in rows], "root long, key long, grp long, main long, shingles binary")
    assert near_copies.candidates(nodes, 0.8).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_candidates_hold_every_similar_pair(spark, seed):
    rng = random.Random(seed)
    pool = [rng.randrange(1 << 40) for _ in range(120)]
    sets = [set(rng.sample(pool, rng.randint(3, 25))) for _ in range(20)]
    sets += [set(list(s)[: max(1, len(s) - rng.randint(0, 3))]) | set(rng.sample(pool, rng.randint(0, 2))) for s in sets for _ in range(3)]
    rows = [(0, i, i % 5, 2, np.array(sorted(s), np.uint64).tobytes()) for i, s in enumerate(sets)]
    got = {frozenset((r.fp, r.to)) for r in near_copies.candidates(spark.createDataFrame(rows, "root long, key long, grp long, main long, shingles binary"), 0.8).collect()}
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if i % 5 != j % 5 and jaccard(sets[i], sets[j]) >= 0.8}
    assert want <= got and want and all(i % 5 != j % 5 for i, j in map(tuple, got))


def test_no_table_name_is_left(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    kept = corpus_pipeline.near_duplicate(spark, docs, folder[0]).count()
    assert 0 < kept and [t.name for t in spark.catalog.listTables() if t.name.startswith("staged_")]
    tables.drop_staged(spark)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("staged_")]


def word_sets(rng, bases, copies):
    """Sets of 1 to 300 hashes, and others that share more or less of each."""
    sets = []
    for _ in range(bases):
        base = [rng.getrandbits(64) for _ in range(rng.choice([1, 3, 4, 5, 16, 60, 300]))]
        sets.append(set(base))
        for _ in range(copies):
            cut = rng.randint(0, max(1, len(base) // 4))
            sets.append((set(base[cut:]) | {rng.getrandbits(64) for _ in range(rng.randint(0, max(1, len(base) // 6)))}) or {1})
    return [np.array(sorted(s), np.uint64) for s in sets]


@pytest.mark.parametrize("shard", [3, 40, 20_000])
def test_candidates_come_from_fingerprints(spark, shard):
    """Groups of nodes by bits of fingerprints and by size, against all pairs; every pair at the similarity is in one group."""
    sets = word_sets(random.Random(shard), 40, 5)
    bits = np.array([np.unpackbits(np.frombuffer(near_copies.fingerprint(s), np.uint8)) for s in sets])
    of = lambda i, j: (np.count_nonzero(bits[i] != bits[j]), np.count_nonzero(bits[i][:64] != bits[j][:64]), min(len(sets[i]), len(sets[j])) / max(len(sets[i]), len(sets[j])))
    near = {(i, j) for i in range(len(sets)) for j in range(i) if (d := of(i, j))[0] <= near_copies.RADIUS and d[1] <= near_copies.FIRST and d[2] >= 0.8 and min(len(sets[i]), len(sets[j])) >= 4}
    nodes = spark.createDataFrame([(i, len(s), near_copies.fingerprint(s)) for i, s in enumerate(sets)], "key long, n int, print binary")
    got = {r.fp: r.root for r in simhash.components(near_copies.print_links(nodes, 0.8, shard)).collect()}
    label = list(range(len(sets)))
    while True:
        new = [min([label[i]] + [label[b if a == i else a] for a, b in near if i in (a, b)]) for i in range(len(sets))]
        if new == label:
            break
        label = new
    assert [got.get(i, i) for i in range(len(sets))] == label
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8 and len(sets[i]) >= 4]
    assert len(alike) > 40 and all(label[i] == label[j] for i, j in alike)


def test_near_copies_need_near_fingerprints(spark, folder, monkeypatch):
    """The stage's candidates are SimHash's alone: with fingerprints that lie apart, no near copy meets another."""
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join(words + [f"end{i}"]), "en", "s", 1) for i in range(6)], COLUMNS).coalesce(1)
    count = lambda: corpus_pipeline.near_duplicate(spark, docs, folder[0]).count()
    assert count() == 1
    real, far = near_copies.print_links, lambda key: np.random.default_rng(abs(key)).bytes(8 * near_copies.WORDS)
    apart = lambda nodes: spark.createDataFrame([(r.key, r.n, far(r.key)) for r in nodes.collect()], "key long, n int, print binary")
    monkeypatch.setattr(near_copies, "print_links", lambda nodes, similarity: real(apart(nodes), similarity))
    assert count() == 6


@pytest.mark.parametrize("words", ["866890 355964 440910 259686 679370 868542 90251 720667 34239", "533257 589310 905173 851080 370369 670644 435732 359410 214205", "819467 464942 618422 304634 122263 462305 97186 639965 282894"])
def test_small_near_copies_with_far_fingerprints_meet(spark, folder, words):
    """Four of five shingles in common, and 25 of the first 64 bits or 74 of all differ: copies at the similarity that a radius of 24 and 72 misses."""
    named = [f"w{w}" for w in words.split()]
    sets = [set(near_copies.shingle_set(" ".join(t), 5).tolist()) for t in (named[:8], named)]
    assert jaccard(*sets) == 0.8
    docs = spark.createDataFrame([(1, " ".join(named[:8]), "en", "s", 1), (2, " ".join(named), "en", "s", 1)], COLUMNS).coalesce(1)
    assert [r.doc_id for r in corpus_pipeline.near_duplicate(spark, docs, folder[0]).collect()] == [1]


@pytest.mark.parametrize("seed", range(3))
def test_dense_groups_by_vantage_points(seed, monkeypatch):
    """A dense group with a chain that leads out of it: the same groups as without vantage points."""
    rng = np.random.default_rng(seed)
    flip = lambda x, k: x ^ np.packbits(np.isin(np.arange(256), rng.choice(256, k, replace=False))).view(np.uint64)
    core = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    rows = [flip(core, int(k)) for k in rng.integers(0, 15, 400)]
    for _ in range(5):
        rows.append(flip(rows[-1], 40))
    rows += list(rng.integers(0, 1 << 63, (200, 4), dtype=np.uint64))
    x, n = np.array(rows)[rng.permutation(len(rows))], np.full(len(rows), 50)
    got = near_copies.print_groups(x, n, 0 * n, 0.8)
    monkeypatch.setattr(near_copies, "DENSE", -1)
    assert got.tolist() == near_copies.print_groups(x, n, 0 * n, 0.8).tolist()
    assert np.bincount(got).max() >= 400
