"""The registered queries themselves, with their production parameters, on a small folder of tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import quality
from tessera.llm.registry import QUERIES

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
BYTES, WORDS = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean, noisy, repeated and odd texts in two languages, most of the first kinds labelled."""
    rng = random.Random(21)
    words = {"en": "the of and with from other being where light stone river".split(), "de": "der und mit auf nicht eine haus wasser garten".split()}
    rows, labels = [], []
    for i in range(1200):
        lang = "en" if i % 3 else "de"
        bad = i % 5 == 0
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(25, 60)))
        if bad:
            text = " ".join(w + rng.choice(["$$", "!!", "###", " w w w"]) for w in text.split())
        elif rng.random() < 0.03:
            text += " $$$ !!! " * 4
        rows.append((i, text, lang, "s", len(text)))
        if i % 4:
            labels.append((i, int(not bad) if rng.random() < 0.97 else int(bad), 0))
    rows += [(2000, None, "en", "s", 0), (2001, "", None, "s", 0), (2002, "x" * 3000 + " <|endoftext|> é　ß", None, "s", 0), (2003, "too short", "de", "s", 0), (None, rows[0][1], "en", "s", 0), rows[7]]
    path = str(tmp_path_factory.mktemp("registered"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, labels


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


def measured(text):
    """The measures of the rules from their definitions."""
    t = text or ""
    w, lines = SPACE.findall(t), [x for x in t.split("\n") if SPACE.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    chars = sum(map(len, w))
    share = lambda a, b: a / b if b else 0.0
    rules = {
        "symbol_share": share(len(re.findall(r"[#*$%&|<>]", t)), chars), "shout_share": share(len(re.findall("[!?]", t)), chars), "upper_share": share(sum(c.isupper() for c in t), chars),
        "dup_line_share": share(len(lines) - len(set(lines)), len(lines)), "repeat_share": share(len(covered), len(w)), "stutter_share": share(sum(a == b for a, b in zip(w, w[1:], strict=False)), len(w)), "word_length": share(chars, len(w)),
    }
    return rules, len(w) < 20 or 100 * len(covered) > 30 * len(w)


def tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0


def test_op2(spark, folder):
    """Verdicts against cutoffs chosen by exact binomial bounds, one stratum, rule and cutoff after another."""
    path, rows, labels = folder
    judged = {}
    for i, q, _ in labels:
        judged[i] = min(q, judged.get(i, 1))
    found = [(i, lang or "und", *measured(text)) for i, text, lang, *_ in rows]
    held = [(s, judged[i], m) for i, s, m, failed in found if i in judged and not failed]
    strata = {s for s, _, _ in held}
    rules, alpha, delta = len(quality.RULES), 0.1, 0.05
    cut = {}
    for s in strata:
        good, bad = ([m for x, q, m in held if x == s and q == want] for want in (1, 0))
        for rule, grid in quality.RULES.items():
            best = None
            for c in sorted(grid, reverse=True):
                k, b = (sum(m[rule] > c for m in side) for side in (good, bad))
                if tail(k, len(good), alpha / rules) > delta / rules / len(strata):
                    break
                gain = (b / len(bad) if bad else 0) - 5.0 * (k / len(good) if good else 0)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, c)
            if best:
                cut[s, rule] = best[1]
    assert cut
    want = [(i, failed, not failed and not any(m[r] > cut.get((s, r), math.inf) for r in m)) for i, s, m, failed in found]
    same([(r.doc_id, r.base_failed, r.kept) for r in QUERIES["op2_quality_rules"](spark, path).collect()], want)
    kept = [(i, k) for i, _, k in want if i in judged]
    assert 0.5 < sum(k for _, k in kept) / len(kept) < 1


def test_op2_sql(spark, folder):
    """The registered SQL gives the same rows."""
    path, rows, labels = folder
    unique = list({r[0]: r for r in rows if r[0] is not None}.values())  # the SQL joins by id
    docs = spark.createDataFrame(unique, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in quality.quality_rules(docs, spark.read.parquet(f"{path}/labels.parquet")).select("doc_id", *quality.BASE, "base_failed", "kept", F.array_join("rejected_by", ",")).collect()]
    con = duckdb.connect()
    tables = {"documents": docs.toPandas(), "labels": spark.read.parquet(f"{path}/labels.parquet").toPandas()}
    for name, df in tables.items():
        con.register(name, df)
    same(got, con.execute(quality.OP2_SQL).fetchall())
    assert len({r[-1] for r in got}) > 2


def test_op3(spark, folder):
    path, rows, _ = folder
    texts = [(i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, [*SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]) for i, t, *_ in rows]
    c = Counter(w for _, out, ws in texts if not out for w in ws)
    n, z = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    got = QUERIES["op3_language_model"](spark, path)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mean_score"]
    got = got.collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got], [(i, out, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / z) for w in ws), 5)) for i, out, ws in texts])
    clean = [r for r in got if r.doc_id is not None and r.doc_id < 1200 and r.held_out]
    assert sum(r.score for r in clean) > sum(r.base_score for r in clean)  # the context helps on texts not learned from


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_op4(spark, folder):
    path, rows, _ = folder
    want = []
    for i, t, *_ in rows:
        ids = WORDS.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(WORDS.decode(ids, skip_special_tokens=False))))
    same(map(tuple, QUERIES["op4_bpe_codec"](spark, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), want)


def test_op5(spark, folder):
    path, rows, _ = folder
    want, total = [], 0
    for i, t, *_ in rows:
        ids = [*BYTES.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        end, at, piece = len(ids) % 2048 or 2048, 0, 0
        while at < len(ids):
            part = ids[at:end]
            want.append((i, piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
            at, end, piece = end, end + 2048, piece + 1
    got = QUERIES["op5_packing"](spark, path).collect()
    same([tuple(r)[:5] for r in got], want)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(total / 2048) + 1


def test_op8(spark, folder):
    path, rows, _ = folder
    want = [(i, len((t or "").encode()), n, n > 512) for i, t, *_ in rows for n in [len(BYTES.encode(t or "", add_special_tokens=False).ids)]]
    same(map(tuple, QUERIES["op8_token_counts"](spark, path).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), want)


def test_op9_and_op10(spark, folder):
    path, rows, _ = folder
    got = QUERIES["op9_syncmers"](spark, path)
    assert got.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    same([(r.doc_id, r.n_chars) for r in got.collect()], [(i, len(t or "")) for i, t, *_ in rows])
    by = {r.doc_id: r for r in QUERIES["op10_simhash"](spark, path).collect()}
    assert by[2000].fingerprint == by[2001].fingerprint == "0" * 16
    assert by[0].component_id == 0 and by[None].fingerprint == by[0].fingerprint and by[2001].component_id == 2000
