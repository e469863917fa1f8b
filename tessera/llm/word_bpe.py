"""BPE encoding and decoding through a pair occurrence index.

The words that a partition's batch has and the worker's cache lacks are laid out as one sequence of symbols.
An index maps every adjacent pair that has a merge rule to all its positions; the active ranks are applied in
ascending order, and each merge updates the lists of the pairs beside it. Words then yield their ids, texts
are looked up word by word, and decoding joins the tokens of the ids.

Null texts count as empty (0 tokens, hashes of empty text); rows with equal or null ids each keep their own
row; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.batches import slices
from tessera.sources.tables import table

TOKENIZER = "word_bpe_49k.json"
#: Control characters at which str.split() would cut but the tokenizer does not.
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
_space = re.compile("[" + "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]+")


class PairIndex:
    """Merges many words at once, rank by rank, on arrays of symbols linked to their neighbours."""

    def __init__(self, merges: list[tuple[str, str]], vocabulary: dict[str, int], end: str):
        self.names = {i: s for s, i in vocabulary.items()}
        first: dict[int, int] = {}
        self.left, self.right, self.made = (np.zeros(len(merges), np.int32) for _ in range(3))
        for rank, (a, b) in enumerate(merges):
            self.left[rank], self.right[rank], self.made[rank] = vocabulary[a], vocabulary[b], vocabulary[a + b]
            first.setdefault(vocabulary[a] << 20 | vocabulary[b], rank)
        codes = np.array(list(first), np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], np.array(list(first.values()), np.int64)[order]
        inner = {ord(s): i for s, i in vocabulary.items() if len(s) == 1}
        last = {ord(s[0]): i for s, i in vocabulary.items() if len(s) == 1 + len(end) and s[1:] == end}
        self.inner, self.last = (np.array([t.get(c, -1) for c in range(max(t) + 2)], np.int32) for t in (inner, last or inner))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is no rule."""
        code = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, given in byte-level characters; characters that the vocabulary lacks are dropped."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths)
        body, tail = self.inner[np.minimum(points, len(self.inner) - 1)], self.last[np.minimum(points[ends - 1], len(self.last) - 1)]
        body[ends - 1] = tail
        symbol = np.insert(body, ends, -1)  # a -1 after each word: no rule joins across it
        symbol = np.append(symbol, np.int32(-1))
        n = len(symbol)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[-1], before[0] = n - 1, n - 1
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(at: np.ndarray, ranks: np.ndarray) -> None:
            """List positions under the ranks of their pairs; a rank that gets its first list becomes active."""
            found = np.flatnonzero(ranks >= 0)
            if not len(found):
                return
            found = found[np.argsort(ranks[found], kind="stable")]
            at, ranks = at[found], ranks[found]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if rank in places:
                    places[rank].append(part)
                else:
                    places[rank] = [part]
                    heapq.heappush(active, rank)

        start = np.arange(n - 1, dtype=np.int32)
        index(start, self.rank_of(symbol[:-1], symbol[1:]))
        while active:
            rank = heapq.heappop(active)
            left, right, made = self.left[rank], self.right[rank], self.made[rank]
            lists = places.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            to = after[at]
            at = at[(symbol[at] == left) & (symbol[to] == right)]  # a merge of lower rank may have taken one of the two
            if left == right and len(at):
                at = self._apart(np.sort(at), after)
            if not len(at):
                continue
            to = after[at]
            following = after[to]
            symbol[at], symbol[to] = made, -2
            after[at], before[following] = following, at
            previous = before[at]
            made_all = np.full(len(at), made, np.int32)
            index(np.concatenate([previous, at]), np.concatenate([self.rank_of(symbol[previous], symbol[at]), self.rank_of(made_all, symbol[following])]))
        kept = symbol >= 0
        counts = np.add.reduceat(kept, np.concatenate([[0], ends[:-1] + np.arange(1, len(words))]))
        ids, out, at = symbol[kept].tolist(), [], 0
        for size in counts.tolist():
            out.append(ids[at : at + size])
            at += size
        return out

    @staticmethod
    def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of equal symbols in a row, the pairs that a walk from the left takes."""
        out, taken = [], -1
        for i, to in zip(at.tolist(), after[at].tolist(), strict=True):
            if i != taken:
                out.append(i)
                taken = to
        return np.array(out, np.int32)


#: Characters for which lower-casing each and splitting by the pattern is all that the tokenizer's own normalizer does.
_plain = re.compile("[\x21-\x7e\xa1-\u024f]+")
_word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_characters() -> list[str]:
    """The printable character that byte-level BPE uses for each byte: itself if printable, else the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_BYTES = dict(enumerate(byte_characters()))


class WordBpe:
    """Encodes and decodes texts. Two caches keep the pieces and words met first, at most ``limit`` each."""

    def __init__(self, file: str, limit: int = 200_000, longest: int = 64):
        with open(file) as f:
            spec = json.load(f)
        model = spec["model"]
        self.index = PairIndex([tuple(m) for m in model["merges"]], model["vocab"], model["end_of_word_suffix"] or "")
        own = Tokenizer.from_file(file)
        self.normalize, self.pre_tokenize = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.limit, self.longest = limit, longest
        self.pieces_known: dict[str, tuple[str, str]] = {}
        self.words_known: dict[str, tuple[str, str]] = {}

    def pieces(self, text: str) -> list[str]:
        """What white space and special strings cut a text into; each encodes by itself as in the text."""
        if any(s in text for s in self.special):
            text = self.split_special.sub(r" \g<0> ", text)
        if any(c in text for c in NOT_SPACE):
            return [p for p in _space.split(text) if p]
        return text.split()

    def words(self, piece: str) -> list[str]:
        """The pre-tokens of a piece as byte-level characters."""
        if _plain.fullmatch(piece):
            found = _word.findall("".join(map(str.lower, piece)) if not piece.isascii() else piece.lower())
            return found if piece.isascii() else [w.encode().decode("latin-1").translate(_BYTES) for w in found]
        return [w for w, _ in self.pre_tokenize(self.normalize(piece))]

    def learn(self, pieces: list[str]) -> dict[str, tuple[str, str]]:
        """ids and decoded form of pieces that the cache lacks, all merged together."""
        parts = [None if p in self.special else self.words(p) for p in pieces]
        known, names = self.words_known, self.index.names
        new = list({w for ws in parts if ws for w in ws if w not in known})
        met = {w: (" ".join(map(str, ids)), " ".join([names[i] for i in ids])) for w, ids in zip(new, self.index.encode(new), strict=True)}
        found = {}
        for piece, words in zip(pieces, parts, strict=True):
            if words is None:
                found[piece] = (str(self.special[piece]), piece)
            elif len(words) == 1:
                found[piece] = known.get(words[0]) or met[words[0]]
            else:
                own = [known.get(w) or met[w] for w in words]
                found[piece] = (" ".join([a for a, _ in own if a]), " ".join([b for _, b in own if b]))
        self._keep(known, met)
        return found

    def _keep(self, cache: dict, new: dict) -> None:
        """Fill a cache up to its limit: what is frequent is met early and stays."""
        room = self.limit - len(cache)
        if room > 0:
            cache.update([x for x in new.items() if len(x[0]) <= self.longest][:room])

    def encode_decode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """The ids of each text in decimal, and the text decoded from them, both joined by spaces."""
        missing: set[str] = set()
        for text in texts:
            missing.update(self.pieces(text))
        new = self.learn([p for p in missing if p not in self.pieces_known])
        del missing
        known = self.pieces_known | new
        for text in texts:
            pairs = [known[p] for p in self.pieces(text)]
            yield " ".join([a for a, _ in pairs if a]), " ".join([b for _, b in pairs if b])
        self._keep(self.pieces_known, new)


@lru_cache(maxsize=1)
def _bpe(file: str) -> WordBpe:
    return WordBpe(file)


def encode_decode(docs: DataFrame, file: str, rows: int = 10_000) -> DataFrame:
    """Each whole text's token count, ids (decimal, joined by a space) and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(file)
        for whole in batches:
            for batch in slices(whole, 1, rows, 16_000_000):
                ids, decoded = zip(*bpe.encode_decode([t or "" for t in batch.column(1).to_pylist()]), strict=True)
                n = pa.array([s.count(" ") + 1 if s else 0 for s in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def digests(docs: DataFrame, file: str, rows: int = 10_000) -> DataFrame:
    """As encode_decode, with SHA-256 of ids and decoded text taken where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(file)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for whole in batches:
            for batch in slices(whole, 1, rows, 16_000_000):
                out = [(s.count(" ") + 1 if s else 0, sha(s), sha(d)) for s, d in bpe.encode_decode([t or "" for t in batch.column(1).to_pylist()])]
                n, a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
