"""Personal data: expressions propose spans, checksums confirm them, nearby context words adjust the score.

Every kind has an expression, a base score, a validator and context words. A span's score is the base score,
raised where the validator is a checksum that holds and where one of the kind's context words stands within
``CONTEXT`` characters before it, lowered where a word of a contrary kind does (order, invoice, version).
Spans that reach ``THRESHOLD`` are kept. The four base kinds keep every span that passes its validator, with its
score; the method adds shorter card numbers and those next to other digits, IBANs (mod 97), social security
numbers, phone numbers without a plus sign and secrets after a key word. Every scan takes time in proportion to
the text: runs are taken whole (possessively), and an e-mail address is sought from its ``@``.

Null texts count as empty (no spans; the digest of empty text); rows with equal or null ids each keep their
own row; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

CONTEXT, THRESHOLD = 40, 0.5


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(s: str) -> bool:
    """The weighted digit sum is a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits(s))):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(s: str) -> bool:
    """ISO 7064 check of an IBAN: country and check digits moved to the end, letters as 10 to 35, remainder 1."""
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


#: characters of an IBAN by country
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 "
    "IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 "
    "SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}


def iban_ends(s: str) -> list[int]:
    """Where an IBAN at the start of s may end: at its country's length, at the end of s, or, for other countries, at any space."""
    spaces = [i for i, c in enumerate(s) if c == " "]
    length = IBAN_LENGTHS.get(s[:2])
    shorter = [i for i in reversed(spaces) if length in (None, len(s[:i].replace(" ", "")))]
    return [*shorter, len(s)] if length else [len(s), *shorter]


def octets(s: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in s.split(".")))


def ssn(s: str) -> bool:
    a, b, c = s.split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the base expression for e-mail addresses, leftmost and non-overlapping: each sign's domain first, then back over the local part."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _local:
            start -= 1
        found = _domain.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern | Callable[[str], Iterator[tuple[int, int]]]
    needs: Callable[[str], bool]  # a cheap test that every text with a match passes
    valid: Callable[[str], bool]
    score: float
    checksum: bool = False
    context: re.Pattern | None = None
    base: bool = False
    ends: Callable[[str], list[int]] | None = None  # where a proposed span may end; without it only as proposed


_digit = re.compile("[0-9]")
_words = lambda *w: re.compile(r"\b(?:" + "|".join(w) + r")\b", re.I)
CONTRARY = _words("order", "invoice", "version", "isbn", "serial", "bestellung", "rechnung", "commande", "pedido")
KINDS = (
    Kind("email", emails, lambda t: "@" in t, lambda s: True, 0.9, context=_words("mail", "email", "e-mail", "contact", "write", "kontakt", "correo", "courriel"), base=True),
    Kind("ip", re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), lambda t: "." in t and _digit.search(t) is not None, octets, 0.6, context=_words("ip", "address", "host", "server", "adresse", "dirección"), base=True),
    Kind("card", re.compile(r"[0-9](?:[\x20-]?[0-9])++"), lambda t: _digit.search(t) is not None, lambda s: 16 <= len(digits(s)) <= 19 and luhn(s), 0.7, checksum=True, context=_words("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"), base=True),
    Kind("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda t: "+" in t, lambda s: 8 <= len(digits(s)) <= 15, 0.6, context=_words("phone", "tel", "call", "mobile", "telefon", "handy", "téléphone", "teléfono"), base=True),
    Kind("card_short", re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9]){11,14}(?![\x20-]?[0-9])"), lambda t: _digit.search(t) is not None, luhn, 0.2, checksum=True, context=_words("card", "visa", "amex", "credit", "karte", "carte", "tarjeta")),
    Kind("card_grouped", re.compile(r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"), lambda t: _digit.search(t) is not None, luhn, 0.3, checksum=True, context=_words("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta")),
    Kind("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b"), lambda t: _digit.search(t) is not None, mod97, 0.4, checksum=True, context=_words("iban", "account", "konto", "compte", "cuenta"), ends=iban_ends),
    Kind("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), lambda t: "-" in t and _digit.search(t) is not None, ssn, 0.5, context=_words("ssn", "social", "security", "tax")),
    Kind("phone_local", re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{3,4}(?![0-9])"), lambda t: _digit.search(t) is not None, lambda s: 8 <= len(digits(s)) <= 11, 0.3, context=_words("phone", "tel", "call", "mobile", "telefon", "handy", "téléphone", "teléfono")),
    Kind("secret", re.compile(r"""(?i)\b(?:token|api[_-]?key|secret|password|passwd)\s*[=:]\s*["']?[A-Za-z0-9_/+.-]{8,}["']?"""), lambda t: "=" in t or ":" in t, lambda s: True, 0.7),
)
BASE = tuple(k.name for k in KINDS if k.base)


def score(kind: Kind, text: str, start: int) -> float:
    """Base score, +0.3 for a checksum that holds, +0.3 for a context word before, -0.2 for a contrary word."""
    near = text[max(0, start - CONTEXT) : start]
    return kind.score + 0.3 * kind.checksum + 0.3 * bool(kind.context and kind.context.search(near)) - 0.2 * bool(CONTRARY.search(near))


def confirmed(kind: Kind, text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the spans that pass the validator; with ``ends`` the scan goes on behind a confirmed end or the failed start."""
    if not isinstance(kind.pattern, re.Pattern):
        yield from ((a, b) for a, b in kind.pattern(text) if kind.valid(text[a:b]))
        return
    if kind.ends is None:
        yield from (m.span() for m in kind.pattern.finditer(text) if kind.valid(m[0]))
        return
    at = 0
    while m := kind.pattern.search(text, at):
        end = next((e for e in kind.ends(m[0]) if kind.valid(m[0][:e])), 0)
        if end:
            yield m.start(), m.start() + end
        at = m.start() + (end or 1)


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by kind as listed, then start; kinds are leftmost and non-overlapping each."""
    found = []
    for kind in KINDS:
        if kind.needs(text):
            for start, end in confirmed(kind, text):
                s = score(kind, text, start)
                if kind.base or s >= THRESHOLD:
                    found.append((kind.name, start, end, round(s, 2)))
    if any(f[0] not in BASE for f in found):  # what lies within a base span is known already
        base = sorted(f[1:3] for f in found if f[0] in BASE)
        starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
        within = lambda f: (i := bisect_right(starts, f[1])) > 0 and reach[i - 1] >= f[2]
        found = [f for f in found if f[0] in BASE or not within(f)]
    return found


def masked(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with every span, overlapping ones together, replaced by the name of its first kind."""
    out, at, until = [], 0, -1
    for kind, start, end, _ in sorted(found, key=lambda f: (f[1], -f[2])):
        if start < until:
            until = max(until, end)
            at = max(at, until)
            continue
        out += [text[at:start], f"<{kind}>"]
        at = until = end
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and its spans as an array of (kind, start, end, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans(t or "")] for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data in ``text`` replaced by the names of its kinds; null stays null."""

    @F.pandas_udf("string")
    def mask(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: masked(t, found) if (found := spans(t)) else t, na_action="ignore")

    return docs.withColumn(text, mask(F.col(text)))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, all spans as text, their scores in the same order, and their number."""
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    scores = F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 2)), ",").alias("scores")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), scores, F.size("spans").cast("long").alias("n_spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))
