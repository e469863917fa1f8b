"""Compression of vectors to codes of small codebooks, by dictionaries of the values of each dimension.

Components become integers, floor(``SCALE`` * x). Vectors are stored once in blocks: for each dimension the sorted
distinct integers of the block (its dictionary) and for each vector the place of its component there. A pass over a
block tabulates, for each dimension, the squared difference of every distinct integer to every entry of the codebook;
the distance of a part to an entry is then gathered from these tables by code and added over the part's dimensions, so
squares are computed once for each distinct integer instead of once for each component. Sums of the parts of an entry
come from counts by dictionary code times the dictionary. A task sends one row of sums for each part and entry; the
driver holds the codebooks only (``PARTS`` x ``ENTRIES`` entries).

Rows whose vector is null or holds null or non-finite components are dropped; so are those that cannot be cut like
the others: whose length is not that of the first kept vector (by vec_id, then vector) or not a positive multiple of ``PARTS``.
Null ids come after all others where the first codebook is drawn; rows with equal ids count each, smaller vectors first.
With fewer than ``ENTRIES`` rows the codebooks have fewer entries, equal entries included (ties go to the first).
Values too large for 64-bit squares are tabulated as Python integers, exactly; an error beyond a long is null. An empty
table gives an empty result; further columns are ignored, whatever their names.

Labels may be hot: their sums are added in the tasks first; those with over a ``HOT``-th of the rows, hence fewer than
``HOT``, come to their rows by broadcast, all others by a join on the label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import staged, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
HOT = 1_000
#: rows and components of a block at most (a single row may have more components)
BLOCK, COMPONENTS = 8_192, 1 << 20
#: squares of differences of values below this add up to less than 2**63 over 32,767 dimensions
SAFE = 1 << 23
#: sums of any size travel as numbers of so many bits
LIMB = 40
LONG = (1 << 63) - 1

Codebooks = list[list[list[int]]]  # part, entry, dimension within the part


def integers(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id, label and the whole components ``v`` (as doubles, which hold them exactly) of the rows with a finite vector of a length that can be cut."""
    x = F.col(vec).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.filter(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % PARTS == 0)).filter(F.coalesce(finite, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long"), "label", F.transform(x, lambda c: c * float(SCALE)).alias("v"))


def floored(v: pa.Array | np.ndarray) -> np.ndarray:
    """Whole numbers below; as Python integers where 64 bits may not hold what is computed with them."""
    down = np.floor(v)
    return down.astype(np.int64) if not down.size or np.abs(down).max() < SAFE else np.array([int(x) for x in down.ravel()], object).reshape(down.shape)


def blocks(kept: DataFrame, width: int) -> DataFrame:
    """Vectors as blocks: ids, labels, and for each dimension its dictionary and the codes of its components.

    Dictionaries are listed as decimal text, so that integers of any size keep their value.
    """
    label, size = kept.schema["label"].dataType.simpleString(), max(1, min(BLOCK, COMPONENTS // width))
    schema = f"ids array<bigint>, labels array<{label}>, codes array<binary>, dictionaries array<array<string>>"

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        n = rows.num_rows
        v = floored(rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, width))
        found = [np.unique(v[:, d], return_inverse=True) for d in range(width)]
        whole = pa.array([0, n], pa.int32())
        lists = [pa.ListArray.from_arrays(whole, rows.column(c).combine_chunks()) for c in ("vec_id", "label")]
        codes = pa.array([[at.astype(np.uint16).tobytes() for _, at in found]], pa.list_(pa.binary()))
        words = pa.array([[[str(x) for x in values.tolist()] for values, _ in found]], pa.list_(pa.list_(pa.string())))
        return pa.RecordBatch.from_arrays([*lists, codes, words], ["ids", "labels", "codes", "dictionaries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = batch.slice(at, size - sum(b.num_rows for b in held))
                held.append(take)
                at += take.num_rows
                if sum(b.num_rows for b in held) == size:
                    yield made(held)
                    held = []
        if held:
            yield made(held)

    return kept.select("vec_id", "label", "v").mapInArrow(run, schema)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray]]]:
    """Each block with its dictionaries as numbers and its codes."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = batch.slice(i, 1)
            values = [np.array([int(x) for x in d], object) for d in block.column("dictionaries")[0].as_py()]
            safe = all(abs(x) < SAFE for d in values for x in (d[0], d[-1]))
            codes = [np.frombuffer(c, np.uint16) for c in block.column("codes")[0].as_py()]
            yield block, [d.astype(np.int64) for d in values] if safe else values, codes


def nearest(values: list[np.ndarray], codes: list[np.ndarray], entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a part its nearest entry (the first of equals) and the squared distance to it, gathered from tables by code."""
    kind = object if any(v.dtype == object for v in values) or any(abs(c) >= SAFE for e in entries for c in e) else np.int64
    book = np.array(entries, kind)
    far = 0
    for d, (own, at) in enumerate(zip(values, codes, strict=True)):
        difference = own.astype(kind)[:, None] - book[None, :, d]
        far = far + (difference * difference)[at]  # a table of distinct integers by entries; gathered by code
    best = np.argmin(far, axis=1)
    return best, far[np.arange(len(best)), best]


def limbs(x: int) -> Iterator[tuple[int, int]]:
    """(k, digit) of a whole number in digits of LIMB bits, its sign on each."""
    sign, rest, k = -1 if x < 0 else 1, abs(x), 0
    while rest or not k:
        yield k, sign * (rest & ((1 << LIMB) - 1))
        rest, k = rest >> LIMB, k + 1


def entry_sums(stored: DataFrame, books: Codebooks) -> dict[tuple[int, int], list[int]]:
    """For each part and entry that is some vector's nearest: how many they are, and the sums of their components."""
    sent = stored.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[int]] = {}
        for _, values, codes in opened(batches):
            wide = len(codes) // PARTS
            for p, entries in enumerate(sent.value):
                v, c = values[p * wide : (p + 1) * wide], codes[p * wide : (p + 1) * wide]
                best, _ = nearest(v, c, entries)
                sums = [np.bincount(best, minlength=len(entries)).tolist()]
                for own, at in zip(v, c, strict=True):  # how often an entry has each distinct integer, times the integers
                    times = np.bincount(best * len(own) + at, minlength=len(entries) * len(own)).reshape(len(entries), len(own))
                    sums.append((times.astype(own.dtype) @ own).tolist())
                for e in np.flatnonzero(sums[0]).tolist():
                    before = total.setdefault((p, e), [0] * (wide + 1))
                    total[p, e] = [a + s[e] for a, s in zip(before, sums, strict=True)]
        rows = [(p, e, d, k, x) for (p, e), s in total.items() for d, whole in enumerate(s) for k, x in limbs(whole)]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    names = ("part", "entry", "d", "k", "x")
    schema = pa.schema([*((n, pa.int32()) for n in names[:4]), ("x", pa.int64())])
    rows = stored.mapInArrow(run, "part int, entry int, d int, k int, x long").groupBy(*names[:4]).agg(F.sum("x").alias("x"))
    wide = sum(len(e) for entries in books for e in entries[:1]) // PARTS
    found: dict[tuple[int, int], list[int]] = {}
    for r in rows.collect():  # a row for each number of the codebooks
        found.setdefault((r["part"], r["entry"]), [0] * (wide + 1))[r["d"]] += r["x"] << (LIMB * r["k"])
    return found


def codebooks(stored: DataFrame, first: list[list[int]], rounds: int = ROUNDS) -> Codebooks:
    """Codebooks that start from the parts of the vectors ``first``: assign, replace by floored means, ``rounds`` times."""
    wide = len(first[0]) // PARTS
    books = [[v[p * wide : (p + 1) * wide] for v in first] for p in range(PARTS)]
    for _ in range(rounds):
        found = entry_sums(stored, books)
        books = [[[x // found[p, e][0] for x in found[p, e][1:]] if (p, e) in found else entry for e, entry in enumerate(entries)] for p, entries in enumerate(books)]
    return books


def coded(stored: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every vector; no shuffle."""
    sent = stored.sparkSession.sparkContext.broadcast(books)
    label = stored.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, values, codes in opened(batches):
            wide, digits, error = len(codes) // PARTS, [], 0
            for p, entries in enumerate(sent.value):
                best, far = nearest(values[p * wide : (p + 1) * wide], codes[p * wide : (p + 1) * wide], entries)
                digits.append(best.astype(np.uint8))
                error = error + far
            code = np.stack(digits, axis=1).tobytes().hex()
            size = 2 * PARTS
            text = [code[i : i + size] for i in range(0, len(code), size)]
            errors = [int(e) if e <= LONG else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([block.column("ids").flatten(), block.column("labels").flatten(), pa.array(text, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return stored.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def with_label_sums(rows: DataFrame, value: str = "error", name: str = "label_error") -> DataFrame:
    """``rows`` (read twice) with the sum of ``value`` over the rows of equal label, null labels together."""
    total = F.sum(F.col(value).cast("decimal(38,0)")).try_cast("long").alias(name)
    totals = staged(rows.groupBy(F.col("label").alias("_label")).agg(total, F.count("*").alias("_rows")), "labels")
    n = rows.count()
    hot = F.broadcast(totals.filter(F.col("_rows") * HOT > n))  # fewer than HOT rows
    cold = totals.filter(F.col("_rows") * HOT <= n)
    same = F.col("label").eqNullSafe(F.col("_label"))
    hot_rows, cold_rows = rows.join(hot, same), rows.join(hot, same, "left_anti").join(cold.hint("merge"), same)
    return hot_rows.unionByName(cold_rows).drop("_label", "_rows")


def compressed(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error of every kept vector, the codebooks)."""
    found = integers(vectors)
    order = (F.col("vec_id").asc_nulls_last(), F.transform("v", lambda c: F.floor(c)))
    start = found.orderBy(*order).limit(1).collect()
    width = len(start[0]["v"]) if start else PARTS
    kept = found.filter(F.size("v") == width)
    first = [[int(x) for x in np.floor(r["v"])] for r in kept.orderBy(*order).limit(ENTRIES).collect()]
    stored = staged(blocks(kept, width), "vectors")
    books = codebooks(stored, first, rounds) if first else [[] for _ in range(PARTS)]
    return coded(stored, books), books


def digest(books: Codebooks) -> str:
    """sha256 of all components by part, entry, position within the part."""
    return hashlib.sha256(",".join(str(x) for entries in books for e in entries for x in e).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compressed(table(spark, sf_dir, "embeddings"))
    found = with_label_sums(staged(rows, "codes"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds as one query after another: parts, their nearest entries, the means."""
    steps = [
        """kept as materialized (
  select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
parts as materialized (select r, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] as x from kept, range(8) t(p)),
b0 as materialized (select p, r - 1 as e, x as c from parts where r <= 16)"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""far{i} as (select r, p, e, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from parts join b{i} using (p)),
a{i} as materialized (select r, p, arg_min(e, (d, e)) as e, any_value(x) as x, min(d) as d from far{i} group by r, p)""")
        if i < ROUNDS:
            steps.append(f"""m{i} as (select p, e, list(m order by k) as c from (
  select p, e, k, floor(sum(x[k])::double / count(*))::bigint as m from a{i}, range(1, 65) t(k) where k <= len(x) group by p, e, k) group by p, e),
b{i + 1} as materialized (select p, e, coalesce(m{i}.c, b{i}.c) as c from b{i} left join m{i} using (p, e))""")
    return f"""with {", ".join(steps)},
coded as (select r, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from a{ROUNDS} group by r),
hashed as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as h from b{ROUNDS})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256 from kept join coded using (r), hashed
"""


OP12_SQL = _sql()
