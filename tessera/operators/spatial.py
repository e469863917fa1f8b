"""Points stored along a space-filling curve, and box queries that read a share of the files.

A point's place on the Z curve interleaves the bits of its two grid numbers. Points are range-partitioned and sorted by
it, so a dense spot is split over many files, and written to folders by the curve's first bits: a box lists the
folders (cells) it meets, the others are never opened, and inside a file the statistics of x and y skip row groups.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.explore import search
from tessera.operators.rank import page

#: bits of each coordinate on the curve, and those that name a folder
FINE, LEVEL = 12, 3

Box = tuple[float, float, float, float]


def z_value(x: int, y: int, bits: int) -> int:
    """The place on the curve of two grid numbers."""
    return sum(((x >> b & 1) << (2 * b)) | ((y >> b & 1) << (2 * b + 1)) for b in range(bits))


def z_column(x: Column, y: Column, bits: int) -> Column:
    """``z_value`` of two columns of grid numbers."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1).cast("long")), 2 * b)).bitwiseOR(F.shiftleft(F.shiftright(y, b).bitwiseAND(F.lit(1).cast("long")), 2 * b + 1))
    return out


def write_points(points: DataFrame, path: str, x: str = "x", y: str = "y", level: int = LEVEL) -> None:
    """Points by cell, with the bounds of the whole table beside them. Points without both coordinates go to a cell of their own (-1), which no box meets."""
    whole = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    bounds = points.filter(whole).agg(*[f(F.col(c).cast("double")).alias(n) for n, f, c in (("x0", F.min, x), ("y0", F.min, y), ("x1", F.max, x), ("y1", F.max, y))])
    bounds.write.parquet(f"{path}/bounds")
    b = bounds.first()
    span = lambda lo, hi: (hi - lo) or 1.0
    grid = lambda c, lo, hi: F.least(F.lit((1 << FINE) - 1), F.floor((F.col(c) - lo) / span(lo, hi) * (1 << FINE))).cast("long")
    z = F.when(whole, z_column(grid(x, b["x0"], b["x1"]), grid(y, b["y0"], b["y1"]), FINE)).otherwise(-1) if b["x0"] is not None else F.lit(-1).cast("long")
    placed = points.withColumn("_z", z.cast("long")).withColumn("cell", F.shiftright("_z", 2 * (FINE - level)))
    placed.repartitionByRange("_z", x, y).sortWithinPartitions("_z").drop("_z").write.partitionBy("cell").parquet(f"{path}/points")


def cells_of(box: Box, bounds: Box, level: int = LEVEL) -> list[int]:
    """The cells that a box meets; at most 4 ** level."""
    side = 1 << level

    def span(lo: float, hi: float, first: float, last: float) -> range:
        width = (last - first) or 1.0
        at = lambda v: min(side - 1, max(0, floor((v - first) / width * side)))
        return range(at(lo), at(hi) + 1) if lo <= last and hi >= first and lo <= hi else range(0)

    return sorted(z_value(i, j, level) for i in span(box[0], box[2], bounds[0], bounds[2]) for j in span(box[1], box[3], bounds[1], bounds[3]))


def in_stored_box(spark: SparkSession, path: str, box: Box, x: str = "x", y: str = "y", level: int = LEVEL) -> DataFrame:
    """The stored points inside a box, edges included; only the folders of its cells are read."""
    b = spark.read.parquet(f"{path}/bounds").first()
    cells = cells_of(box, tuple(b), level) if b["x0"] is not None else []
    stored = spark.read.parquet(f"{path}/points")
    return stored.filter(F.col("cell").isin(cells) if cells else F.lit(False)).filter(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3])).drop("cell")


def region_page(nodes: DataFrame, order: list[Column], kind: str | None = None, kinds: list[str] | None = None, text: str = "", columns: list[str] | None = None, number: int = 1, size: int = 25) -> DataFrame:
    """One page of a region's nodes of some kinds that a search finds, each with ``available`` (nodes of those kinds) and ``total`` (those found)."""
    own = nodes if kinds is None else nodes.filter(F.col(kind).isin(kinds))
    found = search(own, text, columns or [])
    counts = own.agg(F.count("*").alias("available")).join(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row each
    return page(found, order, number, size).join(F.broadcast(counts))
