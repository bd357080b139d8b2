"""Keys of 3D cells, roll-ups of cells, and scans by key."""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import CELL_EARTH, KEY, apply, compact_layers, decode_layers, encode_layers
from ..sources.shared import stored
from .sized import apart

LEVELS = range(1, 22)


def encode(positions: DataFrame) -> DataFrame:
    """Add ``code``, the cell of (lon, lat, alt) at ``level`` 1 to 21; other levels are an error."""
    checked = positions.withColumn("level", F.when(F.col("level").between(LEVELS[0], LEVELS[-1]), F.col("level")).otherwise(F.raise_error(F.lit("a cell level is from 1 to 21"))))
    rows = checked
    for layers in encode_layers():
        rows = apart(apply(rows, layers))
    return rows.selectExpr(*positions.columns, f"{KEY} AS code")


def decode(keys: DataFrame) -> DataFrame:
    """Add the corner nearest zero of cells (code, level): c_lon, c_lat, c_alt."""
    return apply(keys, decode_layers()).select(*keys.columns, "c_lon", "c_lat", "c_alt")


def states(coverage: DataFrame, up: int, value: str = "density") -> DataFrame:
    """(code, n, known, total, most): what is to be known of cells (code, value) gathered into parents so many levels up."""
    rows = coverage.selectExpr(f"code >> {3 * up} AS code", f"{value} AS v")
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.count("v").alias("known"), F.sum("v").alias("total"), F.max("v").alias("most"))


def further(rows: DataFrame, up: int) -> DataFrame:
    """States of parents so many levels up from states of cells."""
    return rows.groupBy(F.expr(f"code >> {3 * up}").alias("code")).agg(*(F.sum(c).alias(c) for c in ("n", "known", "total")), F.max("most").alias("most"))


def roll_up(coverage: DataFrame, up: list[int], value: str = "density") -> DataFrame:
    """(up, code, n, most, mean) of cells (code, value) gathered into parents so many levels up.

    Only the finest level reads the cells; each other one is made of the states of the level below it.
    """
    levels = sorted(set(up))
    made = stored(states(coverage, levels[0], value), "states")
    out = [made.withColumn("up", F.lit(levels[0]))]
    for low, high in zip(levels, levels[1:]):
        made = further(made, high - low)
        out.append(made.withColumn("up", F.lit(high)))
    return reduce(DataFrame.unionByName, out).selectExpr("up", "code", "n", "most", "total / known AS mean")


def scan(coverage: DataFrame, emitter: Column, since: Column, low: Column, high: Column) -> DataFrame:
    """Rows of one emitter from a time on in a range of cells; filters reach the files, which hold this order."""
    return coverage.where((F.col("id") == emitter) & (F.col("timestamp") >= since) & F.col("code").between(low, high))


#: Ranges of keys that a box is covered with at most.
RANGES = 48


def _field(degrees: float, level: int) -> int:
    """The code of a coordinate's size: whole degrees, minutes and seconds."""
    d = int(degrees)
    m = int((degrees - d) * 60)
    s = int(((degrees - d) * 60 - m) * 60)
    return (d * 4096 + m * 64 + s) >> (21 - level)


def _sides(low: float, high: float, level: int) -> list[tuple[int, int]]:
    """Limits of codes of a coordinate: negative ones are marked by the highest bit, but for those within a second of zero."""
    mark, out = 1 << (level - 1), []
    if high > -1 / 3600:
        out.append((_field(max(low, 0.0), level), _field(max(high, 0.0), level)))
    if low < 0:
        out.append((mark | _field(max(-high, 0.0), level), mark | _field(-low, level)))
    return out


def box_limits(lon_lo: float, lon_hi: float, lat_lo: float, lat_hi: float, alt_lo: float, alt_hi: float, level: int) -> list[list[tuple[int, int]]]:
    """Boxes of codes (lon, lat, alt; limits included) that hold the cells of a box of degrees and metres."""
    height = lambda z: (z + CELL_EARTH) / (50000 + CELL_EARTH) * 512
    alt = (_field(height(alt_lo), level), _field(height(alt_hi), level))
    return [[lon, lat, alt] for lon in _sides(lon_lo, lon_hi, level) for lat in _sides(lat_lo, lat_hi, level)]


def key_ranges(box: list[tuple[int, int]], level: int, most: int = RANGES) -> list[tuple[int, int]]:
    """At most so many ranges of keys that hold all cells of a box of codes, few others among them.

    Cells of an octree are keys of one beginning.  The largest that the box cuts is split while ranges are left.
    """

    def cut(bits: int, corner: tuple[int, ...]) -> str:
        spans = [(c << bits, (c + 1 << bits) - 1) for c in corner]
        if any(hi < lo_ or lo > hi_ for (lo, hi), (lo_, hi_) in zip(spans, box)):
            return "out"
        return "in" if all(lo >= lo_ and hi <= hi_ for (lo, hi), (lo_, hi_) in zip(spans, box)) else "part"

    def key(corner: tuple[int, ...], bits: int) -> int:
        return sum(((corner[axis] >> b) & 1) << (3 * b + axis) for axis in range(3) for b in range(level - bits + 1))

    whole, part = [], [(-level, (0, 0, 0))]  # the largest first
    while part and len(whole) + len(part) + 7 <= most:
        bits, corner = heapq.heappop(part)
        if cut(-bits, corner) == "in" or bits == 0:
            whole.append((bits, corner))
            continue
        for child in range(8):
            at = tuple(2 * corner[axis] + (child >> axis & 1) for axis in range(3))
            kind = cut(-bits - 1, at)
            if kind == "in":
                whole.append((bits + 1, at))
            elif kind == "part":
                heapq.heappush(part, (bits + 1, at))
    spans = sorted((key(corner, -bits) << (-3 * bits), (key(corner, -bits) + 1 << (-3 * bits)) - 1) for bits, corner in whole + part)
    out: list[list[int]] = []
    for low, high in spans:
        if out and low == out[-1][1] + 1:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def scan_box(coverage: DataFrame, lon_lo: float, lon_hi: float, lat_lo: float, lat_hi: float, alt_lo: float, alt_hi: float, level: int, most: int = RANGES) -> DataFrame:
    """Rows (code, …) whose cell at a level meets a box of degrees and metres.

    Ranges of keys reach the files, which skip row groups by them; the exact test on each axis follows.
    """
    boxes = box_limits(lon_lo, lon_hi, lat_lo, lat_hi, alt_lo, alt_hi, level)
    ranges = [r for box in boxes for r in key_ranges(box, level, max(8, most // max(1, len(boxes))))]
    rough = " OR ".join(f"code BETWEEN {a} AND {b}" for a, b in ranges) or "FALSE"
    rows = apply(coverage.where(rough), compact_layers())
    exact = " OR ".join("(" + " AND ".join(f"{k} BETWEEN {lo} AND {hi}" for k, (lo, hi) in zip(("k_lon", "k_lat", "k_alt"), box)) + ")" for box in boxes) or "FALSE"
    return rows.where(exact).select(*coverage.columns)
