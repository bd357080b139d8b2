"""Terrain joins on triangle meshes, and elevation models as pixel tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import DEM_METRES, HEIGHT, MBR, apply
from ..sources.shared import stored
from .sized import dealt, few

#: Side of a leaf over the power of two that its triangles' boxes fit in.
LEAF = 4.0


def with_mbr(mesh: DataFrame) -> DataFrame:
    """Triangles with their minimum bounding boxes."""
    return apply(mesh, MBR)


def side_of(level: str) -> str:
    return f"({LEAF}e0 * power(2e0, {level}))"


def _tile(x: str, level: str) -> str:
    return f"CAST(floor(({x}) / {side_of(level)}) AS BIGINT)"


def spread_tiles(rows: DataFrame, level: str, x: tuple[str, str], y: tuple[str, str], names: tuple[str, str]) -> DataFrame:
    """A row for each tile of a level's size between limits."""
    rows = rows.selectExpr("*", f"explode(sequence({_tile(x[0], level)}, {_tile(x[1], level)})) AS {names[0]}")
    return rows.selectExpr("*", f"explode(sequence({_tile(y[0], level)}, {_tile(y[1], level)})) AS {names[1]}")


def leafed(mesh: DataFrame) -> DataFrame:
    """Triangles with their boxes, each in one leaf (level, leaf_x, leaf_y): the level is that of its size, the place its lowest corner's.

    A large triangle is one row in a large leaf, a small one is one in a small leaf.
    """
    rows = with_mbr(mesh).selectExpr("*", "CAST(ceil(log2(greatest(hix - lox, hiy - loy, 1e-3))) AS INT) AS level")
    return rows.selectExpr("*", *(f"{_tile(f'lo{i}', 'level')} AS leaf_{i}" for i in "xy"))


@dataclass(frozen=True)
class Terrain:
    """Triangles in leaves, the leaves' boxes, which levels there are, the mean size of triangles, and the box of all (x, y, z, low and high).

    Triangles at homes (``visibility.around``) may be dealt over a number of partitions of their own.
    """

    triangles: DataFrame
    leaves: DataFrame
    levels: list[int]
    size: float
    limits: tuple[float, ...] = ()
    dealt_over: int | None = None


KEY = ["level", "leaf_x", "leaf_y"]


def indexed(mesh: DataFrame | Terrain) -> Terrain:
    """A mesh by leaves; levels are powers of two of sizes, so there are some dozens at most."""
    if isinstance(mesh, Terrain):
        return mesh
    triangles = leafed(mesh)
    box = [F.min("lox").alias("lox"), F.max("hix").alias("hix"), F.min("loy").alias("loy"), F.max("hiy").alias("hiy")]
    leaves = triangles.groupBy(*KEY).agg(*box)
    ends = [F.coalesce(f(f"{n}{i}"), F.lit(0.0)).alias(f"{n}{i}") for i in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]
    said = triangles.agg(F.array_sort(F.collect_set("level")).alias("levels"), F.avg(F.expr("greatest(hix - lox, hiy - loy)")).alias("size"), *ends).first()
    return Terrain(triangles, leaves, said.levels, said.size or 1.0, tuple(said[2:]))


def prepared(mesh: DataFrame, table: str, buckets: int | None = None) -> Terrain:
    """A mesh by leaves as tables ``table`` and ``table``_leaves, written once.

    Triangles are bucketed by leaf, so that joins with them shuffle what comes to them and not the mesh.  A table of
    that name is replaced; ``dropped`` removes both.
    """
    spark, made = mesh.sparkSession, indexed(mesh)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.triangles.repartition(n, *KEY).write.mode("overwrite").bucketBy(n, *KEY).sortBy(*KEY).saveAsTable(table)
    made.leaves.write.mode("overwrite").saveAsTable(f"{table}_leaves")
    return Terrain(spark.table(table), spark.table(f"{table}_leaves"), made.levels, made.size, made.limits)


def dropped(spark: SparkSession, table: str) -> None:
    for name in (table, f"{table}_leaves"):
        spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")


def meeting(boxes: DataFrame, leaves: DataFrame, levels: list[int]) -> DataFrame:
    """Boxes (qlox, qhix, qloy, qhiy, …) with the keys of the leaves whose boxes they meet, each pair once.

    A box is in the class of its size.  A pair is looked for on tiles of the larger of class and level, of which both
    meet few: no large box makes the tiles of the others larger, and no large triangle is spread over the tiles of
    small boxes.  Of the tiles that both touch, the lowest counts.
    """
    asked = boxes.selectExpr("*", f"CAST(ceil(log2(greatest(qhix - qlox, qhiy - qloy, 1e-3) / {LEAF}e0)) AS INT) AS class")
    classes = asked.agg(F.array_sort(F.collect_set("class"))).first()[0]
    many = lambda own, others: f"explode(array_distinct(transform(array({', '.join(f'{x}' for x in others) or own}), x -> greatest(x, {own})))) AS g"
    asked = spread_tiles(asked.selectExpr("*", many("class", levels)), "g", ("qlox", "qhix"), ("qloy", "qhiy"), ("tile_x", "tile_y"))
    placed = spread_tiles(leaves.selectExpr("*", many("level", classes)), "g", ("lox", "hix"), ("loy", "hiy"), ("tile_x", "tile_y"))
    first = " AND ".join(f"tile_{i} = greatest({_tile(f'lo{i}', 'g')}, {_tile(f'qlo{i}', 'g')})" for i in "xy")
    met = " AND ".join(f"lo{i} <= qhi{i} AND hi{i} >= qlo{i}" for i in "xy")
    pairs = asked.join(placed, ["g", "tile_x", "tile_y"]).where(f"g = greatest(class, level) AND {first} AND {met}")
    return pairs.select(*boxes.columns, *KEY)


def at_levels(rows: DataFrame, levels: list[int]) -> DataFrame:
    """A row for each level."""
    return rows.selectExpr("*", f"explode(array({', '.join(map(str, levels))})) AS level" if levels else "explode(CAST(array() AS ARRAY<INT>)) AS level")


def heights(points: DataFrame, mesh: DataFrame | Terrain, *keys: str) -> DataFrame:
    """Add ``ground``: the highest triangle over each point (keys, x, y), null where there is none.

    A triangle over a point has its lowest corner at most its level's size before it, so a point looks into one leaf
    of each level, or two or four near their limits.  The key is ``pid`` if none is named.  With triangles dealt to
    homes (``visibility.around``) points are looked up at their own, whose columns are among the keys.
    """
    keys = keys or ("pid",)
    terrain = indexed(mesh)
    placed = at_levels(points.select(*keys, "x", "y"), terrain.levels)
    placed = spread_tiles(placed, "level", ("x - power(2e0, level)", "x"), ("y - power(2e0, level)", "y"), ("leaf_x", "leaf_y"))
    home = [k for k in keys if k.startswith("home_") and k in terrain.triangles.columns]
    found = placed.join(terrain.triangles.hint("shuffle_hash") if home else terrain.triangles, [*KEY, *home]).where("x BETWEEN lox AND hix AND y BETWEEN loy AND hiy")
    most = found.selectExpr(*keys, f"{HEIGHT} AS z").groupBy(*keys).agg(F.max("z").alias("ground"))
    return points.join(most.hint("shuffle_hash") if home else most, list(keys), "left")


def overlaps(boxes: DataFrame, mesh: DataFrame | Terrain, residual: Column | None = None) -> DataFrame:
    """Pairs of boxes (bid, qlox … qhiz) and triangles whose boxes overlap, limits included, each pair once.

    ``residual`` is a further condition on a pair.
    """
    terrain = indexed(mesh)
    meet = " AND ".join(f"lo{i} <= qhi{i} AND hi{i} >= qlo{i}" for i in "xyz")
    pairs = meeting(boxes, terrain.leaves, terrain.levels).join(terrain.triangles, KEY).where(meet)
    return pairs.where(residual) if residual is not None else pairs


def overlap_counts(boxes: DataFrame, mesh: DataFrame | Terrain, residual: Column | None = None) -> DataFrame:
    """(bid, hits) of all boxes."""
    hits = overlaps(boxes, mesh, residual).groupBy("bid").agg(F.count("*").alias("hits"))
    return boxes.select("bid").join(hits, "bid", "left").select("bid", F.coalesce("hits", F.lit(0)).alias("hits"))


def rasterise(mesh: DataFrame, resolutions: DataFrame, lon0: float, lat0: float, scale: float) -> DataFrame:
    """Elevation models of a mesh, one for each (dem_id, metres): (dem_id, row, col, lon, lat, x, y, height).

    The mesh's frame is ``lon = lon0 + x / scale``, ``lat = lat0 + y / scale``.  Pixels are sampled at their
    centres; the top row has the highest latitude.  All resolutions are one job.
    """
    pixels = pixel_grid(extent(mesh, lon0, lat0, scale), resolutions)
    pixels = pixels.selectExpr("*", f"(lon - {lon0}e0) * {scale}e0 AS x", f"(lat - {lat0}e0) * {scale}e0 AS y")
    return heights(pixels, mesh, "dem_id", "row", "col").select("dem_id", "row", "col", "lon", "lat", "x", "y", F.col("ground").alias("height"))


def extent(mesh: DataFrame, lon0: float, lat0: float, scale: float) -> DataFrame:
    """One row: the mesh's limits in degrees."""
    limits = with_mbr(mesh).agg(F.min("lox").alias("a"), F.max("hix").alias("b"), F.min("loy").alias("c"), F.max("hiy").alias("d"))
    return limits.selectExpr(f"{lon0}e0 + a / {scale}e0 AS lon_lo", f"{lon0}e0 + b / {scale}e0 AS lon_hi", f"{lat0}e0 + c / {scale}e0 AS lat_lo", f"{lat0}e0 + d / {scale}e0 AS lat_hi")


RASTER = [
    [("res", f"metres / (({DEM_METRES} + {DEM_METRES} * cos(radians((lat_lo + lat_hi) / 2))) / 2)")],
    [("width", "CAST(ceil((lon_hi - lon_lo) / res) AS BIGINT)"), ("rows_n", "CAST(ceil((lat_hi - lat_lo) / res) AS BIGINT)")],
]


def raster_meta(limits: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The models' metadata: (dem_id, gt0, gt1, gt3, gt5, width, height)."""
    rows = apply(resolutions.crossJoin(F.broadcast(limits)), RASTER)  # limits are one row
    return rows.selectExpr("dem_id", "lon_lo AS gt0", "res AS gt1", "lat_hi AS gt3", "-res AS gt5", "width", "rows_n AS height")


def pixel_grid(limits: DataFrame, resolutions: DataFrame) -> DataFrame:
    """All pixels of models over limits: (dem_id, row, col, lon, lat)."""
    rows = apply(resolutions.crossJoin(F.broadcast(limits)), RASTER)  # limits are one row
    rows = dealt(rows.selectExpr("*", "explode(sequence(0L, rows_n - 1)) AS row"), "dem_id", "row").selectExpr("*", "explode(sequence(0L, width - 1)) AS col")
    return rows.selectExpr("dem_id", "row", "col", "lon_lo + (col + 0.5e0) * res AS lon", "lat_hi - (row + 0.5e0) * res AS lat")


#: Place of a point among pixel centres, the four around it, or the nearest where one of them is outside.
CORNERS = [
    [("fcol", "(lon - gt0) / gt1 - 0.5e0"), ("frow", "(lat - gt3) / gt5 - 0.5e0")],
    [("col0", "CAST(floor(fcol) AS BIGINT)"), ("row0", "CAST(floor(frow) AS BIGINT)")],
    [("near_edge", "col0 < 0 OR row0 < 0 OR col0 + 1 >= width OR row0 + 1 >= height")],
    [("ncol", "greatest(0, least(width - 1, CAST(round(fcol) AS BIGINT)))"), ("nrow", "greatest(0, least(height - 1, CAST(round(frow) AS BIGINT)))")],
]


#: Pixels along a block's side.
BLOCK = 16


@dataclass(frozen=True)
class Raster:
    """Elevation models as blocks of n by n pixels and one row and column more: (dem_id, brow, bcol, cells, top), stored."""

    blocks: DataFrame
    n: int


def raster(dem: DataFrame | Raster, n: int = BLOCK) -> Raster:
    """Models (dem_id, row, col, height) as blocks; ``cells`` row by row, null where there is no elevation, ``top`` their maximum.

    Pixels on a block's first row or column are in the block before too, so a quad of pixels lies in one block.  Of
    pixels given twice the highest counts.
    """
    if isinstance(dem, Raster):
        return dem
    near = lambda x: f"IF({x} % {n} = 0 AND {x} > 0, array({x} DIV {n}, {x} DIV {n} - 1), array({x} DIV {n}))"
    rows = dem.selectExpr("dem_id", "row", "col", "height", f"explode({near('row')}) AS brow").selectExpr("*", f"explode({near('col')}) AS bcol")
    rows = rows.selectExpr("dem_id", "brow", "bcol", f"CAST((row - brow * {n}) * {n + 1} + col - bcol * {n} AS INT) AS at", "height")
    held = rows.groupBy("dem_id", "brow", "bcol").agg(F.array_sort(F.collect_list(F.struct("at", "height"))).alias("s"), F.max("height").alias("top"))

    def dense(s: Column) -> Column:
        last = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (s[F.least(i + 1, F.size(s) - 1)].at != x.at))
        gap = lambda d: F.flatten(F.transform(d, lambda x, i: F.concat(F.array_repeat(F.lit(None).cast("double"), x.at - 1 - F.when(i == 0, F.lit(-1)).otherwise(d[F.greatest(i - 1, F.lit(0))].at)), F.array(x.height))))
        return F.transform(F.array(last), gap)[0]

    blocks = held.select("dem_id", "brow", "bcol", F.transform(F.array("s"), dense)[0].alias("cells"), "top")
    return Raster(stored(blocks, "blocks"), n)


def tops(made: Raster, factor: int = 1) -> DataFrame:
    """(dem_id, trow, tcol, top): the maxima of squares of two by two larger blocks, ``factor`` blocks a side, from each on."""
    large = made.blocks.groupBy("dem_id", F.expr(f"brow DIV {factor}").alias("trow"), F.expr(f"bcol DIV {factor}").alias("tcol")).agg(F.max("top").alias("top"))
    around = large.selectExpr("dem_id", "explode(array(trow, trow - 1)) AS trow", "tcol", "top").selectExpr("dem_id", "trow", "explode(array(tcol, tcol - 1)) AS tcol", "top")
    return around.groupBy("dem_id", "trow", "tcol").agg(F.max("top").alias("top"))


def _sampled() -> str:
    """Elevation in a quad: the pixel's own at the edge, else bilinear, else the mean of those that have values."""
    four = [f"h{i}{j}" for j in (0, 1) for i in (0, 1)]
    u, w = "(fcol - col0)", "(frow - row0)"
    bilinear = f"h00 * (1 - {u}) * (1 - {w}) + h10 * {u} * (1 - {w}) + h01 * (1 - {u}) * {w} + h11 * {u} * {w}"
    known = " + ".join(f"CAST({h} IS NOT NULL AS INT)" for h in four)
    mean = f"({' + '.join(f'coalesce({h}, 0e0)' for h in four)}) / nullif({known}, 0)"
    return f"CASE WHEN near_edge THEN h00 ELSE coalesce({bilinear}, {mean}) END"


def sample(points: DataFrame, dem: DataFrame | Raster, meta: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, height): elevation at points (keys, dem_id, lon, lat), null for none.

    Bilinear among four pixel centres; the mean of those that have values if some have none; the nearest
    pixel, clamped, where one of the four is outside.  A point is joined once, on the block that holds its quad.
    """
    made = raster(dem)
    n = made.n
    size = few(meta.select("dem_id", "gt0", "gt1", "gt3", "gt5", "width", F.col("height").alias("height")))
    placed = apply(points.join(size, "dem_id"), CORNERS)
    asked = placed.selectExpr(*dict.fromkeys([*keys, "dem_id"]), "near_edge", "fcol", "frow", "col0", "row0", "CASE WHEN near_edge THEN nrow ELSE row0 END AS row", "CASE WHEN near_edge THEN ncol ELSE col0 END AS col")
    asked = asked.selectExpr("*", f"row DIV {n} AS brow", f"col DIV {n} AS bcol", f"CAST((row % {n}) * {n + 1} + col % {n} AS INT) AS at")
    corners = [f"get(cells, at + {j * (n + 1) + i}) AS h{i}{j}" for j in (0, 1) for i in (0, 1)]
    met = asked.join(made.blocks.select("dem_id", "brow", "bcol", "cells"), ["dem_id", "brow", "bcol"], "left")
    return met.selectExpr(*dict.fromkeys([*keys, "dem_id"]), "near_edge", "fcol", "frow", "col0", "row0", *corners).selectExpr(*keys, f"{_sampled()} AS height")


def pixel_heights(indices: DataFrame, dem: DataFrame) -> DataFrame:
    """Add ``height`` to pixel indices (dem_id, row, col); null outside."""
    return indices.join(dem.select("dem_id", "row", "col", "height"), ["dem_id", "row", "col"], "left")


def dem_extent(meta: DataFrame) -> DataFrame:
    """(dem_id, lon_lo, lon_hi, lat_lo, lat_hi) of models."""
    return meta.selectExpr("dem_id", "gt0 AS lon_lo", "gt0 + width * gt1 AS lon_hi", "gt3 + height * gt5 AS lat_lo", "gt3 AS lat_hi")


def in_bounds(points: DataFrame, meta: DataFrame) -> DataFrame:
    """Points (dem_id, lon, lat) within their model, limits included."""
    return points.join(dem_extent(meta), "dem_id").where("lon BETWEEN lon_lo AND lon_hi AND lat BETWEEN lat_lo AND lat_hi").select(*points.columns)
