"""Visibility as semi and anti joins.

Rays of one emitter share their origin: a ray lies in one sector of azimuth, a triangle in those it spans as
seen from the emitter, all of them where its footprint holds the emitter.  The join on (emitter, sector) leaves
few triangles a ray, which the exact test settles.  How many sectors an emitter has follows from its rays and the
triangles' size.  Emitters at home in tiles (``housed``) have their triangles dealt to the same partitions, where
their rays are made and settled, so no ray is shuffled.  Rays of any origin are joined on the tiles they cross.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import BOXES, CLEARANCE_SQL, DEM_METRES, MEETS, PAIR, RAYS, SEEN, apply
from ..sources.shared import stored
from .sized import apart, dealt, few, partitions
from .terrain import KEY, Raster, Terrain, at_levels, heights, indexed, meeting, raster, sample, side_of, tops

#: Sectors of emitters that have no number of their own.
SECTORS = 720
CORNERS = [f"{p}{i}" for p in "amc" for i in "xyz"] + [f"{f}{i}" for f in ("lo", "hi") for i in "xyz"]


def _sector(azimuth: str) -> str:
    return f"CAST(floor({azimuth} * sectors / 360e0) AS BIGINT)"


def binned(emitters: DataFrame, mesh: DataFrame | Terrain, rays: str, most: float | None = None) -> DataFrame:
    """Emitters (eid, ex, ey, reach) with ``sectors``, for about so many rays each, an SQL expression.

    A triangle of size s at distances up to the reach spans a share a = s / (pi * reach) of the circle in the mean.
    With n sectors each triangle makes 1 + n * a rows, and each ray meets 1 / n + a of the triangles.  The work of T
    triangles and R rays, T * (1 + n * a) + R * T * (1 / n + a), is least for n = sqrt(R / a).  ``most`` bounds
    n * a, so the index grows with the triangles in reach only, and a ray meets at most 1 + 1 / most times as many.
    """
    share = f"greatest(1e0, pi() * reach / CAST({indexed(mesh).size!r} AS DOUBLE))"
    n = f"sqrt(({rays}) * {share})"
    return emitters.selectExpr("*", f"CAST(greatest(1e0, ceil({f'least({n}, {most}e0 * {share})' if most else n})) AS BIGINT) AS sectors")


def pairs_within(emitters: DataFrame, targets: DataFrame, reach: float) -> DataFrame:
    """Emitters (eid, ex, ey, reach) with targets (tx, ty) in reach, joined on tiles of half the longest reach.

    An emitter stays in its tile, a target goes to all tiles in reach of it.  Pairs of emitters that are ``housed``
    for this reach keep their home.
    """
    place = _place(emitters)
    if place:
        asked, side = dealt(emitters, *place), _home_side(f"{reach}e0")
    else:
        place, side = ["home_x", "home_y"], f"({reach}e0 / 2)"
        asked = dealt(emitters.selectExpr("*", *(f"{_tile(f'e{i}', side)} AS home_{i}" for i in "xy")), *place)
    targets = _reached(targets, reach, side)
    near = "(tx - ex) * (tx - ex) + (ty - ey) * (ty - ey) <= reach * reach"
    pairs = asked.hint("shuffle_hash").join(dealt(targets, *place), place).where(near)
    return pairs.select(*emitters.columns, *[c for c in targets.columns if c not in place])


def _reached(targets: DataFrame, reach: float, side: str) -> DataFrame:
    for i in "xy":
        targets = targets.selectExpr("*", f"explode(sequence({_tile(f't{i} - {reach}e0', side)}, {_tile(f't{i} + {reach}e0', side)})) AS home_{i}")
    return targets


def in_homes(targets: DataFrame, reach: float) -> DataFrame:
    """Targets (tx, ty) with each home (home_x, home_y) of emitters ``housed`` for this reach that they may be in reach of."""
    return _reached(targets, reach, _home_side(f"{reach}e0"))


def _tile(x: str, side: str) -> str:
    return f"CAST(floor(({x}) / {side}) AS BIGINT)"


#: The tile an emitter is at home in, and its part of the tile's emitters.
PLACE = ["home_x", "home_y", "home_n"]


def _place(rows: DataFrame) -> list[str]:
    return [c for c in PLACE if c in rows.columns]


def _home_side(reach: str) -> str:
    return f"power(2e0, CAST(ceil(log2(greatest({reach}, 1e-3))) AS INT) - 1)"


def housed(emitters: DataFrame, parts: int | None = None, reach: float | None = None) -> DataFrame:
    """Emitters (eid, ex, ey, reach) with their home: the tile they stand in, at most as wide as their reach, and one of ``parts``.

    With ``reach`` all tiles are made for that reach, as ``pairs_within`` asks for.
    What is dealt by its home stays where the home's triangles come to.  Spark would shuffle both sides of their
    joins again, by all keys, unless told that part of the keys will do.
    """
    emitters.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    side = _home_side("reach" if reach is None else f"{reach}e0")
    part = [f"pmod(hash(eid), {parts}) AS home_n"] if parts else []
    return emitters.selectExpr("*", f"CAST(log2({side}) AS INT) AS home_k", *(f"{_tile(f'e{i}', side)} AS home_{i}" for i in "xy"), *part)


#: Rows of the index of triangles by sectors that a part of a home's emitters has, and that a partition has, about.
HELD, AT_ONCE = 50_000, 200_000


def parting(emitters: DataFrame, size: float, index: float, least: int) -> tuple[int, int]:
    """In how many parts (``least`` or more) homes' emitters (ex, ey, reach) go, and over how many partitions, for triangles of this size.

    A partition's index is held in memory.  Its rows go by the emitters, so parts and partitions do, too.
    """
    rows = f"power(2 * reach / CAST({size!r} AS DOUBLE) + 1, 2) * {1 + index}"
    homes = housed(emitters).groupBy("home_k", "home_x", "home_y").agg(F.sum(F.expr(rows)).alias("n"))
    said = homes.agg(F.coalesce(F.max("n"), F.lit(0.0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("all")).first()
    return max(least, math.ceil(said["most"] / HELD)), max(partitions(emitters), math.ceil(said["all"] / AT_ONCE))


def around(mesh: DataFrame | Terrain, emitters: DataFrame, n: int | None = None) -> Terrain:
    """Triangles in reach of some emitter of a tile, dealt to the tile's partition, of ``n``: one row for each such tile."""
    terrain, place = indexed(mesh), [*_place(emitters), "home_k"]
    limits = [f(F.expr(f"e{i} {s} reach")).alias(f"q{n}{i}") for i in "xy" for f, s, n in ((F.min, "-", "lo"), (F.max, "+", "hi"))]
    homes = emitters.groupBy(*place).agg(*limits)
    near = meeting(homes, terrain.leaves, terrain.levels).join(terrain.triangles, KEY).where("lox <= qhix AND hix >= qlox AND loy <= qhiy AND hiy >= qloy")
    return Terrain(dealt(near.select(*place, *KEY, *CORNERS), *_place(emitters), n=n), terrain.leaves, terrain.levels, terrain.size, terrain.limits, n)


def _with_sectors(rows: DataFrame) -> DataFrame:
    return rows if "sectors" in rows.columns else rows.withColumn("sectors", F.lit(SECTORS).cast("long"))


def sectors_of(mesh: DataFrame | Terrain, emitters: DataFrame) -> DataFrame:
    """Triangles by (eid, sector) as seen from the emitters (eid, ex, ey, ez, reach, sectors) in whose reach they are."""
    terrain, place = indexed(mesh), _place(emitters)
    asked = _with_sectors(emitters).selectExpr(*place, *(["home_k"] if place else []), "eid", "ex", "ey", "ez", "reach", "sectors", *(f"e{i} - reach AS qlo{i}" for i in "xy"), *(f"e{i} + reach AS qhi{i}" for i in "xy"))
    if place:
        near = terrain if "home_x" in terrain.triangles.columns else around(terrain, emitters)
        seen = dealt(asked, *place, n=near.dealt_over).join(near.triangles.hint("shuffle_hash"), [*place, "home_k"])
    else:
        seen = meeting(asked, terrain.leaves, terrain.levels).join(terrain.triangles, KEY)
    seen = seen.where("lox <= qhix AND hix >= qlox AND loy <= qhiy AND hiy >= qloy")
    turn = lambda a: f"({a} - azimuth_a - 360 * floor(({a} - azimuth_a + 180) / 360))"
    azimuth = lambda p: f"degrees(atan2({p}y - ey, {p}x - ex))"
    under = " OR ".join(f"({p}x = ex AND {p}y = ey)" for p in "amc")
    seen = apply(
        seen,
        [
            [("azimuth_a", azimuth("a")), ("azimuth_b", azimuth("m")), ("azimuth_c", azimuth("c"))],
            [("turn_b", turn("azimuth_b")), ("turn_c", turn("azimuth_c"))],
            [("from_", "azimuth_a + least(0e0, turn_b, turn_c) - 1e-7"), ("to_", "azimuth_a + greatest(0e0, turn_b, turn_c) + 1e-7"), ("all_", f"{under} OR greatest(0e0, turn_b, turn_c) - least(0e0, turn_b, turn_c) >= 179.999e0")],
        ],
    )
    bins = f"explode(CASE WHEN all_ THEN sequence(0L, sectors - 1) ELSE sequence({_sector('from_')}, least({_sector('to_')}, {_sector('from_')} + sectors - 1)) END) AS k"
    boxes = CORNERS[-6:]
    seen = seen.selectExpr(*place, "eid", "sectors", *_known(*(f"{c} AS {c}" for c in boxes), *SEEN), "all_", "from_", "to_")
    return seen.selectExpr("*", bins).selectExpr("*", "pmod(k, sectors) AS sector").drop("sectors", "all_", "from_", "to_", "k")


def _known(*columns: str) -> list[str]:
    """The columns with NaN for null, which meets nothing either: the test of a pair then needs no code for nulls, and is compiled."""
    return [f"coalesce({e}, double('NaN')) AS {c}" for e, c in (x.rsplit(" AS ", 1) for x in columns)]


def with_sector(rays: DataFrame) -> DataFrame:
    return _with_sectors(rays).selectExpr("*", *_known(*RAYS), f"pmod({_sector('degrees(atan2(ty - ey, tx - ex))')}, sectors) AS sector")


def _joined(rays: DataFrame, mesh: DataFrame | Terrain, emitters: DataFrame, how: str) -> DataFrame:
    place = _place(emitters)
    triangles = sectors_of(mesh, emitters)
    # the rays of a home are as many as they may be, its triangles few: those are hashed, the rays not sorted
    triangles = (triangles.hint("shuffle_hash") if place else triangles).alias("m")
    asked = with_sector(rays).alias("r")
    keys = reduce(and_, (F.col(f"r.{k}") == F.col(f"m.{k}") for k in [*place, "eid", "sector"]))
    return asked.join(triangles, keys & F.expr(PAIR), how).select(*rays.columns)


def visible(rays: DataFrame, mesh: DataFrame | Terrain, emitters: DataFrame, reach: float | None = None) -> DataFrame:
    """Rays (eid, ex, ey, ez, tx, ty, tz) that no triangle meets, ends excluded.

    Triangles in the emitters' reach count, in ``reach`` for emitters without one.  Emitters and their rays may carry
    ``sectors`` (see ``binned``).
    """
    return _joined(rays, mesh, _reaching(emitters, reach), "left_anti")


def hidden(rays: DataFrame, mesh: DataFrame | Terrain, emitters: DataFrame, reach: float | None = None) -> DataFrame:
    """Rays that some triangle meets."""
    return _joined(rays, mesh, _reaching(emitters, reach), "left_semi")


def flagged(rays: DataFrame, mesh: DataFrame | Terrain, emitters: DataFrame, reach: float | None = None) -> DataFrame:
    """All rays with ``visible``, by one existence join; null where the target has no height."""
    emitters = _reaching(emitters, reach)
    place = _place(emitters)
    keys = " AND ".join(f"m.{k} = r.{k}" for k in [*place, "eid", "sector"])
    blocked = f"EXISTS (SELECT {'/*+ SHUFFLE_HASH(m) */ ' if place else ''}1 FROM {{triangles}} m WHERE {keys} AND {PAIR})"
    columns = ", ".join(f"r.`{c}`" for c in rays.columns)
    rows = f"SELECT {columns}, CASE WHEN r.tz IS NOT NULL THEN NOT {blocked} END AS visible FROM {{asked}} r"
    triangles = sectors_of(mesh, emitters)
    return rays.sparkSession.sql(rows, triangles=triangles.hint("shuffle_hash") if place else triangles, asked=with_sector(rays))


def _reaching(emitters: DataFrame, reach: float | None) -> DataFrame:
    return emitters if reach is None or "reach" in emitters.columns else emitters.withColumn("reach", F.lit(reach))


def _met(rays: DataFrame, terrain: Terrain, *keys: str, slack: float, where: str = "TRUE") -> DataFrame:
    """Keys of the rays that some triangle meets in the leaves below their stretch from (fx, fy) to (gx, gy), of those that have one."""
    # leaves that the stretch crosses, level by level: for each column of them, the rows between its two sides;
    # triangles of a leaf reach their size beyond it
    size, side = "power(2e0, level)", side_of("level")
    cut = lambda x: f"(fy + (gy - fy) * ({x} - fx) / nullif(gx - fx, 0))"
    left, right = f"greatest(least(fx, gx), leaf_x * {side} - {slack})", f"least(greatest(fx, gx), (leaf_x + 1) * {side} + {size} + {slack})"
    # an outer explode, for filters on the stretch would be written out below all that it comes from
    columns = f"sequence(CAST(floor((least(fx, gx) - {size} - {slack}) / {side}) AS BIGINT), CAST(floor((greatest(fx, gx) + {slack}) / {side}) AS BIGINT))"
    crossed = apart(at_levels(rays, terrain.levels)).selectExpr("*", f"explode_outer(CASE WHEN {where} THEN {columns} END) AS leaf_x").where("leaf_x IS NOT NULL")
    crossed = apart(crossed)
    # a stretch may end before its last column, by the slack or a triangle's size
    within = lambda x: f"least(greatest(fx, gx), greatest(least(fx, gx), {x}))"
    left, right = within(left), within(right)
    low, high = f"coalesce(least({cut(left)}, {cut(right)}), least(fy, gy)) - {size} - {slack}", f"coalesce(greatest({cut(left)}, {cut(right)}), greatest(fy, gy)) + {slack}"
    crossed = crossed.selectExpr("*", f"explode(sequence(CAST(floor(({low}) / {side}) AS BIGINT), CAST(floor(({high}) / {side}) AS BIGINT))) AS leaf_y")
    on = [F.col(f"r.{k}") == F.col(f"m.{k}") for k in KEY]
    return apart(crossed).alias("r").join(terrain.triangles.alias("m"), reduce(and_, on) & F.expr(BOXES) & F.expr(MEETS), "left_semi").select(*keys).distinct()


#: What a stretch of a ray is made longer and wider by, in the frame's units, more than rounding makes at the lengths of degrees.
SLACK = 0.05


def traced(rays: DataFrame, mesh: DataFrame | Terrain, keys: list[str]) -> DataFrame:
    """Keys of the rays (ex, ey, ez, tx, ty, tz) that some triangle meets, found along the rays.

    Only the stretch of a ray within the box of the whole mesh counts, which of most far rays is none or short.  The
    work goes by the rays and the leaves they cross low enough, not by the triangles in their emitters' reach.
    """
    terrain = indexed(mesh)
    box = {i: (f"({lo - SLACK!r}D)", f"({hi + SLACK!r}D)") for i, lo, hi in zip("xyz", terrain.limits[::2], terrain.limits[1::2])}
    at = lambda i, x: f"({x} - e{i}) / nullif(t{i} - e{i}, 0)"
    none = lambda i, yes, no: f"CASE WHEN e{i} BETWEEN {box[i][0]} AND {box[i][1]} THEN {yes} ELSE {no} END"
    first = ", ".join(f"coalesce(least({at(i, lo)}, {at(i, hi)}), {none(i, '0e0', '2e0')})" for i, (lo, hi) in box.items())
    last = ", ".join(f"coalesce(greatest({at(i, lo)}, {at(i, hi)}), {none(i, '1e0', '-1e0')})" for i, (lo, hi) in box.items())
    rows = rays.selectExpr(*keys, *(f"{p}{i}" for p in "et" for i in "xyz"), f"greatest(0e0, {first}) AS first", f"least(1e0, {last}) AS last")
    ends = [f"e{i} + (t{i} - e{i}) * {s} AS {p}{i}" for p, s in (("f", "first"), ("g", "last")) for i in "xy"]
    return _met(rows.selectExpr(*keys, *(f"{p}{i}" for p in "et" for i in "xyz"), *ends, "first <= last AS some"), terrain, *keys, slack=SLACK, where="some")


def pair_visibility(pairs: DataFrame, mesh: DataFrame | Terrain) -> DataFrame:
    """Add ``visible`` to pairs (rid, px, py, ph, qx, qy, qh) with heights above the ground.

    An end lies at the whole metres of ground + 0.1, plus its height; without ground, at its height alone.
    """
    terrain = indexed(mesh)
    ends = pairs.selectExpr("rid", "explode(array(named_struct('side', 0, 'x', px, 'y', py), named_struct('side', 1, 'x', qx, 'y', qy))) AS p").select("rid", "p.*")
    z = lambda side: F.max(F.expr(f"CASE WHEN side = {side} THEN coalesce(floor(ground + 0.1e0), 0e0) END"))
    ground = heights(ends, terrain, "rid", "side").groupBy("rid").agg(z(0).cast("double").alias("pz"), z(1).cast("double").alias("qz"))
    rays = pairs.join(ground, "rid")
    rays = rays.selectExpr(*pairs.columns, "px AS ex", "py AS ey", "pz + ph AS ez", "qx AS tx", "qy AS ty", "qz + qh AS tz")
    met = _met(rays.selectExpr("*", "ex AS fx", "ey AS fy", "tx AS gx", "ty AS gy"), terrain, "rid", slack=1e-6)
    return rays.join(met.withColumn("met", F.lit(True)), "rid", "left").select(*pairs.columns, "ez", "tz", F.col("met").isNull().alias("visible"))


#: Samples of a ray over an elevation model: as many as pixels, two at least.
STEPS = [
    [("dx", "t_lon - e_lon"), ("dy", "t_lat - e_lat")],
    [("dx_m", f"dx * {DEM_METRES} * cos(radians((e_lat + t_lat) / 2))"), ("dy_m", f"dy * {DEM_METRES}")],
    [("dist_m", "sqrt(dx_m * dx_m + dy_m * dy_m)")],
    [("n", f"greatest(CAST(ceil(dist_m / (gt1 * {DEM_METRES})) AS BIGINT), 2)"), ("same", "abs(dx) < 1e-9 AND abs(dy) < 1e-9")],
]
SAMPLES = [[("lon", "e_lon + i / CAST(n AS DOUBLE) * (t_lon - e_lon)"), ("lat", "e_lat + i / CAST(n AS DOUBLE) * (t_lat - e_lat)"), ("ray_h", "e_alt + i / CAST(n AS DOUBLE) * (t_alt - e_alt)")]]


#: Blocks along a side of the coarser squares of the pyramid, one sample of so many that is looked up first.
COARSE, STRIDE = 8, 8
RAY = ["rid", "dem_id", "e_lon", "e_lat", "e_alt", "t_lon", "t_lat", "t_alt", "n", "dist_m"]


def _stepped(rays: DataFrame, meta: DataFrame) -> DataFrame:
    return apply(rays.join(few(meta.select("dem_id", "gt1")), "dem_id"), STEPS).where("NOT same").select(*RAY)


def _looked_up(points: DataFrame, dem: Raster, meta: DataFrame) -> DataFrame:
    """Samples (RAY, i) with the elevation there and whether the ray runs below it."""
    keys = ["rid", "dem_id", "n", "dist_m", "i", "lon", "lat", "ray_h"]
    rows = sample(apply(points, SAMPLES).select(*keys), dem, meta, keys)
    return rows.withColumnRenamed("height", "terrain_h").withColumn("below", F.expr(f"coalesce(ray_h < terrain_h - {CLEARANCE_SQL}, FALSE)"))


def _parts(rows: DataFrame, dem: Raster, factor: int, meta: DataFrame) -> DataFrame:
    """Stretches (RAY, low, high) of samples cut so short that each lies in two by two squares of the pyramid, less those above the terrain.

    Quads of samples are monotone along a ray, so those of a stretch lie between those of its ends.
    """
    n = dem.n * factor
    size = few(meta.select("dem_id", "gt0", "gt1", "gt3", "gt5", "width", "height"))
    at = lambda i, axis: f"((e_{axis} + {i} / CAST(n AS DOUBLE) * (t_{axis} - e_{axis})) - {'gt0' if axis == 'lon' else 'gt3'}) / {'gt1' if axis == 'lon' else 'gt5'} - 0.5e0"
    long = f"greatest(abs(({at('high', 'lon')}) - ({at('low', 'lon')})), abs(({at('high', 'lat')}) - ({at('low', 'lat')})))"
    rows = rows.join(size, "dem_id").selectExpr(*rows.columns, "gt0", "gt1", "gt3", "gt5", "width", "height", f"CAST(ceil({long} / {n - 3}e0) AS BIGINT) AS parts")
    rows = rows.selectExpr("*", "explode(sequence(0L, greatest(parts, 1L) - 1)) AS part")
    first, last = "low + ((high - low + 1) * part) DIV greatest(parts, 1L)", "low + ((high - low + 1) * (part + 1)) DIV greatest(parts, 1L) - 1"
    rows = rows.withColumnsRenamed({"low": "low_", "high": "high_"})
    rows = rows.selectExpr(*RAY, "gt0", "gt1", "gt3", "gt5", "width", "height", f"{first.replace('low', 'low_').replace('high', 'high_')} AS low", f"{last.replace('low', 'low_').replace('high', 'high_')} AS high").where("low <= high")
    # a pixel to spare on both sides, clamped as samples are
    least = lambda axis, most: f"greatest(0L, least({most} - 1, CAST(floor(least({at('low', axis)}, {at('high', axis)})) AS BIGINT))) DIV {n}"
    rows = rows.selectExpr("*", f"{least('lat', 'height')} AS trow", f"{least('lon', 'width')} AS tcol")
    ray_h = lambda i: f"(e_alt + {i} / CAST(n AS DOUBLE) * (t_alt - e_alt))"
    met = rows.join(tops(dem, factor), ["dem_id", "trow", "tcol"])
    return met.where(f"least({ray_h('low')}, {ray_h('high')}) < top - {CLEARANCE_SQL} + 1e-6").select(*RAY, "low", "high")


def dem_rounds(rays: DataFrame, dem: DataFrame | Raster, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples that decide which rays are blocked, in two rounds, with whether each is below the terrain.

    Stretches of a ray above the maxima of the squares they cross need no sample.  Of the others some samples are
    looked up first; the rest only of rays that none of these blocks.
    """
    made = raster(dem)
    whole = _stepped(rays, meta).selectExpr("*", "1L AS low", "n - 1 AS high")
    parts = stored(_parts(_parts(whole, made, COARSE, meta), made, 1, meta), "stretches")
    some = f"transform(sequence(0L, (high - low) DIV {STRIDE}), k -> least(high, low + k * {STRIDE} + {STRIDE // 2}))"
    first = _looked_up(parts.selectExpr(*RAY, f"explode(array_distinct({some})) AS i"), made, meta)
    first = stored(first.select("rid", "dem_id", "i", "below"), "samples")
    left = parts.join(first.where("below").select("rid", "dem_id"), ["rid", "dem_id"], "left_anti")
    rest = left.selectExpr(*RAY, f"explode(array_except(sequence(low, high), {some})) AS i")
    return first, _looked_up(rest, made, meta).select("rid", "dem_id", "i", "below")


def dem_visible(rays: DataFrame, dem: DataFrame | Raster, meta: DataFrame, long: bool = True) -> DataFrame:
    """(rid, dem_id, visible) of rays over elevation models; samples without elevation don't block.

    ``long`` rays go through the rounds above; of rays of a few samples each, whose stretches would cost as much as
    their samples, all samples are looked up at once.
    """
    if long:
        first, rest = dem_rounds(rays, dem, meta)
        samples = first.union(rest)
    else:
        samples = _looked_up(_stepped(rays, meta).selectExpr(*RAY, "explode(sequence(1L, n - 1)) AS i"), raster(dem), meta)
    blocked = samples.groupBy("rid", "dem_id").agg(F.max("below").alias("blocked")).where("blocked")
    return rays.select("rid", "dem_id").join(blocked, ["rid", "dem_id"], "left").select("rid", "dem_id", (~F.coalesce("blocked", F.lit(False))).alias("visible"))


def dem_profile(rays: DataFrame, dem: DataFrame | Raster, meta: DataFrame) -> DataFrame:
    """(rid, dem_id, n, dist_m, first_below, samples): every sample, ends too; the first inner one below, or -1."""
    samples = _stepped(rays, meta).selectExpr(*RAY, "explode(sequence(0L, n)) AS i")
    grouped = _looked_up(samples, raster(dem), meta).groupBy("rid", "dem_id", "n", "dist_m").agg(
        F.coalesce(F.min(F.expr("CASE WHEN below AND i BETWEEN 1 AND n - 1 THEN i END")), F.lit(-1)).alias("first_below"),
        F.array_sort(F.collect_list(F.struct("i", "lon", "lat", "ray_h", "terrain_h", "below"))).alias("samples"),
    )
    return grouped
