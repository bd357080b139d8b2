"""The registered queries over the domain tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import DECIBEL, apply, rounded
from ..operators import boxes, cells, coverage, grid, patches, sights, summary, terrain, visibility
from ..operators.sized import few
from ..sources import io
from ..sources.fixtures import view
from ..sources.shared import folder, stored
from ..streaming import kept
from ..streaming import poses as pose_streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Metres between cells, emitters' reach, and the mesh's frame in degrees.
STEP, REACH, LON0, LAT0, SCALE = 10.0, 60.0, 114.16, 22.28, 100000.0
#: Resolutions of elevation models in metres, and heights of the sweep.
RESOLUTIONS, HEIGHTS = [10.0, 15.0, 20.0], [1.0, 11.0, 21.0]
#: Reach and height in metres of the grid that a pose request is answered with.
POSE_REACH, POSE_HEIGHT = 20.0, 11.0
#: Poses as emitters in the mesh's frame, kept off rounding edges.
POSE_EMITTERS = ["event_id AS eid", "CAST(emitter_id % 8 AS BIGINT) AS model", f"(lon - {LON0}e0) * {SCALE}e0 AS ex", f"(lat - {LAT0}e0) * {SCALE}e0 AS ey", "alt + 0.37e0 AS ez", f"{POSE_REACH}e0 AS reach", "theta + 0.10041e0 AS e_theta", "phi + 0.10037e0 AS e_phi"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _round(*columns: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in columns]


#: Decibels of a density, null for none.
LOGARITHM = "CASE WHEN density > 0 THEN 10 * log10(density) END"


def _rounded(rows: DataFrame, keys: list[str], digits: int = 6, **columns: str) -> DataFrame:
    """Keys and expressions of doubles rounded; of rows as many as pairs, so cheaply."""
    made = rows.selectExpr(*keys, *(f"{e} AS {c}" for c, e in columns.items()))
    return made.selectExpr(*keys, *(f"{rounded(c, digits)} AS {c}" for c in columns))


def _modelled(spark, sf):
    return coverage.with_models(view(spark, sf, "emitters"), view(spark, sf, "models"))


def _pairs(spark, sf):
    return visibility.pairs_within(view(spark, sf, "emitters"), view(spark, sf, "targets"), REACH)


def _visible_pairs(spark, sf):
    return sights.settled(view(spark, sf, "emitters"), view(spark, sf, "targets"), view(spark, sf, "mesh"), REACH)


def _station_models(spark, sf, name="stations"):
    stations = view(spark, sf, name).selectExpr("sid AS eid", "sid % 8 AS model", "*", "lon AS e_lon", "lat AS e_lat", "alt AS e_alt", "CAST(sid * 37 % 360 - 180 AS DOUBLE) + 0.10041e0 AS e_theta", "CAST(sid * 11 % 21 - 10 AS DOUBLE) + 0.10037e0 AS e_phi")
    return coverage.with_models(stations, view(spark, sf, "models"))


def _volume(spark, sf, name="stations"):
    """Scored cells of the stations' 3D grids, 0 where the mesh hides them."""
    return coverage.volume_coverage(_station_models(spark, sf, name), view(spark, sf, "mesh"), view(spark, sf, "bands"), LON0, LAT0, SCALE)


def _coverage_rows(spark, sf):
    """Volume coverage as stored: id, code at key level 16, place, density, time."""
    rows = _volume(spark, sf).selectExpr("eid AS id", "c_lon AS lon", "c_lat AS lat", "greatest(c_alt, 0e0) AS alt", "density", "CAST(i AS DOUBLE) AS timestamp", "16L AS level")
    return cells.encode(rows).drop("level")


def _resolutions(spark):
    rows = ", ".join(f"({i}L, {m}e0)" for i, m in enumerate(RESOLUTIONS))
    return spark.sql(f"SELECT * FROM (VALUES {rows}) AS v(dem_id, metres)")


def _ground(spark, sf):
    return coverage.ground_coverage(_modelled(spark, sf), view(spark, sf, "mesh"), view(spark, sf, "bands"), STEP)


def _heights(spark, sf, flags=None):
    levels = spark.createDataFrame([(h,) for h in HEIGHTS], "height double")
    return coverage.height_coverage(_modelled(spark, sf), view(spark, sf, "mesh"), view(spark, sf, "bands"), levels, STEP, flags)


def _compared(spark, sf):
    """Cells at heights, by mesh and by elevation models of each resolution."""
    mesh = view(spark, sf, "mesh")
    dem = terrain.rasterise(mesh, _resolutions(spark), LON0, LAT0, SCALE)
    meta = stored(terrain.raster_meta(terrain.extent(mesh, LON0, LAT0, SCALE), _resolutions(spark)), "meta")
    seen = _heights(spark, sf, lambda emitters: patches.with_flags(emitters, dem, meta, HEIGHTS, STEP, LON0, LAT0, SCALE)).where("visible IS NOT NULL")
    frame = [f"{LON0}e0 + tx / {SCALE}e0 AS t_lon", f"{LAT0}e0 + ty / {SCALE}e0 AS t_lat"]
    if "flags" in seen.columns:
        rows = seen.crossJoin(few(meta.selectExpr("dem_id", "CAST(count(*) OVER () AS INT) AS n_models", "CAST(row_number() OVER (ORDER BY dem_id) AS INT) AS nth")))
        own = f"substring(flags, CAST(array_position(array({', '.join(f'{h}e0' for h in HEIGHTS)}), height) - 1 AS INT) * n_models + nth, 1)"
        rows = rows.selectExpr("*", f"coalesce({own} = X'01', TRUE) AS visible_dem", *frame).drop("flags", "nth", "n_models")
    else:
        seen = stored(seen, "seen").selectExpr("*", *frame, f"{LON0}e0 + ex / {SCALE}e0 AS e_lon", f"{LAT0}e0 + ey / {SCALE}e0 AS e_lat", "named_struct('eid', eid, 'idx', idx, 'height', height) AS rid")
        rays = seen.crossJoin(few(meta.select("dem_id")))
        told = visibility.dem_visible(rays.selectExpr("rid", "dem_id", "e_lon", "e_lat", "ez AS e_alt", "t_lon", "t_lat", "tz AS t_alt"), dem, meta, long=False)
        rows = seen.join(told.withColumnRenamed("visible", "visible_dem"), "rid")
    return summary.compared(rows.withColumnRenamed("visible", "visible_mesh"))


@query
def src1_mesh(spark, sf):
    corners = [f"{p}{i}" for p in "amc" for i in "xyz"]
    return terrain.with_mbr(view(spark, sf, "mesh")).select("tri_id", *corners, *[f"{f}{i}" for i in "xyz" for f in ("lo", "hi")])


@query
def src2_dem(spark, sf):
    rows = view(spark, sf, "dem").join(few(view(spark, sf, "dem_meta").drop("height", "width")), "dem_id")
    return io.with_sentinel(rows.selectExpr("dem_id", "row", "col", "height", "round(gt0 + (col + 0.5e0) * gt1, 9) AS lon", "round(gt3 + (row + 0.5e0) * gt5, 9) AS lat"))


@query
def src3_catalog(spark, sf):
    return _modelled(spark, sf).select("eid", "name", "kind", "n", "d", "f", "g", "pt", "theta_lo", "theta_hi", "phi_lo", "phi_hi", "model_range")


@query
def src4_pose_lines(spark, sf):
    return io.parse_poses(view(spark, sf, "pose_lines")).selectExpr("line_id", "CASE WHEN ok THEN round(lon, 9) END AS lon", "CASE WHEN ok THEN round(lat, 9) END AS lat", "CASE WHEN ok THEN alt END AS alt", "CASE WHEN ok THEN phi END AS phi", "CASE WHEN ok THEN theta END AS theta", "ok")


@query
def src5_position_csv(spark, sf):
    path = folder(spark, "positions")
    io.write_csv(view(spark, sf, "positions").withColumnRenamed("pid", "id"), path)
    return io.read_positions(spark, path)


@query
def src5_code_csv(spark, sf):
    """Codes written as ``id,code``, read back and decoded at the levels of their positions."""
    path, rows = folder(spark, "codes"), view(spark, sf, "positions").withColumnRenamed("pid", "id")
    io.write_csv(cells.encode(rows).select("id", "code"), path)
    keys = io.read_codes(spark, path).join(rows.select("id", "level"), "id")
    return cells.decode(keys).select("id", "code", *_round("c_lon", "c_lat", digits=9), *_round("c_alt", digits=4))


@query
def snk1_coverage_rows(spark, sf):
    path = folder(spark, "coverage")
    io.append_coverage(_coverage_rows(spark, sf), path, "volume")
    return io.read_coverage(spark, path).selectExpr("CAST(id AS BIGINT) AS id", "code", "round(lon, 6) AS lon", "round(lat, 6) AS lat", "round(alt, 3) AS alt", f"{DECIBEL} AS db", "timestamp")


@query
def snk2_comparison_csv(spark, sf):
    path = folder(spark, "comparison")
    io.write_csv(io.comparison_rows(_compared(spark, sf).selectExpr("*", "t_lon AS lon", "t_lat AS lat", "tz AS alt")), path)
    rows = spark.read.schema("lon DOUBLE, lat DOUBLE, alt DOUBLE, visible_mesh INT, visible_dem INT, disagreement INT, power_density DOUBLE").csv(path, header=True)
    return rows.groupBy("alt", "visible_mesh", "visible_dem", "disagreement").agg(F.count("*").alias("cells"), F.round(F.min("lon"), 6).alias("lon_lo"), F.round(F.max("lat"), 6).alias("lat_hi"))


@query
def snk3_viewshed_csv(spark, sf):
    return io.viewshed_lines(_ground(spark, sf))


@query
def snk2_densities_csv(spark, sf):
    """The compared cells as exported, densities too, read back."""
    path = folder(spark, "comparison")
    io.write_csv(io.comparison_rows(_compared(spark, sf).selectExpr("*", "t_lon AS lon", "t_lat AS lat", "tz AS alt")), path)
    rows = spark.read.schema("lon DOUBLE, lat DOUBLE, alt DOUBLE, visible_mesh INT, visible_dem INT, disagreement INT, power_density DOUBLE").csv(path, header=True)
    strong = F.expr("CASE WHEN power_density >= 1e-4 THEN round(10 * log10(power_density), 2) END")
    return rows.select(*_round("lon", "lat", "alt"), "visible_mesh", "visible_dem", "disagreement", strong.alias("db"))


@query
def snk3_viewshed_files(spark, sf):
    """Viewsheds written as text files and read back: how many cells of each emitter's lines are visible."""
    path = folder(spark, "viewsheds")
    io.write_viewshed(_ground(spark, sf), path)
    lines = spark.read.text(path, recursiveFileLookup=False).selectExpr("CAST(eid AS BIGINT) AS eid", "value")
    return lines.groupBy("eid", F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query
def snk4_printed_rows(spark, sf):
    return io.printed(view(spark, sf, "poses"), "theta")


@query
def snk5_replaced_table(spark, sf):
    path = folder(spark, "table")
    rows = view(spark, sf, "targets")
    io.replace_table(rows.withColumn("tz", F.lit(0.0)), path)
    io.replace_table(rows, path)
    return spark.read.parquet(path)


@query
def grid1_ground(spark, sf):
    return grid.ground_grid(view(spark, sf, "emitters"), STEP).select("eid", "idx", *_round("x", "y"))


@query
def grid2_box(spark, sf):
    asked = view(spark, sf, "stations").selectExpr("sid", "lon - 0.0011e0 AS lon_lo", "lon + 0.0011e0 AS lon_hi", "lat - 0.0007e0 AS lat_lo", "lat + 0.0007e0 AS lat_hi", "15e0 AS metres")
    return grid.box_grid(asked).select("sid", "i", "j", *_round("lon", "lat", digits=9))


def _levels(low: int, high: int) -> Query:
    def of(spark, sf):
        rows = grid.cell_grid(view(spark, sf, "stations").where(f"level BETWEEN {low} AND {high}"))
        return rows.select("sid", "level", "i", "j", "z", *_round("c_lon", "c_lat", digits=9), *_round("c_alt", digits=4))

    return of


@query
def grid3_coarse(spark, sf):
    """Levels 0 to 6 and 25, that the stations do not have."""
    rows = grid.cell_grid(view(spark, sf, "coarse_stations"))
    return rows.select("sid", "level", "i", "j", "z", *_round("c_lon", "c_lat", digits=9), *_round("c_alt", digits=4))


QUERIES |= {"grid3_degrees": _levels(0, 9), "grid4_minutes": _levels(10, 15), "grid5_seconds": _levels(16, 21), "grid6_parts_of_seconds": _levels(22, 30), "grid7_all_levels": _levels(0, 30)}


@query
def cell1_encode(spark, sf):
    return cells.encode(view(spark, sf, "positions")).select("pid", "level", "code")


@query
def cell2_decode(spark, sf):
    return cells.decode(cells.encode(view(spark, sf, "positions")).select("pid", "level", "code")).select("pid", "level", *_round("c_lon", "c_lat", digits=9), *_round("c_alt", digits=4))


@query
def cell3_roll_up(spark, sf):
    rows = cells.roll_up(_coverage_rows(spark, sf), [1, 2, 4])
    return rows.selectExpr("up", "code", "n", "CASE WHEN most > 0 THEN round(10 * log10(most), 2) END AS most_db", "CASE WHEN mean > 0 THEN round(10 * log10(mean), 2) END AS mean_db")


@query
def cell4_scan(spark, sf):
    path = folder(spark, "scan")
    io.append_coverage(_coverage_rows(spark, sf), path, "volume")
    rows = io.read_coverage(spark, path)
    # the emitter with the most rows, from the second time step on, in the lower three quarters of its keys
    found = rows.groupBy("id").agg(F.count("*").alias("n"), F.min("code").alias("low"), F.max("code").alias("high")).orderBy(F.desc("n"), "id").first()
    chosen = found or {"id": 0, "low": 0, "high": 0}
    return cells.scan(rows, F.lit(chosen["id"]), F.lit(1.0), F.lit(chosen["low"]), F.lit((chosen["low"] + 3 * chosen["high"]) // 4)).selectExpr("CAST(id AS BIGINT) AS id", "code", "timestamp")


#: The box that is scanned: degrees east and north, metres up.
BOX = (115.0, 117.5, 23.0, 25.0, 0.0, 30000.0)


@query
def cell4_box(spark, sf):
    """Stored rows whose cell meets a box, by few ranges of keys, counted by cell."""
    path = folder(spark, "scan")
    io.append_coverage(_coverage_rows(spark, sf), path, "volume")
    rows = cells.scan_box(io.read_coverage(spark, path), *BOX, level=16)
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.round(F.min("lon"), 6).alias("lon_lo"), F.round(F.max("lat"), 6).alias("lat_hi"))


@query
def cell5_round_trip(spark, sf):
    encoded = cells.encode(view(spark, sf, "positions"))
    rows = cells.decode(encoded)
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("lon") - F.col("c_lon"))), 7).alias("lon_error"), F.round(F.max(F.abs(F.col("lat") - F.col("c_lat"))), 7).alias("lat_error"), F.round(F.max(F.abs(F.col("alt") - F.col("c_alt"))), 3).alias("alt_error"))


@query
def ter1_heights(spark, sf):
    points = view(spark, sf, "targets").selectExpr("tid AS pid", "tx AS x", "ty AS y")
    return terrain.heights(points, view(spark, sf, "mesh"), "pid").select("pid", *_round("ground"))


@query
def ter2_overlaps(spark, sf):
    asked = view(spark, sf, "targets").selectExpr("tid AS bid", *(f"t{i} - 15 AS qlo{i}" for i in "xyz"), *(f"t{i} + 15 AS qhi{i}" for i in "xyz"))
    return terrain.overlap_counts(asked, view(spark, sf, "mesh"))


def _raster(resolutions: list[int]) -> Query:
    def of(spark, sf):
        chosen = _resolutions(spark).where(F.col("dem_id").isin(resolutions))
        return io.with_sentinel(terrain.rasterise(view(spark, sf, "mesh"), chosen, LON0, LAT0, SCALE)).select("dem_id", "row", "col", *_round("lon", "lat", digits=9), *_round("height"))

    return of


QUERIES |= {"ter3_rasterise": _raster([0]), "ter4_resolutions": _raster([0, 1, 2])}


@query
def ter5_bilinear(spark, sf):
    points = view(spark, sf, "points").selectExpr("pid", "0L AS dem_id", "lon", "lat")
    return terrain.sample(points, view(spark, sf, "dem"), view(spark, sf, "dem_meta"), ["pid"]).select("pid", *_round("height"))


@query
def ter6_pixels(spark, sf):
    indices = view(spark, sf, "points").selectExpr("pid", "0L AS dem_id", "pid % 170 AS row", "pid * 7 % 110 AS col")
    return io.with_sentinel(terrain.pixel_heights(indices, view(spark, sf, "dem"))).select("pid", "row", "col", "height")


@query
def ter7_bounds(spark, sf):
    inside = terrain.in_bounds(view(spark, sf, "points").selectExpr("pid", "0L AS dem_id", "lon", "lat"), view(spark, sf, "dem_meta"))
    limits = terrain.dem_extent(view(spark, sf, "dem_meta"))
    return inside.join(few(limits), "dem_id").select("pid", *_round("lon_lo", "lon_hi", "lat_lo", "lat_hi"))


@query
def los1_mesh(spark, sf):
    emitters = view(spark, sf, "emitters").select("eid", *sights.OWN)
    return sights.settled(emitters, view(spark, sf, "targets"), view(spark, sf, "mesh"), REACH, hidden=True).select("eid", "tid")


@query
def los2_pairs(spark, sf):
    pairs = view(spark, sf, "targets").selectExpr("tid AS rid", "tx AS px", "ty AS py", "5e0 AS ph", "tx + (tid * 37 % 161) - 80.03e0 AS qx", "ty + (tid * 53 % 141) - 70.07e0 AS qy", "2e0 AS qh")
    return visibility.pair_visibility(pairs, view(spark, sf, "mesh")).select("rid", *_round("ez", "tz"), "visible")


@query
def los3_viewshed(spark, sf):
    return _ground(spark, sf).select("eid", "i", "j", *_round("ground"), "visible")


@query
def los4_dem(spark, sf):
    rays = view(spark, sf, "rays").withColumn("dem_id", F.lit(0).cast("long"))
    return visibility.dem_visible(rays, view(spark, sf, "dem"), view(spark, sf, "dem_meta")).select("rid", "visible")


@query
def los5_dem_profile(spark, sf):
    rays = view(spark, sf, "rays").withColumn("dem_id", F.lit(0).cast("long"))
    rows = visibility.dem_profile(rays, view(spark, sf, "dem"), view(spark, sf, "dem_meta"))
    return rows.selectExpr("rid", "n", "round(dist_m, 4) AS dist_m", "first_below", "CAST(size(samples) AS BIGINT) AS n_samples", "CAST(size(filter(samples, s -> s.below)) AS BIGINT) AS n_below")


def _segment_counts(spark, sf, projections):
    return boxes.segment_counts(view(spark, sf, "emitters"), view(spark, sf, "targets"), view(spark, sf, "mesh"), REACH, projections)


@query
def los6_boxes(spark, sf):
    """How many triangles' boxes share a point with the box of each segment of an emitter and a target."""
    return _segment_counts(spark, sf, False)


@query
def los6_segment_boxes(spark, sf):
    """How many triangles' boxes each segment of an emitter and a target meets in all three projections."""
    return _segment_counts(spark, sf, True)


@query
def cov1_patterns(spark, sf):
    """Patterns of the models that emitters have, at each thousandth of a degree: sums by whole degrees."""
    used = view(spark, sf, "models").join(view(spark, sf, "emitters").select("model").distinct(), "model", "left_semi")
    rows = coverage.pattern_table(used).selectExpr("model", "axis", "CAST(floor(key / 1000) AS BIGINT) AS degree", "e")
    return rows.groupBy("model", "axis", "degree").agg(F.round(F.sum(F.abs("e")), 3).alias("total"), F.count("e").alias("n"))


def _angles(spark, sf):
    return coverage.in_frame(coverage.with_models(_pairs(spark, sf), view(spark, sf, "models")))


@query
def cov2_attenuation(spark, sf):
    from ..functions.formulas import ATTENUATION, SECTOR

    rows = coverage.with_attenuation(apply(_angles(spark, sf), SECTOR), view(spark, sf, "bands"))
    return _rounded(rows, ["eid", "tid"], db_km=ATTENUATION)


@query
def cov3_frame(spark, sf):
    return _rounded(_angles(spark, sf), ["eid", "tid"], theta="theta", phi="phi", r="r")


@query
def cov4_sector(spark, sf):
    from ..functions.formulas import SECTOR

    return _rounded(apply(_angles(spark, sf), SECTOR), ["eid", "tid", "outside"], dtheta="dtheta", dphi="dphi").select("eid", "tid", "dtheta", "dphi", "outside")


@query
def cov5_density(spark, sf):
    rows = coverage.with_models(_visible_pairs(spark, sf), view(spark, sf, "models"))
    return _rounded(coverage.score(rows, view(spark, sf, "bands")).withColumn("is_zero", F.expr("density = 0")), ["eid", "tid", "is_zero"], 2, db=LOGARITHM).select("eid", "tid", "db", "is_zero")


@query
def cov5_decibels(spark, sf):
    """Scores to four decimals, hidden targets left out."""
    rows = coverage.with_models(_visible_pairs(spark, sf), view(spark, sf, "models"))
    return _rounded(coverage.score(rows, view(spark, sf, "bands")), ["eid", "tid"], 4, db=LOGARITHM)


@query
def cov6_volume(spark, sf):
    return _volume(spark, sf).selectExpr("eid", "i", "j", "z", f"{DECIBEL} AS db")


@query
def cov6_hidden_cells(spark, sf):
    """Volumes of stations among the mesh: most cells near the ground are hidden, and far-reaching stations are among them."""
    return _volume(spark, sf, "sites").selectExpr("eid", "i", "j", "z", "visible", f"{DECIBEL} AS db")


@query
def cov7_ground(spark, sf):
    return _ground(spark, sf).selectExpr("eid", "idx", "visible", f"{DECIBEL} AS db")


@query
def cov8_heights(spark, sf):
    return _heights(spark, sf).selectExpr("eid", "height", "idx", "low_height", "visible", f"{DECIBEL} AS db")


@query
def cov9_detectable(spark, sf):
    rows = coverage.score(coverage.with_models(_visible_pairs(spark, sf), view(spark, sf, "models")), view(spark, sf, "bands"))
    return coverage.detectable(rows, view(spark, sf, "bands"), rcs=1.0, models=view(spark, sf, "models")).select("eid", "tid", "detectable")


@query
def cov10_snapshot(spark, sf):
    rows = coverage.with_models(_visible_pairs(spark, sf), view(spark, sf, "models"))
    return _rounded(coverage.score(rows, view(spark, sf, "bands"), snapshot=True), ["eid", "tid", "outside"], 2, db=LOGARITHM).select("eid", "tid", "db", "outside")


@query
def cov11_separation(spark, sf):
    rays = view(spark, sf, "rays").selectExpr("rid", "e_lon AS lon1", "e_lat AS lat1", "t_lon AS lon2", "t_lat AS lat2")
    return coverage.separation(rays).select("rid", *_round("metres", digits=4), *_round("bearing", digits=4))


@query
def agg1_totals(spark, sf):
    rows = summary.totals(_heights(spark, sf), ["eid", "height"])
    return rows.selectExpr("eid", "height", "cells", "visible", "round(percent, 4) AS percent", "round(10 * log10(least), 2) AS least_db", "round(10 * log10(most), 2) AS most_db")


@query
def agg2_intensity(spark, sf):
    return summary.intensity(stored(_heights(spark, sf), "cells"), ["eid", "height"]).selectExpr("eid", "height", "idx", "level", "red DIV 4 AS red", "green DIV 4 AS green", "blue DIV 4 AS blue")


@query
def agg2_colours(spark, sf):
    """Intensity with its whole colours."""
    return summary.intensity(stored(_heights(spark, sf), "cells"), ["eid", "height"]).select("eid", "height", "idx", "level", "red", "green", "blue")


@query
def agg3_agreement(spark, sf):
    return _compared(spark, sf).select("eid", "height", "idx", "dem_id", "visible_mesh", "visible_dem", "agreement", "disagreement")


def _shares(rows: DataFrame, *keys: str) -> DataFrame:
    db = [f"CASE WHEN {c} > 0 THEN round(10 * log10({c}), 2) END AS {c}_db" for c in ("least", "most")]
    return rows.selectExpr(*keys, "cells", "by_mesh", "by_dem", "disagreements", *(f"round({c}, 4) AS {c}" for c in ("percent_mesh", "percent_dem", "accuracy")), *db)


@query
def agg4_comparison(spark, sf):
    return _shares(summary.comparison(_compared(spark, sf), ["dem_id", "height"]), "dem_id", "height")


@query
def agg5_cube(spark, sf):
    return _shares(summary.comparison(_compared(spark, sf), ["dem_id", "height"], cube=True), "dem_id", "height")


def _as_stream(spark, sf, name, out):
    """The rows of a view as a stream of files."""
    view(spark, sf, name).write.parquet(out)
    return spark.readStream.schema(spark.read.parquet(out).schema).option("maxFilesPerTrigger", 4).parquet(out)


def pose_angles(batch: DataFrame) -> DataFrame:
    """Distance and bearing from each pose to a fixed mark: what a pose request appends here."""
    return coverage.separation(batch.selectExpr("event_id", "emitter_id", "lon AS lon1", "lat AS lat1", "114.16731e0 AS lon2", "22.28117e0 AS lat2"))


@query
def str1_pose_requests(spark, sf):
    out = folder(spark, "requests")
    stream = _as_stream(spark, sf, "poses", folder(spark, "poses"))
    pose_streams.append_each(stream, pose_angles, out, folder(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "emitter_id", *_round("metres", "bearing", digits=4))


@query
def str1_pose_coverage(spark, sf):
    """Each pose request is answered with the scored cells of a grid round it."""
    out = folder(spark, "requests")
    stream = _as_stream(spark, sf, "poses", folder(spark, "poses"))

    table = f"terrain_{uuid.uuid4().hex}"
    mesh = terrain.prepared(view(spark, sf, "mesh"), table)

    def cells_of(batch: DataFrame) -> DataFrame:
        emitters = coverage.with_models(batch.selectExpr(*POSE_EMITTERS), view(spark, sf, "models"))
        levels = spark.createDataFrame([(POSE_HEIGHT,)], "height double")
        return coverage.height_coverage(emitters, mesh, view(spark, sf, "bands"), levels, STEP)

    pose_streams.append_each(stream, cells_of, out, folder(spark, "progress")).awaitTermination()
    terrain.dropped(spark, table)
    return spark.read.parquet(out).selectExpr("eid AS event_id", "idx", "visible", f"{DECIBEL} AS db")


@query
def str2_latest_pose(spark, sf):
    return pose_streams.latest(view(spark, sf, "poses")).selectExpr("emitter_id", "CAST(unix_micros(ts) AS BIGINT) AS micros", "round(lon, 6) AS lon", "round(lat, 6) AS lat", "alt", "phi", "theta")


#: Kept poses as emitters in the mesh's frame.
KEPT_EMITTERS = ["emitter_id AS eid", *POSE_EMITTERS[1:]]


@query
def str2_kept_coverage(spark, sf):
    """Moves and turns come in two runs of a stream, later ones first; only poses that change are scored, and the last of each stands."""
    out, held, progress = folder(spark, "coverage"), folder(spark, "events"), folder(spark, "progress")
    events = view(spark, sf, "pose_events")
    table = f"terrain_{uuid.uuid4().hex}"
    mesh = terrain.prepared(view(spark, sf, "mesh"), table)

    def cells_of(poses: DataFrame) -> DataFrame:
        emitters = coverage.with_models(poses.selectExpr(*KEPT_EMITTERS), view(spark, sf, "models"))
        levels = spark.createDataFrame([(POSE_HEIGHT,)], "height double")
        return coverage.height_coverage(emitters, mesh, view(spark, sf, "bands"), levels, STEP)

    for part in ("event_id % 5 >= 2", "event_id % 5 < 2"):
        events.where(part).write.mode("append").parquet(held)
        stream = spark.readStream.schema(events.schema).parquet(held)
        kept.score_changed(stream, cells_of, out, progress).awaitTermination()
    terrain.dropped(spark, table)
    return kept.standing(spark.read.parquet(out)).selectExpr("eid", "idx", "visible", f"{DECIBEL} AS db")
