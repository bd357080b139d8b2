"""Cases at the edges of the domain's operators."""

import math

import pytest

from viewfield.operators import cells, coverage, grid, summary, terrain, visibility
from viewfield.sources import io
from viewfield.sources.fixtures import VIEWS
from viewfield.streaming import poses

CORNERS = "tri_id long, ax double, ay double, az double, mx double, my double, mz double, cx double, cy double, cz double"
WALL = (1, 5.0, -5.0, 0.0, 5.0, 5.0, 0.0, 5.0, 0.0, 20.0)  # upright, across the way east
ROOF = (2, -9.0, -9.0, 9.0, 9.0, -9.0, 9.0, 0.0, 9.0, 9.0)  # over the emitter at the origin


def _hidden(spark, triangles, emitter, targets):
    mesh = spark.createDataFrame(triangles, CORNERS)
    emitters = spark.createDataFrame([(0, *emitter, 100.0)], "eid long, ex double, ey double, ez double, reach double")
    rays = emitters.crossJoin(spark.createDataFrame([(i, *map(float, t)) for i, t in enumerate(targets)], "tid long, tx double, ty double, tz double"))
    return {r.tid for r in visibility.hidden(rays, mesh, emitters, 100.0).collect()}


def test_wall_hides_behind_but_not_before_nor_above(spark):
    assert _hidden(spark, [WALL], (0.0, 0.0, 1.0), [(10, 0, 1), (4, 0, 1), (10, 0, 60), (-10, 0, 1), (5, 0, 1)]) == {0}


def test_azimuth_wraps(spark):
    west = (1, -5.0, -5.0, 0.0, -5.0, 5.0, 0.0, -5.0, 0.0, 20.0)
    assert _hidden(spark, [west], (0.0, 0.0, 1.0), [(-10, 0, 1), (-10, 0.001, 1), (-10, -0.001, 1), (10, 0, 1)]) == {0, 1, 2}


def test_roof_over_the_emitter_is_in_all_sectors(spark):
    assert _hidden(spark, [ROOF], (0.0, 0.0, 1.0), [(0, 0, 20), (1, 2, 20), (-2, 1, 20), (3, -3, 5), (0, 0, 9)]) == {0, 1, 2}


def test_no_terrain_hides_nothing(spark):
    assert _hidden(spark, [], (0.0, 0.0, 1.0), [(10, 0, 1)]) == set()


def test_hidden_cells_of_a_volume_have_no_density(spark):
    stations = spark.sql("SELECT 0L AS eid, 2L AS model, 114.16e0 AS lon, 22.28e0 AS lat, 2e0 AS alt, 21L AS level, 200e0 AS range_m, 114.16e0 AS e_lon, 22.28e0 AS e_lat, 2e0 AS e_alt, 0.1e0 AS e_theta, 0.1e0 AS e_phi")
    stations = coverage.with_models(stations, spark.sql(VIEWS["models"]))
    wall = (1, 10.0, -400.0, -500.0, 10.0, 400.0, -500.0, 10.0, 0.0, 2000.0)
    rows = lambda triangles: {(r.i, r.j, r.z): r for r in coverage.volume_coverage(stations, spark.createDataFrame(triangles, CORNERS), spark.sql(VIEWS["bands"]), 114.16, 22.28, 100000.0).collect()}
    free, walled = rows([]), rows([wall])
    assert free.keys() == walled.keys() and all(r.visible for r in free.values())
    behind = {k for k, r in walled.items() if r.tx > 10 and abs(r.ty) < 100}
    assert any(free[k].density > 0 for k in behind) and all(not walled[k].visible and walled[k].density == 0 for k in behind)
    assert any(r.density > 0 for r in walled.values()) and all(r.density == free[k].density for k, r in walled.items() if r.tx < 10)


def test_height_is_the_highest_and_null_beside(spark):
    flat = (3, 0.0, 0.0, 1.0, 10.0, 0.0, 1.0, 0.0, 10.0, 1.0)
    slope = (4, 0.0, 0.0, 0.0, 10.0, 0.0, 10.0, 0.0, 10.0, 0.0)
    points = spark.createDataFrame([(1, 5.0, 2.0), (2, 0.5, 0.5), (3, 9.0, 9.0), (4, 0.0, 0.0)], "pid long, x double, y double")
    got = {r.pid: r.ground for r in terrain.heights(points, spark.createDataFrame([flat, slope, WALL], CORNERS)).collect()}
    assert got == {1: 5.0, 2: 1.0, 3: None, 4: 1.0}


@pytest.fixture(scope="module")
def dem(spark):
    heights = [(0, r, c, None if (r, c) == (0, 0) else float(10 * r + c)) for r in range(3) for c in range(3)]
    meta = spark.createDataFrame([(0, 0.0, 1.0, 3.0, -1.0, 3, 3)], "dem_id long, gt0 double, gt1 double, gt3 double, gt5 double, width long, height long")
    return spark.createDataFrame(heights, "dem_id long, row long, col long, height double"), meta


def test_bilinear(spark, dem):
    places = [(1, 1.5, 1.5), (2, 2.0, 1.0), (3, 1.0, 2.0), (4, 99.0, -99.0), (5, 0.5, 2.5), (6, 2.9, 0.1)]
    points = spark.createDataFrame([(p, 0, x, y) for p, x, y in places], "pid long, dem_id long, lon double, lat double")
    got = {r.pid: r.height for r in terrain.sample(points, *dem, ["pid"]).collect()}
    # a centre, the middle of four, three of four, far outside, the empty pixel among others, the last corner
    assert got == {1: 11.0, 2: 16.5, 3: (1 + 10 + 11) / 3, 4: 22.0, 5: (1 + 10 + 11) / 3, 6: 22.0}


def test_ray_to_its_own_place_is_visible(spark, dem):
    rays = spark.createDataFrame([(1, 0, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0), (2, 0, 0.5, 0.5, 0.0, 2.5, 0.5, 0.0)], "rid long, dem_id long, e_lon double, e_lat double, e_alt double, t_lon double, t_lat double, t_alt double")
    assert {r.rid: r.visible for r in visibility.dem_visible(rays, *dem).collect()} == {1: True, 2: False}


def test_cell_corner_is_within_a_cell_and_parent_is_a_shift(spark):
    rows = [(i, lon, lat, alt, level) for level in (1, 10, 15, 20, 21) for i, (lon, lat, alt) in enumerate([(-179.9999, -89.9999, 0.0), (0.0, 0.0, 49999.0), (114.5, -22.25, 77.0), (-0.0001, 0.0001, 1.0)])]
    at = cells.encode(spark.createDataFrame(rows, "pid long, lon double, lat double, alt double, level long"))
    codes = {(r.pid, r.level): r.code for r in at.collect()}
    assert all(codes[i, 15] == codes[i, 20] >> 15 for i in range(4)) and all(0 <= c < 1 << 63 for c in codes.values())
    for r in cells.decode(at).where("level = 21").collect():
        assert abs(r.lon - r.c_lon) <= 1 / 3600 + 1e-9 and abs(r.lat - r.c_lat) <= 1 / 3600 + 1e-9


def test_cell_levels_are_checked(spark):
    with pytest.raises(Exception, match="cell level"):
        cells.encode(spark.createDataFrame([(1, 0.0, 0.0, 0.0, 22)], "pid long, lon double, lat double, alt double, level long")).collect()


def _scored(spark, target, model="m0", snapshot=False):
    emitter = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, *map(float, target))], "eid long, ex double, ey double, ez double, e_theta double, e_phi double, tx double, ty double, tz double")
    models = spark.sql(VIEWS["models"]).where(f"name = '{model}'")
    return coverage.score(emitter.crossJoin(models), spark.sql(VIEWS["bands"]), snapshot=snapshot).first()


def test_density(spark):
    ahead = _scored(spark, (0, 1000, 0))
    assert ahead.dtheta == 0 and math.isclose(ahead.density, 20_000 * 10**3.2 / (4 * math.pi * 1e6 * 10 ** (6.8 * 1000 / 1000 / 10)), rel_tol=1e-9)
    assert _scored(spark, (0, -1000, 0)).density == 0  # behind
    assert _scored(spark, (0, 0, 0), "m2").density is None  # no distance, in a sector all round
    assert _scored(spark, (0, 1000, 0), "m7").db_km == 0  # beyond 20000 MHz
    assert _scored(spark, (0, 1000, 0), "m6").db_km == 0  # below 1000 MHz


def test_grid_without_cells(spark):
    e = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 10.0)], "eid long, ex double, ey double, reach double")
    assert grid.ground_grid(e, 10.0).groupBy("eid").count().collect() == [(2, 4)]


def test_bad_pose_lines(spark):
    lines = ["1:2:3,4:5:6,7,8,9", "1:2,4:5:6,7,8,9", "", "a,b,c,d,e", "1:2:3,4:5:6,7,8", None, "1:2:3,4:5:6,7,8,9,10"]
    good, bad = io.quarantined(io.parse_poses(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert good.count() == 1 and bad.count() == 6
    assert good.first().alt == 7.0


def test_grey_without_signal(spark):
    rows = spark.createDataFrame([(1, True, 0.0), (1, True, 1.0), (1, False, 100.0), (2, None, None)], "k long, visible boolean, density double")
    got = {(r.k, r.density): (r.red, r.green, r.blue) for r in summary.intensity(rows, ["k"]).collect()}
    assert got == {(1, 0.0): (128, 128, 128), (1, 1.0): (255, 255, 180), (1, 100.0): (255, 0, 0), (2, None): (128, 128, 128)}


def test_latest_pose_of_a_stream_is_that_of_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i, 100 - i // 2) for i in range(60)], "emitter_id long, event_id long, s long").selectExpr("emitter_id", "event_id", "timestamp_seconds(s) AS ts", *(f"CAST(event_id AS DOUBLE) AS {c}" for c in poses.POSE))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    poses.latest(stream).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(spark.table("latest").collect()) == sorted(poses.latest(rows).collect())


def test_a_pose_request_is_answered_with_its_whole_grid(spark):
    from viewfield.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["str1_pose_coverage"](spark, sf).collect()
    assert len({(r.event_id, r.idx) for r in rows}) == len(rows) == 16 * spark.read.parquet(f"{sf}/events.parquet").count()
    assert {r.visible for r in rows} == {True, False} and any(r.db is not None for r in rows) and all(r.db is None for r in rows if not r.visible)


def test_a_slanted_segment_misses_boxes_in_its_own_box(spark):
    from viewfield.functions.formulas import CROSSES

    rows = spark.sql("SELECT *, 0e0 AS ex, 0e0 AS ey, 0e0 AS ez, 10e0 AS tx, 10e0 AS ty, 10e0 AS tz FROM VALUES (1, 4e0, 4e0, 4e0, 6e0, 6e0, 6e0), (2, 7e0, 1e0, 1e0, 9e0, 3e0, 3e0), (3, 4e0, 4e0, 8e0, 6e0, 6e0, 9e0), (4, 9e0, 9e0, 9e0, 20e0, 20e0, 20e0) AS v(id, lox, loy, loz, hix, hiy, hiz)")
    assert {r.id for r in rows.where(CROSSES).collect()} == {1, 4}
