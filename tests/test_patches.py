"""Elevation models at homes against the rays one by one."""

import pytest

from viewfield.operators import grid, patches, visibility
from viewfield.plans import queries

SF = "/root/testdata/sf0.001"
FRAME = (114.16, 22.28, 100000.0)


@pytest.fixture(scope="module")
def world(spark):
    """Emitters in the middle, at the edges, beyond them and without a height, over two models with gaps."""
    emitters = spark.createDataFrame([(1, 50.03, 60.07, 40.0, 30.0), (2, 1.0, 2.0, 12.0, 30.0), (3, 119.0, 118.5, 9.0, 30.0), (4, 400.0, -300.0, 20.0, 30.0), (5, 60.0, 60.0, None, 30.0), (6, 55.0, 65.0, 3.0, 7.0), (7, 50.0, 50.0, 5.0, 0.0)], "eid long, ex double, ey double, ez double, reach double")
    dem = spark.range(2).selectExpr("id AS dem_id", "explode(sequence(0L, 11L)) AS row").selectExpr("*", "explode(sequence(0L, 11L)) AS col")
    dem = dem.selectExpr("*", "CASE WHEN (row * 7 + col * 5 + dem_id) % 6 = 0 OR row BETWEEN 4 AND 6 AND col BETWEEN 4 AND 6 THEN NULL ELSE CAST(row * 131 + col * 17 + dem_id * 5 AS INT) % 23 / 1e0 END AS height").where("(row + col + dem_id) % 11 > 0")
    meta = spark.sql("SELECT id AS dem_id, 114.16e0 + id * 0.00002e0 AS gt0, 0.0001e0 AS gt1, 22.2812e0 AS gt3, -0.0001e0 AS gt5, 12L AS width, 12L AS height FROM range(2)")
    return visibility.housed(emitters, 3), dem, meta


def test_flags_are_those_of_rays_one_by_one(spark, world):
    emitters, dem, meta = world
    heights, (lon0, lat0, scale) = [1.0, 6.0, 15.0], FRAME
    known = patches.with_flags(emitters, dem, meta, heights, 7.0, *FRAME)
    rays = grid.ground_grid(emitters, 7.0).selectExpr("*", "explode(array(1e0, 6e0, 15e0)) AS t_alt").selectExpr("*", "explode(array(0L, 1L)) AS dem_id")
    rays = rays.selectExpr("named_struct('eid', eid, 'idx', idx, 'h', t_alt) AS rid", "dem_id", f"{lon0}e0 + ex / {scale}e0 AS e_lon", f"{lat0}e0 + ey / {scale}e0 AS e_lat", "ez AS e_alt", f"{lon0}e0 + x / {scale}e0 AS t_lon", f"{lat0}e0 + y / {scale}e0 AS t_lat", "t_alt")
    expected = {(*r.rid, r.dem_id): r.visible for r in visibility.dem_visible(rays, dem, meta, long=False).collect()}
    got = {}
    for r in known.select("eid", "flags").collect():
        for at, flag in enumerate(r.flags):
            got[(r.eid, at // 6, heights[at // 2 % 3], at % 2)] = flag == 1
    assert got == expected
    assert len(set(expected.values())) == 2


def test_compared_cells_are_the_same_without_patches(spark, monkeypatch):
    columns = ["eid", "height", "idx", "dem_id", "visible_mesh", "visible_dem", "t_lon", "t_lat", "tz", "density"]
    rows = lambda: sorted(map(repr, queries._compared(spark, SF).select(*columns).collect()))
    expected = rows()
    monkeypatch.setattr(patches, "PIXELS", 0)
    assert rows() == expected


def test_comparison_shuffles_no_samples(spark):
    """Rays over the models are settled at their emitters: nothing is dealt by pixel blocks or by ray."""
    plan = queries.QUERIES["agg4_comparison"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "brow" not in plan and "rid" not in plan
