"""What a task holds in memory does not grow with the tables."""

from pyspark.sql import functions as F

from viewfield.operators import coverage, grid, sized, visibility
from viewfield.plans import queries
from viewfield.sources.fixtures import view

SF = "/root/testdata/sf0.001"


def test_reach_of_parts_of_seconds_ends_at_the_farthest_cell(spark):
    stations = view(spark, SF, "sites").where("level >= 22")
    cells = grid.cell_grid(stations).groupBy("sid").agg(*(F.max(F.abs(F.col(f"c_{x}") - F.col(x))).alias(f"far_{x}") for x in ("lon", "lat")))
    rows = grid.reaching(stations).join(cells, "sid").collect()
    assert rows
    for r in rows:
        assert 0 <= r.lon_reach - r.far_lon < 1e-8 and 0 <= r.lat_reach - r.far_lat < 1e-8


def test_parts_of_homes_and_partitions_grow_with_emitters(spark):
    few, many = (spark.range(n).selectExpr("id AS eid", "50e0 AS ex", "50e0 AS ey", "60e0 AS reach") for n in (10, 10_000))
    own = sized.partitions(few)
    assert visibility.parting(few, 9.0, 2.0, 8) == (8, own)
    parts, n = visibility.parting(many, 9.0, 2.0, 8)
    rows = 10_000 * (120 / 9 + 1) ** 2 * 3
    assert rows / parts <= visibility.HELD and rows / n <= visibility.AT_ONCE


def test_volumes_are_the_same_in_many_parts(spark, monkeypatch):
    rows = lambda: sorted(map(repr, queries.QUERIES["cov6_hidden_cells"](spark, SF).collect()))
    expected = rows()
    monkeypatch.setattr(visibility, "HELD", 100)
    monkeypatch.setattr(visibility, "AT_ONCE", 300)
    seen, given = [], coverage.around
    monkeypatch.setattr(coverage, "around", lambda mesh, emitters, n=None: seen.append(n) or given(mesh, emitters, n))
    assert rows() == expected
    assert seen[0] > sized.partitions(spark.range(1))


def test_apart_joins_no_partitions(spark):
    rows = spark.range(100).repartition(3 * sized.partitions(spark.range(1))).selectExpr("id + 1 AS id")
    assert sized.apart(rows).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
