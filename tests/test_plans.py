"""Plans that must hold at size: index rows, rows read, samples looked up, and writes that are run again."""

import random
import re

import pytest
from pyspark.sql import functions as F

from viewfield.functions.formulas import BOXES, CROSSES, apply, compact_layers
from viewfield.operators import boxes, cells, grid, terrain, visibility
from viewfield.operators.sized import dealt
from viewfield.plans import queries
from viewfield.sources import io
from viewfield.sources.fixtures import view
from viewfield.sources.shared import folder, stored
from viewfield.streaming import kept

from .test_edges import CORNERS

SF = "/root/testdata/sf0.001"
EMITTERS = "eid long, ex double, ey double, ez double, reach double"


def triangles(seed, n, size, extent=200.0):
    """Some triangles of about so many metres, upright ones and flat ones."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        x, y, s = r.uniform(-extent, extent), r.uniform(-extent, extent), size * r.uniform(0.5, 1)
        out.append((seed * 10_000 + k, x, y, 0.0, x + s, y + r.uniform(-s, s), r.uniform(0, 20), x + r.uniform(-s, s), y + s, r.uniform(0, 20)))
    return out


def meets(a, b):
    """The mesh test in plain Python: does the open segment meet the triangle?"""
    e, t = a
    p = [b[i : i + 3] for i in (1, 4, 7)]
    sub = lambda x, y: [i - j for i, j in zip(x, y)]
    cross = lambda x, y: [x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]]
    dot = lambda x, y: sum(i * j for i, j in zip(x, y))
    ray, e1, e2, s = sub(t, e), sub(p[1], p[0]), sub(p[2], p[0]), sub(e, p[0])
    det, far = dot(e1, cross(ray, e2)), dot(ray, ray) ** 0.5
    if abs(det) < 1e-6 * far or det == 0:
        return False
    u, w, at = dot(s, cross(ray, e2)) / det, dot(ray, cross(s, e1)) / det, dot(e2, cross(s, e1)) / det
    return 0 <= u <= 1 and 0 <= w and u + w <= 1 and at * far > 1e-6 and at < 1


@pytest.fixture(scope="module")
def scene(spark):
    mesh = triangles(1, 150, 8.0) + triangles(2, 60, 1.0) + triangles(3, 2, 10_000.0) + triangles(4, 8, 120.0)
    r = random.Random(9)
    emitters = [(k, r.uniform(-150, 150), r.uniform(-150, 150), r.uniform(1, 15), reach) for k, reach in enumerate([5.0, 30.0, 90.0, 300_000.0])]
    rays = []
    for eid, ex, ey, ez, reach in emitters:
        for tid in range(40):
            d, x, y = min(reach, 200.0), r.uniform(-0.7, 0.7), r.uniform(-0.7, 0.7)
            rays.append((eid, ex, ey, ez, reach, tid, ex + d * x, ey + d * y, r.uniform(0.5, 25)))
    hidden = {(q[0], q[5]) for q in rays if any(meets((q[1:4], q[6:9]), t) for t in mesh)}
    frames = spark.createDataFrame(mesh, CORNERS), spark.createDataFrame(emitters, EMITTERS), spark.createDataFrame(rays, f"{EMITTERS}, tid long, tx double, ty double, tz double")
    return *frames, hidden


@pytest.mark.parametrize("sectors", [1, 2, 7, 64, 720, 5000])
def test_any_number_of_sectors_gives_the_same(scene, sectors):
    mesh, emitters, rays, hidden = scene
    with_ = lambda x: x.withColumn("sectors", F.lit(sectors).cast("long") + F.col("eid"))
    assert {(r.eid, r.tid) for r in visibility.hidden(with_(rays), mesh, with_(emitters)).collect()} == hidden
    assert 10 < len(hidden) < 150


def test_sectors_follow_rays_and_triangles(spark, scene):
    mesh, emitters, rays, hidden = scene
    few, many = (visibility.binned(emitters, mesh, n) for n in ("4", "1000000"))
    assert all(a.sectors < b.sectors for a, b in zip(few.orderBy("eid").collect(), many.orderBy("eid").collect()))
    own = visibility.binned(emitters, mesh, "40")
    rows = visibility.flagged(rays.join(own.select("eid", "sectors"), "eid"), mesh, own).collect()
    assert len(rows) == 160 and {(r.eid, r.tid) for r in rows if not r.visible} == hidden


def test_index_of_pose_requests_is_smaller_than_the_product(spark):
    """Sixteen rays each: the index holds fewer rows than emitters' rays times the triangles in their reach."""
    mesh = terrain.indexed(view(spark, SF, "mesh"))
    poses = visibility.binned(view(spark, SF, "poses").selectExpr(*queries.POSE_EMITTERS), mesh, "16")
    pairs = visibility.sectors_of(mesh, poses.withColumn("sectors", F.lit(1).cast("long"))).count()
    rows = visibility.sectors_of(mesh, poses).count()
    assert pairs < rows < 5 * pairs < 16 * pairs


def test_leaves_hold_each_triangle_once_at_any_size(spark, scene):
    mesh, emitters, _, _ = scene
    made = terrain.indexed(mesh)
    assert made.triangles.count() == mesh.count()
    near = terrain.meeting(emitters.selectExpr("eid", "ex - reach AS qlox", "ex + reach AS qhix", "ey - reach AS qloy", "ey + reach AS qhiy"), made.leaves, made.levels).collect()
    leaves = {(r.level, r.leaf_x, r.leaf_y): r for r in made.leaves.collect()}
    want = {(e.eid, k) for e in emitters.collect() for k, b in leaves.items() if b.lox <= e.ex + e.reach and b.hix >= e.ex - e.reach and b.loy <= e.ey + e.reach and b.hiy >= e.ey - e.reach}
    assert {(r.eid, (r.level, r.leaf_x, r.leaf_y)) for r in near} == want and len(near) == len(want)
    # the one far emitter meets every leaf, the near ones few
    assert len([k for k in want if k[0] == 3]) == len(leaves) > 3 * len([k for k in want if k[0] == 0])


def test_heights_of_small_and_large_triangles(spark):
    def height(x, y, t):
        (ax, ay, az), (mx, my, mz), (cx, cy, cz) = (t[i : i + 3] for i in (1, 4, 7))
        det = (mx - ax) * (cy - ay) - (cx - ax) * (my - ay)
        u, v = ((x - ax) * (cy - ay) - (cx - ax) * (y - ay)) / det, ((mx - ax) * (y - ay) - (x - ax) * (my - ay)) / det
        return az + u * (mz - az) + v * (cz - az) if u >= 0 and v >= 0 and u + v <= 1 else None

    mesh = triangles(11, 80, 1.0, 20.0) + triangles(12, 40, 9.0, 20.0) + triangles(13, 3, 10_000.0, 5000.0)
    r = random.Random(3)
    points = [(i, r.uniform(-25, 25), r.uniform(-25, 25)) for i in range(150)] + [(900, 20_000.0, 0.0)]
    got = {p.pid: p.ground for p in terrain.heights(spark.createDataFrame(points, "pid long, x double, y double"), spark.createDataFrame(mesh, CORNERS)).collect()}
    for i, x, y in points:
        found = [h for h in (height(x, y, t) for t in mesh) if h is not None]
        assert got[i] == pytest.approx(max(found), abs=1e-6) if found else got[i] is None


def _shuffles_above(plan, table):
    """How many exchanges lie between a table's scan and the join that it comes to."""
    found = []

    def walk(node, above):
        name = node.nodeName()
        if table in node.toString().split("\n")[0] and "Scan" in name:
            found.append(above)
        above = 0 if "Join" in name else above + ("Exchange" in name or "ShuffleQueryStage" in name)
        inner = node.plan() if "QueryStage" in name else None
        for child in [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]:
            walk(child, above)

    walk(plan, 0)
    assert found
    return max(found)


def test_prepared_terrain_is_not_shuffled(spark, scene):
    mesh, emitters, rays, hidden = scene
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    made = terrain.prepared(mesh, "test_terrain")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        points = rays.selectExpr("eid * 1000 + tid AS pid", "tx AS x", "ty AS y")
        df = terrain.heights(points, made)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().executedPlan()
        print(plan.toString())
        assert _shuffles_above(plan, "test_terrain") == 0
        assert {(r.eid, r.tid) for r in visibility.hidden(rays, made, emitters).collect()} == hidden
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        terrain.dropped(spark, "test_terrain")
    assert not spark.catalog.tableExists("test_terrain")


def dem_of(spark, n, height):
    rows = [(0, r, c, height(r, c)) for r in range(n) for c in range(n)]
    meta = spark.createDataFrame([(0, 114.0, 0.0001, 22.3, -0.0001, n, n)], "dem_id long, gt0 double, gt1 double, gt3 double, gt5 double, width long, height long")
    return spark.createDataFrame(rows, "dem_id long, row long, col long, height double"), meta


def test_blocks_hold_quads_with_gaps_and_repeats(spark):
    dem, _ = dem_of(spark, 37, lambda r, c: None if (r * 7 + c) % 11 == 0 else float(100 * r + c))
    dem = dem.where("(row * 3 + col) % 13 <> 0").union(dem.where("row = 5 AND col = 5").withColumn("height", F.lit(-3.0)))
    want = {}
    for r in dem.collect():
        old = want.get((r.row, r.col))
        want[r.row, r.col] = r.height if old is None else old if r.height is None else max(old, r.height)
    for n in (4, 16):
        made = terrain.raster(dem, n)
        for b in made.blocks.collect():
            for i in range(n + 1):
                for j in range(n + 1):
                    at = i * (n + 1) + j
                    assert (b.cells[at] if at < len(b.cells) else None) == want.get((b.brow * n + i, b.bcol * n + j))


@pytest.mark.parametrize("hills", [True, False])
def test_rays_look_up_few_samples(spark, hills):
    """The same answer as from all samples, from less than half of them."""
    shape = (lambda r, c: 60.0 if 30 <= r % 80 < 36 else 5.0 + (r * 7 + c * 3) % 5) if hills else (lambda r, c: float((r * 7919 + c * 104729) % 601) / 10)
    dem, meta = dem_of(spark, 120, shape)
    r = random.Random(7)
    place = lambda: (114.0 + r.uniform(0, 0.012), 22.3 - r.uniform(0, 0.012), r.uniform(20, 70))
    rays = spark.createDataFrame([(i, 0, *place(), *place()) for i in range(120)], "rid long, dem_id long, e_lon double, e_lat double, e_alt double, t_lon double, t_lat double, t_alt double")
    whole = visibility.dem_profile(rays, dem, meta).selectExpr("rid", "n", "first_below").collect()
    first, rest = visibility.dem_rounds(rays, dem, meta)
    looked = first.count() + rest.count()
    assert looked < sum(x.n - 1 for x in whole) / 2
    blocked = {x.rid for x in whole if x.first_below >= 0}
    assert {x.rid for x in visibility.dem_visible(rays, dem, meta).collect() if not x.visible} == blocked
    assert 0 < len(blocked) < 120


ROWS = "id long, timestamp double, code long, density double"


def test_a_job_that_fails_and_is_run_again_doubles_nothing(spark):
    path = folder(spark, "again")
    rows = spark.range(2000).selectExpr("id % 7 AS id", "CAST(id % 3 AS DOUBLE) AS timestamp", "id AS code", "1e0 AS density")
    io.append_coverage(rows.where("code < 500"), path, "first")
    broken = rows.withColumn("density", F.expr("CASE WHEN code = 1999 THEN raise_error('lost') ELSE density END"))
    with pytest.raises(Exception, match="lost"):
        io.append_coverage(broken, path, "second")
    assert io.read_coverage(spark, path).count() == 500
    for _ in range(2):
        io.append_coverage(rows.where("code >= 500"), path, "second")
        got = io.read_coverage(spark, path)
        assert got.count() == 2000 and got.select("code").distinct().count() == 2000
    with pytest.raises(Exception, match="lost"):  # a failed repeat takes the job away, not the others
        io.append_coverage(broken, path, "second")
    assert io.read_coverage(spark, path).count() == 500


def test_stored_coverage_has_no_files_for_each_emitter(spark):
    path = folder(spark, "files")
    rows = spark.range(3000).selectExpr("id % 600 AS id", "0e0 AS timestamp", "id AS code", "1e0 AS density")
    io.append_coverage(rows, path, "all")
    got = io.read_coverage(spark, path)
    assert got.count() == 3000 and got.where("id = 7").count() == 5
    assert len(got.inputFiles()) < 100


def test_roll_up_of_roll_ups(spark):
    rows = [(r, random.Random(r).choice([None, 0.5 * r])) for r in range(4000)]
    df = spark.createDataFrame(rows, "code long, density double")
    got = {(r.up, r.code): (r.n, r.most, r.mean) for r in cells.roll_up(df, [4, 1, 2]).collect()}
    for up in (1, 2, 4):
        groups = {}
        for code, v in rows:
            groups.setdefault(code >> 3 * up, []).append(v)
        for code, values in groups.items():
            known = [v for v in values if v is not None]
            n, most, mean = got[up, code]
            assert n == len(values) and most == (max(known) if known else None) and (mean == pytest.approx(sum(known) / len(known)) if known else mean is None)
    assert len(got) == sum(len({c >> 3 * up for c, _ in rows}) for up in (1, 2, 4))
    assert cells.roll_up(df.limit(0), [1, 2]).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_key_ranges_hold_all_cells_of_a_box(spark, seed):
    r = random.Random(seed)
    level = r.choice([6, 12, 16, 21])
    low = lambda a, b: sorted((r.uniform(a, b), r.uniform(a, b)))
    box = (*low(-30, 30), *low(-20, 20), *low(0, 40000))
    places = [(i, r.uniform(-31, 31), r.uniform(-21, 21), r.uniform(0, 45000), level) for i in range(1500)]
    rows = stored(cells.encode(spark.createDataFrame(places, "pid long, lon double, lat double, alt double, level long")), "codes")
    found = {x.pid for x in cells.scan_box(rows, *box, level=level).collect()}
    inside = {i for i, x, y, z, _ in places if box[0] <= x <= box[1] and box[2] <= y <= box[3] and box[4] <= z <= box[5]}
    assert inside <= found
    # what is found beside them lies in the cells on the box's sides
    by_axes = apply(rows, compact_layers()).collect()
    limits = cells.box_limits(*box, level)
    assert found == {x.pid for x in by_axes if any(all(lo <= x[k] <= hi for k, (lo, hi) in zip(("k_lon", "k_lat", "k_alt"), b)) for b in limits)}
    assert all(len(cells.key_ranges(b, level, 40)) <= 40 for b in limits)


def _rows_of_scans(df):
    """Rows that the scans of an executed plan gave."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains("numOutputRows"):
            total += metrics.apply("numOutputRows").value()
    return total


def test_a_box_reads_few_rows(spark):
    """Row groups are skipped by the ranges of keys that cover the box."""
    places = spark.range(200_000).selectExpr("id % 2 AS id", "0e0 AS timestamp", "CAST(id % 447 AS DOUBLE) / 10 AS lon", "CAST(id DIV 447 AS DOUBLE) / 10 AS lat", "CAST(id % 97 AS DOUBLE) * 100 AS alt", "16L AS level")
    path = folder(spark, "box")
    spark.conf.set("parquet.block.size", str(64 << 10))
    spark.conf.set("parquet.page.size", str(8 << 10))
    try:
        io.append_coverage(cells.encode(places).drop("level"), path, "all")
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.unset("parquet.page.size")
    rows = io.read_coverage(spark, path)
    found = cells.scan_box(rows, 10.0, 12.0, 10.0, 12.0, 0.0, 3000.0, level=16).select("code", "lon", "lat")
    n = len(found.collect())
    assert n > 0 and _rows_of_scans(found) < rows.count() / 4


def test_kept_poses_follow_late_events_and_a_restart(spark):
    """The last pose that each emitter's stream gave is that of a table of all events; events that change nothing give none."""
    r = random.Random(12)
    rows = [(r.randrange(6), i, r.randrange(40), r.choice(["move", "turn"]), *(float(r.randrange(50)) for _ in range(5))) for i in range(150)]
    rows += [(99, 1000, 5, "turn", *[1.0] * 5), (7, 1001, 5, "move", *[2.0] * 5)]  # never moved; never turned
    r.shuffle(rows)
    events = spark.createDataFrame(rows, "emitter_id long, event_id long, s long, kind string, lon double, lat double, alt double, phi double, theta double").selectExpr("emitter_id", "event_id", "timestamp_seconds(s) AS ts", "kind", "lon", "lat", "alt", "phi", "theta")
    held, out, progress = (folder(spark, x) for x in ("events", "poses", "progress"))
    given = []

    def run(part):
        part.write.mode("append").parquet(held)
        stream = spark.readStream.schema(events.schema).parquet(held)
        kept.score_changed(stream, lambda poses: poses.selectExpr("emitter_id AS eid", "*"), out, progress).awaitTermination()
        given.append(spark.read.parquet(out).count())

    run(events.where("event_id % 3 = 0 OR event_id > 900"))
    run(events.where("event_id % 3 <> 0 AND event_id < 900"))  # another query, which takes up the state where the first left it
    poses = {x[0]: tuple(x) for x in kept.standing(spark.read.parquet(out)).drop("eid").collect()}
    want = {x[0]: tuple(x) for x in kept.latest(events).collect()}
    assert poses == want and set(want) == {0, 1, 2, 3, 4, 5, 7}
    ordered = sorted((x for x in rows if x[0] == 0), key=lambda x: (x[2], x[1]))
    move, turn = ([x for x in ordered if x[3] == k][-1] for k in ("move", "turn"))
    assert want[0] == (0, *move[4:7], move[7] + turn[7], move[8] + turn[8])
    run(events.where("event_id = 1001").withColumn("ts", F.expr("ts - INTERVAL 1 SECOND")))
    assert given[2] == given[1]


def test_pose_lines_from_files_and_as_a_stream(spark):
    lines = [f"114:{i % 60}:{i % 59},22:{i % 58}:1,{i},{i % 61 - 30},{i % 360 - 180}" if i % 7 else f"114:{i};22" for i in range(100)]
    path, out = folder(spark, "lines"), folder(spark, "parsed")
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(3).write.text(path)
    parsed = io.read_pose_lines(spark, path)
    stream = io.stream_pose_lines(spark, path).writeStream.format("parquet").option("checkpointLocation", folder(spark, "progress")).trigger(availableNow=True).start(out)
    stream.awaitTermination()
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(parsed) == plain(spark.read.parquet(out)) and parsed.where("ok").count() == 85
    good, bad = io.quarantined(parsed)
    assert good.count() == 85 and bad.count() == 15


def test_grids_beyond_a_bound_are_left_out(spark):
    stations = view(spark, SF, "stations").where("level < 16")
    sizes = {x.sid: x["count"] for x in grid.cell_grid(stations).groupBy("sid").count().collect()}
    most = sorted(sizes.values())[len(sizes) // 2]
    left = {x.sid: x["count"] for x in grid.cell_grid(stations, most).groupBy("sid").count().collect()}
    assert left == {k: n for k, n in sizes.items() if n <= most} and 0 < len(left) < len(sizes)
    reach = {x.sid: x.n_cells for x in grid.reaching(stations).collect()}
    assert all(reach[k] == n for k, n in sizes.items())


def test_no_cell_lies_beyond_its_stations_reach(spark):
    for name in ("stations", "coarse_stations", "sites"):
        limits = grid.reaching(view(spark, "/root/testdata/sf0.01", name))
        cells_ = grid.cell_grid(limits)
        assert cells_.where("abs(c_lon - lon) > lon_reach OR abs(c_lat - lat) > lat_reach").count() == 0
        assert cells_.count() > 0


def test_rays_settled_at_home_and_rays_followed_give_what_all_pairs_give(scene):
    mesh, emitters, rays, hidden = scene
    own = visibility.housed(visibility.binned(emitters, mesh, "40", 2.0), 3)
    placed = dealt(rays.join(own.select("eid", "sectors", "home_k", *visibility.PLACE), "eid"), *visibility.PLACE)
    assert {(r.eid, r.tid) for r in visibility.hidden(placed, mesh, own).collect()} == hidden
    assert {(r.eid, r.tid) for r in visibility.flagged(placed, mesh, own).where("NOT visible").collect()} == hidden
    assert {(r.eid, r.tid) for r in visibility.traced(rays, mesh, ["eid", "tid"]).collect()} == hidden


@pytest.mark.parametrize("name", ["los1_mesh", "cov5_density", "cov6_hidden_cells", "cov8_heights"])
def test_rays_are_not_shuffled_to_their_sectors(spark, name):
    """Rays grow with the product of emitters and targets, or with grids; they are settled where they are made."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan and not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "sector" in x]


@pytest.mark.parametrize("projections", [False, True])
def test_segments_meet_the_boxes_that_all_pairs_show(spark, projections):
    r = random.Random(5)
    mesh = spark.createDataFrame(triangles(5, 300, 25.0), CORNERS)
    places = [(k, r.uniform(-150, 150), r.uniform(-150, 150), r.uniform(-5, 25)) for k in range(150)]
    targets = spark.createDataFrame([*places, (900, 3.0, 4.0, None), (901, 0.0, 0.0, 5.0)], "tid long, tx double, ty double, tz double")
    emitters = spark.createDataFrame([(k, x, y, z, 60.0) for k, x, y, z in places[:25]] + [(990, 0.0, 0.0, 5.0, 60.0), (991, 1000.0, 0.0, 5.0, 60.0)], EMITTERS)
    pairs = emitters.crossJoin(targets).where("(tx - ex) * (tx - ex) + (ty - ey) * (ty - ey) <= reach * reach")
    met = BOXES + (f" AND {CROSSES}" if projections else "")
    wanted = pairs.join(terrain.with_mbr(mesh), F.expr(met), "left").groupBy("eid", "tid").agg(F.count("lox").alias("hits"))
    got = boxes.segment_counts(emitters, targets, mesh, 60.0, projections)
    assert sorted(got.collect()) == sorted(wanted.collect()) and got.where("hits > 3").count() > 0


@pytest.mark.parametrize("name", ["los6_boxes", "los6_segment_boxes"])
def test_segments_are_counted_where_they_are_made(spark, name):
    """Segments are as many as emitters times targets; neither they nor their boxes are shuffled or grouped."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange" in x and ("bid" in x or "tid" in x)] and "FlatMapGroupsInArrow" in plan


@pytest.mark.parametrize("name", ["cov8_heights", "cov6_volume", "cell3_roll_up"])
def test_generated_joins_are_short_enough_to_be_compiled(spark, name):
    """HotSpot leaves methods over 8,000 bytes to its interpreter, and Spark drops code over 64 KB."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = queries._coverage_rows(spark, SF) if name == "cell3_roll_up" else queries.QUERIES[name](spark, SF)
        said = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(rows._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = {}
    for part in said.split("== Subtree ")[1:]:
        tree = part.split("Generated code:")[0].splitlines()[1:3]
        sizes[" ".join(tree)] = int(re.search(r"maxMethodCodeSize:(-?\d+)", part).group(1))
    assert min(sizes.values()) > 0
    assert max(n for tree, n in sizes.items() if "ShuffledHashJoin" in tree) < 8000
