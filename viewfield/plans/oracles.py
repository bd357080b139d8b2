"""The registered queries as plain SQL over the given tables.

Joins are stated as they are meant, pair by pair; only scalar formulas are shared with the queries.
"""

from __future__ import annotations

from ..functions.formulas import ATTENUATION, BOXES, CELL_EARTH, CLEARANCE_SQL, CROSSES, DECIBEL, DENSITY, FROM_DEGREES, FROM_METRES, HEIGHT, KEY, MBR, MEETS, PATTERNS, SECTOR, SNAPSHOT, TURNED, decode_layers, distance, encode_layers, nested, pattern
from ..operators.grid import BOX, COUNTS, PLACES
from ..operators.summary import AGREEMENT, GREY, NORMAL, PALETTE
from ..operators.terrain import CORNERS, RASTER
from ..operators.visibility import SAMPLES, STEPS
from ..sources.fixtures import text
from .queries import BOX as BOX_
from .queries import HEIGHTS, KEPT_EMITTERS, LAT0, LON0, POSE_EMITTERS, POSE_HEIGHT, REACH, RESOLUTIONS, SCALE, STEP

ORACLES: dict[str, str] = {}


def _r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def v(name: str) -> str:
    return f"({text(name)})"


MESH = f"({nested(text('mesh'), MBR)})"
CORNER_COLUMNS = ", ".join(f"{p}{i}" for p in "amc" for i in "xyz")
BOX_COLUMNS = ", ".join(f"{f}{i}" for i in "xyz" for f in ("lo", "hi"))
PAIRS = f"SELECT e.*, t.* FROM {v('emitters')} e JOIN {v('targets')} t ON (tx - ex) * (tx - ex) + (ty - ey) * (ty - ey) <= reach * reach"
MODELLED = f"SELECT e.*, m.* EXCLUDE (model) FROM {v('emitters')} e JOIN {v('models')} m ON e.model = m.model"
HIDDEN = f"EXISTS (SELECT 1 FROM mesh_ m WHERE {BOXES} AND {MEETS})"
WITH_MESH = f"WITH mesh_ AS MATERIALIZED (SELECT * FROM {MESH} q) "


def _models(rows: str) -> str:
    return f"SELECT p.*, m.* EXCLUDE (model) FROM ({rows}) p JOIN {v('models')} m ON p.model = m.model"


def _score(rows: str, degrees: bool = False, snapshot: bool = False) -> str:
    inner = nested(rows, (FROM_DEGREES if degrees else FROM_METRES) + TURNED + (SNAPSHOT if snapshot else SECTOR))
    banded = f"SELECT s.*, b.* FROM ({inner}) s LEFT JOIN {v('bands')} b ON f = band_f AND dphi >= band_from AND dphi < band_to"
    return nested(banded, PATTERNS + DENSITY)


ANGLES = nested(_models(PAIRS), FROM_METRES + TURNED)
VISIBLE = f"SELECT * FROM ({PAIRS}) r WHERE NOT {HIDDEN}"

ORACLES["src1_mesh"] = f"SELECT tri_id, {CORNER_COLUMNS}, {BOX_COLUMNS} FROM {MESH} q"
ORACLES["src2_dem"] = f"SELECT d.dem_id, d.row, d.col, coalesce(d.height, -9999e0) AS height, round(gt0 + (col + 0.5e0) * gt1, 9) AS lon, round(gt3 + (d.row + 0.5e0) * gt5, 9) AS lat FROM {v('dem')} d JOIN {v('dem_meta')} m ON d.dem_id = m.dem_id"
ORACLES["src3_catalog"] = f"SELECT eid, name, kind, n, d, f, g, pt, theta_lo, theta_hi, phi_lo, phi_hi, model_range FROM ({MODELLED}) q"
_part = lambda i: f"string_split(value, ',')[{i + 1}]"
_dms = lambda i: " + ".join(f"TRY_CAST(string_split({_part(i)}, ':')[{k + 1}] AS DOUBLE) / {d}" for k, d in enumerate((1, 60, 3600)))
_parsed = f"SELECT *, {_dms(0)} AS lon_, {_dms(1)} AS lat_, " + ", ".join(f"TRY_CAST({_part(i)} AS DOUBLE) AS {n}_" for i, n in ((2, "alt"), (3, "phi"), (4, "theta"))) + f" FROM {v('pose_lines')} q"
ORACLES["src4_pose_lines"] = f"""SELECT line_id, CASE WHEN ok THEN round(lon_, 9) END AS lon, CASE WHEN ok THEN round(lat_, 9) END AS lat, CASE WHEN ok THEN alt_ END AS alt, CASE WHEN ok THEN phi_ END AS phi, CASE WHEN ok THEN theta_ END AS theta, ok
FROM (SELECT *, len(string_split(value, ',')) = 5 AND coalesce(lon_ + lat_ + alt_ + phi_ + theta_, NULL) IS NOT NULL AS ok FROM ({_parsed}) p) q"""
ORACLES["src5_position_csv"] = f"SELECT pid AS id, lon, lat, alt, level FROM {v('positions')} q"
ORACLES["snk5_replaced_table"] = text("targets")
ORACLES["snk4_printed_rows"] = f"SELECT printf('[%s],%.6f,%.6f,%.3f %.3f', strftime(ts, '%Y-%m-%d %H:%M:%S'), lon, lat, alt, theta) AS line FROM {v('poses')} q"

_cells = f"""SELECT *, i * n_side + j AS idx, ex - reach + j * {STEP}e0 AS x, ey - reach + i * {STEP}e0 AS y
FROM (SELECT *, unnest(range(n_side)) AS j FROM (SELECT *, unnest(range(n_side)) AS i FROM (SELECT *, CAST(ceil(2 * reach / {STEP}e0) AS BIGINT) AS n_side FROM %s) a) b) c"""
ORACLES["grid1_ground"] = f"SELECT eid, idx, {_r('x', 'y')} FROM ({_cells % v('emitters')}) q"
_boxes = f"SELECT sid, lon - 0.0011e0 AS lon_lo, lon + 0.0011e0 AS lon_hi, lat - 0.0007e0 AS lat_lo, lat + 0.0007e0 AS lat_hi, 15e0 AS metres FROM {v('stations')} q"
ORACLES["grid2_box"] = f"""SELECT sid, i, j, round(lon_lo + j * lon_step, 9) AS lon, round(lat_lo + i * lat_step, 9) AS lat
FROM (SELECT *, unnest(range(n_lon)) AS j FROM (SELECT *, unnest(range(n_lat)) AS i FROM ({nested(_boxes, BOX)}) a) b) c"""


def _grid(stations: str) -> str:
    counted = nested(stations, COUNTS)
    spread = f"SELECT *, unnest(range(n_lon)) AS z FROM (SELECT *, unnest(range(n_lat)) AS j FROM (SELECT *, unnest(range(n_alt)) AS i FROM ({counted}) a) b) c"
    return nested(spread, PLACES)


for _name, _low, _high in (("grid3_degrees", 0, 9), ("grid4_minutes", 10, 15), ("grid5_seconds", 16, 21), ("grid6_parts_of_seconds", 22, 30), ("grid7_all_levels", 0, 30)):
    ORACLES[_name] = f"SELECT sid, level, i, j, z, {_r('c_lon', 'c_lat', digits=9)}, {_r('c_alt', digits=4)} FROM ({_grid(f'SELECT * FROM {v("stations")} s WHERE level BETWEEN {_low} AND {_high}')}) q"

ORACLES["grid3_coarse"] = f"SELECT sid, level, i, j, z, {_r('c_lon', 'c_lat', digits=9)}, {_r('c_alt', digits=4)} FROM ({_grid(text('coarse_stations'))}) q"


def _encoded(rows: str) -> str:
    # one statement a layer; a layer that changes a column stands for the old one
    for layers in encode_layers():
        first = True
        for layer in layers:
            (name, e), = layer
            rows = f"SELECT *, {e} AS {name} FROM ({rows}) q" if first else f"SELECT * REPLACE ({e} AS {name}) FROM ({rows}) q"
            first = False
    return f"SELECT * EXCLUDE (k_lon, k_lat, k_alt), {KEY} AS code FROM ({rows}) q"


def _decoded(rows: str) -> str:
    for i, layer in enumerate(decode_layers()):
        new = ", ".join(f"{e} AS {n}" for n, e in layer)
        rows = f"SELECT *, {new} FROM ({rows}) q" if layer[0][0].startswith("c_") or i == 0 else f"SELECT * REPLACE ({new}) FROM ({rows}) q"
    return rows


ENCODED, DECODED = _encoded(text("positions")), _decoded(_encoded(text("positions")))
ORACLES["cell1_encode"] = f"SELECT pid, level, code FROM ({ENCODED}) q"
ORACLES["cell2_decode"] = f"SELECT pid, level, {_r('c_lon', 'c_lat', digits=9)}, {_r('c_alt', digits=4)} FROM ({DECODED}) q"
ORACLES["src5_code_csv"] = f"SELECT pid AS id, code, {_r('c_lon', 'c_lat', digits=9)}, {_r('c_alt', digits=4)} FROM ({DECODED}) q"
ORACLES["cell5_round_trip"] = f"SELECT level, count(*) AS n, round(max(abs(lon - c_lon)), 7) AS lon_error, round(max(abs(lat - c_lat)), 7) AS lat_error, round(max(abs(alt - c_alt)), 3) AS alt_error FROM ({DECODED}) q GROUP BY level"

_placed = lambda name: f"SELECT sid AS eid, sid % 8 AS model, *, lon AS e_lon, lat AS e_lat, alt AS e_alt, CAST(sid * 37 % 360 - 180 AS DOUBLE) + 0.10041e0 AS e_theta, CAST(sid * 11 % 21 - 10 AS DOUBLE) + 0.10037e0 AS e_phi FROM {v(name)} q"
_stations = _placed("stations")
VOLUME = _score(f"SELECT *, c_lon AS t_lon, c_lat AS t_lat, c_alt AS t_alt FROM ({_grid(_models(_stations))}) q", degrees=True)
COVERAGE = _encoded(f"SELECT eid AS id, c_lon AS lon, c_lat AS lat, greatest(c_alt, 0e0) AS alt, density, CAST(i AS DOUBLE) AS timestamp, 16 AS level FROM ({VOLUME}) q")
ORACLES["cov6_volume"] = f"SELECT eid, i, j, z, {DECIBEL} AS db FROM ({VOLUME}) q"
_frame = lambda p, lon, lat, alt: f"({lon} - {LON0}e0) * {SCALE}e0 AS {p}x, ({lat} - {LAT0}e0) * {SCALE}e0 AS {p}y, {alt} AS {p}z"
_site_rays = f"SELECT *, c_lon AS t_lon, c_lat AS t_lat, c_alt AS t_alt, {_frame('e', 'e_lon', 'e_lat', 'e_alt')}, {_frame('t', 'c_lon', 'c_lat', 'c_alt')} FROM ({_grid(_models(_placed('sites')))}) q"
ORACLES["cov6_hidden_cells"] = WITH_MESH + f", rays_ AS MATERIALIZED ({_site_rays}), seen_ AS MATERIALIZED (SELECT *, NOT {HIDDEN} AS visible FROM rays_ r) SELECT eid, i, j, z, visible, CASE WHEN visible THEN {DECIBEL} END AS db FROM ({_score('SELECT * FROM seen_', degrees=True)}) q"
ORACLES["snk1_coverage_rows"] = f"SELECT id, code, round(lon, 6) AS lon, round(lat, 6) AS lat, round(alt, 3) AS alt, {DECIBEL} AS db, timestamp FROM ({COVERAGE}) q"
ORACLES["cell3_roll_up"] = f"""SELECT up, code, n, CASE WHEN most > 0 THEN round(10 * log10(most), 2) END AS most_db, CASE WHEN mean > 0 THEN round(10 * log10(mean), 2) END AS mean_db
FROM (SELECT up, c.code >> (3 * up) AS code, count(*) AS n, max(density) AS most, avg(density) AS mean FROM ({COVERAGE}) c, (VALUES (1), (2), (4)) u(up) GROUP BY 1, 2) q"""
ORACLES["cell4_scan"] = f"""WITH c AS MATERIALIZED ({COVERAGE}), b AS (SELECT id AS b_id, count(*) AS n, min(code) AS low, max(code) AS high FROM c GROUP BY id ORDER BY n DESC, id LIMIT 1)
SELECT id, code, timestamp FROM c, b WHERE id = b_id AND timestamp >= 1 AND code BETWEEN low AND (low + 3 * high) // 4"""

_keys = _decoded(f"SELECT * EXCLUDE (k_lon, k_lat, k_alt) FROM (SELECT *, 0 AS k_lon, 0 AS k_lat, 0 AS k_alt FROM ({COVERAGE}) c) d")
_edge = lambda x: f"CAST(floor({x}) AS BIGINT) * 4096 + CAST(floor(({x} - floor({x})) * 60) AS BIGINT) * 64 + CAST(floor((({x} - floor({x})) * 60 - floor(({x} - floor({x})) * 60)) * 60) AS BIGINT)"
_inside = lambda k, lo, hi: f"{k} >> 5 BETWEEN ({_edge(lo)}) >> 5 AND ({_edge(hi)}) >> 5"
_high = lambda z: f"(({z}e0 + {CELL_EARTH}e0) / (50000 + {CELL_EARTH}e0) * 512)"
ORACLES["cell4_box"] = f"SELECT code, count(*) AS n, round(min(lon), 6) AS lon_lo, round(max(lat), 6) AS lat_hi FROM ({_keys}) q WHERE {_inside('k_lon', f'{BOX_[0]}e0', f'{BOX_[1]}e0')} AND {_inside('k_lat', f'{BOX_[2]}e0', f'{BOX_[3]}e0')} AND {_inside('k_alt', _high(BOX_[4]), _high(BOX_[5]))} GROUP BY code"

_ground = lambda points, key: f"(SELECT p.{key} AS key_, max({HEIGHT}) AS ground FROM ({points}) p JOIN mesh_ m ON x BETWEEN lox AND hix AND y BETWEEN loy AND hiy GROUP BY 1)"
ORACLES["ter1_heights"] = WITH_MESH + f"SELECT tid AS pid, round(ground, 6) AS ground FROM {v('targets')} t LEFT JOIN {_ground(f'SELECT tid, tx AS x, ty AS y FROM {v("targets")} q', 'tid')} g ON tid = key_"
ORACLES["ter2_overlaps"] = WITH_MESH + f"SELECT tid AS bid, (SELECT count(*) FROM mesh_ WHERE " + " AND ".join(f"lo{i} <= t{i} + 15 AND hi{i} >= t{i} - 15" for i in "xyz") + f") AS hits FROM {v('targets')} t"
_limits = f"SELECT {LON0}e0 + min(lox) / {SCALE}e0 AS lon_lo, {LON0}e0 + max(hix) / {SCALE}e0 AS lon_hi, {LAT0}e0 + min(loy) / {SCALE}e0 AS lat_lo, {LAT0}e0 + max(hiy) / {SCALE}e0 AS lat_hi FROM {MESH} q"
_presets = "(VALUES " + ", ".join(f"({i}, {m}e0)" for i, m in enumerate(RESOLUTIONS)) + ") r(dem_id, metres)"
_sizes = nested(f"SELECT r.*, l.* FROM {_presets}, ({_limits}) l", RASTER)
_pixels = f"""SELECT *, (lon - {LON0}e0) * {SCALE}e0 AS x, (lat - {LAT0}e0) * {SCALE}e0 AS y FROM (SELECT dem_id, prow, pcol, lon_lo + (pcol + 0.5e0) * res AS lon, lat_hi - (prow + 0.5e0) * res AS lat
FROM (SELECT *, unnest(range(width)) AS pcol FROM (SELECT *, unnest(range(rows_n)) AS prow FROM ({_sizes}) a) b) c) d"""
_dems = f"SELECT p.dem_id, prow, pcol, lon, lat, max(CASE WHEN x BETWEEN lox AND hix AND y BETWEEN loy AND hiy THEN {HEIGHT} END) AS height FROM ({_pixels}) p LEFT JOIN mesh_ m ON x BETWEEN lox AND hix AND y BETWEEN loy AND hiy GROUP BY ALL"
for _name, _ids in (("ter3_rasterise", "(0)"), ("ter4_resolutions", "(0, 1, 2)")):
    ORACLES[_name] = WITH_MESH + f"SELECT dem_id, prow AS \"row\", pcol AS col, {_r('lon', 'lat', digits=9)}, round(coalesce(height, -9999e0), 6) AS height FROM ({_dems}) q WHERE dem_id IN {_ids}"


def _sampled(points: str, dem: str, meta: str, keys: str) -> str:
    """Elevation at points (keys, dem_id, lon, lat) by four look-ups."""
    placed = nested(f"SELECT p.*, m.* EXCLUDE (dem_id) FROM ({points}) p JOIN ({meta}) m ON p.dem_id = m.dem_id", CORNERS)
    joins = " ".join(f"LEFT JOIN dem_ h{i}{j} ON h{i}{j}.dem_id = c.dem_id AND h{i}{j}.pcol = col0 + {i} AND h{i}{j}.prow = row0 + {j}" for i in (0, 1) for j in (0, 1))
    four = "[h00.height, h10.height, h01.height, h11.height]"
    u, w = "(fcol - col0)", "(frow - row0)"
    bilinear = f"h00.height * (1 - {u}) * (1 - {w}) + h10.height * {u} * (1 - {w}) + h01.height * (1 - {u}) * {w} + h11.height * {u} * {w}"
    return f"""SELECT {keys}, CASE WHEN near_edge THEN nn.height WHEN {bilinear} IS NOT NULL THEN {bilinear} ELSE list_avg({four}) END AS terrain
FROM ({placed}) c {joins} LEFT JOIN dem_ nn ON nn.dem_id = c.dem_id AND nn.pcol = ncol AND nn.prow = nrow"""


WITH_DEM = f"WITH dem_ AS MATERIALIZED (SELECT dem_id, row AS prow, col AS pcol, height FROM {v('dem')} q) "
ORACLES["ter5_bilinear"] = WITH_DEM + f"SELECT pid, round(terrain, 6) AS height FROM ({_sampled(f'SELECT pid, 0 AS dem_id, lon, lat FROM {v("points")} q', '', text('dem_meta'), 'pid')}) q"
ORACLES["ter6_pixels"] = WITH_DEM + f"SELECT pid, pid % 170 AS \"row\", pid * 7 % 110 AS col, coalesce(height, -9999e0) AS height FROM {v('points')} p LEFT JOIN dem_ ON prow = pid % 170 AND pcol = pid * 7 % 110"
_extent = f"SELECT gt0 AS lon_lo, gt0 + width * gt1 AS lon_hi, gt3 + height * gt5 AS lat_lo, gt3 AS lat_hi FROM {v('dem_meta')} q"
ORACLES["ter7_bounds"] = f"SELECT pid, {_r('lon_lo', 'lon_hi', 'lat_lo', 'lat_hi')} FROM {v('points')} p, ({_extent}) x WHERE lon BETWEEN lon_lo AND lon_hi AND lat BETWEEN lat_lo AND lat_hi"

ORACLES["los1_mesh"] = WITH_MESH + f"SELECT eid, tid FROM ({PAIRS}) r WHERE {HIDDEN}"
_two = f"SELECT tid AS rid, tx AS px, ty AS py, 5e0 AS ph, tx + (tid * 37 % 161) - 80.03e0 AS qx, ty + (tid * 53 % 141) - 70.07e0 AS qy, 2e0 AS qh FROM {v('targets')} q"
_end = lambda s: f"LEFT JOIN {_ground(f'SELECT rid, {s}x AS x, {s}y AS y FROM two', 'rid')} g{s} ON g{s}.key_ = rid"
_z = lambda s: f"CASE WHEN g{s}.ground IS NULL THEN 0e0 ELSE floor(g{s}.ground + 0.1e0) END + {s}h"
ORACLES["los2_pairs"] = WITH_MESH + f", two AS ({_two}), r AS MATERIALIZED (SELECT rid, px AS ex, py AS ey, {_z('p')} AS ez, qx AS tx, qy AS ty, {_z('q')} AS tz FROM two {_end('p')} {_end('q')}) SELECT rid, {_r('ez', 'tz')}, NOT {HIDDEN} AS visible FROM r"

_steps = nested(f"SELECT r.*, 0 AS dem_id, gt1 FROM {v('rays')} r, {v('dem_meta')} m", STEPS)


def _over(steps: str, meta: str, first: str, last: str) -> str:
    points = nested(f"SELECT *, unnest(range({first}, {last})) AS i FROM ({steps}) s WHERE NOT same", SAMPLES)
    return f"SELECT *, coalesce(ray_h < terrain - {CLEARANCE_SQL}, FALSE) AS below FROM ({_sampled(f'SELECT rid, dem_id, n, dist_m, i, lon, lat, ray_h FROM ({points}) p', '', meta, 'rid, c.dem_id, n, dist_m, i, ray_h')}) q"


ORACLES["los4_dem"] = WITH_DEM + f"SELECT rid, NOT coalesce(blocked, FALSE) AS visible FROM {v('rays')} r LEFT JOIN (SELECT rid AS k, bool_or(below) AS blocked FROM ({_over(_steps, text('dem_meta'), '1', 'n')}) q GROUP BY rid) b ON rid = k"
ORACLES["los5_dem_profile"] = WITH_DEM + f"""SELECT rid, n, round(dist_m, 4) AS dist_m, coalesce(min(i) FILTER (WHERE below AND i BETWEEN 1 AND n - 1), -1) AS first_below, count(*) AS n_samples, count(*) FILTER (WHERE below) AS n_below
FROM ({_over(_steps, text('dem_meta'), '0', 'n + 1')}) q GROUP BY rid, n, dist_m"""
ORACLES["los6_boxes"] = WITH_MESH + f"SELECT eid, tid, count(lox) AS hits FROM ({PAIRS}) r LEFT JOIN mesh_ m ON {BOXES} GROUP BY eid, tid"
ORACLES["los6_segment_boxes"] = WITH_MESH + f"SELECT eid, tid, count(lox) AS hits FROM ({PAIRS}) r LEFT JOIN mesh_ m ON {BOXES} AND {CROSSES} GROUP BY eid, tid"

ORACLES["cov1_patterns"] = f"""SELECT model, axis, degree, round(sum(abs(e)), 3) AS total, count(e) AS n FROM (
SELECT model, axis, CAST(floor(key / 1000) AS BIGINT) AS degree, CASE WHEN axis = 'theta' THEN {pattern('theta', 'key')} ELSE {pattern('phi', 'key')} END AS e
FROM (SELECT m.*, a.axis, k.range AS key FROM {v('models')} m, (VALUES ('theta'), ('phi')) a(axis), range(360000) k WHERE model IN (SELECT model FROM {v('emitters')} e)) q) p GROUP BY 1, 2, 3"""
ORACLES["cov2_attenuation"] = f"SELECT eid, tid, round({ATTENUATION}, 6) AS db_km FROM ({nested(ANGLES, SECTOR)}) s LEFT JOIN {v('bands')} b ON f = band_f AND dphi >= band_from AND dphi < band_to"
ORACLES["cov3_frame"] = f"SELECT eid, tid, {_r('theta', 'phi', 'r')} FROM ({ANGLES}) q"
ORACLES["cov4_sector"] = f"SELECT eid, tid, {_r('dtheta', 'dphi')}, outside FROM ({nested(ANGLES, SECTOR)}) q"
ORACLES["cov5_density"] = WITH_MESH + f"SELECT eid, tid, {DECIBEL} AS db, density = 0 AS is_zero FROM ({_score(_models(VISIBLE))}) q"
ORACLES["cov5_decibels"] = WITH_MESH + f"SELECT eid, tid, CASE WHEN density > 0 THEN round(10 * log10(density), 4) END AS db FROM ({_score(_models(VISIBLE))}) q"
ORACLES["cov10_snapshot"] = WITH_MESH + f"SELECT eid, tid, {DECIBEL} AS db, outside FROM ({_score(_models(VISIBLE), snapshot=True)}) q"
_at_range = f"SELECT m.*, 0e0 AS dphi, 0e0 AS dtheta, FALSE AS outside, model_range AS r FROM {v('models')} m"
_reference = nested(f"SELECT s.*, b.* FROM ({_at_range}) s LEFT JOIN {v('bands')} b ON f = band_f AND dphi >= band_from AND dphi < band_to", PATTERNS + DENSITY)
ORACLES["cov9_detectable"] = WITH_MESH + f"SELECT eid, tid, coalesce(density / nullif(r * r, 0) >= reference, FALSE) AS detectable FROM ({_score(_models(VISIBLE))}) q JOIN (SELECT model AS k, density * 1e0 / 7.5e0 / (model_range * model_range) AS reference FROM ({_reference}) x) y ON model = k"
_north, _east = distance("e_lon", "e_lat", "e_lon", "t_lat"), distance("e_lon", "t_lat", "t_lon", "t_lat")
_turn = f"degrees(atan2(CASE WHEN t_lon < e_lon THEN -1 ELSE 1 END * {_east}, CASE WHEN t_lat < e_lat THEN -1 ELSE 1 END * {_north}))"
ORACLES["cov11_separation"] = f"SELECT rid, round({distance('e_lon', 'e_lat', 't_lon', 't_lat')}, 4) AS metres, round(CASE WHEN {_turn} < 0 THEN {_turn} + 360 ELSE {_turn} END, 4) AS bearing FROM {v('rays')} q"

_grounded = f"SELECT c.*, ground, x AS tx, y AS ty FROM cells_ c LEFT JOIN ground_ g ON g.key_ = c.pid"
WITH_CELLS = WITH_MESH + f", cells_ AS MATERIALIZED (SELECT *, concat(eid, '/', idx) AS pid FROM ({_cells % f'({MODELLED})'}) q), ground_ AS MATERIALIZED {_ground('SELECT * FROM cells_', 'pid')}"
_seen = "SELECT *, CASE WHEN tz IS NULL THEN NULL ELSE NOT hidden END AS visible FROM (SELECT *, %s AS hidden FROM rays_) q" % HIDDEN
_covered = f"SELECT * REPLACE (CASE WHEN visible IS NULL THEN NULL WHEN visible THEN density ELSE 0e0 END AS density) FROM ({_score('SELECT * FROM seen_')}) q"
GROUND = WITH_CELLS + f", rays_ AS MATERIALIZED (SELECT *, ground + 0.1e0 AS tz FROM ({_grounded}) q), seen_ AS MATERIALIZED ({_seen}), covered_ AS MATERIALIZED ({_covered}) "
_sweep = "(VALUES " + ", ".join(f"({h}e0)" for h in HEIGHTS) + ") s(height)"
SWEPT = WITH_CELLS + f", rays_ AS MATERIALIZED (SELECT *, height AS tz, coalesce(ground - height >= 50, FALSE) AS low_height FROM ({_grounded}) q, {_sweep}), seen_ AS MATERIALIZED ({_seen}), covered_ AS MATERIALIZED ({_covered}) "
ORACLES["los3_viewshed"] = GROUND + "SELECT eid, i, j, round(ground, 6) AS ground, visible FROM covered_"
ORACLES["snk3_viewshed_csv"] = GROUND + """SELECT eid, i AS "row", string_agg(CAST(coalesce(visible, FALSE) AS INT), ',' ORDER BY j) AS line, count(*) FILTER (WHERE coalesce(visible, FALSE)) AS n_visible, count(*) FILTER (WHERE NOT coalesce(visible, FALSE)) AS n_hidden FROM covered_ GROUP BY 1, 2"""
_lines = """SELECT eid, i, string_agg(CAST(coalesce(visible, FALSE) AS INT), ',' ORDER BY j) AS line FROM covered_ GROUP BY 1, 2"""
ORACLES["snk3_viewshed_files"] = GROUND + f"SELECT eid, line, count(*) AS n FROM ({_lines}) q GROUP BY 1, 2"
ORACLES["cov7_ground"] = GROUND + f"SELECT eid, idx, visible, {DECIBEL} AS db FROM covered_"
ORACLES["cov8_heights"] = SWEPT + f"SELECT eid, height, idx, low_height, visible, {DECIBEL} AS db FROM covered_"
_totals = "SELECT eid, height, count(*) AS cells, count(*) FILTER (WHERE visible) AS visible, 100.0 * count(*) FILTER (WHERE visible) / count(*) AS percent, greatest(min(density) FILTER (WHERE density > 0), 1e-6) AS least_, max(density) FILTER (WHERE density > 0) AS most FROM covered_ GROUP BY 1, 2"
# without a positive density the least is its floor
_totals = f"SELECT * EXCLUDE (least_), coalesce(least_, 1e-6) AS least FROM ({_totals}) q"
ORACLES["agg1_totals"] = SWEPT + f"SELECT eid, height, cells, visible, round(percent, 4) AS percent, round(10 * log10(least), 2) AS least_db, round(10 * log10(most), 2) AS most_db FROM ({_totals}) q"
_level = f"SELECT c.eid, c.height, idx, {NORMAL % 0.5} AS level FROM covered_ c JOIN ({_totals}) t ON c.eid = t.eid AND c.height = t.height"
_palette = "(VALUES " + ", ".join(f"({i}, {p[0]}, {p[1]}, {p[2]}, {q[0]}, {q[1]}, {q[2]})" for i, (p, q) in enumerate(zip(PALETTE, [*PALETTE[1:], PALETTE[-1]]))) + ") p(stop_, r0, g0, b0, r1, g1, b1)"
_colour = lambda c: f"CASE WHEN level IS NULL THEN {GREY} ELSE CAST(floor({c}0 + (level * 10 - stop_) * ({c}1 - {c}0) + 1e-9) AS INT) END"
_mix = lambda c: f"{_colour(c)} // 4"
ORACLES["agg2_colours"] = SWEPT + f"SELECT eid, height, idx, level, {_colour('r')} AS red, {_colour('g')} AS green, {_colour('b')} AS blue FROM ({_level}) l LEFT JOIN {_palette} ON stop_ = least(10, floor(level * 10))"
ORACLES["agg2_intensity"] = SWEPT + f"SELECT eid, height, idx, level, {_mix('r')} AS red, {_mix('g')} AS green, {_mix('b')} AS blue FROM ({_level}) l LEFT JOIN {_palette} ON stop_ = least(10, floor(level * 10))"

_shift = lambda a, o, c: f"{o}e0 + {c} / {SCALE}e0 AS {a}"
_meta = f"SELECT dem_id, lon_lo AS gt0, res AS gt1, lat_hi AS gt3, -res AS gt5, width, rows_n AS height FROM ({_sizes}) s"
_cells_rays = f"SELECT concat(eid, '/', idx, '/', height) AS rid, m.dem_id, gt1, {_shift('e_lon', LON0, 'ex')}, {_shift('e_lat', LAT0, 'ey')}, ez AS e_alt, {_shift('t_lon', LON0, 'tx')}, {_shift('t_lat', LAT0, 'ty')}, tz AS t_alt FROM covered_ c, (SELECT dem_id, gt1 FROM meta_) m WHERE visible IS NOT NULL"
COMPARED = (
    SWEPT
    + f", dem_ AS MATERIALIZED (SELECT dem_id, prow, pcol, height FROM ({_dems}) q), meta_ AS MATERIALIZED ({_meta}), blocked_ AS MATERIALIZED (SELECT rid AS k, dem_id AS k_dem, bool_or(below) AS blocked FROM ({_over(nested(_cells_rays, STEPS), 'SELECT * FROM meta_', '1', 'n')}) q GROUP BY 1, 2)"
    + f", compared_ AS MATERIALIZED (SELECT *, {AGREEMENT} AS agreement, visible_mesh <> visible_dem AS disagreement FROM (SELECT c.* EXCLUDE (visible), visible AS visible_mesh, m.dem_id, NOT coalesce(blocked, FALSE) AS visible_dem FROM covered_ c CROSS JOIN (SELECT dem_id FROM meta_) m LEFT JOIN blocked_ ON k = concat(eid, '/', idx, '/', height) AND k_dem = m.dem_id WHERE visible IS NOT NULL) q) "
)
ORACLES["agg3_agreement"] = COMPARED + "SELECT eid, height, idx, dem_id, visible_mesh, visible_dem, agreement, disagreement FROM compared_"
ORACLES["snk2_comparison_csv"] = COMPARED + f"SELECT tz AS alt, CAST(visible_mesh AS INT) AS visible_mesh, CAST(visible_dem AS INT) AS visible_dem, CAST(disagreement AS INT) AS disagreement, count(*) AS cells, round(min({LON0}e0 + tx / {SCALE}e0), 6) AS lon_lo, round(max({LAT0}e0 + ty / {SCALE}e0), 6) AS lat_hi FROM compared_ GROUP BY 1, 2, 3, 4"
ORACLES["snk2_densities_csv"] = COMPARED + f"""SELECT round({LON0}e0 + tx / {SCALE}e0, 6) AS lon, round({LAT0}e0 + ty / {SCALE}e0, 6) AS lat, round(tz, 6) AS alt, CAST(visible_mesh AS INT) AS visible_mesh, CAST(visible_dem AS INT) AS visible_dem, CAST(disagreement AS INT) AS disagreement,
CASE WHEN density >= 1e-4 THEN round(10 * log10(density), 2) END AS db FROM compared_"""
_counts = "count(*) AS cells, count(*) FILTER (WHERE visible_mesh) AS by_mesh, count(*) FILTER (WHERE visible_dem) AS by_dem, count(*) FILTER (WHERE disagreement) AS disagreements, round(100.0 * count(*) FILTER (WHERE visible_mesh) / count(*), 4) AS percent_mesh, round(100.0 * count(*) FILTER (WHERE visible_dem) / count(*), 4) AS percent_dem, round(100.0 * count(*) FILTER (WHERE NOT disagreement) / count(*), 4) AS accuracy, round(10 * log10(min(density) FILTER (WHERE density > 0)), 2) AS least_db, round(10 * log10(max(density) FILTER (WHERE density > 0)), 2) AS most_db"
ORACLES["agg4_comparison"] = COMPARED + f"SELECT dem_id, height, {_counts} FROM compared_ GROUP BY dem_id, height"
ORACLES["agg5_cube"] = COMPARED + f"SELECT dem_id, height, {_counts} FROM compared_ GROUP BY CUBE (dem_id, height)"

_mark = [x.replace("e_lon", "lon").replace("e_lat", "lat").replace("t_lon", "114.16731e0").replace("t_lat", "22.28117e0") for x in (distance("e_lon", "e_lat", "t_lon", "t_lat"), _turn)]
ORACLES["str1_pose_requests"] = f"SELECT event_id, emitter_id, round({_mark[0]}, 4) AS metres, round(CASE WHEN {_mark[1]} < 0 THEN {_mark[1]} + 360 ELSE {_mark[1]} END, 4) AS bearing FROM {v('poses')} q"
_poses = _models(f"SELECT {', '.join(POSE_EMITTERS)} FROM {v('poses')} q")
ORACLES["str1_pose_coverage"] = (
    WITH_MESH
    + f", cells_ AS MATERIALIZED (SELECT *, concat(eid, '/', idx) AS pid FROM ({_cells % f'({_poses})'}) q), rays_ AS MATERIALIZED (SELECT *, x AS tx, y AS ty, {POSE_HEIGHT}e0 AS tz FROM cells_), seen_ AS MATERIALIZED ({_seen}), covered_ AS MATERIALIZED ({_covered}) SELECT eid AS event_id, idx, visible, {DECIBEL} AS db FROM covered_"
)
_last = lambda kind, columns: f"SELECT emitter_id AS k, {columns} FROM {v('pose_events')} q WHERE kind = '{kind}' QUALIFY row_number() OVER (PARTITION BY emitter_id ORDER BY ts DESC, event_id DESC) = 1"
_kept = f"SELECT m.k AS emitter_id, lon, lat, alt, m.phi + coalesce(t.phi, 0e0) AS phi, m.theta + coalesce(t.theta, 0e0) AS theta FROM ({_last('move', 'lon, lat, alt, phi, theta')}) m LEFT JOIN ({_last('turn', 'phi, theta')}) t ON m.k = t.k"
ORACLES["str2_kept_coverage"] = ORACLES["str1_pose_coverage"].replace(_poses, _models(f"SELECT {', '.join(KEPT_EMITTERS)} FROM ({_kept}) q")).replace("eid AS event_id", "eid")
ORACLES["str2_latest_pose"] = f"SELECT emitter_id, epoch_us(ts) AS micros, round(lon, 6) AS lon, round(lat, 6) AS lat, alt, phi, theta FROM {v('poses')} q QUALIFY row_number() OVER (PARTITION BY emitter_id ORDER BY ts DESC, event_id DESC) = 1"
