"""Domain tables derived from the given ones, as SQL that Spark runs over them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Emitter models (name, kind, n, d m, f MHz, g dB, pt kW, theta from, to, phi from, to, range m).
MODELS = [
    ("m0", "SEW", 1, 0.48, 10000, 32, 20, -30, 30, 0, 30, 46000),
    ("m1", "SEW", 1, 0.66, 10000, 35, 143, -45, 45, -20, 10, 200000),
    ("m2", "SEW", 1, 1.3, 3000, 29, 500, -180, 180, -30, 30, 445000),
    ("m3", "SEW", 1, 4.3, 1000, 28.5, 360, -180, 180, -23.5, 23.5, 463000),
    ("m4", "PHASED", 4480, 3.5, 3000, 42, 5000, -180, 180, 0, 90, 324100),
    ("m5", "PHASED", 5161, 2.44, 5000, 39, 200, -60, 60, 22.5, 85, 170000),
    ("m6", "YAGI", 1, 1, 450, 32, 1000, -180, 180, 0, 0, 270000),
    ("m7", "PHASED", 256, 0.006, 24000, 25, 0.001, -180, 180, -90, 0, 300),
]
#: Attenuation in dB/km by frequency (MHz) at the ends of bands of angle.
ANGLES = [0, 0.5, 1, 2, 5, 10, 30, 60, 90]
ATTENUATION = {
    1000: [3.4, 2.7, 2.2, 1.55, 0.8, 0.4, 0.55, 0, 0],
    3000: [4.4, 3.4, 2.8, 1.9, 0.95, 0.5, 0.08, 0, 0],
    5000: [5.0, 3.8, 3.0, 2.1, 1.0, 0.54, 0.19, 0.11, 0],
    10000: [6.8, 5.0, 4.0, 2.6, 1.4, 0.7, 0.24, 0.14, 0.12],
}
#: Steps of grid levels, (unit, step) from level 0 on; finer levels halve the second.
STEPS = [("d", 256), ("d", 256), ("d", 128), ("d", 64), ("d", 32), ("d", 16), ("d", 8), ("d", 4), ("d", 2), ("d", 1)] + [("m", 2**k) for k in range(5, -1, -1)] + [("s", 2**k) for k in range(5, -1, -1)]


def _rows(rows: list[tuple]) -> str:
    value = lambda v: f"'{v}'" if isinstance(v, str) else f"{float(v)!r}e0" if "e" not in repr(float(v)) else repr(float(v))
    return ", ".join(f"({', '.join(map(value, r))})" for r in rows)


BANDS = [(f, ANGLES[i], ANGLES[i + 1], v[i], v[i + 1]) for f, v in ATTENUATION.items() for i in range(8)]
VIEWS = {
    "models": f"SELECT CAST(model AS BIGINT) AS model, name, kind, n, d, f, g, pt, theta_lo, theta_hi, phi_lo, phi_hi, model_range FROM (VALUES {_rows([(i, *m) for i, m in enumerate(MODELS)])}) AS v(model, name, kind, n, d, f, g, pt, theta_lo, theta_hi, phi_lo, phi_hi, model_range)",
    "bands": f"SELECT * FROM (VALUES {_rows(BANDS)}) AS v(band_f, band_from, band_to, db_from, db_to)",
    "mesh": """SELECT tri_id, CAST(10 * g AS DOUBLE) AS ax, CAST(10 * h AS DOUBLE) AS ay, 0e0 AS az, CAST(10 * g + 8 AS DOUBLE) AS mx, CAST(10 * h + 1 AS DOUBLE) AS my, CAST(p_size AS DOUBLE) AS mz,
        CAST(10 * g + 2 AS DOUBLE) AS cx, CAST(10 * h + 9 AS DOUBLE) AS cy, CAST(p_size AS DOUBLE) / 2 AS cz
        FROM (SELECT p_partkey AS tri_id, p_size, p_partkey % 50 AS g, CAST(floor(p_partkey / 50) AS BIGINT) AS h FROM {part}) v""",
    "targets": "SELECT c_custkey AS tid, CAST(c_custkey * 7919 % 5003 AS DOUBLE) / 10 AS tx, CAST(c_custkey * 104729 % 5009 AS DOUBLE) / 10 AS ty, CAST(c_custkey % 97 AS DOUBLE) * 31 / 100 + 1 AS tz FROM {customer}",
    "emitters": """SELECT s_suppkey AS eid, CAST(s_suppkey * 1237 % 499 AS DOUBLE) + 0.03e0 AS ex, CAST(s_suppkey * 3571 % 497 AS DOUBLE) + 0.07e0 AS ey, CAST(40 + s_suppkey % 11 AS DOUBLE) AS ez,
        CAST(s_suppkey % 8 AS BIGINT) AS model, 60e0 AS reach, CAST(s_suppkey * 37 % 360 - 180 AS DOUBLE) + 0.10041e0 AS e_theta, CAST(s_suppkey * 11 % 21 - 10 AS DOUBLE) + 0.10037e0 AS e_phi FROM {supplier}""",
    "stations": """SELECT sid, CAST(sid * 7919 % 6000 AS DOUBLE) / 1000 + 114.0001e0 AS lon, CAST(sid * 104729 % 5000 AS DOUBLE) / 1000 + 22.0001e0 AS lat, CAST(sid % 1000 AS DOUBLE) + 0.5e0 AS alt, level,
        CASE WHEN level < 10 THEN 300000e0 + sid % 5 * 30000 WHEN level < 16 THEN 5500e0 * power(2e0, 15 - level) WHEN level < 22 THEN 122e0 * power(2e0, 21 - level) ELSE 25e0 END AS range_m
        FROM (SELECT s_suppkey AS sid, CAST(7 + s_suppkey % 18 AS BIGINT) AS level FROM {supplier}) v""",
    "coarse_stations": """SELECT sid, CAST(sid * 7919 % 6000 AS DOUBLE) / 1000 + 14.0001e0 AS lon, CAST(sid * 104729 % 5000 AS DOUBLE) / 1000 + 22.0001e0 AS lat, CAST(sid % 1000 AS DOUBLE) + 0.5e0 AS alt, level,
        CASE WHEN level < 10 THEN 143000e0 * (CASE WHEN level = 0 THEN 256 ELSE power(2e0, 9 - level) END) ELSE 5e0 END AS range_m
        FROM (SELECT s_suppkey AS sid, CASE WHEN s_suppkey % 8 = 7 THEN CAST(25 AS BIGINT) ELSE CAST(s_suppkey % 8 AS BIGINT) END AS level FROM {supplier}) v""",
    # stations within the mesh's own extent; each 25th reaches far beyond it
    "sites": """SELECT s_suppkey AS sid, 114.16e0 + (CAST(s_suppkey * 1237 % 499 AS DOUBLE) + 0.03e0) / 100000 AS lon, 22.28e0 + (CAST(s_suppkey * 3571 % 497 AS DOUBLE) + 0.07e0) / 100000 AS lat, CAST(5 + s_suppkey % 23 AS DOUBLE) + 0.5e0 AS alt,
        CASE WHEN s_suppkey % 25 = 7 THEN CAST(8 AS BIGINT) ELSE CAST(22 AS BIGINT) END AS level, CASE WHEN s_suppkey % 25 = 7 THEN 300000e0 ELSE 45e0 END AS range_m FROM {supplier}""",
    "dem": "SELECT CAST(0 AS BIGINT) AS dem_id, CAST(floor(k / 100) AS BIGINT) AS row, k % 100 AS col, CASE WHEN k % 41 = 0 THEN NULL ELSE CAST(k * 7919 % 601 AS DOUBLE) / 10 END AS height FROM (SELECT o_orderkey AS k FROM {orders}) v",
    "dem_meta": "SELECT CAST(0 AS BIGINT) AS dem_id, 114.16e0 AS gt0, 0.0001e0 AS gt1, 22.29e0 AS gt3, -0.0001e0 AS gt5, CAST(100 AS BIGINT) AS width, CAST(floor(max(o_orderkey) / 100) + 1 AS BIGINT) AS height FROM {orders}",
    "points": "SELECT c_custkey AS pid, 114.1597e0 + CAST(c_custkey * 7919 % 10607 AS DOUBLE) / 1000000 AS lon, 22.2903e0 - CAST(c_custkey * 104729 % 15607 AS DOUBLE) / 1000000 AS lat, CAST(c_custkey % 97 AS DOUBLE) + 0.5e0 AS alt FROM {customer}",
    "rays": """SELECT c_custkey AS rid, 114.16013e0 + CAST(c_custkey * 131 % 9973 AS DOUBLE) / 1000000 AS e_lon, 22.28977e0 - CAST(c_custkey * 173 % 14983 AS DOUBLE) / 1000000 AS e_lat, 40.5e0 + c_custkey % 29 AS e_alt,
        114.16011e0 + CAST(c_custkey * 7919 % 9967 AS DOUBLE) / 1000000 AS t_lon, 22.28971e0 - CAST(c_custkey * 104729 % 14951 AS DOUBLE) / 1000000 AS t_lat, 30.5e0 + c_custkey % 37 AS t_alt FROM {customer}""",
    "positions": "SELECT o_orderkey AS pid, CAST(o_orderkey * 7919 % 3600000 AS DOUBLE) / 10000 - 180 AS lon, CAST(o_orderkey * 104729 % 1800000 AS DOUBLE) / 10000 - 90 AS lat, CAST(o_orderkey * 31 % 50000 AS DOUBLE) AS alt, CAST(1 + o_orderkey % 21 AS BIGINT) AS level FROM {orders}",
    "poses": "SELECT user_id % 10 AS emitter_id, event_id, CAST(ts AS TIMESTAMP) AS ts, 114.16e0 + CAST(event_id % 997 AS DOUBLE) / 100000 AS lon, 22.28e0 + CAST(event_id % 499 AS DOUBLE) / 100000 AS lat, CAST(event_id % 83 AS DOUBLE) AS alt, CAST(event_id % 61 - 30 AS DOUBLE) AS phi, CAST(event_id % 360 - 180 AS DOUBLE) AS theta FROM {events}",
    # every third event turns the antenna, the others move the carrier
    "pose_events": "SELECT user_id AS emitter_id, event_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_id % 3 = 0 THEN 'turn' ELSE 'move' END AS kind, 114.16e0 + CAST(event_id % 997 AS DOUBLE) / 100000 AS lon, 22.28e0 + CAST(event_id % 499 AS DOUBLE) / 100000 AS lat, CAST(event_id % 83 AS DOUBLE) AS alt, CAST(event_id % 31 - 15 AS DOUBLE) AS phi, CAST(event_id % 360 - 180 AS DOUBLE) AS theta FROM {events}",
    # every 13th line is broken in one of two ways
    "pose_lines": """SELECT event_id AS line_id, CASE WHEN event_id % 13 = 5 THEN concat('114:', CAST(event_id % 60 AS VARCHAR(9)), ';22') WHEN event_id % 13 = 9 THEN concat('x:1:2,3:4:5,', CAST(event_id % 83 AS VARCHAR(9)), ',1,2')
        ELSE concat('114:', CAST(event_id % 60 AS VARCHAR(9)), ':', CAST(event_id % 59 AS VARCHAR(9)), ',22:', CAST(event_id % 58 AS VARCHAR(9)), ':', CAST(event_id % 57 AS VARCHAR(9)), ',', CAST(event_id % 83 AS VARCHAR(9)), ',', CAST(event_id % 61 - 30 AS VARCHAR(9)), ',', CAST(event_id % 360 - 180 AS VARCHAR(9))) END AS value FROM {events}""",
}


def tables_of(view: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", VIEWS[view])))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a DataFrame over the Parquet tables that it derives from."""
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(name)})


def text(name: str) -> str:
    """The same view as SQL text over tables of those names."""
    return VIEWS[name].format(**{t: t for t in tables_of(name)})
