"""Formulas of grids, angles, scores and keys against numbers worked out in plain Python from their definitions."""

import math

import pytest

from viewfield.functions.formulas import DENSITY, FROM_DEGREES, FROM_METRES, PATTERNS, SECTOR, TURNED, apply
from viewfield.operators import cells, coverage, grid

RADIUS = 6371.193


def dms(x):
    d = math.trunc(x)
    m = math.trunc((x - d) * 60)
    return d, m, math.trunc(((x - d) * 60 - m) * 60)


def limits(lon, lat, alt, reach, level):
    """Corners of a station's grid in degrees; altitudes are degrees too."""
    east, north = reach / (110000 * math.cos(math.radians(lat))), reach / 110000
    low = alt - reach if level < 16 else alt if level < 22 else alt - 50
    up = lambda a: (a / 1000 + RADIUS) / 110
    return [(lon - east, lon + east), (lat - north, lat + north), (up(low), up(alt + reach))]


def degree_axis(lo, n, step):
    return [dms(lo)[0] + i * step for i in range(n)]


def minute_axis(lo, n, step):
    d, m, _ = dms(lo)
    per = math.ceil(60 / step) * step  # minutes till the next degree, in whole steps
    out = []
    for i in range(n):
        at = m - m % step + i * step
        out.append(d + at // per + at % per / 60)
    return out


def second_axis(lo, n, step):
    d, m, s = dms(lo)
    per = math.ceil(60 / step) * step
    out = []
    for i in range(n):
        at = s + i * step
        minute = m + at // per
        out.append(d + minute // 60 + minute % 60 / 60 + at % per / 3600)
    return out


def fine_axis(lo, n, step):
    d, m, s = dms(lo)
    return [(d * 3600 + m * 60 + s + i * step) / 3600 for i in range(n)]


def expected(lon, lat, alt, reach, level):
    """All cells of one station as (lon, lat, alt in metres)."""
    (x0, x1), (y0, y1), (z0, z1) = limits(lon, lat, alt, reach, level)
    seconds = lambda x: dms(x)[0] * 3600 + dms(x)[1] * 60 + dms(x)[2]
    if level < 10:
        step = 256 if level == 0 else 2 ** (9 - level)
        n = int((dms(z1)[0] - dms(z0)[0]) / step)
        axes = [degree_axis(lo, n, step) for lo in (x0, y0, z0)]
    elif level < 16:
        step = 2 ** (15 - level)
        per = math.ceil(60 / step) * step
        snapped = lambda x: dms(x)[1] - dms(x)[1] % step
        n = math.floor(((dms(z1)[0] - dms(z0)[0]) * per + snapped(z1) - snapped(z0)) / step)
        axes = [minute_axis(lo, n, step) for lo in (x0, y0, z0)]
    elif level < 22:
        step = 2 ** (21 - level)
        per = math.ceil(60 / step) * step
        count = lambda a, b: math.ceil((((dms(b)[0] - dms(a)[0]) * 60 + dms(b)[1] - dms(a)[1]) * per + dms(b)[2] - dms(a)[2]) / step)
        axes = [second_axis(a, count(a, b), step) for a, b in ((x0, x1), (y0, y1), (z0, z1))]
    else:
        step = 1 / 2 ** (level - 21)
        count = lambda a, b: math.ceil((seconds(b) - seconds(a)) / step) + 1 if seconds(b) > seconds(a) else 0
        axes = [fine_axis(a, count(a, b), step) for a, b in ((x0, x1), (y0, y1), (z0, z1))]
    return {(round(x, 8), round(y, 8), round((z * 110 - RADIUS) * 1000, 3)) for x in axes[0] for y in axes[1] for z in axes[2]}


@pytest.mark.parametrize(
    "station",
    [(114.3217, 22.4811, 500.5, 143000.0 * 64, 3), (114.3217, 22.4811, 500.5, 143000.0 * 256, 0), (114.3217, 22.4811, 500.5, 331000.0, 9), (113.9021, 22.0433, 120.5, 42000.0, 12), (113.9021, 22.9933, 120.5, 9000.0, 15), (114.0051, 22.0052, 77.5, 2100.0, 17), (114.9993, 22.9993, 77.5, 131.0, 21), (114.0001, 22.0001, 9.5, 25.0, 22), (114.0001, 22.0001, 9.5, 30.0, 25)],
)
def test_cells_of_each_kind_of_level(spark, station):
    rows = grid.cell_grid(spark.createDataFrame([(1, *station)], "sid long, lon double, lat double, alt double, range_m double, level long")).collect()
    got = {(round(r.c_lon, 8), round(r.c_lat, 8), round(r.c_alt, 3)) for r in rows}
    want = expected(*station)
    assert len(rows) == len(want) > 0
    assert {tuple(round(v, 6) for v in c) for c in got} == {tuple(round(v, 6) for v in c) for c in want}


def haversine(lon1, lat1, lon2, lat2):
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((a - b) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon1 - lon2) / 2) ** 2
    return 2 * math.asin(math.sqrt(h)) * RADIUS * 1000


def angles(north, west, up, theta, phi):
    t, p = math.radians(theta), math.radians(phi)
    x, y = north * math.cos(t) - west * math.sin(t), north * math.sin(t) + west * math.cos(t)
    x, z = up * math.sin(p) + x * math.cos(p), up * math.cos(p) - x * math.sin(p)
    r = math.sqrt(x * x + y * y + z * z)
    return (180.0 if x == 0 and y == 0 else math.degrees(math.atan2(y, x))), math.degrees(math.asin(z / r)) if r else 0.0, r


def test_frames(spark):
    poses = [(0.0, 0.0), (37.0, 0.0), (-120.5, 8.0), (179.0, -11.0)]
    targets = [(30.0, 40.0, 12.0), (-7.0, 3.0, 0.0), (0.0, -50.0, -4.0), (1.0, 0.0, 90.0)]
    rows = [(i, 5.0, 6.0, 7.0, *p, 5.0 + x, 6.0 + y, 7.0 + z) for i, (p, (x, y, z)) in enumerate((p, t) for p in poses for t in targets)]
    df = spark.createDataFrame(rows, "i long, ex double, ey double, ez double, e_theta double, e_phi double, tx double, ty double, tz double")
    for r in apply(df, FROM_METRES + TURNED).collect():
        want = angles(r.ty - r.ey, r.ex - r.tx, r.tz - r.ez, r.e_theta, r.e_phi)
        assert (r.theta, r.phi, r.r) == pytest.approx(want, abs=1e-9)
    rows = [(i, 114.1, 22.2, 50.0, 20.0, 3.0, 114.1 + x, 22.2 + y, 80.0) for i, (x, y) in enumerate([(0.01, 0.02), (-0.03, 0.01), (-0.002, -0.04), (0.05, -0.001)])]
    df = spark.createDataFrame(rows, "i long, e_lon double, e_lat double, e_alt double, e_theta double, e_phi double, t_lon double, t_lat double, t_alt double")
    for r in apply(df, FROM_DEGREES + TURNED).collect():
        north = math.copysign(haversine(r.e_lon, r.e_lat, r.e_lon, r.t_lat), r.t_lat - r.e_lat)
        west = math.copysign(haversine(r.e_lon, r.e_lat, r.t_lon, r.e_lat), r.e_lon - r.t_lon)
        assert (r.theta, r.phi, r.r) == pytest.approx(angles(north, west, 30.0, 20.0, 3.0), abs=1e-7)


def element(kind, n, d, f, axis, key):
    a, k = key / 1000, math.pi * d * f / 300
    if key == 0:
        return 1.0
    if key == 180000:
        return 0.0
    if kind == "YAGI":
        x = 1.3894 * a / (7 if axis == "theta" else 20)
        return math.sin(x) / x
    s = k * math.sin(math.radians(a))
    return math.sin(s) / s if kind == "SEW" else math.sin(n * s) / (n * math.sin(s))


MODELS = {"SEW": (1.0, 0.48, 10000.0, 32.0, 20.0), "PHASED": (256.0, 0.06, 3000.0, 25.0, 1.5), "YAGI": (1.0, 1.0, 450.0, 32.0, 1000.0)}
#: attenuation at 10 GHz and 3 GHz, dB/km, by angle
DB = {10000.0: {0: 6.8, 0.5: 5.0, 1: 4.0, 2: 2.6, 5: 1.4, 10: 0.7, 30: 0.24, 60: 0.14, 90: 0.12}, 3000.0: {0: 4.4, 0.5: 3.4, 1: 2.8, 2: 1.9, 5: 0.95, 10: 0.5, 30: 0.08, 60: 0, 90: 0}}


def attenuation(f, angle):
    if f < 1000 or f > 20000 or angle >= 90:
        return 0.0
    at = sorted(DB[f])
    lo = max(a for a in at if a <= angle)
    hi = at[at.index(lo) + 1]
    return DB[f][lo] + (DB[f][hi] - DB[f][lo]) * (angle - lo) / (hi - lo)


def test_patterns_and_densities(spark):
    from viewfield.sources.fixtures import VIEWS

    bands, rows = spark.sql(VIEWS["bands"]), []
    for kind, (n, d, f, g, pt) in MODELS.items():
        for i, (theta, phi, r) in enumerate([(3.0, 1.0, 900.0), (45.25, 12.5, 3000.0), (-60.0, 44.0, 150.0), (178.0, 2.0, 80.0), (31.0, -75.0, 42.0), (10.0, 10.0, 0.0)]):
            rows.append((kind, i, n, d, f, g, pt, theta, phi, r, -30.0, 30.0, 0.0, 30.0))
    df = spark.createDataFrame(rows, "kind string, i long, n double, d double, f double, g double, pt double, theta double, phi double, r double, theta_lo double, theta_hi double, phi_lo double, phi_hi double")
    got = apply(coverage.with_attenuation(apply(df, SECTOR), bands), PATTERNS + DENSITY).collect()
    assert len(got) == len(rows)
    for r in got:
        excess = [max(lo - a, a - hi, 0.0) for a, lo, hi in ((r.theta, -30, 30), (r.phi, 0, 30))]
        assert [r.dtheta, r.dphi] == pytest.approx(excess) and r.outside == (max(excess) >= 90)
        if r.outside:
            assert r.density == 0
        elif r.r == 0:
            assert r.density is None
        else:
            e = [element(r.kind, r.n, r.d, r.f, axis, math.floor(x * 1000)) for axis, x in zip(("theta", "phi"), excess)]
            loss = 10 ** (attenuation(r.f, excess[1]) * r.r / 1000 / 10)
            assert r.density == pytest.approx(r.pt * 1000 * 10 ** (r.g / 10) * abs(e[0] * e[1]) / (4 * math.pi * r.r**2 * loss), rel=1e-9)


def test_separation(spark):
    rows = [(0, 114.1, 22.2, 114.2, 22.3), (1, 114.1, 22.2, 114.0, 22.3), (2, 114.1, 22.2, 114.0, 22.1), (3, -70.0, -33.0, -70.0, -33.5), (4, 10.0, 50.0, 11.0, 50.0)]
    got = coverage.separation(spark.createDataFrame(rows, "k long, lon1 double, lat1 double, lon2 double, lat2 double")).orderBy("k").collect()
    for r in got:
        assert r.metres == pytest.approx(haversine(r.lon1, r.lat1, r.lon2, r.lat2))
        north = math.copysign(haversine(r.lon1, r.lat1, r.lon1, r.lat2), r.lat2 - r.lat1)
        east = math.copysign(haversine(r.lon1, r.lat2, r.lon2, r.lat2), r.lon2 - r.lon1)
        assert r.bearing == pytest.approx(math.degrees(math.atan2(east, north)) % 360)


def interleaved(lon, lat, alt, level):
    """A cell's key bit by bit."""

    def axis(x, signed):
        d = math.floor(abs(x))
        m = math.floor((abs(x) - d) * 60)
        s = math.floor(((abs(x) - d) * 60 - m) * 60)
        return (d << 12 | m << 6 | s | (1 << 20 if signed and x < 0 and d + m + s > 0 else 0)) >> (21 - level)

    codes = axis(lon, True), axis(lat, True), axis((alt + 6371.393) / (50000 + 6371.393) * 512, False)
    return sum((c >> bit & 1) << (3 * bit + k) for k, c in enumerate(codes) for bit in range(21))


def test_keys_bit_by_bit(spark):
    places = [(114.1234, 22.2345, 80.0), (-73.9857, 40.7484, 443.2), (151.2153, -33.8568, 0.0), (-0.0001, -0.0001, 49999.0), (-179.9, -89.9, 12345.6), (0.0, 0.0, 0.0)]
    rows = [(*p, level) for p in places for level in (1, 5, 12, 16, 20, 21)]
    got = cells.encode(spark.createDataFrame(rows, "lon double, lat double, alt double, level long")).collect()
    assert [r.code for r in got] == [interleaved(r.lon, r.lat, r.alt, r.level) for r in got]


def test_cheap_rounding_is_rounding(spark):
    import random

    from viewfield.functions.formulas import rounded

    r = random.Random(3)
    odd = [0.0, -0.0, -1e-9, 0.5, -0.5, 2.5e-6, -2.5e-6, 0.0000005, 1.0000005, 1.005, -1.005, 0.285, 1e300, -1e300, 5e-324, float("inf"), float("-inf"), float("nan"), None]
    values = odd + [k / 2e6 for k in range(-50, 50)] + [k / 200 for k in range(-300, 300)] + [r.uniform(-1, 1) * 10 ** r.uniform(-9, 12) for _ in range(5000)]
    rows = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (2, 4, 6):
        both = rows.selectExpr("x", f"{rounded('x', digits)} AS a", f"round(x, {digits}) AS b")
        # as text, for -0 equals 0
        assert both.where("NOT CAST(a AS STRING) <=> CAST(b AS STRING)").count() == 0
        assert both.where(f"abs(x * 1e{digits}) < 1e9 AND abs(x * 1e{digits} - floor(x * 1e{digits}) - 0.5) > 1e-3").count() > 2000
