"""Scalar formulas as SQL text, and layers of them.

A layer is a list of (name, expression) over the columns of the layer before.  ``apply`` adds layers to a
DataFrame; the text is plain SQL, so that tests can state it to another engine too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

Layers = list[list[tuple[str, str]]]

#: Fixed values.  Three conventions of radius stand side by side in the domain.
EARTH_KM = 6371.193  # distances, and altitude as degrees in grids
CELL_EARTH = 6371.393  # altitude in cell keys
GRID_METRES = 110000  # metres a degree in grids
DEM_METRES = 111320  # metres a degree in elevation models
NODATA = -9999
CLEARANCE_SQL = "0.05e0"  # metres that a ray may run under the terrain


def apply(df: DataFrame, layers: Layers) -> DataFrame:
    for layer in layers:
        names = {n for n, _ in layer}
        df = df.selectExpr(*[f"`{c}`" for c in df.columns if c not in names], *(f"{e} AS `{n}`" for n, e in layer))
    return df


def nested(inner: str, layers: Layers) -> str:
    """The same layers as nested SELECTs over a query."""
    for i, layer in enumerate(layers):
        inner = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer)} FROM ({inner}) l{i}"
    return inner


def whole(x: str) -> str:
    """Towards zero."""
    return f"CAST(CASE WHEN {x} < 0 THEN ceil({x}) ELSE floor({x}) END AS BIGINT)"


def rounded(x: str, digits: int) -> str:
    """``round(x, digits)`` of a column of doubles, to the last bit, mostly without the decimals that round goes by.

    Away from ties the nearest whole number of steps is plain, and a double divided by a power of ten is the double
    nearest to that decimal.  Adding zero makes -0 zero.
    """
    y = f"({x} * 1e{digits})"
    return f"CASE WHEN abs({y}) < 1e9 AND abs({y} - floor({y}) - 0.5e0) > 1e-3 THEN rint({y}) / 1e{digits} + 0e0 ELSE round({x}, {digits}) END"


def distance(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Great-circle metres."""
    a = f"power(sin((radians({lat1}) - radians({lat2})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin((radians({lon1}) - radians({lon2})) / 2), 2)"
    return f"(2 * asin(least(1e0, sqrt({a}))) * {EARTH_KM}e0 * 1000)"


#: The target in the emitter's frame: north, west, up; turned by its pose; then angles and distance.
FROM_METRES: Layers = [[("x0", "ty - ey"), ("y0", "ex - tx"), ("z0", "tz - ez")]]
FROM_DEGREES: Layers = [
    [
        ("x0", f"CASE WHEN e_lat < t_lat THEN 1 ELSE -1 END * {distance('e_lon', 'e_lat', 'e_lon', 't_lat')}"),
        ("y0", f"CASE WHEN e_lon > t_lon THEN 1 ELSE -1 END * {distance('e_lon', 'e_lat', 't_lon', 'e_lat')}"),
        ("z0", "t_alt - e_alt"),
    ]
]
TURNED: Layers = [
    [("x1", "x0 * cos(radians(e_theta)) - y0 * sin(radians(e_theta))"), ("y1", "x0 * sin(radians(e_theta)) + y0 * cos(radians(e_theta))")],
    [("x2", "z0 * sin(radians(e_phi)) + x1 * cos(radians(e_phi))"), ("z2", "z0 * cos(radians(e_phi)) - x1 * sin(radians(e_phi))")],
    [("r", "sqrt(x2 * x2 + y1 * y1 + z2 * z2)"), ("theta", "CASE WHEN x2 = 0 AND y1 = 0 THEN 180e0 ELSE degrees(atan2(y1, x2)) END")],
    [("phi", "CASE WHEN r = 0 THEN 0e0 ELSE degrees(asin(greatest(-1e0, least(1e0, z2 / r)))) END")],
]
#: Degrees beyond the scan limits, 0 within.
SECTOR: Layers = [
    [("dtheta", "greatest(theta_lo - theta, theta - theta_hi, 0e0)"), ("dphi", "greatest(phi_lo - phi, phi - phi_hi, 0e0)")],
    [("outside", "dtheta >= 90 OR dphi >= 90")],
]
#: At the pose itself: how far the target is from where the antenna points.
SNAPSHOT: Layers = [[("dtheta", "abs(theta)"), ("dphi", "abs(phi)")], [("outside", "dtheta >= 90 OR dphi >= 90")]]


def pattern(axis: str, key: str) -> str:
    """Antenna pattern at a milli-degree key, by columns kind, n, d, f."""
    a, k = f"({key} / 1000e0)", "(pi() * d * f / 300)"
    s = f"sin(radians({a}))"
    width = {"theta": "7e0", "phi": "20e0"}[axis]
    quotient = {
        "PHASED": f"sin(n * {k} * {s}) / nullif(n * sin({k} * {s}), 0)",
        "SEW": f"sin({k} * {s}) / nullif({k} * {s}, 0)",
        "YAGI": f"sin(1.3894e0 * {a} / {width}) / nullif(1.3894e0 * {a} / {width}, 0)",
    }
    cases = " ".join(f"WHEN kind = '{x}' THEN {y}" for x, y in quotient.items())
    return f"CASE WHEN {key} = 0 THEN 1e0 WHEN {key} = 180000 THEN 0e0 {cases} END"


ATTENUATION = "CASE WHEN f < 1000 OR f > 20000 OR dphi >= 90 THEN 0e0 ELSE db_from - (dphi - band_from) / (band_to - band_from) * (db_from - db_to) END"
PATTERNS: Layers = [
    [("key_theta", "CAST(floor(dtheta * 1000) AS BIGINT)"), ("key_phi", "CAST(floor(dphi * 1000) AS BIGINT)")],
    [("e_of_theta", pattern("theta", "key_theta")), ("e_of_phi", pattern("phi", "key_phi"))],
]
DENSITY: Layers = [
    [("db_km", ATTENUATION)],
    [("density", "CASE WHEN outside THEN 0e0 WHEN r = 0 THEN NULL ELSE pt * 1000 * power(10e0, g / 10) * abs(e_of_theta) * abs(e_of_phi) / (4 * pi() * r * r * power(10e0, db_km * r / 1000 / 10)) END")],
]
DECIBEL = "CASE WHEN density > 0 THEN round(10 * log10(density), 2) END"


def _meets() -> str:
    """Does the open segment e-t meet triangle a, m, c?  Two-sided, ends excluded, parallel misses."""
    v = lambda p, q: [f"({p}{i} - {q}{i})" for i in "xyz"]
    cross = lambda p, q: [f"({p[1]} * {q[2]} - {p[2]} * {q[1]})", f"({p[2]} * {q[0]} - {p[0]} * {q[2]})", f"({p[0]} * {q[1]} - {p[1]} * {q[0]})"]
    dot = lambda p, q: "(" + " + ".join(f"{x} * {y}" for x, y in zip(p, q)) + ")"
    ray, e1, e2, s = v("t", "e"), v("m", "a"), v("c", "a"), v("e", "a")
    det, far = dot(e1, cross(ray, e2)), f"sqrt({dot(ray, ray)})"
    u, w, t = dot(s, cross(ray, e2)), dot(ray, cross(s, e1)), dot(e2, cross(s, e1))
    # the ray is not of length one: det, u and w hold its length as a factor, t is a share of it
    inside = f"{u} / {det} >= 0 AND {u} / {det} <= 1 AND {w} / {det} >= 0 AND ({u} + {w}) / {det} <= 1"
    return f"CASE WHEN abs({det}) < 1e-6 * {far} OR {det} = 0 THEN FALSE ELSE {inside} AND {t} / {det} * {far} > 1e-6 AND {t} / {det} < 1 END"


MEETS = _meets()


def _parted() -> tuple[list[str], list[str], str]:
    """The same test and that of the boxes, in columns of a triangle seen from e, columns of the ray, and what is left for each pair.

    All operations are those of the tests above in their order, so the values are the same to the last bit; a pair's
    own code is short enough to be compiled.
    """
    v = lambda p, q: [f"({p}{i} - {q}{i})" for i in "xyz"]
    names = lambda n: [f"{n}{i}" for i in "xyz"]
    cross = lambda p, q: [f"({p[1]} * {q[2]} - {p[2]} * {q[1]})", f"({p[2]} * {q[0]} - {p[0]} * {q[2]})", f"({p[0]} * {q[1]} - {p[1]} * {q[0]})"]
    dot = lambda p, q: "(" + " + ".join(f"{x} * {y}" for x, y in zip(p, q)) + ")"
    e1, e2, s, ray = v("m", "a"), v("c", "a"), v("e", "a"), v("t", "e")
    side = cross(s, e1)
    triangle = [f"{x} AS {n}{i}" for n, xs in (("u1", e1), ("u2", e2), ("us", s), ("uq", side)) for i, x in zip("xyz", xs)] + [f"{dot(e2, side)} AS ut"]
    rays = [f"{x} AS ray{i}" for i, x in zip("xyz", ray)] + [f"sqrt({dot(ray, ray)}) AS ray_far"]
    rays += [f"{f}(e{i}, t{i}) AS ray_{n}{i}" for i in "xyz" for f, n in (("least", "lo"), ("greatest", "hi"))]
    p = cross(names("ray"), names("u2"))
    det, u, w, far = dot(names("u1"), p), dot(names("us"), p), dot(names("ray"), names("uq")), "ray_far"
    inside = f"{u} / {det} >= 0 AND {u} / {det} <= 1 AND {w} / {det} >= 0 AND ({u} + {w}) / {det} <= 1"
    meets = f"CASE WHEN abs({det}) < 1e-6 * {far} OR {det} = 0 THEN FALSE ELSE {inside} AND ut / {det} * {far} > 1e-6 AND ut / {det} < 1 END"
    return triangle, rays, " AND ".join([*(f"lo{i} <= ray_hi{i} AND hi{i} >= ray_lo{i}" for i in "xyz"), meets])


#: Columns of triangles (a, m, c) and emitters (e), columns of rays (e, t), and the test of boxes and triangle over both.
SEEN, RAYS, PAIR = _parted()
MBR: Layers = [[(f"{f}{i}", f"{g}(a{i}, m{i}, c{i})") for i in "xyz" for f, g in (("lo", "least"), ("hi", "greatest"))]]
#: The segment's box and the triangle's share a point.
BOXES = " AND ".join(f"lo{i} <= greatest(e{i}, t{i}) AND hi{i} >= least(e{i}, t{i})" for i in "xyz")


def _crosses() -> str:
    """Does the segment e-t meet the box lo-hi in all three projections?  Boxes that share no point are told before."""

    def diagonal(i: str, j: str, q: str, s: str) -> str:
        side = lambda p: f"((({p}{i} - lo{i}) * ({s}{j} - {q}{j})) - (({p}{j} - {q}{j}) * (hi{i} - lo{i})))"
        turn = lambda f, g: f"((({f}{i} - e{i}) * (t{j} - e{j})) - (({g}{j} - e{j}) * (t{i} - e{i})))"
        return f"NOT ({side('e')} * {side('t')} > 0 OR {turn('lo', q)} * {turn('hi', s)} > 0)"

    inside = lambda p, i, j: f"({p}{i} BETWEEN lo{i} AND hi{i} AND {p}{j} BETWEEN lo{j} AND hi{j})"
    plane = lambda i, j: f"({inside('e', i, j)} OR {inside('t', i, j)} OR {diagonal(i, j, 'lo', 'hi')} OR {diagonal(i, j, 'hi', 'lo')})"
    return " AND ".join(plane(i, j) for i, j in ("xy", "xz", "yz"))


CROSSES = _crosses()
#: Height of a triangle over (x, y), null beside it.
_DET = "((mx - ax) * (cy - ay) - (cx - ax) * (my - ay))"
_U = f"(((x - ax) * (cy - ay) - (cx - ax) * (y - ay)) / {_DET})"
_V = f"(((mx - ax) * (y - ay) - (x - ax) * (my - ay)) / {_DET})"
HEIGHT = f"CASE WHEN abs({_DET}) < 1e-6 THEN NULL WHEN {_U} >= 0 AND {_V} >= 0 AND {_U} + {_V} <= 1 THEN az + {_U} * (mz - az) + {_V} * (cz - az) END"

#: Masks and shifts that spread 21 bits to every third, and back.
MASKS = [0x1F00000000FFFF, 0x1F0000FF0000FF, 0x100F00F00F00F00F, 0x10C30C30C30C30C3, 0x1249249249249249]
SHIFTS = [32, 16, 8, 4, 2]


def _axis(v: str, code: str, negative: str | None) -> Layers:
    d = f"CAST(floor(abs({v})) AS BIGINT)"
    m = f"CAST(floor((abs({v}) - {d}) * 60) AS BIGINT)"
    s = f"CAST(floor(((abs({v}) - {d}) * 60 - {m}) * 60) AS BIGINT)"
    sign = f" + CASE WHEN {negative} AND {d} + {m} + {s} > 0 THEN 1048576 ELSE 0 END" if negative else ""
    return [[(code, f"({d} * 4096 + {m} * 64 + {s}{sign}) >> (21 - level)")]]


def _spread(x: str) -> Layers:
    # only bits that stay under the mask are moved, so nothing runs over
    return [[(x, f"({x} & {m}) | (({x} & ({m} >> {k})) << {k})")] for m, k in zip(MASKS, SHIFTS)]


def encode_layers() -> list[Layers]:
    """Per axis: the code and its spread, under names k_lon, k_lat, k_alt; alternating with renames for SQL."""
    alt = f"((alt + {CELL_EARTH}e0) / (50000 + {CELL_EARTH}e0) * 512)"
    return [_axis("lon", "k_lon", "lon < 0") + _spread("k_lon"), _axis("lat", "k_lat", "lat < 0") + _spread("k_lat"), _axis(alt, "k_alt", None) + _spread("k_alt")]


KEY = "k_lon | (k_lat << 1) | (k_alt << 2)"


def compact_layers() -> Layers:
    """The codes k_lon, k_lat, k_alt of each axis of a key."""
    out: Layers = [[("k_lon", f"code & {MASKS[-1]}"), ("k_lat", f"(code >> 1) & {MASKS[-1]}"), ("k_alt", f"(code >> 2) & {MASKS[-1]}")]]
    for m, k in zip([*MASKS[-2::-1], 0x1FFFFF], SHIFTS[::-1]):
        out.append([(x, f"({x} | ({x} >> {k})) & {m}") for x in ("k_lon", "k_lat", "k_alt")])
    return out


def decode_layers() -> Layers:
    out = compact_layers()
    out.append([(x, f"{x} << (21 - level)") for x in ("k_lon", "k_lat", "k_alt")])
    value = lambda x, bits: f"(((({x} >> 12) & {bits}) + (({x} >> 6) & 63) / 60e0 + ({x} & 63) / 3600e0))"
    sign = lambda x: f"CASE WHEN ({x} & 1048576) > 0 THEN -1 ELSE 1 END"
    out.append([("c_lon", f"{sign('k_lon')} * {value('k_lon', 255)}"), ("c_lat", f"{sign('k_lat')} * {value('k_lat', 255)}"), ("c_alt", f"{value('k_alt', 511)} / 512 * (50000 + {CELL_EARTH}e0) - {CELL_EARTH}e0")])
    return out
