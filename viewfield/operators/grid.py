"""Target grids round emitters: projections and explodes, never built on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import DEM_METRES, EARTH_KM, GRID_METRES, Layers, apply, whole
from ..sources.fixtures import STEPS
from .sized import dealt


def spread(rows: DataFrame, name: str, n: str) -> DataFrame:
    """A row for each of n steps 0, 1, …, none if n is not positive.

    The explode is an outer one: of an inner one, or of a filter on n, the optimizer would put a test below
    all the layers that n comes from and write them out in it many times over.
    """
    return rows.selectExpr("*", f"explode_outer(CASE WHEN {n} > 0 THEN sequence(0L, {n} - 1) END) AS {name}").where(f"{name} IS NOT NULL")


def ground_grid(emitters: DataFrame, step: float) -> DataFrame:
    """Square grid round each emitter (eid, ex, ey, reach): adds idx, x, y; an emitter without cells gives none.

    Cells of emitters with a home are made there.
    """
    n = f"CAST(ceil(2 * reach / {step}e0) AS BIGINT)"
    rows, home = emitters.selectExpr("*", f"{n} AS n_side"), [c for c in emitters.columns if c in ("home_x", "home_y", "home_n")]
    rows = spread(dealt(rows, *home), "i", "n_side") if home else dealt(spread(rows, "i", "n_side"), "eid", "i")
    rows = spread(rows, "j", "n_side")
    return rows.selectExpr("*", "i * n_side + j AS idx", f"ex - reach + j * {step}e0 AS x", f"ey - reach + i * {step}e0 AS y")


def cells_in(step: float) -> str:
    """How many cells an emitter's square grid has."""
    return f"power(ceil(2 * reach / {step}e0), 2)"


BOX: Layers = [
    [("lat_c", "(lat_lo + lat_hi) / 2")],
    [("lon_step", f"metres / ({DEM_METRES} * cos(radians(lat_c)))"), ("lat_step", f"metres / {DEM_METRES}")],
    [("n_lon", "CAST(ceil((lon_hi - lon_lo) / lon_step) AS BIGINT)"), ("n_lat", "CAST(ceil((lat_hi - lat_lo) / lat_step) AS BIGINT)")],
]


def box_grid(boxes: DataFrame) -> DataFrame:
    """Grid over boxes (lon_lo, lon_hi, lat_lo, lat_hi, metres), anchored at the lower corner: adds i, j, lon, lat."""
    rows = spread(dealt(spread(apply(boxes, BOX), "i", "n_lat"), "lon_lo", "lat_lo", "i"), "j", "n_lon")
    return rows.selectExpr("*", "lon_lo + j * lon_step AS lon", "lat_lo + i * lat_step AS lat")


def _step() -> str:
    cases = " ".join(f"WHEN level = {k} THEN {s}e0" for k, (_, s) in enumerate(STEPS))
    return f"CASE {cases} ELSE 1 / power(2e0, level - 21) END"


#: Limits as degrees, also of the altitude; the finest levels look 50 m down, levels of seconds only up.
_HALF = f"range_m / ({GRID_METRES} * cos(radians(lat)))"
_ALT = f"((%s) / 1000 + {EARTH_KM}e0) / 110"
_LOW = "CASE WHEN level < 16 THEN alt - range_m WHEN level < 22 THEN alt ELSE alt - 50 END"


def _dms(name: str) -> Layers:
    d, m = whole(name), whole(f"({name} - {name}_d) * 60")
    return [[(f"{name}_d", d)], [(f"{name}_m", m)], [(f"{name}_s", whole(f"(({name} - {name}_d) * 60 - {name}_m) * 60"))]]


def _together(parts: list[Layers]) -> Layers:
    return [[x for p in parts for x in p[k]] for k in range(len(parts[0]))]


LIMITS = ["lon_lo", "lat_lo", "alt_lo", "lon_hi", "lat_hi", "alt_hi"]


def _count(axis: str) -> str:
    lo, hi = f"{axis}_lo", f"{axis}_hi"
    by_degree = f"{whole('(alt_hi_d - alt_lo_d) / step')}"
    minute = lambda x: f"({x}_m - {x}_m % CAST(step AS BIGINT))"
    by_minute = f"CAST(floor(((alt_hi_d - alt_lo_d) * virtual + {minute('alt_hi')} - {minute('alt_lo')}) / step) AS BIGINT)"
    by_second = f"CAST(ceil((((({hi}_d - {lo}_d) * 60 + {hi}_m - {lo}_m) * virtual) + {hi}_s - {lo}_s) / step) AS BIGINT)"
    seconds = lambda x: f"({x}_d * 3600 + {x}_m * 60 + {x}_s)"
    finer = f"CASE WHEN {seconds(hi)} > {seconds(lo)} THEN CAST(ceil(({seconds(hi)} - {seconds(lo)}) / step) AS BIGINT) + 1 ELSE 0 END"
    return f"CASE WHEN level < 10 THEN {by_degree} WHEN level < 16 THEN {by_minute} WHEN level < 22 THEN {by_second} ELSE {finer} END"


#: Levels below 10 step whole degrees, below 16 minutes, below 22 seconds, with as many of them in the next unit
#: as steps fit whole or in part; above, parts of a second.
COUNTS: Layers = [
    [("step", _step()), ("lon_lo", f"lon - {_HALF}"), ("lon_hi", f"lon + {_HALF}"), ("lat_lo", f"lat - range_m / {GRID_METRES}"), ("lat_hi", f"lat + range_m / {GRID_METRES}"), ("alt_lo", _ALT % _LOW), ("alt_hi", _ALT % "alt + range_m")],
    *_together([_dms(x) for x in LIMITS]),
    [("virtual", "CAST(ceil(60 / step) * step AS BIGINT)")],
    [("n_lon", _count("lon")), ("n_lat", _count("lat")), ("n_alt", _count("alt"))],
]


def _place(axis: str, i: str) -> str:
    """Degrees of step i on an axis; the longitude's minutes start at the longitude's own lower limit."""
    lo, tot = f"{axis}_lo", f"({i} * CAST(step AS BIGINT) + {axis}_lo_s)"
    by_minute = f"({i} * CAST(step AS BIGINT) + {lo}_m - {lo}_m % CAST(step AS BIGINT))"
    minutes = f"(CAST(floor({tot} / virtual) AS BIGINT) + {lo}_m)"
    return (
        f"CASE WHEN level < 10 THEN {lo}_d + {i} * step "
        f"WHEN level < 16 THEN {lo}_d + floor({by_minute} / virtual) + ({by_minute} % virtual) / 60e0 "
        f"WHEN level < 22 THEN {lo}_d + floor({minutes} / 60) + ({minutes} % 60) / 60e0 + ({tot} % virtual) / 3600e0 "
        f"ELSE ({lo}_d * 3600 + {lo}_m * 60 + {lo}_s + {i} * step) / 3600e0 END"
    )


PLACES: Layers = [[("c_lon", _place("lon", "z")), ("c_lat", _place("lat", "j")), ("c_alt", f"(({_place('alt', 'i')}) * 110 - {EARTH_KM}e0) * 1000")]]


#: What the places of a grid's cells are made of, by station.
COUNTED = ["step", "virtual", *(f"{x}_{part}" for x in ("lon_lo", "lat_lo", "alt_lo") for part in "dms"), "n_lon", "n_lat", "n_alt"]


def cell_grid(stations: DataFrame, most: int | None = None, by: Sequence[str] = ("lon", "lat", "level", "i", "j"), n: int | None = None) -> DataFrame:
    """3D grid of each station (lon, lat, alt, range_m, level): adds i, j, z, c_lon, c_lat, c_alt.

    ``most`` is an optional bound: stations with more points give none.  Rows are dealt by ``by``: those of (i, j) if i
    is among the columns, else the stations, in whose partitions, of ``n``, the cells then stay.  Stations that ``reaching`` has
    counted are not counted again.
    """
    known = [c for c in stations.columns if c in COUNTED]
    rows = stations if len(known) == len(COUNTED) else apply(stations, COUNTS)
    columns = [c for c in stations.columns if c not in COUNTED] if len(known) == len(COUNTED) else stations.columns
    if most is not None:
        rows = rows.withColumn("n_alt", F.expr(f"CASE WHEN n_lon * n_lat * n_alt <= {most} THEN n_alt END"))
    # each axis's place is made as soon as its step is there, so none is made again for the cells of the inner ones
    (lon, lat, alt), = PLACES
    low = apply(spread(rows if "i" in by else dealt(rows, *by, n=n), "i", "n_alt"), [[alt]])
    mid = apply(spread(low, "j", "n_lat"), [[lat]])
    rows = apply(spread(dealt(mid, *by, n=n) if "i" in by else mid, "z", "n_lon"), [[lon]])
    return rows.select(*columns, "i", "j", "z", "c_lon", "c_lat", "c_alt")


#: A unit of a level's steps in degrees; how far a grid starts below its limit: at a whole degree, at a whole step of minutes, or at a second.
_UNIT = "(CASE WHEN level < 10 THEN 1e0 WHEN level < 16 THEN 1 / 60e0 ELSE 1 / 3600e0 END)"
_SLACK = "(CASE WHEN level < 10 THEN 1e0 WHEN level < 16 THEN (step + 1) / 60e0 ELSE 2 / 3600e0 END)"


def reaching(stations: DataFrame) -> DataFrame:
    """Stations with ``n_cells``, how many cells their grids have, ``lon_reach`` and ``lat_reach``, which no cell lies beyond, in degrees, and ``COUNTED``.

    A grid starts not far below its lower limit and goes on for its number of steps.  Parts of seconds (level 22 on) are
    evenly spaced, so the first and the last of them tell.
    """
    half = {"lon": _HALF, "lat": f"range_m / {GRID_METRES}"}
    ends = lambda axis: ", ".join(f"abs({_place(axis, i)} - {axis})" for i in ("0L", f"greatest(0L, n_{axis} - 1)"))
    farthest = lambda axis: f"CASE WHEN level < 22 THEN greatest({half[axis]}, greatest(0L, n_{axis}) * step * {_UNIT} - {half[axis]}) + {_SLACK} ELSE greatest({ends(axis)}) + 1e-9 END"
    cells = "CAST(greatest(0L, n_lon) * greatest(0L, n_lat) * greatest(0L, n_alt) AS DOUBLE)"
    return apply(stations, COUNTS).selectExpr(*stations.columns, *COUNTED, f"{cells} AS n_cells", f"{farthest('lon')} AS lon_reach", f"{farthest('lat')} AS lat_reach")
