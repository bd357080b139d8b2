"""Coverage scores: power density at targets by column expressions over joins with small fixed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import DENSITY, FROM_DEGREES, FROM_METRES, PATTERNS, SECTOR, SNAPSHOT, TURNED, apply, distance, pattern
from ..sources.shared import stored
from .grid import cell_grid, cells_in, ground_grid, reaching
from .sized import apart, dealt, few
from .terrain import Terrain, heights, indexed
from .visibility import PLACE, around, binned, flagged, housed, parting, traced


def with_models(emitters: DataFrame, models: DataFrame) -> DataFrame:
    """Emitters with the parameters of their models."""
    return emitters.join(few(models), "model")


#: Parameters of a model.
PARAMETERS = ["name", "kind", "n", "d", "f", "g", "pt", "theta_lo", "theta_hi", "phi_lo", "phi_hi", "model_range"]


def without_models(emitters: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Emitters with models less the models' parameters, and those by model, for rows that are joined before they are scored.

    The code of a join that carries few columns is short enough to be compiled (see ``apart``).
    """
    own = [c for c in emitters.columns if c in PARAMETERS]
    if "model" not in emitters.columns or not own:
        return emitters, None
    return emitters.drop(*own), emitters.select("model", *own).distinct()


def _again(rows: DataFrame, models: DataFrame | None, columns: list[str]) -> DataFrame:
    """Rows with the parameters taken from their emitters, all columns in their old order."""
    return (rows if models is None else with_models(rows, models)).select(*columns)


def pattern_table(models: DataFrame) -> DataFrame:
    """(model, axis, key, e): the pattern of each model and axis at each thousandth of a degree."""
    keys = models.selectExpr("*", "explode(array('theta', 'phi')) AS axis").selectExpr("*", "explode(sequence(0L, 359999L)) AS key")
    return keys.selectExpr("model", "axis", "key", f"CASE WHEN axis = 'theta' THEN {pattern('theta', 'key')} ELSE {pattern('phi', 'key')} END AS e")


def with_attenuation(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Rows (f, dphi) with their band; the frequency is the key."""
    inside = (F.col("f") == F.col("band_f")) & (F.col("dphi") >= F.col("band_from")) & (F.col("dphi") < F.col("band_to"))
    return rows.join(few(bands), inside, "left")


def in_frame(pairs: DataFrame, degrees: bool = False) -> DataFrame:
    """Theta, phi and distance of targets as seen from emitters with their poses."""
    return apply(pairs, (FROM_DEGREES if degrees else FROM_METRES) + TURNED)


def score(pairs: DataFrame, bands: DataFrame, degrees: bool = False, snapshot: bool = False) -> DataFrame:
    """Add ``density`` in W/m2 to pairs with models: 0 out of the sector, null at no distance or unknown frequency.

    By default the best over the scan limits; ``snapshot`` scores the direction of the pose alone.
    """
    rows = apart(apply(in_frame(pairs, degrees), SNAPSHOT if snapshot else SECTOR))
    return apply(with_attenuation(rows, bands), PATTERNS + DENSITY)


def detectable(scored: DataFrame, bands: DataFrame, rcs: float, models: DataFrame | None = None) -> DataFrame:
    """Add ``detectable``: does the echo of a cross-section reach what the model has at its own range?

    ``density / R2 >= reference``, the reference being density(0, 0, range) * rcs / 7.5 / range2, in metres.
    ``models`` are those of the scored rows, which are else made twice.
    """
    models = scored if models is None else models
    at_range = models.select("model", "kind", "n", "d", "f", "g", "pt", "model_range").distinct().selectExpr("*", "0e0 AS dphi", "0e0 AS dtheta", "FALSE AS outside", "model_range AS r")
    reference = apply(with_attenuation(at_range, bands), PATTERNS + DENSITY).selectExpr("model", f"density * {rcs}e0 / 7.5e0 / (model_range * model_range) AS reference")
    return scored.join(few(reference), "model").selectExpr(*scored.columns, "coalesce(density / nullif(r * r, 0) >= reference, FALSE) AS detectable")


def separation(pairs: DataFrame) -> DataFrame:
    """Add ``metres`` and ``bearing`` (degrees from north, clockwise) from (lon1, lat1) to (lon2, lat2)."""
    north, east = distance("lon1", "lat1", "lon1", "lat2"), distance("lon1", "lat2", "lon2", "lat2")
    turn = f"degrees(atan2(CASE WHEN lon2 < lon1 THEN -1 ELSE 1 END * {east}, CASE WHEN lat2 < lat1 THEN -1 ELSE 1 END * {north}))"
    return pairs.selectExpr("*", f"{distance('lon1', 'lat1', 'lon2', 'lat2')} AS metres", f"CASE WHEN {turn} < 0 THEN {turn} + 360 ELSE {turn} END AS bearing")


def ground_coverage(emitters: DataFrame, mesh: DataFrame | Terrain, bands: DataFrame, step: float) -> DataFrame:
    """Cells round emitters with models at ground + 0.1: adds ground, visible, density (0 where hidden)."""
    terrain = indexed(mesh)
    given, (emitters, models) = emitters.columns, without_models(emitters)
    emitters = housed(binned(emitters, terrain, cells_in(step), INDEX), PARTS)
    terrain = around(terrain, emitters)
    placed = heights(ground_grid(emitters, step), terrain, *PLACE, "eid", "idx").selectExpr("*", "x AS tx", "y AS ty", "ground + 0.1e0 AS tz").drop("x", "y")
    return _covered(placed, terrain, emitters, bands, models, given)


def height_coverage(emitters: DataFrame, mesh: DataFrame | Terrain, bands: DataFrame, levels: DataFrame, step: float, flags: Callable[[DataFrame], DataFrame | None] | None = None) -> DataFrame:
    """Cells at each of a table of heights (height), all in one job; heights under 1 are left out.

    ``low_height`` marks cells 50 m or more under the ground.  ``flags`` may add flags to the emitters
    (``patches.with_flags``), of which a cell keeps its own.
    """
    terrain, levels = indexed(mesh), levels.where("height >= 1")
    given, (emitters, models) = emitters.columns, without_models(emitters)
    emitters = housed(binned(emitters, terrain, f"{cells_in(step)} * {max(1, levels.count())}", INDEX), PARTS)
    terrain = around(terrain, emitters)
    known = flags(emitters) if flags else None
    cells = ground_grid(emitters, step) if known is None else _own_flags(ground_grid(known, step))
    placed = heights(cells, terrain, *PLACE, "eid", "idx").crossJoin(few(levels))
    placed = placed.selectExpr("*", "x AS tx", "y AS ty", "height AS tz", "coalesce(ground - height >= 50, FALSE) AS low_height").drop("x", "y")
    return _covered(placed, terrain, emitters, bands, models, given)


def _own_flags(cells: DataFrame) -> DataFrame:
    """Cells with their own stretch of their emitters' flags."""
    return cells.withColumn("flags", F.expr("substring(flags, CAST(idx * (length(flags) DIV (n_side * n_side)) AS INT) + 1, CAST(length(flags) DIV (n_side * n_side) AS INT))"))


#: A home's triangles make so many rows each in the mean for sectors, beside their own.
INDEX = 2.0
#: Parts of a home's emitters, at least.
PARTS = 8
#: Triangles in reach for each cell, and cells, from which on a station's rays are followed instead.
FAR, LARGE = 16, 1_000_000


def volume_coverage(stations: DataFrame, mesh: DataFrame | Terrain, bands: DataFrame, lon0: float, lat0: float, scale: float) -> DataFrame:
    """Cells of the 3D grids of stations with models: adds visible, density (0 where hidden).

    Rays are traced in the mesh's frame, ``lon = lon0 + x / scale``, ``lat = lat0 + y / scale``; scores are by degrees.
    A station's reach is that of its own cells, east and west as north and south.  Where many triangles may be in reach for each of its cells, or cells
    are very many, the rays are followed over the mesh; the others' are settled at their stations' homes.
    """
    terrain, given = indexed(mesh), stations.columns
    stations, models = without_models(stations)
    frame = lambda p, lon, lat, alt: [f"({lon} - {lon0}e0) * {scale}e0 AS {p}x", f"({lat} - {lat0}e0) * {scale}e0 AS {p}y", f"{alt} AS {p}z"]
    # a metre spares rounding; stored, for filters made of a reach would else hold all that it comes from
    emitters = reaching(stations).selectExpr("*", *frame("e", "e_lon", "e_lat", "e_alt"), f"greatest(lon_reach, lat_reach) * {scale}e0 + 1 AS reach")
    many = f"pi() * power(reach / CAST({terrain.size!r} AS DOUBLE), 2) > {FAR} * greatest(n_cells, 1e0) OR n_cells > {LARGE}"
    emitters = stored(binned(emitters, terrain, "greatest(n_cells, 1e0)", INDEX).selectExpr("*", f"{many} AS far").drop("lon_reach", "lat_reach", "n_cells"), "stations")
    columns = [*stations.columns, *(f"{p}{i}" for p in "et" for i in "xyz"), "i", "j", "z", "c_lon", "c_lat", "c_alt", "t_lon", "t_lat", "t_alt"]
    rays = lambda rows, by, n=None: cell_grid(rows, by=by, n=n).selectExpr("*", "c_lon AS t_lon", "c_lat AS t_lat", "c_alt AS t_alt", *frame("t", "c_lon", "c_lat", "c_alt"))
    near = emitters.where("NOT far")
    parts, n = parting(near, terrain.size, INDEX, PARTS)
    near = housed(near, parts)
    settled = flagged(rays(near, PLACE, n), around(terrain, near, n), near).select(*columns, "visible")
    far, cell = rays(emitters.where("far"), ("eid", "i", "j")), ["eid", "i", "j", "z"]
    met = dealt(traced(apart(far), terrain, cell), *cell[:3]).withColumn("met", F.lit(True))
    followed = far.join(met.hint("shuffle_hash"), cell, "left").select(*columns, F.expr("CASE WHEN tz IS NOT NULL THEN met IS NULL END AS visible"))
    seen = apart(settled).unionByName(apart(followed))
    scored = score(_again(seen, models, [*given, *(c for c in seen.columns if c not in given)]), bands, degrees=True)
    return scored.withColumn("density", F.expr("CASE WHEN visible THEN density ELSE 0e0 END"))


def _covered(rays: DataFrame, terrain: Terrain, emitters: DataFrame, bands: DataFrame, models: DataFrame | None, given: list[str]) -> DataFrame:
    seen = apart(flagged(rays, terrain, emitters).drop("sectors", *PLACE, "home_k"))
    seen = _again(seen, models, [*given, *(c for c in seen.columns if c not in given)])
    return score(seen, bands).selectExpr(*seen.columns, "CASE WHEN visible THEN density WHEN NOT visible THEN 0e0 END AS density")
