"""Elevation models at the homes of emitters whose cells are grids: rays settled by emitter, none shuffled.

A patch is the pixels of a model in reach of a home's emitters, so patches go by the ground that emitters stand on and
not by their number.  An emitter meets the patches of its home in one row, where its rays are settled in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import CLEARANCE_SQL, DEM_METRES
from ..sources.shared import stored
from .sized import dealt, few
from .visibility import PLACE

#: Pixels of a patch, and flags of an emitter, at most.
PIXELS, FLAGS = 65_536, 1_048_576
MODEL = ["dem_id", "gt0", "gt1", "gt3", "gt5", "width", "height", "r0", "c0", "across"]


def _windows(emitters: DataFrame, meta: DataFrame, tile: list[str], lon0: float, lat0: float, scale: float) -> DataFrame:
    """(tile, MODEL, r1, c1): the rows and columns of each model that samples of rays from a tile's emitters may need."""
    limits = [f(F.expr(f"e{i} {s} reach")).alias(f"q{n}{i}") for i in "xy" for f, s, n in ((F.min, "-", "lo"), (F.max, "+", "hi"))]
    lon, lat = (lambda q: f"({lon0}e0 + {q} / {scale}e0 - gt0) / gt1"), (lambda q: f"({lat0}e0 + {q} / {scale}e0 - gt3) / gt5")
    # a pixel to spare on both sides, clamped as samples are; rows run from north to south
    at = lambda x, more, size: f"greatest(0L, least({size} - 1, CAST(floor({x} - 0.5e0) AS BIGINT) + {more}))"
    rows = emitters.groupBy(*tile).agg(*limits).crossJoin(few(meta))
    rows = rows.selectExpr("*", f"{at(lat('qhiy'), -1, 'height')} AS r0", f"{at(lat('qloy'), 2, 'height')} AS r1", f"{at(lon('qlox'), -1, 'width')} AS c0", f"{at(lon('qhix'), 2, 'width')} AS c1")
    return rows.selectExpr(*tile, *MODEL[:-1], "c1 - c0 + 1 AS across", "r1", "c1")


def with_flags(emitters: DataFrame, dem: DataFrame, meta: DataFrame, heights: list[float], step: float, lon0: float, lat0: float, scale: float) -> DataFrame | None:
    """Emitters at home (``housed``) with ``flags``: whether each cell of their grids is seen over each model, stored.

    A byte for each cell (idx), height and model, in this order, models by ``dem_id``; 1 for seen, as ``dem_visible``
    tells it.  The emitters' frame is ``lon = lon0 + x / scale``, ``lat = lat0 + y / scale``.  None if an emitter's
    cells or a home's pixels are too many for one row.
    """
    place = [c for c in PLACE if c in emitters.columns] + ["home_k"]
    tile = [c for c in place if c != "home_n"]
    windows, models = _windows(emitters, meta, tile, lon0, lat0, scale), meta.count()
    pixels = windows.agg(F.max(F.expr("(r1 - r0 + 1) * across"))).first()[0] or 0
    cells = emitters.agg(F.max(F.expr(f"power(ceil(2 * reach / {step}e0), 2)"))).first()[0] or 0
    if pixels > PIXELS or cells * len(heights) * models > FLAGS:
        return None
    asked = windows.selectExpr(*tile, *MODEL, "c1", "explode(sequence(r0, r1)) AS row").selectExpr(*tile, *MODEL, "row", "explode(sequence(c0, c1)) AS col")
    known = dem.selectExpr("dem_id", "row", "col", "height AS z")
    found = asked.join(known, ["dem_id", "row", "col"], "left").groupBy(*tile, *MODEL, "row", "col").agg(F.max("z").alias("z"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "z"))), lambda s: s.z)
    held = found.groupBy(*tile, *MODEL).agg(values.alias("cells")).groupBy(*tile).agg(F.array_sort(F.collect_list(F.struct(*MODEL, "cells"))).alias("models"))
    # emitters and patches are dealt to the homes by themselves, so the few large rows are not gathered in few tasks
    homes = dealt(emitters.select(*place).distinct().join(held, tile), *place[:-1])
    met = dealt(emitters, *place[:-1]).join(homes.hint("shuffle_hash"), place, "left").select(*emitters.columns, "models")
    return stored(met.mapInArrow(_runner(heights, models, step, lon0, lat0, scale), emitters.withColumn("flags", F.lit(b"")).schema), "flags")


def _runner(heights: list[float], models: int, step: float, lon0: float, lat0: float, scale: float):
    """Of batches of emitters with ``models`` those with ``flags``."""
    clearance = float(CLEARANCE_SQL)

    def seen(ex: float, ey: float, ez: float, reach: float, patches: list[tuple]) -> bytes:
        n = max(0, int(np.ceil(2 * reach / step)))
        i, j = np.divmod(np.arange(n * n), max(n, 1))
        e_lon, e_lat = lon0 + ex / scale, lat0 + ey / scale
        t_lon, t_lat = lon0 + (ex - reach + j * step) / scale, lat0 + (ey - reach + i * step) / scale
        rays = e_lon, e_lat, ez, t_lon - e_lon, t_lat - e_lat, (e_lat + t_lat) / 2
        out = np.ones((n * n, len(heights), models), np.uint8)
        for d, patch in enumerate(patches):
            _settle(out[:, :, d], *rays, heights, clearance, *patch)
        return out.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.asarray(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in ("ex", "ey", "ez", "reach")]
            held, flags = batch.column("models"), []
            for k, (ex, ey, ez, reach) in enumerate(zip(*(x.tolist() for x in places))):
                given = [(*(s[c].as_py() for c in MODEL[1:]), s["cells"].values) for s in held[k]] if held[k].is_valid else []
                whole = not (np.isnan(ex) or np.isnan(ey) or np.isnan(reach))
                flags.append(seen(ex, ey, ez, reach, given) if whole else None)
            names = [c for c in batch.schema.names if c != "models"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(flags, pa.binary())], names=[*names, "flags"])

    return run


def _settle(out, e_lon, e_lat, ez, dx, dy, mid, heights, clearance, gt0, gt1, gt3, gt5, width, height, r0, c0, across, cells) -> None:
    """Set ``out`` (ray, height) to 0 where a sample of a ray runs below a patch.

    The operations are those of ``STEPS``, ``SAMPLES``, ``CORNERS`` and ``sample`` in their order.  Samples lie over the
    same places for all heights.
    """
    dx_m, dy_m = dx * DEM_METRES * np.cos(np.radians(mid)), dy * DEM_METRES
    n = np.maximum(np.ceil(np.sqrt(dx_m * dx_m + dy_m * dy_m) / (gt1 * DEM_METRES)).astype(np.int64), 2)
    inner = np.where((np.abs(dx) < 1e-9) & (np.abs(dy) < 1e-9), 0, n - 1)
    ray = np.repeat(np.arange(len(n)), inner)
    if not len(ray):
        return
    k = np.arange(len(ray)) - np.repeat(np.cumsum(inner) - inner, inner) + 1
    share = k / n[ray]
    fcol, frow = (e_lon + share * dx[ray] - gt0) / gt1 - 0.5, (e_lat + share * dy[ray] - gt3) / gt5 - 0.5
    col0, row0 = np.floor(fcol), np.floor(frow)
    u, w = fcol - col0, frow - row0
    edge = (col0 < 0) | (row0 < 0) | (col0 + 1 >= width) | (row0 + 1 >= height)
    col, row = (np.where(edge, np.clip(a + (b >= 0.5), 0, size - 1), a).astype(np.int64) for a, b, size in ((col0, u, width), (row0, w, height)))
    z, none = cells.to_numpy(zero_copy_only=False), cells.is_null().to_numpy(zero_copy_only=False)
    at = (row - r0) * across + col - c0
    four = [np.minimum(at + y * across + x, len(z) - 1) for y in (0, 1) for x in (0, 1)]
    h00, h10, h01, h11 = (z[a] for a in four)
    ground = h00 * (1 - u) * (1 - w) + h10 * u * (1 - w) + h01 * (1 - u) * w + h11 * u * w
    ground[edge] = h00[edge]
    lacks = [none[a] for a in four]
    missing = np.where(edge, lacks[0], False)
    if (some := ~edge & (lacks[0] | lacks[1] | lacks[2] | lacks[3])).any():
        known = sum((~x[some]).astype(np.int64) for x in lacks)
        total = sum(np.where(x[some], 0.0, h[some]) for x, h in zip(lacks, (h00, h10, h01, h11)))
        ground[some] = total / np.maximum(known, 1)
        missing[some] = known == 0
    limit, odd = ground - clearance, np.isnan(ground)
    for h, level in enumerate(heights):
        ray_h = ez + share * (level - ez)
        below = ((ray_h < limit) | odd & ~np.isnan(ray_h)) & ~missing
        out[ray[below], h] = 0
