"""Aggregations, intensity and classification of coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 1e-6
#: Colours at 0, 0.1, … 1.
PALETTE = [(255, 255, 180), (255, 240, 160), (255, 220, 140), (255, 200, 100), (255, 170, 60), (255, 140, 40), (255, 110, 20), (255, 80, 10), (255, 50, 5), (255, 25, 2), (255, 0, 0)]
GREY = 128


def totals(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, cells, visible, percent, least, most): counts, and limits of positive density, the least from 1e-6 on."""
    positive = F.when(F.col("density") > 0, F.col("density"))
    return cells.groupBy(*by).agg(
        F.count("*").alias("cells"),
        F.count_if("visible").alias("visible"),
        (100 * F.count_if("visible") / F.count("*")).alias("percent"),
        F.greatest(F.min(positive), F.lit(LEAST)).alias("least"),
        F.max(positive).alias("most"),
    )


def _channel(c: int, v: str, low: str) -> str:
    """A colour's channel by straight lines between the palette's stops."""
    base = "CASE " + " ".join(f"WHEN {low} = {i} THEN {p[c]}" for i, p in enumerate(PALETTE)) + " END"
    step = "CASE " + " ".join(f"WHEN {low} = {i} THEN {q[c] - p[c]}" for i, (p, q) in enumerate(zip(PALETTE, PALETTE[1:]))) + " ELSE 0 END"
    return f"CASE WHEN {v} IS NULL THEN {GREY} ELSE CAST(floor({base} + ({v} * 10 - {low}) * {step} + 1e-9) AS INT) END"


#: Share of the way from the least to the most, on a logarithmic scale; null without a signal.
NORMAL = "CASE WHEN density > 0 AND most > least THEN round(power(greatest(0e0, least(1e0, (ln(density) - ln(least)) / (ln(most) - ln(least)))), %s), 6) END"


def intensity(cells: DataFrame, by: list[str], gamma: float = 0.5) -> DataFrame:
    """Add ``level`` (0 to 1) and ``red``, ``green``, ``blue`` by each group's own limits; no signal is grey."""
    rows = cells.join(totals(cells, by).select(*by, "least", "most"), by)
    rows = rows.selectExpr(*cells.columns, f"{NORMAL % gamma} AS level").selectExpr("*", "CAST(least(10, floor(level * 10)) AS INT) AS stop_")
    return rows.selectExpr(*cells.columns, "level", *(f"{_channel(c, 'level', 'stop_')} AS {n}" for c, n in enumerate(("red", "green", "blue"))))


AGREEMENT = "CASE WHEN visible_mesh AND visible_dem THEN 'both' WHEN visible_mesh THEN 'only mesh' WHEN visible_dem THEN 'only dem' ELSE 'neither' END"


def compared(cells: DataFrame) -> DataFrame:
    """Add ``agreement`` and ``disagreement`` to cells with visible_mesh and visible_dem."""
    return cells.selectExpr("*", f"{AGREEMENT} AS agreement", "visible_mesh <> visible_dem AS disagreement")


def comparison(cells: DataFrame, by: list[str], cube: bool = False) -> DataFrame:
    """Confusion counts, shares and density limits of compared cells by keys, or by all subsets of them."""
    grouped = cells.cube(*by) if cube else cells.groupBy(*by)
    positive = F.when(F.col("density") > 0, F.col("density"))
    share = lambda x: 100 * x / F.count("*")
    return grouped.agg(
        F.count("*").alias("cells"),
        F.count_if("visible_mesh").alias("by_mesh"),
        F.count_if("visible_dem").alias("by_dem"),
        F.count_if("disagreement").alias("disagreements"),
        share(F.count_if("visible_mesh")).alias("percent_mesh"),
        share(F.count_if("visible_dem")).alias("percent_dem"),
        share(F.count_if(~F.col("disagreement"))).alias("accuracy"),
        F.min(positive).alias("least"),
        F.max(positive).alias("most"),
    )
