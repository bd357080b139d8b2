"""Plans that go by the size of what they join or spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of at most so many rows is sent to all tasks.
FEW = 10_000


def few(rows: DataFrame) -> DataFrame:
    """``rows`` marked for broadcast if they are few; else Spark chooses the join."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


#: More partitions than rows are ever in.
WIDE = 1 << 20


def apart(rows: DataFrame) -> DataFrame:
    """``rows`` as they are, but what is made of them is generated as code of its own: methods over 64 KB are not compiled.

    No partitions are joined, for a task holds the hash tables of all partitions that it reads until it ends.
    """
    return rows.coalesce(WIDE)


def partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(rows: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """``rows`` dealt by keys over ``n`` or all shuffle partitions, before they are spread into many more.

    A number is given, for a few rows would else be joined into one partition again.
    """
    return rows.repartition(n or partitions(rows), *keys)
