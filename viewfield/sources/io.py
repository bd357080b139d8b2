"""Readers and writers of the domain's text and table forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import NODATA

COMPARISON = ["lon", "lat", "alt", "visible_mesh", "visible_dem", "disagreement", "power_density"]


def parse_poses(lines: DataFrame) -> DataFrame:
    """Add lon, lat, alt, phi, theta and ``ok`` to pose lines ``d:m:s,d:m:s,alt,phi,theta``; a bad line has ok false.

    Works on batch and streaming rows alike.
    """
    part = lambda i: f"get(split(value, ','), {i})"
    dms = lambda i: " + ".join(f"try_cast(get(split({part(i)}, ':'), {k}) AS DOUBLE) / {d}" for k, d in enumerate((1, 60, 3600)))
    shape = f"size(split(value, ',')) = 5 AND size(split({part(0)}, ':')) = 3 AND size(split({part(1)}, ':')) = 3"
    rows = lines.selectExpr("*", f"{dms(0)} AS lon", f"{dms(1)} AS lat", *(f"try_cast({part(i)} AS DOUBLE) AS {n}" for i, n in ((2, "alt"), (3, "phi"), (4, "theta"))))
    return rows.selectExpr("*", f"coalesce({shape} AND lon IS NOT NULL AND lat IS NOT NULL AND alt IS NOT NULL AND phi IS NOT NULL AND theta IS NOT NULL, FALSE) AS ok")


def quarantined(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that could not be read."""
    return parsed.where("ok").drop("ok", "value"), parsed.where("NOT ok").select("value")


def read_pose_lines(spark: SparkSession, path: str) -> DataFrame:
    """Parsed poses of text files, a line each."""
    return parse_poses(spark.read.text(path))


def stream_pose_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of the text files that come into a folder."""
    return parse_poses(spark.readStream.text(path))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """CSV of ``id,lon,lat,alt,level``."""
    return spark.read.schema("id LONG, lon DOUBLE, lat DOUBLE, alt DOUBLE, level LONG").csv(path, header=True)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """CSV of ``id,code``."""
    return spark.read.schema("id LONG, code LONG").csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


#: Rows of a file of coverage at most.
FILE_ROWS = 5_000_000


def append_coverage(rows: DataFrame, path: str, job: str) -> None:
    """Append a job's coverage rows (id, timestamp, code, …): files in order of emitter, time and cell.

    Ranges of the whole key are dealt, so an emitter with many rows goes to several tasks and many emitters with few
    share a file; scans skip files and row groups by their limits.  The rows are made once and put aside, for finding
    the ranges reads them too.  A job has a folder of its own, which a repeated run replaces, and a mark that is
    written when all its rows are: ``read_coverage`` sees whole jobs only, each once.
    """
    spark, mark, aside = rows.sparkSession, f"{path}/_done/job={job}", f"{path}/_aside/job={job}"
    _removed(spark, mark)
    rows.write.mode("overwrite").parquet(aside)
    made = spark.read.schema(rows.schema).parquet(aside)
    dealt = made.repartitionByRange("id", "timestamp", "code").sortWithinPartitions("id", "timestamp", "code")
    dealt.write.option("maxRecordsPerFile", FILE_ROWS).mode("overwrite").parquet(f"{path}/job={job}")
    _removed(spark, aside)
    spark.sql(f"SELECT '{job}' AS name").coalesce(1).write.mode("overwrite").parquet(mark)


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all jobs that ended; an error if there is none."""
    jobs = [r.name for r in spark.read.parquet(f"{path}/_done").select("name").collect()]  # a row a job
    return spark.read.option("basePath", path).parquet(*[f"{path}/job={j}" for j in sorted(jobs)]).drop("job")


def _removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def replace_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def comparison_rows(cells: DataFrame) -> DataFrame:
    """Compared cells as they are exported: ten decimals, flags 0 and 1."""
    number = lambda c: F.round(c, 10).alias(c)
    flag = lambda c: F.col(c).cast("int").alias(c)
    return cells.select(number("lon"), number("lat"), number("alt"), flag("visible_mesh"), flag("visible_dem"), flag("disagreement"), F.round("density", 10).alias("power_density"))


def viewshed_lines(cells: DataFrame) -> DataFrame:
    """(eid, row, line, n_visible, n_hidden): each grid row's cells as 0 and 1, in order, with their counts."""
    one = F.coalesce(F.col("visible"), F.lit(False)).cast("int")
    lines = cells.groupBy("eid", F.col("i").alias("row")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", one.alias("v")))), lambda s: s.v.cast("string")), ",").alias("line"),
        F.sum(one).alias("n_visible"),
        F.sum(1 - one).alias("n_hidden"),
    )
    return lines


def write_viewshed(cells: DataFrame, path: str) -> None:
    """Viewsheds as text: a folder for each emitter, a line of 0 and 1 for each grid row, in order within files."""
    lines = viewshed_lines(cells).selectExpr("eid", "row", "line AS value")
    lines.repartitionByRange("eid", "row").sortWithinPartitions("eid", "row").select("eid", "value").write.partitionBy("eid").mode("overwrite").text(path)


def printed(rows: DataFrame, value: str) -> DataFrame:
    """One column ``line``: ``[ts],lon,lat,alt value`` with fixed decimals."""
    return rows.select(F.format_string("[%s],%.6f,%.6f,%.3f %.3f", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "lon", "lat", "alt", value).alias("line"))


def with_sentinel(dem: DataFrame) -> DataFrame:
    """Missing elevations as the exported value."""
    return dem.withColumn("height", F.coalesce("height", F.lit(float(NODATA))))
