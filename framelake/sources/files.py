"""Photo files as tables: listings first, contents only of what was chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PHOTO_SUFFIXES
from ..functions.scalar import suffix


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mtime, length, ext, day) of all photos under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return listed(files.select("path", F.col("modificationTime").alias("mtime"), "length"))


def listed(files: DataFrame) -> DataFrame:
    """Files (path, mtime, ...) whose suffix is a photo's, with suffix and day."""
    found = files.withColumn("ext", suffix(F.col("path"))).where(F.col("ext").isin(*PHOTO_SUFFIXES))
    return found.withColumn("day", F.to_date("mtime"))


def day_facets(files: DataFrame) -> DataFrame:
    return files.groupBy("day").agg(F.count(F.lit(1)).alias("n_files"))


def chosen(files: DataFrame, days: list | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Files of the days that are switched on and within the dates, both included."""
    keep: Column = F.lit(True)
    if days is not None:
        keep = keep & F.col("day").isin(*days)
    if start is not None:
        keep = keep & (F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        keep = keep & (F.col("day") <= F.lit(end).cast("date"))
    return files.where(keep)


def capped(files: DataFrame, most: int = 200) -> DataFrame:
    """The import cap: newest days first, by path within a day."""
    return files.orderBy(F.col("day").desc(), "path").limit(most)


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Contents of chosen files: key, path, length, content."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.concat(F.lit("file:"), "path").alias("key"), "path", "length", "content")


def load_selected(chosen: DataFrame, folder: str) -> DataFrame:
    """Contents of the files under `folder` that the table `chosen` (path) names: key, path, length, content.

    The listing is joined with the table, so no list of paths passes through the driver; contents of other files are not kept.
    """
    spark = chosen.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    wanted = files.join(chosen.select("path").distinct(), "path", "left_semi")
    return wanted.select(F.concat(F.lit("file:"), "path").alias("key"), "path", "length", "content")
