"""What to copy, move or delete, as tables. Nothing here touches a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import base_name, dir_name, folder_name_ok


#: A file's stem and suffix, and the stem and number of a name that looks as if it had been given one.
STEM, NUMBERED = r"^(.*?)(\.[^.]*)?$", r"^(.*)_([1-9][0-9]{0,8})(\.[^.]*)?$"


def _named(rows: DataFrame, existing: DataFrame | None, order: str) -> DataFrame:
    """`rows` (key, src, dir) with dst: the file's name, with _1, _2 ... before its suffix where a name is taken.

    Names that the folder already has (`existing`: dir, name) and the own names of other rows count as taken, so no two rows
    get one name and none gets a name that is there. Of rows of one name the first in `order` keeps it if it is free.
    """
    named = rows.withColumn("name", base_name(F.col("src")))
    held = named.select("dir", "name").limit(0) if existing is None else existing.select("dir", "name").distinct()
    place = Window.partitionBy("dir", "name").orderBy(order)
    met = named.withColumn("nth", F.row_number().over(place)).join(held.withColumn("held", F.lit(1)), ["dir", "name"], "left")
    met = met.withColumn("nth", F.col("nth") - F.when(F.col("held").isNull(), 1).otherwise(0))  # 0 keeps the name
    stem = [F.regexp_extract("name", STEM, i) for i in (1, 2)]
    parts = [F.regexp_extract("name", NUMBERED, i) for i in (1, 2, 3)]
    both = named.select("dir", "name").union(held).where(F.col("name").rlike(NUMBERED)).distinct()
    used = both.select("dir", parts[0].alias("stem"), parts[2].alias("suffix"), parts[1].cast("long").alias("number"))
    # As many numbers as rows need and names have; those that no name has, in order.
    asked = met.where("nth > 0").groupBy("dir", "name").agg(F.max("nth").cast("long").alias("most")).select("dir", "name", stem[0].alias("stem"), stem[1].alias("suffix"), "most")
    room = used.groupBy("dir", "stem", "suffix").agg(F.count(F.lit(1)).alias("n"))
    tried = asked.join(room, ["dir", "stem", "suffix"], "left").withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most") + F.coalesce("n", F.lit(0)))))
    free = tried.join(used, ["dir", "stem", "suffix", "number"], "left_anti").withColumn("nth", F.row_number().over(Window.partitionBy("dir", "name").orderBy("number"))).select("dir", "name", "nth", "number")
    unique = F.when(F.col("nth") == 0, F.col("name")).otherwise(F.concat(stem[0], F.lit("_"), F.col("number").cast("string"), stem[1]))
    return met.join(free, ["dir", "name", "nth"], "left").withColumn("dst", F.concat("dir", F.lit("/"), unique)).drop("name", "nth", "held", "dir", "number")


def export_plan(best: DataFrame, photos: DataFrame, folder: str, existing: DataFrame | None = None, order: str = "key") -> DataFrame:
    """(key, src, dst): each group's best photo that has a path, copied into one folder."""
    rows = best.select("key").join(photos.where(F.col("path").isNotNull()), "key").select("key", F.col("path").alias("src"), F.lit(folder).alias("dir"))
    return _named(rows, existing, order)


def filing_plan(wanted: DataFrame, photos: DataFrame, copy: bool = True, existing: DataFrame | None = None) -> DataFrame:
    """(key, action, src, dst): photos of `wanted` (key, folder) that have a path go to that folder beside the photo."""
    rows = wanted.join(photos.where(F.col("path").isNotNull()), "key")
    placed = rows.select("key", F.lit("copy" if copy else "move").alias("action"), F.col("path").alias("src"), F.concat(dir_name(F.col("path")), F.lit("/"), F.col("folder")).alias("dir"))
    return _named(placed, existing, "key").select("key", "action", "src", "dst")


def filing_report(wanted: DataFrame, photos: DataFrame, failed: DataFrame) -> DataFrame:
    """(key, outcome) of what was asked: failed (its path is among `failed`), skipped (no path), or done."""
    met = wanted.select("key").join(photos.select("key", "path"), "key", "left").join(failed.select("path", F.lit(True).alias("bad")).distinct(), "path", "left")
    return met.select("key", F.when(F.col("path").isNull(), "skipped").when(F.col("bad"), "failed").otherwise("done").alias("outcome"))


def all_but_best(members: DataFrame, best: DataFrame, group: str = "component") -> DataFrame:
    """Members that are not their group's best."""
    return members.join(best.select(group, F.col("key").alias("best_key")), group).where(F.col("key") != F.col("best_key"))


def delete_plan(chosen: DataFrame, photos: DataFrame, unmarked: DataFrame | None = None, in_flight: DataFrame | None = None) -> DataFrame:
    """(key, path) to move to the trash: chosen, not unmarked in the review, not in flight, and with a path."""
    rows = chosen.select("key").distinct()
    for other in (unmarked, in_flight):
        if other is not None:
            rows = rows.join(other.select("key"), "key", "left_anti")
    return rows.join(photos.where(F.col("path").isNotNull()).select("key", "path"), "key")


def pruned(members: DataFrame, processed: DataFrame) -> DataFrame:
    """Members that are left; groups without any are gone, and the rest must be ranked again."""
    return members.join(processed.select("key"), "key", "left_anti")


def filing_outcome(wanted: DataFrame, photos: DataFrame, job: str = "job", order: str = "ord", unwritable: DataFrame | None = None, missing: DataFrame | None = None, faulty: DataFrame | None = None) -> DataFrame:
    """(job, key, src, outcome): how each job's filing ends when its photos are taken one after the other.

    `wanted` has job, key and ord; photos without a path are not taken on and have no row. A job of which any folder (`unwritable`: dir)
    cannot be written is `refused` whole. Else sources that are gone (`missing`: path) are `missing` and the job goes on, the first that
    fails (`faulty`: path) is `failed` and ends it, and what comes after is `not_reached`; the others are `done`. Ties in ord go by
    key. Nothing is run in order: the least failing place of a job, an aggregate, splits it. Null jobs are one job.
    """
    paths = photos.where(F.col("path").isNotNull()).select("key", F.col("path").alias("src"))
    rows = wanted.select(F.col(job).alias("job"), "key", F.col(order).alias("ord")).join(paths, "key")

    def among(rows: DataFrame, other: DataFrame | None, column: str, value, name: str) -> DataFrame:
        if other is None:
            return rows.withColumn(name, F.lit(False))
        return rows.withColumn("__v", value).join(other.select(F.col(column).alias("__v"), F.lit(True).alias(name)).distinct(), "__v", "left").drop("__v").withColumn(name, F.coalesce(name, F.lit(False)))

    rows = among(rows, unwritable, "dir", dir_name(F.col("src")), "closed")
    rows = among(rows, missing, "path", F.col("src"), "gone")
    rows = among(rows, faulty, "path", F.col("src"), "bad")
    place = F.struct("ord", "key")
    jobs = rows.groupBy(F.col("job").alias("__job")).agg(F.max("closed").alias("refused"), F.min(F.when(F.col("bad") & ~F.col("gone"), place)).alias("stop"))
    met = rows.join(jobs, F.col("job").eqNullSafe(F.col("__job")))
    after = F.coalesce(place > F.col("stop"), F.lit(False))
    at = F.coalesce(place == F.col("stop"), F.lit(False))
    outcome = F.when(F.col("refused"), "refused").when(after, "not_reached").when(at, "failed").when(F.col("gone"), "missing").otherwise("done")
    return met.select("job", "key", "src", outcome.alias("outcome"))


def accepted_folders(names: DataFrame, by: str, order: str, name: str = "name", most: int = 10) -> DataFrame:
    """(by, folder, place): the folders that each `by` has after asking for names in the order: trimmed, valid, each once, the first `most`."""
    trimmed = F.trim(F.col(name))
    first = names.where(folder_name_ok(F.col(name))).groupBy(by, trimmed.alias("folder")).agg(F.min(order).alias("__first"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("__first", "folder"))
    return first.withColumn("place", place).where(F.col("place") <= most).drop("__first")
