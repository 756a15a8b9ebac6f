"""Import facets: what is switched on by a log of toggles, counts and totals by day, and the import cap found on day counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def switched_on(toggles: DataFrame | None) -> tuple[Column, DataFrame | None]:
    """(condition on the column day, table of days that flip it) after a log of toggles: seq, action, day, day_to.

    Actions: `all` and `clear` switch all days on or off, `range` switches on those from day to day_to (both included) and off the
    others, `toggle` flips one day. Before any of them all days are on. Only the last of the first three and what comes after
    it count, so the log is aggregated, not replayed.
    """
    if toggles is None:
        return F.lit(True), None
    last = toggles.where(F.col("action").isin("all", "clear", "range")).agg(F.max_by(F.struct("action", "day", "day_to"), "seq").alias("x"), F.max("seq").alias("seq")).first()
    flips = toggles.where("action = 'toggle'")
    if last.seq is None:
        return F.lit(True), flips
    flips = flips.where(F.col("seq") > last.seq)
    if last.x.action == "range":
        return F.coalesce(F.col("day").between(F.lit(last.x.day), F.lit(last.x.day_to)), F.lit(False)), flips
    return F.lit(last.x.action == "all"), flips


def import_facets(files: DataFrame, toggles: DataFrame | None = None, most: int = 200, descending: bool = True) -> DataFrame:
    """A row for each day of `files` (day): n_files, chosen, place (in the list's order), selected_total, over_limit, n_imported.

    n_imported is how many files of the day the cap lets through: chosen days go in from the newest on, so whole days do until
    the boundary day, which has what is left. Files without a day are in no facet. The windows run over days, not files.
    """
    on, flips = switched_on(toggles)
    days = files.where("day IS NOT NULL").groupBy("day").agg(F.count(F.lit(1)).alias("n_files")).withColumn("chosen", on)
    if flips is not None:
        odd = flips.groupBy("day").agg((F.count(F.lit(1)) % 2 == 1).alias("odd"))
        days = days.join(odd, "day", "left").withColumn("chosen", F.col("chosen") != F.coalesce("odd", F.lit(False))).drop("odd")
    taken = F.when(F.col("chosen"), F.col("n_files")).otherwise(0)
    newest = Window.orderBy(F.col("day").desc())
    listed = Window.orderBy(F.col("day").desc() if descending else F.col("day"))
    total = F.sum(taken).over(Window.partitionBy())
    before = F.coalesce(F.sum(taken).over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return days.select(
        "day", "n_files", "chosen", F.row_number().over(listed).alias("place"), total.alias("selected_total"), (total > most).alias("over_limit"),
        F.least(taken, F.greatest(F.lit(0), most - before)).alias("n_imported"),
    )


def imported(files: DataFrame, toggles: DataFrame | None = None, most: int = 200) -> DataFrame:
    """The files (day, path and others) that an import takes: chosen days from the newest on, by path within a day, at most `most`.

    The cap is found on the counts of days; whole days are taken as they are, and only the boundary day is put in order.
    """
    facets = import_facets(files, toggles, most).where("n_imported > 0")
    boundary = facets.where("n_imported < n_files").first()  # one day at most
    whole = files.join(F.broadcast(facets.where("n_imported = n_files").select("day")), "day", "left_semi")
    if boundary is None:
        return whole
    rest = files.where(F.col("day") == F.lit(boundary.day)).orderBy("path").limit(boundary.n_imported)
    return whole.unionByName(rest)
