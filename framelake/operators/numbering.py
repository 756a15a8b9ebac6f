"""Numbering and islands over a total order, by a prefix scan over range partitions.

Rows are dealt out by ranges of the order, sorted and numbered inside each part; a summary of each part (how many rows or
islands it has, its first and last time) is scanned over the short list of parts, and its carry added to the part's rows. A part
is a range of the whole order with its tie-breaks, so one day, one second or one group with all the rows spreads over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..lineage import cut

#: Bits of monotonically_increasing_id that number the rows of a part.
WITHIN = 33
#: Tasks that the rows of one group go to when they are joined with what is known of the group.
SALTS = 256


def _sorted(rows: DataFrame, order: list[Column]) -> DataFrame:
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())


def _part() -> Column:
    return F.shiftright("__at", WITHIN)


def _before(name: str) -> Column:
    """Sum over the parts before this one; there are as many parts as tasks."""
    return F.coalesce(F.sum(name).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def ordinal(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` with their number from 1 in the order, which should be total: of rows that are equal in it, any may come first."""
    placed = cut(_sorted(rows, order))
    sizes = placed.groupBy(_part().alias("__part")).agg(F.count(F.lit(1)).alias("__n")).select("__part", _before("__n").alias("__before"))
    within = F.col("__at").bitwiseAND(F.lit((1 << WITHIN) - 1))
    met = placed.join(F.broadcast(sizes), _part() == F.col("__part"))
    return met.withColumn(name, F.col("__before") + within + 1).drop("__at", "__part", "__before")


def rank_in_group(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """`rows` with their number from 1 in their group, by the order. A group's rows are ranged over many tasks where they are many."""
    placed = ordinal(rows, [F.col(group), *order], "__number")
    starts = placed.groupBy(F.col(group).alias("__group")).agg(F.min("__number").alias("__start"))
    return placed.join(starts, F.col(group).eqNullSafe(F.col("__group"))).withColumn(name, F.col("__number") - F.col("__start") + 1).drop("__number", "__group", "__start")


def spread_join(rows: DataFrame, values: DataFrame, on: str, key: str = "key") -> DataFrame:
    """`rows` with the columns of `values`, which has one row for each value of `on`. Rows are dealt out by `on` and a salt of their key, so one value
    with all the rows goes to `SALTS` tasks; only the values are copied, to the salts that rows have."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    few = salted.select(on, "__salt").distinct().join(values, on)
    return salted.join(few, [on, "__salt"]).drop("__salt")


def islands(rows: DataFrame, gap_s: int, t: str = "t", key: str = "key", name: str = "island") -> DataFrame:
    """Timed rows with the number of their island: rows at most `gap_s` from the one before are in its island."""
    timed = _sorted(rows.where(F.col(t).isNotNull()), [F.col(t), F.col(key)])
    at = timed.columns.index(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds how many islands have begun in the part after its first row."""
        last, begun = None, 0
        for b in batches:
            if b.num_rows:
                times = b.column(at).to_numpy().astype(np.int64)
                begins = np.diff(times, prepend=times[0] if last is None else last) > gap_s
                numbers = begun + np.cumsum(begins)
                last, begun = times[-1], int(numbers[-1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64())], names=[*b.schema.names, "__begun"])

    placed = cut(timed.mapInArrow(run, StructType([*timed.schema.fields, StructField("__begun", LongType())])))
    parts = placed.groupBy(_part().alias("__part")).agg(F.min(t).alias("first"), F.max(t).alias("last"), F.max("__begun").alias("begun"))
    fresh = F.coalesce(F.col("first") - F.lag("last").over(Window.orderBy("__part")) > gap_s, F.lit(True)).cast("long")
    parts = parts.withColumn("fresh", fresh).withColumn("all", F.col("begun") + F.col("fresh"))
    parts = parts.select("__part", (_before("all") + F.col("fresh")).alias("__before"))
    met = placed.join(F.broadcast(parts), _part() == F.col("__part"))
    return met.withColumn(name, F.col("__before") + F.col("__begun")).drop("__at", "__begun", "__part", "__before")
