"""The compare set replayed from a log of presses, long logs in segments."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..lineage import cut
from .numbering import rank_in_group

#: Presses of a segment, and photos that are compared at most.
SEGMENT, MOST = 4096, 4


def press(held: list, key, mouse: bool, most: int) -> tuple[str, object]:
    """One press on the set `held`, which it changes: what it did, and the key it drove out. A key that is held goes; else a mouse drives out
    the oldest of a full set, and the keyboard leaves a full set as it is. No key is no press."""
    if key is None:
        return "ignored", None
    if key in held:
        held.remove(key)
        return "removed", None
    if len(held) >= most and not mouse:
        return "ignored", None
    out = held.pop(0) if len(held) >= most else None
    held.append(key)
    return "added", out


def replayed(log: DataFrame, by: str, order: list[Column], key: str = "key", mouse: str = "mouse", most: int = MOST, segment: int = SEGMENT) -> DataFrame:
    """`log` with action (added, removed, ignored), evicted (the key driven out, or null) and held (the set after the press, oldest first), for
    each `by` from an empty set, in the order, which should be total. `mouse` tells a press by mouse (null: not). Rows whose `by` is
    null are one log.

    A log is cut into segments of `segment` presses, replayed by different tasks from guessed sets: first from an empty one, then from
    what the segment before ended with, until no guess was wrong. Only segments whose guess changed are replayed again, and
    only their number reaches the driver. Logs of one segment take one pass. A set forgets what it held after a few presses by
    mouse, so two or three rounds are usual; where keys are held throughout, a round for each segment is the worst case.
    """
    placed = rank_in_group(log, by, order, "__nth")
    kind = log.schema[key].dataType
    placed = cut(placed.withColumn("__segment", F.floor((F.col("__nth") - 1) / segment)).withColumn("__by", F.col(by)))
    many = placed.agg(F.max("__segment").alias("n")).first().n or 0
    none, columns = F.lit(None).cast(ArrayType(kind)), list(log.columns)

    def rows_of(t: pa.Table) -> tuple[pa.Table, list, list, list]:
        t = t.sort_by("__nth")
        start = t.column("__start")[0].as_py()
        return t, list(start or ()), t.column(key).to_pylist(), t.column(mouse).to_pylist()

    def ends(t: pa.Table) -> pa.Table:
        t, held, keys, by_mouse = rows_of(t)
        for k, m in zip(keys, by_mouse):
            press(held, k, bool(m), most)
        return pa.table([t.column("__by").slice(0, 1), t.column("__segment").slice(0, 1), pa.array([held], pa.list_(t.schema.field(key).type))], names=["__by", "__segment", "end"])

    def told(t: pa.Table) -> pa.Table:
        t, held, keys, by_mouse = rows_of(t)
        done = []
        for k, m in zip(keys, by_mouse):
            done.append((*press(held, k, bool(m), most), list(held)))
        value = t.schema.field(key).type
        more = [pa.array([x[i] for x in done], x_kind) for i, x_kind in enumerate((pa.string(), value, pa.list_(value)))]
        return pa.table([*(t.column(c) for c in columns), *more], names=[*columns, "action", "evicted", "held"])

    by_segment = [F.col("__by"), F.col("__segment")]
    fields = [StructField("__by", log.schema[by].dataType), StructField("__segment", LongType())]
    with_start = placed.withColumn("__start", none)
    if many:
        same = F.col("__by").eqNullSafe(F.col("__of")) & (F.col("__segment") == F.col("__at"))
        schema = StructType([*fields, StructField("end", ArrayType(kind))])
        narrow = placed.select("__by", "__segment", "__nth", key, mouse)
        known = cut(narrow.withColumn("__start", none).groupBy(*by_segment).applyInArrow(ends, schema).withColumn("__start", none))
        while True:
            # What a segment should start with is what the one before ended with.
            before = known.select(F.col("__by").alias("__of"), (F.col("__segment") + 1).alias("__at"), F.col("end").alias("right"))
            met = known.join(before, same, "left").drop("__of", "__at")
            wrong = cut(met.where(~F.coalesce("right", F.array().cast(ArrayType(kind))).eqNullSafe(F.coalesce("__start", F.array().cast(ArrayType(kind))))).select(*by_segment, F.col("right").alias("__start")))
            if not wrong.count():
                break
            asked = wrong.select(F.col("__by").alias("__of"), F.col("__segment").alias("__at"), "__start")
            again = narrow.join(asked, same).drop("__of", "__at").groupBy(*by_segment).applyInArrow(ends, schema)
            new = again.select(F.col("__by").alias("__of"), F.col("__segment").alias("__at"), F.col("end").alias("new_end")).join(asked.withColumnsRenamed({"__of": "o", "__at": "s", "__start": "new_start"}), F.col("__of").eqNullSafe(F.col("o")) & (F.col("__at") == F.col("s"))).drop("o", "s")
            fixed = known.join(new, same, "left")
            known = cut(fixed.select(*by_segment, F.when(F.col("__at").isNotNull(), F.col("new_end")).otherwise(F.col("end")).alias("end"), F.when(F.col("__at").isNotNull(), F.col("new_start")).otherwise(F.col("__start")).alias("__start")))
        starts = known.select(F.col("__by").alias("__of"), F.col("__segment").alias("__at"), "__start")
        with_start = placed.join(starts, same).drop("__of", "__at")
    schema = StructType([*log.schema.fields, StructField("action", StringType()), StructField("evicted", kind), StructField("held", ArrayType(kind))])
    return with_start.groupBy(*by_segment).applyInArrow(told, schema)
