"""Group attributes, best-shot scores and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RankConfig
from .numbering import ordinal, spread_join


def iso_adjusted(sharpness: Column, iso: Column, config: RankConfig = RankConfig()) -> Column:
    """Sharpness held down above the knee, where noise looks like detail."""
    return F.when(iso > config.iso_knee, sharpness / (1 + (iso - config.iso_knee) * F.lit(config.iso_slope))).otherwise(sharpness)


def burst_flag(n_timed: Column, first: Column, last: Column, window_s: int) -> Column:
    """Two photos with a time or more, all within the window."""
    return F.coalesce((n_timed >= 2) & (last - first <= window_s), F.lit(False))


def best_score(is_burst: Column, s: Column, exposure: Column, face: Column) -> Column:
    """Bursts go by sharpness alone; groups with a face by face, sharpness and exposure; others by sharpness and exposure."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    x, f = unit(exposure), unit(face)
    return F.when(is_burst, s).when(f > 0, 0.6 * f + 0.35 * s + 0.05 * x).otherwise(0.8 * s + 0.2 * x)


def with_scores(members: DataFrame, group: str = "component", is_burst: str = "is_burst", config: RankConfig = RankConfig()) -> DataFrame:
    """`members` (sharpness, iso, exposure, face) with s_norm, relative to the sharpest of the group, and score."""
    adjusted = members.withColumn("adjusted", iso_adjusted(F.col("sharpness"), F.col("iso"), config))
    top = F.greatest(F.lit(config.min_group_max), F.max("adjusted").over(Window.partitionBy(group)))
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("adjusted") / top))
    scored = adjusted.withColumn("s_norm", unit)
    return scored.withColumn("score", best_score(F.col(is_burst), F.col("s_norm"), F.col("exposure"), F.col("face")))


def with_group_scores(members: DataFrame, groups: DataFrame, config: RankConfig = RankConfig()) -> DataFrame:
    """The same for members and groups (component, is_burst), whatever their sizes: the sharpest of a group is aggregated and
    joined, so no group's members need to meet."""
    adjusted = members.withColumn("adjusted", iso_adjusted(F.col("sharpness"), F.col("iso"), config))
    top = adjusted.groupBy("component").agg(F.greatest(F.lit(config.min_group_max), F.max("adjusted")).alias("__top")).join(groups.select("component", "is_burst"), "component")
    met = spread_join(adjusted, top, "component")
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("adjusted") / F.col("__top")))
    return met.withColumn("s_norm", unit).withColumn("score", best_score(F.col("is_burst"), F.col("s_norm"), F.col("exposure"), F.col("face"))).drop("__top")


def ranked(scored: DataFrame, group: str = "component", order: str = "input_ord") -> DataFrame:
    """Rank in the group, best first; ties by input order."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col("score").desc(), F.col(order))))


def best_of(scored: DataFrame, group: str = "component", order: str = "input_ord", key: str = "key") -> DataFrame:
    """(group, best_key, best_score) of what `ranked` puts first, as an aggregate: no group is put in order."""
    first = F.max(F.struct(F.col("score"), (-F.col(order)).alias("o"), F.col(key).alias("k"))).alias("b")
    return scored.groupBy(group).agg(first).select(group, F.col("b.k").alias("best_key"), F.col("b.score").alias("best_score"))


def groups_of(members: DataFrame, window_s: int, group: str = "component", t: str = "t", order: str = "input_ord") -> DataFrame:
    """One row per group: size, number with a time, earliest and latest time, first place in the input, is_burst."""
    found = members.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.count(t).alias("n_timed"), F.min(t).alias("earliest"), F.max(t).alias("latest"), F.min(order).alias("first_ord"))
    return found.withColumn("is_burst", burst_flag(F.col("n_timed"), F.col("earliest"), F.col("latest"), window_s))


def numbered(groups: DataFrame) -> DataFrame:
    """Groups with group_id G1, G2 ... by first place in the input, and position: by earliest time, unknown last."""
    ids = ordinal(groups, [F.col("first_ord")], "__id")
    named = ids.withColumn("group_id", F.concat(F.lit("G"), F.col("__id").cast("string")))
    return ordinal(named, [F.col("earliest").asc_nulls_last(), F.col("__id")], "position").drop("__id")


def portrait_keys(photos: DataFrame, has_face: str = "has_face", t: str = "t") -> DataFrame:
    """Sort keys of the portrait list: faces first, then time, unknown as the epoch."""
    return photos.withColumn("face_key", F.when(F.col(has_face), 0).otherwise(1)).withColumn("time_key", F.coalesce(t, F.lit(0).cast("long")))


def best_or_first(groups: DataFrame, members: DataFrame, group: str = "component") -> DataFrame:
    """(group, key) to show for each group: its best while that is a member, else the first member by input order."""
    first = members.groupBy(group).agg(F.min_by("key", "input_ord").alias("first_key"))
    best = groups.select(group, F.col("best_key").alias("key")).join(members.select(group, "key"), [group, "key"], "left_semi")
    return first.join(best, group, "left").select(group, F.coalesce("key", "first_key").alias("key"))
