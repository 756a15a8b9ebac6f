"""Photos joined with features and detections, updates, and look-ups by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_features(photos: DataFrame, features: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """Inner join on the key; of features that repeat a key the one of the highest version counts."""
    value = F.struct(*[c for c in features.columns if c != key])
    latest = features.groupBy(key).agg(F.max_by(value, F.col(version)).alias("f")).select(key, "f.*").drop(version)
    return photos.join(latest, key)


def updated(rows: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """Rows with new values where `changes` has any; a null changes nothing."""
    new = changes.select(key, *[F.col(c).alias(f"__new_{c}") for c in changes.columns if c != key])
    met = rows.join(new, key, "left")
    return met.select(key, *[F.coalesce(f"__new_{c}", c).alias(c) if f"__new_{c}" in met.columns else F.col(c) for c in rows.columns if c != key])


def known(keys: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """Rows of the keys that exist."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def without(rows: DataFrame, *taken: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key is in none of the tables: what is in flight, done, or no longer there."""
    for other in taken:
        rows = rows.join(other.select(key), key, "left_anti")
    return rows


def toggled(chosen: DataFrame, flips: DataFrame, key: str = "key") -> DataFrame:
    """Symmetric difference of two sets of keys."""
    both = chosen.select(key).distinct().union(flips.select(key).distinct())
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select(key)


def enriched(entries: DataFrame, detections: DataFrame, key: str = "key", object_roi_override: bool = True) -> DataFrame:
    """Entries with their largest object (the first of equals); its region's sharpness replaces theirs where positive."""
    area = F.col("w") * F.col("h")
    largest = detections.where("kind = 'object'").groupBy(key).agg(F.max_by(F.struct("label", "x", "y", "w", "h", "roi_sharpness"), F.struct(area, -F.col("ord"))).alias("object"))
    met = entries.join(largest, key, "left")
    if object_roi_override:
        met = met.withColumn("sharpness", F.coalesce(F.when(F.col("object.roi_sharpness") > 0, F.col("object.roi_sharpness")), "sharpness"))
    return met


def normalised_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, label: Column) -> Column:
    """A box relative to its image, each side within 0 and 1; without a label it is an `Object`."""
    unit = lambda a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), a / b))
    return F.struct(F.coalesce(label, F.lit("Object")).alias("label"), unit(x, width).alias("x"), unit(y, height).alias("y"), unit(w, width).alias("w"), unit(h, height).alias("h"))


def compared(rows: DataFrame, by: str, order: str, most: int = 4, key: str = "key") -> DataFrame:
    """The compare set of each `by`: the last `most` keys chosen, as a fifth drops the oldest."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc(), F.col(key).desc()))
    return rows.withColumn("slot", place).where(F.col("slot") <= most)


def united(*chosen: DataFrame, key: str = "key") -> DataFrame:
    """Keys that are in any of the tables, each once."""
    out = chosen[0].select(key)
    for other in chosen[1:]:
        out = out.union(other.select(key))
    return out.distinct()


def owning_group(keys: DataFrame, members: DataFrame, key: str = "key", group: str = "component") -> DataFrame:
    """(key, group) of the keys that a group holds; of several groups the first."""
    return keys.select(key).distinct().join(members.groupBy(key).agg(F.min(group).alias(group)), key)


def resized(width: Column, height: Column, most: int = 640) -> Column:
    """Width and height (a struct) of an image whose longer side is brought down to `most`; smaller images stay."""
    longer = F.greatest(width, height)
    side = lambda v: F.when(longer <= most, v).when(v == longer, most).otherwise(F.round(v * most / longer)).cast("int")
    return F.struct(side(width).alias("w"), side(height).alias("h"))


def pixel_region(x: Column, y: Column, w: Column, h: Column, seen: Column, width: Column, height: Column) -> Column:
    """A box found on an image of the size `seen` (struct of w and h) as a region of the original: rounded, inside it, at least a pixel."""
    held = lambda v, low, high: F.greatest(low, F.least(high, F.round(v).cast("int")))
    rx = held(x / seen.w * width, F.lit(0), width - 1)
    ry = held(y / seen.h * height, F.lit(0), height - 1)
    return F.struct(rx.alias("x"), ry.alias("y"), held(w / seen.w * width, F.lit(1), width - rx).alias("w"), held(h / seen.h * height, F.lit(1), height - ry).alias("h"))


def selection_summary(members: DataFrame, selected: DataFrame, group: str = "component", key: str = "key") -> DataFrame:
    """One row: photos, with_face, selected (of the photos that are left) and groups."""
    met = members.join(selected.select(key, F.lit(True).alias("__on")).distinct(), key, "left")
    counts = met.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("face") > 0).alias("f"), F.count("__on").alias("s"))
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n", "photos"), ("f", "with_face"), ("s", "selected"))], F.count(F.lit(1)).alias("groups"))
