"""Similarity of two photos as Column builders over their features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import GroupingConfig

#: Slices of a colour histogram: hue, saturation, value (fixed sizes).
HSV_SIZES = (180, 256, 256)


def seconds_close(a: Column, b: Column, window_s: int | Column) -> Column:
    """Both times known (whole seconds) and at most the window apart; false if one is null."""
    return F.coalesce(F.abs(a - b) <= window_s, F.lit(False))


def within_horizon(a: Column, b: Column, horizon_s: int) -> Column:
    """Whether two photos are compared at all: a time is unknown, or they are less than the horizon apart."""
    return a.isNull() | b.isNull() | (F.abs(a - b) < horizon_s)


def hash_half(hex_text: Column, high: bool) -> Column:
    """32 bits of a 64-bit hexadecimal hash, left-padded to 16 digits, as a long."""
    padded = F.lpad(hex_text, 16, "0")
    return F.conv(F.substring(padded, 1 if high else 9, 8), 16, 10).cast("long")


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Differing bits of two hashes given as lists of long words."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[1:], b[1:], strict=True)), F.bit_count(a[0].bitwiseXOR(b[0])))


def phash_close(a: list[Column], b: list[Column], most: int) -> Column:
    """At most so many bits differ; an unknown or all-zero hash is close to none."""
    known = lambda h: sum(h[1:], h[0]) != 0
    return F.coalesce(known(a) & known(b) & (hamming(a, b) <= most), F.lit(False))


def bhattacharyya(p: Column, q: Column) -> Column:
    """sqrt(1 - sum of sqrt(p * q)) of two histograms; 1 if they are empty or of different lengths."""
    overlap = F.aggregate(F.zip_with(p, q, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(p) == F.size(q)) & (F.size(p) > 0), F.sqrt(F.greatest(F.lit(0.0), 1 - overlap))).otherwise(F.lit(1.0))


def mean_bin(hist: Column) -> Column:
    """Mean index of a normalised histogram."""
    return F.aggregate(F.transform(hist, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)


def hsv_weights(mean_saturation: Column) -> tuple[Column, Column, Column]:
    """Weights of hue, saturation and value, by the smaller mean saturation of the two photos."""
    r = (mean_saturation - 15) / 35
    high, low = mean_saturation >= 50, mean_saturation <= 15
    pick = lambda a, b, c: F.when(high, F.lit(a)).when(low, F.lit(b)).otherwise(c)
    return pick(0.95, 0.0, 0.95 * r), pick(0.03, 0.5, 0.5 - 0.47 * r), pick(0.02, 0.5, 0.5 - 0.48 * r)


def hsv_distance(p: Column, q: Column, sizes: tuple[int, int, int] = HSV_SIZES, scale: float = 1.0) -> Column:
    """Weighted distance of two colour histograms of hue, saturation and value bins; `scale` is the width of a saturation bin."""
    h, s, v = sizes
    parts = [(1, h), (1 + h, s), (1 + h + s, v)]
    cut = lambda c, k: F.slice(c, *parts[k])
    mean = F.least(mean_bin(cut(p, 1)), mean_bin(cut(q, 1))) * scale
    return sum((w * bhattacharyya(cut(p, k), cut(q, k)) for k, w in enumerate(hsv_weights(mean))), F.lit(0.0))


def color_distance(p: Column, q: Column) -> Column:
    """The distance by length: 692 bins are hue, saturation and value; others are compared bin by bin."""
    both = sum(HSV_SIZES)
    return F.when((F.size(p) == both) & (F.size(q) == both), hsv_distance(p, q)).otherwise(bhattacharyya(p, q))


def color_veto(p: Column, q: Column, config: GroupingConfig = GroupingConfig(), distance: Column | None = None) -> Column:
    """Whether colours differ so clearly that nothing else counts; an unknown histogram vetoes nothing."""
    known = p.isNotNull() & q.isNotNull() & (F.size(p) > 0) & (F.size(q) > 0)
    if config.empty_hist == "skip_veto":
        known = known & F.exists(p, lambda x: x > 0) & F.exists(q, lambda x: x > 0)
    return F.coalesce(known & ((color_distance(p, q) if distance is None else distance) > config.max_color_distance), F.lit(False))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs of x, y, w, h); 0 without overlap."""
    w = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    union = a.w * a.h + b.w * b.h - w * h
    return F.when((w <= 0) | (h <= 0) | (union <= 0), F.lit(0.0)).otherwise(w * h / union)


def object_matches(a: Column, b: Column, min_iou: float) -> Column:
    """Number of pairs of objects of one label that overlap enough; an object may count more than once."""
    pairs = F.transform(a, lambda x: F.size(F.filter(b, lambda y: (x.label == y.label) & (iou(x, y) >= min_iou))))
    return F.aggregate(pairs, F.lit(0), lambda s, n: s + n)


def semantic_similar(t_a: Column, t_b: Column, a: Column, b: Column, config: GroupingConfig = GroupingConfig()) -> Column:
    enough = object_matches(a, b, config.semantic_min_iou) >= config.semantic_min_matches
    return seconds_close(t_a, t_b, config.semantic_window_min * 60) & F.coalesce(enough, F.lit(False))


def descriptor_matches(a: Column, b: Column, most: int) -> Column:
    """Rows of a for which some row of b differs in at most `most` bits; a row is an array of long words."""
    near = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, n: s + n) <= most
    return F.size(F.filter(a, lambda x: F.exists(b, lambda y: near(x, y))))


def similar(veto: Column, burst: Column, semantic: Column, orb: Column, phash: Column) -> Column:
    """The composite rule: no veto, and any of the four."""
    return ~veto & (burst | semantic | orb | phash)
