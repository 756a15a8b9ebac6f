"""The colour veto at full width: a lower bound from few merged bins settles most pairs, whole histograms the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GroupingConfig
from ..functions.similarity import HSV_SIZES, hsv_weights, mean_bin
from ..lineage import cut

#: Merged bins of hue, saturation and value; of other histograms as many as these together.
MERGED = (6, 5, 5)
#: What rounding may add to a bound.
SLACK = 1e-9


def _roots(hist: Column) -> Column:
    return F.transform(hist, lambda v: F.sqrt(v.cast("double")))


def _merged(hist: Column, n: int, width: Column | int) -> Column:
    """Roots of the sums of n runs of `width` bins; runs beyond the end are empty."""
    width = F.lit(width)
    sums = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(F.slice(hist, (i * width + 1).cast("int"), width.cast("int")), F.lit(0.0), lambda s, v: s + v.cast("double")))
    return _roots(sums)


def color_features(photos: DataFrame, key: str = "key", hist: str = "hist") -> DataFrame:
    """(key, bins, few, saturation, filled) of the photos with a histogram of one bin or more: number of bins, roots of the merged bins, mean saturation
    (of whole HSV histograms), whether any bin is filled. Narrow; the roots of all bins are worked out where they are needed."""
    h, s, v = HSV_SIZES
    c = F.col(hist)
    parts = [F.slice(c, 1, h), F.slice(c, 1 + h, s), F.slice(c, 1 + h + s, v)]
    whole = F.size(c) == h + s + v
    merged = F.concat(*[_merged(p, n, -(-size // n)) for p, n, size in zip(parts, MERGED, HSV_SIZES, strict=True)])
    few = F.when(whole, merged).otherwise(_merged(c, sum(MERGED), F.ceil(F.size(c) / sum(MERGED))))
    rows = photos.where(c.isNotNull() & (F.size(c) > 0))
    return rows.select(key, F.size(c).alias("bins"), few.alias("few"), F.when(whole, mean_bin(parts[1])).alias("saturation"), F.exists(c, lambda x: x > 0).alias("filled"))


def _distance(p: Column, q: Column) -> Column:
    """Bhattacharyya distance of two histograms given by their roots; of merged bins it is never more than of the bins."""
    return F.sqrt(F.greatest(F.lit(0.0), 1 - F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)))


def _whole_distance(p: Column, q: Column, bins: Column, saturation: Column, sizes: tuple[int, int, int]) -> Column:
    ends = [0, sizes[0], sizes[0] + sizes[1]]
    cut = lambda c, k: F.slice(c, ends[k] + 1, sizes[k])
    hsv = sum((w * _distance(cut(p, k), cut(q, k)) for k, w in enumerate(hsv_weights(saturation))), F.lit(0.0))
    return F.when(bins == sum(HSV_SIZES), hsv).otherwise(_distance(p, q))


def _state(a: Column, b: Column, config: GroupingConfig) -> Column:
    """By the features of two photos (structs, null without a histogram): 1 if their colours veto the pair for sure, 0 if they do not, null
    if only all bins can tell."""
    bound = _whole_distance(a.few, b.few, a.bins, F.least(a.saturation, b.saturation), MERGED)
    skipped = ~(a.filled & b.filled) if config.empty_hist == "skip_veto" else F.lit(False)
    most = config.max_color_distance
    unknown = a.bins.isNull() | b.bins.isNull()
    return F.when(unknown | skipped, 0).when(a.bins != b.bins, F.lit(int(1.0 > most))).when(bound > most + SLACK, 1)


def surely_vetoed(a: Column, b: Column, config: GroupingConfig = GroupingConfig()) -> Column:
    return F.coalesce(_state(a, b, config) == 1, F.lit(False))


def bounded(pairs: DataFrame, features: DataFrame, config: GroupingConfig = GroupingConfig(), key: str = "key") -> DataFrame:
    """`pairs` (a, b and others) with state: 1 if the colours veto the pair for sure, 0 if they do not, null if only all bins can tell."""
    side = lambda c: features.select(F.col(key).alias(c), F.struct("bins", "few", "saturation", "filled").alias(f"__{c}"))
    met = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    a, b = F.col("__a"), F.col("__b")
    return met.withColumn("state", _state(a, b, config)).withColumn("saturation", F.least(a.saturation, b.saturation)).drop("__a", "__b")


def settled(open_pairs: DataFrame, photos: DataFrame, config: GroupingConfig = GroupingConfig(), key: str = "key", hist: str = "hist") -> DataFrame:
    """`open_pairs` (as `bounded` leaves them) with veto, from all bins of both photos."""
    side = lambda c: photos.select(F.col(key).alias(c), _roots(F.col(hist)).alias(f"__{c}"))
    met = open_pairs.join(side("a"), "a").join(side("b"), "b")
    distance = _whole_distance(F.col("__a"), F.col("__b"), F.size("__a"), F.col("saturation"), HSV_SIZES)
    return met.withColumn("veto", distance > config.max_color_distance).drop("__a", "__b")


def with_veto(pairs: DataFrame, photos: DataFrame, config: GroupingConfig = GroupingConfig(), key: str = "key", hist: str = "hist") -> DataFrame:
    """`pairs` (a, b and others) with veto: whether the colours of the photos differ so clearly that nothing else counts.

    Only the keys of the pairs and few bins of each photo are moved for all of them; whole histograms follow, by key, for the
    pairs that few bins leave open. Photos without a histogram veto nothing.
    """
    told = cut(bounded(pairs, color_features(photos, key, hist), config, key))  # narrow, and read twice
    sure = told.where("state IS NOT NULL").withColumn("veto", F.col("state") == 1)
    return sure.unionByName(settled(told.where("state IS NULL"), photos, config, key, hist)).drop("state", "saturation")
