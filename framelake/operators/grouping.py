"""Photos to groups in one call: pairs judged where they meet, then components, numbers and ranks.

Photos near in time meet in blocks with all that the rule looks at, those without a time meet all; a task keeps the links alone, and for
groups no more of them than join what it found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GroupingConfig, RankConfig
from ..lineage import cut
from . import cluster, colors, judges, rank
from .blocks import CROWDED, judged_pairs
from .hashes import hash_links
from .numbering import rank_in_group

#: What the rule looks at, besides key and time.
FEATURES = ("high", "low", "hist", "objects", "descriptors")


def _narrow(photos: DataFrame, key: str) -> DataFrame:
    """What hashes are looked up by."""
    has = lambda c: (F.coalesce(F.size(c), F.lit(0)) if c in photos.columns else F.lit(0)).alias(f"n_{c}")
    return photos.select(F.col(key).alias("key"), "t", "high", "low", has("descriptors"))


def _untimed(photos: DataFrame, config: GroupingConfig) -> DataFrame:
    """(a, b): photos of close hashes, one of them at least without a time; a is one without, the smaller key of two. Without descriptors, hashes
    alone link such photos, and are looked up."""
    narrow = _narrow(photos, "key")
    asked = narrow.where("t IS NULL")
    found = hash_links(asked, narrow, config.max_phash).join(asked.select(F.col("key").alias("y"), F.lit(True).alias("both")), "y", "left")
    found = found.where("both IS NULL OR x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return colors.with_veto(found, photos, config).where("NOT veto").drop("veto") if "hist" in photos.columns else found


def photo_links(photos: DataFrame, config: GroupingConfig = GroupingConfig(), key: str = "key", linking: bool = False, crowded: int = CROWDED) -> DataFrame:
    """(a, b): pairs of similar photos by the composite rule, a the earlier one (one without a time first, then the smaller key). With `linking` some
    links, at most one for each photo of a task, with the same components.

    `photos`: key, t (seconds or null), high and low (halves of the hash or null), and where they exist hist, objects (array of ord, label,
    x, y, w, h) and descriptors (array of arrays of words); a missing column is as if all its values were null.
    """
    columns = {c for c in FEATURES if c in photos.columns}
    rows = photos.select(F.col(key).alias("key"), "t", F.col("t").cast("long").alias("time"), *sorted(columns))
    by_all = "descriptors" in columns
    links = judged_pairs(rows, config.horizon_s, ["time", *sorted(columns)], judges.composite(config, columns), "", untimed=by_all, forest=linking, crowded=crowded)
    return links if by_all else links.union(_untimed(rows, config))


def group_photos(photos: DataFrame, config: GroupingConfig = GroupingConfig(), ranks: RankConfig = RankConfig(), key: str = "key", crowded: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of `photos`, which have the columns of `photo_links` and input_ord, sharpness, iso, exposure, face.

    groups: group_id (G1, G2 ... by first place in the input), position (by earliest time, unknown last), size, n_timed, earliest, latest,
    is_burst, best_key. members: key, group_id, position, is_burst, adjusted, s_norm, score, rank (best first, ties by input). Photos
    similar to none are groups of one. Keys are unique; an empty table gives empty ones.
    """
    links = photo_links(photos, config, key, linking=True, crowded=crowded)
    rows = photos.select(F.col(key).alias("key"), "t", "input_ord", "sharpness", "iso", "exposure", "face")
    members = cut(cluster.label_all(rows, links))
    groups = rank.numbered(rank.groups_of(members, config.burst_window_s))
    scored = rank.with_group_scores(members, groups, ranks)
    placed = cut(rank_in_group(scored, "component", [F.col("score").desc(), F.col("input_ord"), F.col("key")], "rank"))
    best = placed.where("rank = 1").select("component", F.col("key").alias("best_key"))
    whole = cut(groups.join(best, "component"))
    shown = placed.join(whole.select("component", "group_id", "position"), "component")
    return (
        whole.select("group_id", "position", "size", "n_timed", "earliest", "latest", "is_burst", "best_key"),
        shown.select("key", "group_id", "position", "is_burst", "adjusted", "s_norm", "score", "rank"),
    )
