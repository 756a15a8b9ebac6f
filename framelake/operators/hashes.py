"""Photos of close perceptual hashes whatever their times: multi-index hashing."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a 64-bit hash, which is two words of 32 bits.
PARTS = 4


def _parts(parts: int) -> list[Column]:
    """The parts of the columns high and low, as numbers."""
    each, bits = parts // 2, 64 // parts
    return [F.shiftrightunsigned(w, bits * (each - 1 - i)).bitwiseAND(F.lit((1 << bits) - 1)) for w in ("high", "low") for i in range(each)]


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in some) for n in range(radius + 1) for some in combinations(range(bits), n)]


def hash_links(asked: DataFrame, photos: DataFrame, most: int, key: str = "key", parts: int = PARTS) -> DataFrame:
    """(x, y) for each key of `asked` and each other key of `photos` whose hashes (columns high and low, of 32 bits each) differ in at most `most`
    bits. Unknown and all-zero hashes are close to none; two photos that are both asked are found from either side.

    Of `parts` parts of two close hashes one differs in most / parts bits at most. Each different hash of `photos` stands under
    its parts, each different asked hash looks under all values that near, and a pair counts at the first of its parts that are
    near; then whole hashes are compared. Equal hashes are looked up once, however many photos share one. With p parts of b
    bits and radius r the share of hashes looked at is about p * sum(C(b, i), i <= r) / 2^b: 4 % for 14 bits and 4 parts.
    """
    if parts not in (2, 4, 8, 16):
        raise ValueError("a hash has 2, 4, 8 or 16 parts")
    bits, radius = 64 // parts, most // parts
    known = "high IS NOT NULL AND low IS NOT NULL AND (high <> 0 OR low <> 0)"
    hashes = lambda rows: rows.where(known).select("high", "low").distinct()
    numbered = lambda: F.posexplode(F.array(*_parts(parts))).alias("part", "value")
    stand = hashes(photos).select("high", "low", numbered())
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(bits, radius)])
    look = hashes(asked).select(F.col("high").alias("h"), F.col("low").alias("l"), numbered()).select("h", "l", "part", F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    # Many keys come of few hashes, which a planner cannot see: neither side is to be broadcast.
    pairs = look.join(stand.hint("merge"), ["part", "value"])
    apart = [F.col("h").bitwiseXOR(F.col("high")), F.col("l").bitwiseXOR(F.col("low"))]
    of_part = pairs.select("h", "l", "part", F.col("high").alias("h2"), F.col("low").alias("l2"), apart[0].alias("high"), apart[1].alias("low"))
    near = F.array(*[F.bit_count(p) <= radius for p in _parts(parts)])
    close = of_part.where((F.bit_count("high") + F.bit_count("low") <= most) & (F.array_position(near, True) == F.col("part") + 1)).select("h", "l", "h2", "l2")
    x = asked.where(known).select(F.col(key).alias("x"), F.col("high").alias("h"), F.col("low").alias("l"))
    y = photos.where(known).select(F.col(key).alias("y"), F.col("high").alias("h2"), F.col("low").alias("l2"))
    return close.join(x, ["h", "l"]).join(y, ["h2", "l2"]).where("x <> y").select("x", "y")
