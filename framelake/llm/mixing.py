"""Mixing sources to target weights: nested hash-threshold histograms, refined only at the boundary, and no sort of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .common import WORD, fresh, quoted, saved, text_of

HASH_BITS, LEVEL_BITS = 60, 10
SALTS = 64


def word_count(text_col: str) -> Column:
    return F.size(F.regexp_extract_all(text_of(text_col), F.lit(WORD), 0)).cast("long")


def _hash(id_col: str, text_col: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("mixing"), quoted(id_col), text_of(text_col)), 64 - HASH_BITS)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One narrow row per row of `docs`: doc_id, source, size in words, and h, a fixed 60-bit hash of id and text."""
    return docs.select(quoted(id_col).alias("doc_id"), quoted(source_col).alias("source"), word_count(text_col).alias("size"), _hash(id_col, text_col).alias("h"))


def twins(narrow: DataFrame) -> DataFrame:
    """(source, h) that several rows share, as rows that repeat id and text do. Counts combine before the shuffle."""
    return saved(narrow.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("source", "h"))


def told_apart(rows: DataFrame, shared: DataFrame, source: str = "source", h: str = "h") -> DataFrame:
    """`rows`, those with a `shared` source and hash numbered and hashed anew with their numbers. Which of some equal rows gets
    which number does not matter, so reruns agree. Rows are numbered in the parts that they were read in, after those of
    the parts before, so that no task gets more of a hash than it has read."""
    if shared.isEmpty():
        return rows
    s, t, part, nth, ahead, n = fresh(rows, "s", "t", "part", "nth", "ahead", "n")
    side = shared.select(F.col("source").alias(s), F.col("h").alias(t))
    same = quoted(source).eqNullSafe(F.col(s)) & (F.col(h) == F.col(t))
    equal = cut(rows.withColumn(part, F.spark_partition_id()).join(side, same, "left_semi"))
    parts = equal.groupBy(quoted(source).alias(s), F.col(h).alias(t), part).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(s, t).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(s, t, F.col(part).alias(f"{part}_"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(ahead))
    numbered = equal.withColumn(nth, F.row_number().over(Window.partitionBy(quoted(source), h, part).orderBy(F.lit(0))))
    met = numbered.join(parts, same & (F.col(part) == F.col(f"{part}_")))
    anew = met.withColumn(h, F.shiftrightunsigned(F.xxhash64(F.col(h), F.col(ahead) + F.col(nth)), 64 - HASH_BITS))
    return rows.join(side, same, "left_anti").union(anew.select(*map(quoted, rows.columns)))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, source_size) with each source's target.

    Sources by code point (null last) take `weights` in turn and share the sum of all sizes; a target stops at
    `max_repeats` times its source's size and the excess is reshared by weight. The fixed point of that resharing is
    a water level: in the order of cap / weight, a source is capped when the level over the sources not yet capped
    exceeds its ratio. One row per source, so the two windows without a partition hold only that short list.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.get(F.array(*[F.lit(x).cast("long") for x in weights]), turn)
    ranked = sources.withColumn("weight", w).withColumn("cap", max_repeats * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    prefix = ranked.select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        F.sum("weight").over(whole).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weights_before"),
    )
    rest, open_weight = F.col("total") - F.col("caps_before"), F.col("weights") - F.col("weights_before")
    # The first source whose cap is not below the level fixes the level of all that follow.
    held = prefix.withColumn("rest", rest).withColumn("open_weight", open_weight).withColumn("open", F.col("cap") * F.col("open_weight") >= F.col("rest") * F.col("weight"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("weights_before"), F.col("rest"), F.col("open_weight")))).over(whole)
    level = held.withColumn("level", first)
    share = F.col("level.rest").cast("double") * F.col("weight") / F.col("level.open_weight")
    is_open = F.col("weights_before") >= F.col("level.weights_before")
    return level.select("source", "source_size", F.when(is_open, share).otherwise(F.col("cap").cast("double")).alias("target"))


def thresholds(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source the whole passes over it, and the hash below which documents get one pass more.

    The budget of the extra pass is target - passes * source_size. Level by level, sizes are summed by source and
    the next ten hash bits under the boundary bucket found so far; the first bucket whose running sum passes the
    budget is the next boundary. Only documents of boundary buckets are summed again, and after six levels a
    boundary is a single hash: it is taken when that brings the sum nearer to the budget.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    state = cut(state.select("source", "source_size", "target", "passes", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below")))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        inside = docs.select("source", "size", "h") if level == 1 else salted_join(docs, state.select("source", "low")).where(F.shiftright(F.col("h") - F.col("low"), shift + LEVEL_BITS) == 0).where("h >= low")
        sums = inside.groupBy("source", F.shiftleft(F.shiftright("h", shift), shift).alias("start")).agg(F.sum("size").alias("part"), F.count(F.lit(1)).alias("n"))
        running = Window.partitionBy("source").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        ordered = sums.withColumn("before", F.coalesce(F.sum("part").over(running), F.lit(0)))
        met = ordered.alias("o").join(state.select("source", "budget", "below").alias("s"), F.col("o.source").eqNullSafe(F.col("s.source")))
        left = F.col("budget") - F.col("below")
        # The last bucket that starts within the budget holds the boundary.
        best = met.where(F.col("before") <= left).groupBy(F.col("s.source").alias("source")).agg(F.max(F.struct("start", "before", "part", "n")).alias("b"))
        state = state.alias("s").join(best.alias("n"), F.col("s.source").eqNullSafe(F.col("n.source")), "left").select(
            *[f"s.{c}" for c in ("source", "source_size", "target", "passes", "budget")],
            F.coalesce("b.start", "s.low").alias("low"),
            (F.col("s.below") + F.coalesce("b.before", F.lit(0))).alias("below"),
            F.coalesce("b.part", F.lit(0)).alias("part"),
            F.coalesce("b.n", F.lit(0)).alias("n"),
        )
        state = cut(state)
        if level < HASH_BITS // LEVEL_BITS and state.where("n > 1").isEmpty():
            break
    # One hash (or one document) is left at the boundary; it goes to the nearer side.
    nearer = F.abs(F.col("below") + F.col("part") - F.col("budget")) < F.abs(F.col("budget") - F.col("below"))
    end = F.when(nearer, F.col("low") + F.lit(1 << shift)).otherwise(F.col("low"))
    return state.select("source", "source_size", "target", "passes", end.alias("threshold"))


def salted_join(docs: DataFrame, per_source: DataFrame, source: str = "source", h: str = "h") -> DataFrame:
    """`docs` with its source's row. A source may hold a third of all rows, so both sides are dealt by source and salt;
    the side with one row per source is copied once for each salt. Spark broadcasts it when it measures it as small."""
    side = per_source.withColumnRenamed("source", "__side_source").withColumn("__side_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.col(h), F.lit(SALTS)).cast("int")
    return docs.join(side, quoted(source).eqNullSafe(F.col("__side_source")) & (salt == F.col("__side_salt"))).drop("__side_source", "__side_salt")


def _copies(passes: str, threshold: str, h: str, most: int) -> Column:
    return F.least(F.col(passes) + (F.col(h) < F.col(threshold)).cast("long"), F.lit(most).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, copies, taken = copies * size.

    A document is copied once for each whole pass over its source, and once more if its hash lies below the source's
    threshold, so no document is taken more than `max_repeats` times and reruns agree. Null or empty texts have
    size 0; a null source is a source of its own, the last. Rows that repeat an id and a text are told apart by a
    number, and count one by one. An empty table gives an empty result. Columns other than the three named are not read.
    """
    narrow = cut(sized(docs, id_col, text_col, source_col))
    narrow = told_apart(narrow, twins(narrow))
    goals = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    joined = salted_join(narrow, thresholds(narrow, goals))
    return joined.withColumn("copies", _copies("passes", "threshold", "h", max_repeats)).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, with all their columns, each as often as `mix` takes it (rows taken no time are left out).

    Nulls, empty texts, repeated rows and empty tables count as in `mix`; extra columns may have any names.
    """
    narrow = cut(sized(docs, id_col, text_col, source_col))
    shared = twins(narrow)
    narrow = told_apart(narrow, shared)
    goals = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    h, passes, threshold, copies, nth = fresh(docs, "h", "passes", "threshold", "copies", "nth")
    limits = thresholds(narrow, goals).select("source", F.col("passes").alias(passes), F.col("threshold").alias(threshold))
    rows = told_apart(docs.withColumn(h, _hash(id_col, text_col)), shared, source_col, h)
    times = salted_join(rows, limits, source_col, h).withColumn(copies, _copies(passes, threshold, h, max_repeats)).where(F.col(copies) > 0)
    return times.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*map(quoted, docs.columns))
