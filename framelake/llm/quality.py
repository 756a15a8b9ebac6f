"""Quality rules: a threshold table compiled into one projection of ratios, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, quoted, text_of

#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = (
    "the of and to in a is that it was for on are as with be at by this from or an "
    "der die das und ist nicht von mit ein eine zu den dem des im sich auf für als auch "
    "le la les de et un une que qui dans pour pas sur est du en au avec par ce "
    "el los las y que en un una por con para del se no es al lo como"
).split()

#: A word with two or more characters, a capital of A-Z, and no small letter.
SHOUTED = r"^(?=..)[^\p{Ll}]*[A-Z][^\p{Ll}]*$"


@dataclass(frozen=True)
class Rule:
    """A document passes when low <= numerator / denominator <= high; null bounds are open, a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None


#: The threshold table. Numerators and denominators are columns of `measures`.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.5),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("shouted_words", "n_shouted_words", "n_words", None, 0.5),
)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text, one row per row of `docs` (repeated rows included); null text counts as empty.

    Only `id_col` and `text_col` are read, so other columns cannot clash. A word is a run without ASCII white
    space. n_repeat_words counts the words that lie in a three-word window which occurs at least twice in the
    text, found by sorting 64-bit hashes of the windows inside the row: no shuffle, n log n in the length of the text.
    """
    words = docs.select(quoted(id_col).alias("doc_id"), text_of(text_col).alias("t")).withColumn("w", F.regexp_extract_all("t", F.lit(WORD), 0))
    window = lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))
    grams = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), window)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    counted = words.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("w", lambda x: x.rlike(SHOUTED))).cast("long").alias("n_shouted_words"),
        lines.alias("lines"),
        F.sort_array(grams).alias("s"),
    )
    again = lambda x, i: F.coalesce(x.h == F.get("s", i - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("s", i + 1).h, F.lit(False))
    covered = F.flatten(F.transform(F.filter("s", again), lambda x: F.array(x.i, x.i + 1, x.i + 2)))
    return counted.select(
        *[c for c in counted.columns if c not in ("lines", "s")],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean column over `measures`: true where every rule passes."""
    passed = F.lit(True)
    for r in rules:
        n, d = F.col(r.numerator), F.col(r.denominator)
        if r.low is not None:
            passed = passed & (n >= F.lit(r.low) * d)
        if r.high is not None:
            passed = passed & (n <= F.lit(r.high) * d)
    return passed


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """`measures` with base_failed (too short, or more than half of the words repeated) and kept.

    An empty or null text has zero counts and fails the base; an empty table gives an empty result.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
