"""Photos compared where they meet, against brute force; no pair is moved before it is judged."""

import random
import re

import pytest
from pyspark.sql import functions as F

from framelake import queries, scene_queries
from framelake.config import GroupingConfig
from framelake.functions import similarity
from framelake.operators import blocks, judges

CONFIG = GroupingConfig()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def brute(rows, horizon=660):
    order = sorted((t, k) for k, t in rows if t is not None)
    return {(k, m) for i, (t, k) in enumerate(order) for u, m in order[i + 1 :] if u - t < horizon}


@pytest.mark.parametrize("crowded", (4096, 40, 7))
def test_each_pair_is_met_once(spark, crowded):
    r = random.Random(3)
    rows = [(k, r.choice((r.randint(-3000, 9000), 4000, 660 * r.randint(-2, 5), None))) for k in r.sample(range(1000), 260)]
    df = spark.createDataFrame(rows, "key long, t long")
    for area in (1 << 16, 9):
        got = [tuple(x) for x in blocks.judged_pairs(df, 660, [], judges.all_met, "", crowded=crowded, area=area).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)
    asked = [k for k, t in rows if t is None]
    want = brute(rows) | {(k, m) for k in asked for m, t in rows if t is not None or k < m}
    got = [tuple(x) for x in blocks.judged_pairs(df, 660, [], judges.all_met, "", untimed=True, crowded=crowded).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert blocks.judged_pairs(df.limit(0), 660, [], judges.all_met, "").collect() == []


def test_a_forest_has_the_same_components(spark):
    rows = [(k, k // 50 * 5000 + k % 3) for k in range(400)]
    links = blocks.judged_pairs(spark.createDataFrame(rows, "key long, t long"), 660, [], judges.all_met, "", forest=True, crowded=20).collect()
    assert len(links) < 8 * 400 and {x.a // 50 == x.b // 50 for x in links} == {True}
    root = {k: k for k, _ in rows}
    for _ in range(9):
        for x in links:
            root[x.a] = root[x.b] = min(root[x.a], root[x.b])
    assert all(root[k] == k // 50 * 50 for k in root)


def test_colours_as_the_columns_have_them(spark):
    """Whole, short, empty and unknown histograms; distances at the threshold too."""
    r = random.Random(5)

    def unit(n):
        x = [r.random() ** 4 for _ in range(n)]
        return [v / sum(x) for v in x]

    hists = [unit(180) + unit(256) + unit(256) for _ in range(20)] + [[0.0] * 692, [], None, unit(64), unit(64), [0.5, 0.5], [1.0, 0.0], [0.5625, 0.4375], [None, 1.0]]
    rows = [(k, k, h) for k, h in enumerate(hists)]
    photos = spark.createDataFrame(rows, "key long, t long, hist array<double>")
    side = lambda c: photos.select(F.col("key").alias(c), F.col("hist").alias(f"of_{c}"))
    pairs = side("a").join(side("b"), F.col("a") < F.col("b"))
    for most in (0.5, 0.3, (1 - 0.5**0.5) ** 0.5):
        for empty in ("veto", "skip_veto"):
            config = GroupingConfig(max_color_distance=most, empty_hist=empty)
            want = {tuple(x) for x in pairs.select("a", "b", similarity.color_veto(F.col("of_a"), F.col("of_b"), config)).collect()}
            assert {tuple(x) for x in blocks.judged_pairs(photos, 660, ["hist"], judges.color_veto(config), "veto boolean").collect()} == want
    d = similarity.bhattacharyya(F.col("of_a"), F.col("of_b"))
    want = {tuple(x) for x in pairs.select("a", "b", F.round(d, 6), similarity.color_veto(F.col("of_a"), F.col("of_b"), GroupingConfig(max_color_distance=0.4), d)).collect()}
    assert {tuple(x) for x in blocks.judged_pairs(photos, 660, ["hist"], judges.bhattacharyya(0.4), "distance double, veto boolean").collect()} == want


def test_halves_round_as_in_spark(spark):
    r = random.Random(6)
    v = [r.random() for _ in range(2000)] + [(2 * r.randrange(10**6) + 1) / 2e6 for _ in range(2000)] + [0.0, 1.0, 0.1234565, 1e-7, 5e-7]
    want = [x.r for x in spark.createDataFrame([(x,) for x in v], "v double").coalesce(1).select(F.round("v", 6).alias("r")).collect()]
    import numpy as np

    assert judges.rounded(np.array(v)).tolist() == want


SETTLED_WHERE_THEY_MEET = [
    "hamming_pairs",
    "composite_all_edges",
    "bhattacharyya_pairs",
    "adaptive_hsv",
    "burst_pairs",
    "candidate_pairs",
    "semantic_pairs",
    "veto_692",
    "object_links",
    "composite_edges",
    "semantic_window_pairs",
]


@pytest.mark.parametrize("name", SETTLED_WHERE_THEY_MEET)
def test_no_pair_is_moved(spark, sf_dir, name):
    """Pairs come out of the step in which two photos meet: no join, aggregate or exchange is above it."""
    made = (queries.QUERIES | scene_queries.QUERIES)[name](spark, sf_dir)
    above = plan_of(made).split("MapInArrow")
    assert len(above) == 2 and not re.search("Join|Aggregate|Repartition|Generate|LogicalRDD", above[0])
