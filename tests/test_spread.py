"""Numbering, islands and components where one day, one group or one node has all the rows: right, and spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import cluster, numbering


@pytest.fixture
def many_parts(spark):
    """As many tasks as a large table would have, although this one is small."""
    keys = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield 16
    for k, v in before.items():
        spark.conf.set(k, v)


def parts_of(df):
    """Rows of each part in which the rows were sorted, told from what was written."""
    return [x.n for x in df.groupBy(numbering._part().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_one_day_uses_all_tasks(spark, many_parts):
    rows = spark.range(8000).select(F.col("id").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(86_400))).alias("t"))
    sizes = parts_of(numbering._sorted(rows, [F.col("t"), F.col("key")]))
    assert len(sizes) == many_parts and max(sizes) < 3 * 8000 / many_parts
    got = {x.key: x.n for x in numbering.ordinal(rows, [F.col("t"), F.col("key")], "n").collect()}
    want = sorted((x.t, x.key) for x in rows.collect())
    assert got == {k: i for i, (_, k) in enumerate(want, 1)}


@pytest.mark.parametrize("gap", [0, 3, 20])
def test_islands_reach_over_parts(spark, many_parts, gap):
    """Islands that begin, end, fill or span parts, and a second with a third of the rows."""
    r = random.Random(gap)
    rows = [(i, r.choice((r.randint(0, 6000), 3000 + r.randint(0, 40), 3333))) for i in range(1500)] + [(2000, None)]
    got = {x.key: x.island for x in numbering.islands(spark.createDataFrame(rows, "key long, t long"), gap).collect()}
    want, last, n = {}, None, 0
    for t, k in sorted((t, k) for k, t in rows if t is not None):
        n += last is None or t - last > gap
        want[k], last = n, t
    assert got == want
    assert numbering.islands(spark.createDataFrame([], "key long, t long"), gap).collect() == []


def test_rank_in_a_group_that_holds_all(spark, many_parts):
    rows = spark.range(3000).select(F.col("id").alias("key"), F.when(F.col("id") < 2900, "a").when(F.col("id") < 2990, "b").alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    got = {x.key: x.place for x in numbering.rank_in_group(rows, "g", [F.col("v").desc(), F.col("key")], "place").collect()}
    want = {}
    for g in ("a", "b", None):
        for i, x in enumerate(sorted((x for x in rows.collect() if x.g == g), key=lambda x: (-x.v, x.key)), 1):
            want[x.key] = i
    assert got == want


def test_hub_of_many_leaves(spark):
    """A star around a middle node: its neighbours are told by broadcast, and no shuffle brings them together."""
    n = 20_000
    links = spark.range(n).select(F.col("id").alias("a"), F.lit(n // 2).cast("long").alias("b"))
    got = cluster.components(links, hub=100)
    assert got.agg(F.count(F.lit(1)), F.max("label"), F.countDistinct("node")).first()[:] == (n, 0, n)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    plan = cluster._star(edges, True, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan


def test_hubs_give_the_same_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(12)) for _ in range(250)] + [(r.randrange(400, 900), r.randrange(400, 900)) for _ in range(300)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = sorted(map(tuple, cluster.components(df).collect()))
    for hub in (1, 3, 20):
        assert sorted(map(tuple, cluster.components(df, hub=hub, hubs=10_000).collect())) == want


def test_stars_end_without_another_round(spark):
    """Edges that are stars already are told as such, and nothing else is."""
    state = lambda edges: cluster._state(spark.createDataFrame(edges, "a long, b long"))
    assert state([(5, 1), (4, 1), (9, 7)]) == (3, 0, 2)
    assert state([(5, 1), (5, 2)])[1] and state([(5, 3), (3, 1)])[1]
