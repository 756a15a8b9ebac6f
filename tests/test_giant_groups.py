"""Groups that time makes may hold all photos: none is held, ordered or joined in one task, and no pairs are needed to find them."""

import re

import pytest
from pyspark.sql import functions as F

from framelake import queries
from framelake.operators import cluster, numbering, rank

from .test_blocks import plan_of


def test_burst_components_need_no_pairs(spark, sf_dir, monkeypatch):
    def refused(*_):
        raise AssertionError("components of pairs")

    monkeypatch.setattr(cluster, "label_all", refused)
    made = queries.burst_components(spark, sf_dir)
    assert made.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


@pytest.mark.parametrize("name", ("burst_components", "burst_best", "owning_group"))
def test_members_meet_their_group_over_salts(spark, sf_dir, name):
    plan = plan_of(queries.QUERIES[name](spark, sf_dir))
    assert "__salt" in plan and not re.search(r"Window \[[^\n]*\], \[component", plan)


def test_one_group_with_all_rows_spreads(spark):
    rows = spark.range(4000).select(F.col("id").alias("key"), F.lit(7).alias("component"))
    values = spark.createDataFrame([(7, 1.5), (8, 2.5)], "component int, v double")
    joined = numbering.spread_join(rows, values, "component")
    assert joined.where("v = 1.5").count() == 4000
    few = rows.select(F.pmod(F.xxhash64("key"), F.lit(numbering.SALTS)).alias("s")).groupBy("s").count()
    assert few.count() > 200 and few.agg(F.max("count")).first()[0] < 60


def test_the_best_of_a_group_as_ranks_have_it(spark):
    rows = [(k, k % 5, (k * 7 % 4) / 4 if k % 6 else None, 100 - k % 9 if k % 2 else k) for k in range(60)]
    rows = [(k, g, s, o * 100 + k) for k, g, s, o in rows]
    df = spark.createDataFrame(rows, "key long, component int, score double, input_ord long")
    want = {(x.component, x.key) for x in rank.ranked(df).where("rank = 1").collect()}
    assert {(x.component, x.best_key) for x in rank.best_of(df).collect()} == want
