"""Hard negatives against SQL and brute force: clusters, ties, blocks and parts, rows that take no part."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import hard_negatives, registry

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, n_positives=5, n_negatives=3):
    kept = []
    for place, (i, e, label) in enumerate(rows):
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((place, i, [math.floor(256 * float(np.float32(x))) for x in e], label))
    out = []
    for a, i, q, label in kept:
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), j is None, j or 0, b, j, other) for b, j, v, other in kept if b != a]
        scored.sort(key=lambda x: x[:4])
        for p in [x for x in scored if x[5] == label][:n_positives]:
            fit = [x for x in scored if x[5] != label and -50 * p[0] <= -100 * x[0] <= -95 * p[0]][:n_negatives]
            out += [(i, p[4], r, x[4], -p[0], -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(df, every, **more):
    return sorted((tuple(x) for x in hard_negatives.mine(df, F.col("vec_id") % every == 0, **more).collect()), key=repr)


def clustered(n, dim, centres, spread, seed):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    x = c[r.integers(0, centres, n)] + spread * r.normal(size=(n, dim))
    return [(i, [float(v) for v in np.float32(y / np.linalg.norm(y))], int(r.integers(0, 4))) for i, y in enumerate(x)]


def test_query_matches_sql(spark, sf_dir):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = registry.op13_hard_negatives(spark, sf_dir)
    rel = db.sql(registry.ORACLES["op13_hard_negatives"])
    assert sorted(got.columns) == sorted(rel.columns)
    want = sorted(rel.fetchall())
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == want and want


@pytest.mark.parametrize("spread", [0.05, 0.4, 3.0])
def test_blocks_and_parts(spark, spread):
    rows = clustered(400, 6, 9, spread, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 5)
    assert mined(df, 5) == want
    assert mined(df, 5, pivots=8, anchors=9, rows=30) == want


def test_ties_nulls_repeats_and_lengths(spark):
    """A third of the rows are one vector; some ids and rows repeat; some rows take no part, and vectors have several lengths."""
    r = random.Random(2)
    rows = [(i, [0.5, 0.25, -0.125], i % 3) for i in range(60)]
    rows += [(60 + i, [r.uniform(-1, 1) for _ in range(r.choice((1, 3, 3, 4)))], r.choice((0, 1, 2, None))) for i in range(90)]
    rows += [rows[0], rows[70], (5, [1.0, 1.0, 1.0], 1), (None, [0.5, 0.25, -0.125], 1), (None, [0.4, 0.3, 0.0], 2), (200, None, 1), (205, [None, 1.0], 1), (210, [float("nan")], 0), (215, [float("inf"), 0.0], 0), (220, [], 1)]
    rows += [(225, [300.0, 2.0, 1.0], 0), (226, [250.0, 1.0], 1), (227, [280.0, 0.0, 3.0], 0), (230, [0.0, 0.0, 0.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(1)).withColumn("group", F.lit("x")).withColumn("d.id", F.lit(2.0))
    want = brute(rows, 5)
    assert mined(df, 5) == want
    assert mined(df, 5, pivots=4, anchors=7, rows=16) == want


def test_empty_tables_and_no_anchors(spark):
    rows = clustered(20, 4, 2, 0.1, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df.limit(0), 5) == [] and mined(df, 1000) == brute(rows, 1000)
    assert hard_negatives.mine(df, F.lit(None).cast("boolean")).collect() == []
    alone = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)], SCHEMA)
    assert mined(alone, 5) == []


def test_vectors_go_only_to_groups_that_they_might_serve(spark):
    """With clusters, the bounds leave most vectors out of most groups; without, cells form one group and nothing is copied twice."""
    for spread, n_groups, copies in ((0.02, range(3, 99), 0.5), (5.0, range(1, 2), 1.01)):
        rows = clustered(2000, 8, 6, spread, 5)
        x = np.floor(256 * np.array([e for _, e, _ in rows]))
        most = int((x * x).sum(axis=1).max())
        cells = hard_negatives.Cells(x[:12], most)
        d, a = cells.of_rows(x), cells.of_anchors(x[::50])
        cell, own = d.argmin(axis=1), a.argmin(axis=1)
        sizes = [(j, int((cell == j).sum()), float(d[cell == j, j].max())) for j in set(cell)]
        # What a score of 0.9 |q|^2 or more needs.
        norm = (x[::50] ** 2).sum(axis=1)
        high = np.sqrt(norm + most - 1.8 * norm)
        bands = [(i, 0.0, float(high[own == i].max()), float(a[own == i, i].max()), int((own == i).sum())) for i in set(own)]
        groups = hard_negatives.Groups(cells, bands, sizes, 1000, 500)
        served = groups.served(d)
        assert len(groups.members) in n_groups
        assert sum(s.sum() for s in served) <= copies * len(x) * len(served)
        for k, q in enumerate(x[::50]):
            needed = np.flatnonzero(x @ q >= 0.9 * norm[k])
            assert served[groups.group_of[own[k]]][needed].all()
