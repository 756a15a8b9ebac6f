"""The pipeline's stages, one after the other, against brute-force versions; and the registry against SQL."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from framelake.llm import registry
from framelake.llm.common import table

from .test_filters import brute_targets
from .test_text import brute_components, near_rows


def test_stages_on_odd_rows(spark, make, odd_rows, tmp_path):
    docs = make(odd_rows + near_rows()[:60])
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "jaccard_join", "mix_sources", "sentencepiece"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(x) for x in docs.collect()]
        docs = stage(spark, docs, "")
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "sentencepiece":
            assert docs.columns == columns
        kept[name] = before, docs.collect()
    before, after = kept["language_id"]
    assert sorted(repr(x.doc_id) for x in after) == sorted(repr(x[0]) for x in before if any(c.isalpha() for c in x[1] or ""))
    before, after = kept["exact_dedup"]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(norm(x.text) for x in after) == sorted({norm(x[1]) for x in before})
    before, after = kept["jaccard_join"]
    want = brute_components([x[:4] for x in before], 5, 80)
    assert sorted(repr(x.doc_id) for x in after) == sorted({repr(c) for _, n, c in want if n})
    before, after = kept["mix_sources"]
    sizes, taken = Counter(), Counter()
    for x in before:
        sizes[x[3]] += len(x[1].split())
    for x in after:
        taken[x.source] += len(x.text.split())
    largest = {s: max(len(x[1].split()) for x in before if x[3] == s) for s in sizes}
    for s, goal in brute_targets(sizes).items():
        assert abs(taken[s] - goal) <= largest[s]
    assert max(Counter(repr(x.doc_id) for x in after).values()) <= 3
    before, after = kept["sentencepiece"]
    assert len(before) == len(after) and all(x.round_trip or x.doc_id == 10 for x in after)


def test_run_keeps_clean_documents(spark, sf_dir):
    done = corpus_pipeline.run(spark, sf_dir).collect()
    assert done and all(x.round_trip and x.n_pieces == len(x.ids) for x in done)


def test_stages_on_an_empty_table(spark, make):
    docs = make([])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_registry_matches_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, rel = registry.QUERIES[name](spark, sf_dir), db.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    assert sorted(repr([str(x[c]) for c in columns]) for x in df.collect()) == sorted(repr([str(x[i]) for i in order]) for x in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_every_query_returns_every_row(spark, sf_dir, name):
    n = registry.QUERIES[name](spark, sf_dir).count()
    assert n == table(spark, sf_dir, "pages" if name == "op7_html_text" else "documents").count()
