"""Operators whose columns have names with dots, spaces and backticks."""

import pytest
from pyspark.sql import functions as F

from framelake.llm import bpe_codec, hard_negatives, html_text, license_scan, quality, ranked_search, secret_scan, trie_dedup, url_filter

TEXT = "This work is licensed under the MIT License and the key is password = abcdefghijkl0123 " * 3


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT, "x"), (2, None, "y")], "`d.id` long, `t.e`` xt` string, d string")


@pytest.mark.parametrize("operator", [license_scan.scan, quality.assess, secret_scan.scan, bpe_codec.encode, trie_dedup.dedup])
def test_documents(docs, operator):
    plain = operator(docs.withColumnsRenamed({"d.id": "doc_id", "t.e` xt": "text"}))
    got = operator(docs, id_col="d.id", text_col="t.e` xt")
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.columns == plain.columns


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.example.net/en/x", "<p>Some words of an article.</p>"), (2, None, None)], "`p.id` long, `u.rl` string, `h.ml` string")
    assert {x.page_id: x.rule for x in url_filter.judge(pages, id_col="p.id", url_col="u.rl").collect()} == {1: "example.net/en/", 2: None}
    got = html_text.extract(pages, id_col="p.id", url_col="u.rl", html_col="h.ml")
    assert {x.page_id: (x.url, x.text) for x in got.collect()} == {1: ("http://a.example.net/en/x", "Some words of an article."), 2: (None, "")}


def test_search_and_vectors(spark, docs):
    queries = spark.createDataFrame([(7, "license key")], "`i.d` int, `q.t` string")
    assert [(x.item_id, x.doc_id) for x in ranked_search.search(docs, queries, id_col="d.id", text_col="t.e` xt", item_col="i.d", query_col="q.t").collect()] in ([(7, 1)], [])
    v = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.7, 0.7], 2)], "`v.id` long, `e.v` array<float>, `l.b` int")
    got = hard_negatives.mine(v, F.col("`v.id`") == 0, "v.id", "e.v", "l.b").collect()
    assert [(x.anchor_id, x.positive_id, x.negative_id) for x in got] == [(0, 1, 2)]
