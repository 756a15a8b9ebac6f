"""Ranked search against SQL, brute force over planted rows, and the blocks against all ways to cut."""

import itertools
import math
import random
import re

import duckdb
import numpy as np

from framelake.llm import ranked_search, registry


def brute(docs, queries, k):
    words = lambda t: re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    texts = [(i, words(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    asked = {}
    for item, text in queries:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, w in texts:
            score = 0
            for t in terms:
                if t in w:
                    df, tf = sum(t in x for _, x in texts), w.count(t)
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += weight * (1_000_000_000 * tf // (1000 * tf + 20 * (50 + 50 * len(w) * n_docs // n_terms)))
            if score:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def test_query_matches_sql(spark, sf_dir):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = registry.op12_ranked_search(spark, sf_dir)
    rel = db.sql(registry.ORACLES["op12_ranked_search"])
    assert sorted(got.columns) == sorted(rel.columns)
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_shards_blocks_and_ties(spark):
    """Small shards and several blocks of queries give what brute force gives, ties and long lists included."""
    r = random.Random(3)
    vocabulary = [f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(600)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice((3, 8, 20, 60))))) for i in range(300)]
    docs += [(1000 + i, "same words here w1 w2") for i in range(40)]
    queries = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 12)))) for i in range(12)] + [(50, "same words"), (51, "unheard"), (52, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    want = brute(docs, queries, 7)
    for shard, block in ((ranked_search.SHARD, ranked_search.BLOCK_TERMS), (400, 25)):
        got = sorted((tuple(x) for x in ranked_search.search(d, q, k=7, shard=shard, block_terms=block).collect()), key=repr)
        assert got == want


def test_odd_rows(spark, make, odd_rows):
    docs = make(odd_rows).withColumnRenamed("label", "d.id").withColumnRenamed("key", "rank").withColumnRenamed("w", "terms")
    queries = [(1, "The ONE only"), (1, "été 😀"), (None, "12 end"), (None, None), (2, ""), (3, "Été naïve")]
    q = spark.createDataFrame([(*x, "z") for x in queries], "item_id int, text string, n string")
    got = sorted((tuple(x) for x in ranked_search.search(docs, q, k=4).collect()), key=repr)
    assert got == brute([(i, t) for i, t, *_ in odd_rows], queries, 4)
    assert ranked_search.search(docs.limit(0), q).collect() == [] and ranked_search.search(docs, q.limit(0)).collect() == []
    assert ranked_search.search(docs.limit(0), q).columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_are_the_best_cut():
    """The dynamic programme's cost is the least over all ways to cut, for several lists at once."""
    r = np.random.default_rng(4)
    sizes = [9, 1, 0, 7, 12]
    scores, starts = r.integers(1, 40, sum(sizes)), np.concatenate(([0], np.cumsum(sizes)))

    def cost(s, cuts, price, longest):
        if any(b - a > longest for a, b in zip(cuts, cuts[1:])):
            return math.inf
        return sum((b - a) * s[a:b].max() - s[a:b].sum() + price * s.max() for a, b in zip(cuts, cuts[1:]))

    for price, longest in ((0, 64), (1, 64), (2, 3), (5, 64)):
        begin = ranked_search.cut_blocks(scores, starts, price, longest)
        for a, b in zip(starts, starts[1:]):
            s = scores[a:b]
            mine = [int(x) - a for x in begin if a <= x < b] + [b - a]
            every = [[0, *c, b - a] for n in range(b - a) for c in itertools.combinations(range(1, b - a), n)]
            assert b == a or cost(s, mine, price, longest) == min(cost(s, c, price, longest) for c in every)


def test_blocks_are_skipped():
    """Rare terms raise the threshold so far that most postings of the common ones are never read, and nothing is lost."""
    r = np.random.default_rng(6)
    n = 20_000
    length = r.integers(5, 3000, n)
    have = [np.flatnonzero(r.random(n) < p) for p in (0.002, 0.002, 0.003, 0.003, 0.9, 0.8, 0.7, 0.6)]
    doc, term = np.concatenate(have), np.repeat(np.arange(8), [len(x) for x in have])
    place = np.argsort(doc, kind="stable")
    tf, weight = r.integers(1, 4, len(doc)), np.array([4000, 4000, 3900, 3800, 100, 150, 200, 300])
    shard = ranked_search.Shard(np.arange(n), length, np.bincount(doc, minlength=n), term[place], tf, weight, n, int(length.sum()))
    rows, scores = shard.search(np.arange(8), 10)
    assert shard.n_read < len(doc) / 4
    d, t = doc[place], term[place]
    whole = np.zeros(n, np.int64)
    np.add.at(whole, d, weight[t] * (1_000_000_000 * tf // (1000 * tf + 20 * (50 + 50 * length[d] * n // length.sum()))))
    assert [(-int(s), int(x)) for x, s in zip(rows, scores)] == sorted((-int(s), i) for i, s in enumerate(whole))[:10]
