"""Ranked lexical search: shards of postings in blocks of variable size, searched exactly by skipping blocks.

Only postings of the queries' terms are kept. Documents are dealt into shards of a bounded number of postings; in a shard
they are numbered by length, as a term's scores fall with it. Each posting list is cut into blocks by dynamic programming:
of all ways to cut it, the one with the least sum of bound errors (what a block's highest score says too much about its
postings) and of a price for each block. A search adds up, for every document, the highest scores of the blocks that it
falls in. Documents whose sum reaches the threshold, the score of the k-th best so far, are the pivots; blocks without a
pivot are skipped unread. As terms are read in waves, the sums come down to the scores, and pivots become few.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, saved, slices, text_of

#: Runs of ASCII letters and digits and of everything beyond ASCII (a Java pattern).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings of a shard; terms, with repeats, of the queries that go through the documents in one pass.
SHARD, BLOCK_TERMS = 1 << 20, 1 << 20
#: Most postings of a block; the price of a block, in postings of its list's highest score.
LONGEST, PRICE = 64, 2
#: Terms of the first wave of a search; each further wave has twice as many.
WAVE = 4
#: The bytes of terms, A-Z in lower case; all others end a term. What is not ASCII is made of bytes from 0x80 on.
BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def cut_blocks(scores: np.ndarray, starts: np.ndarray, price: int = PRICE, longest: int = LONGEST) -> np.ndarray:
    """Where blocks begin in posting lists that lie one after the other (list k from starts[k] to starts[k + 1]).

    Least cost of the first i postings: the least over b of that of the first i - b, and b times the highest of the last b
    scores, and a price. The sum of the scores themselves is the same for all ways to cut. All lists take step i at once.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    first, sizes = starts[:-1][order], sizes[order]
    if not len(order):
        return np.empty(0, np.int64)
    fee = price * np.maximum.reduceat(scores, np.sort(first))[np.argsort(np.argsort(first))]
    cost_at = first + order  # a place more for each list: the cost of no posting
    cost, taken = np.zeros(len(scores) + len(starts), np.int64), np.zeros(len(scores) + len(starts), np.int32)
    back = np.arange(longest)
    active = len(order)
    for i in range(1, int(sizes[0]) + 1):
        while sizes[active - 1] < i:
            active -= 1
        b = back[: min(i, longest)]
        highest = np.maximum.accumulate(scores[(first[:active, None] + (i - 1)) - b], axis=1)
        total = cost[(cost_at[:active, None] + (i - 1)) - b] + highest * (b + 1)
        best = total.argmin(axis=1)
        cost[cost_at[:active] + i] = total[np.arange(active), best] + fee[:active]
        taken[cost_at[:active] + i] = best + 1
    begins = []
    at = sizes.copy()  # all lists are traced back at once
    live = np.arange(len(order))
    while len(live):
        at[live] -= taken[cost_at[live] + at[live]]
        begins.append(first[live] + at[live])
        live = live[at[live] > 0]
    return np.sort(np.concatenate(begins))


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from first[k] up to end[k], for each k."""
    sizes = end - first
    return np.arange(sizes.sum()) + np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)


class Shard:
    """Documents of one shard with their postings: `terms` of each document and how often it has them, flat, `counts` a document."""

    def __init__(self, order: np.ndarray, length: np.ndarray, counts: np.ndarray, terms: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> None:
        by_length = np.argsort(length, kind="stable")
        self.rows, self.n = by_length, len(by_length)
        self.order = order[by_length]  # the place of each document's id among the shard's
        number = np.empty(self.n, np.int64)
        number[by_length] = np.arange(self.n)
        doc = np.repeat(number, counts)
        norm = 50 + (50 * length * n_docs) // n_terms
        score = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(norm, counts)))
        place = np.lexsort((doc, terms))
        self.doc, self.score, terms = doc[place], score[place], terms[place]
        starts = np.searchsorted(terms, np.arange(len(weight) + 1))
        self.begin = cut_blocks(self.score, starts)
        self.end = np.append(self.begin[1:], len(self.score))
        self.low, self.high = self.doc[self.begin], self.doc[self.end - 1]
        self.top = np.maximum.reduceat(self.score, self.begin) if len(self.begin) else self.score[:0]
        self.blocks_of = np.searchsorted(self.begin, starts)  # blocks never reach over the end of a list
        self.n_read = 0

    def _bounds(self, blocks: np.ndarray) -> np.ndarray:
        """For each document, the sum of the highest scores of those of the blocks that it falls in."""
        steps = np.zeros(self.n + 1, np.int64)
        np.add.at(steps, self.low[blocks], self.top[blocks])
        np.subtract.at(steps, self.high[blocks] + 1, self.top[blocks])
        return np.cumsum(steps)[:-1]

    def _read(self, terms: np.ndarray, bound: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """`bound` with what the terms' blocks may give replaced by what they do give, right for the pivots (a flag for
        each document). Blocks that hold none are skipped."""
        blocks = _ranges(self.blocks_of[terms], self.blocks_of[terms + 1])
        before = np.concatenate(([0], np.cumsum(pivots)))
        live = blocks[before[self.high[blocks] + 1] > before[self.low[blocks]]]
        at = _ranges(self.begin[live], self.end[live])
        self.n_read += len(at)
        out = bound - self._bounds(blocks)
        np.add.at(out, self.doc[at], self.score[at])
        return out

    def search(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the input and scores of the k best documents with a score above 0, by score, then by the order of their ids.

        The terms that can give most, mostly the rarest, are read first. The documents then ahead are scored to the end; the
        k-th best of them is the threshold, and each further wave of terms is read only where a document can still reach it.
        """
        blocks = _ranges(self.blocks_of[terms], self.blocks_of[terms + 1])
        if not len(blocks):
            return self.rows[:0], self.score[:0]
        terms = terms[self.blocks_of[terms + 1] > self.blocks_of[terms]]
        top = np.array([self.top[self.blocks_of[t] : self.blocks_of[t + 1]].max() for t in terms])
        terms = terms[np.argsort(-top, kind="stable")]
        waves = [terms[a:b] for a, b in ((WAVE * (2**i - 1), WAVE * (2 ** (i + 1) - 1)) for i in range(len(terms).bit_length())) if a < len(terms)]
        bound = self._read(waves[0], self._bounds(blocks), np.ones(self.n, bool))
        threshold = 1
        if self.n > 4 * k and len(waves) > 1:
            ahead = np.zeros(self.n, bool)
            ahead[np.argpartition(bound, self.n - 2 * k)[self.n - 2 * k :]] = True
            found = np.where(ahead, self._read(np.concatenate(waves[1:]), bound, ahead), 0)
            threshold = max(1, int(np.partition(found, self.n - k)[self.n - k]))
        pivots = bound >= threshold
        for wave in waves[1:]:
            bound = self._read(wave, bound, pivots)
            pivots &= bound >= threshold
        best = np.flatnonzero(pivots)
        best = best[np.lexsort((self.order[best], -bound[best]))][:k]
        return self.rows[best], bound[best]


def _postings(rows: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf) of rows (doc_id, text): number of terms, and the known terms with their numbers of occurrences."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = known.keys()
        for b in slices(batches, 512):
            n, sizes, terms, tf = [], [0], [], []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                words = raw.translate(BYTES).split()
                count = Counter(words)
                n.append(len(words))
                for w in names & count.keys():
                    terms.append(known[w])
                    tf.append(count[w])
                sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n long, terms array<int>, tf array<int>")


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy().astype(np.int64)


def _best(index: DataFrame, searches: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int, n_shards: int) -> DataFrame:
    """(item, doc_id, score): the k best of each shard for each search (item is its number)."""
    shared = index.sparkSession.sparkContext.broadcast((searches, weight))
    id_type = index.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches, weight = shared.value
        parts = list(batches)
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        ids = t.column("doc_id").combine_chunks()
        order = np.empty(len(ids), np.int64)
        order[pc.array_sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        # Rows of one id are equal in order too.
        counts = pc.list_value_length(t.column("terms")).combine_chunks().to_numpy().astype(np.int64)
        shard = Shard(order, t.column("n").to_numpy().astype(np.int64), counts, _flat(t, "terms"), _flat(t, "tf"), weight, n_docs, n_terms)
        for item, terms in enumerate(searches):
            rows, scores = shard.search(terms, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), item), pa.int32()), ids.take(pa.array(rows)), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    # Dealt out by number, not by a key: every shard has as many documents, whatever their ids and texts.
    return index.where(F.size("terms") > 0).repartition(n_shards).mapInArrow(run, f"item int, doc_id {id_type}, score long")


def _block(docs: DataFrame, items: DataFrame, k: int, shard: int) -> DataFrame | None:
    """Results of one block of queries (item_id, terms)."""
    spark = docs.sparkSession
    found = items.collect()  # at most about BLOCK_TERMS terms
    names = sorted({t for x in found for t in x.terms})
    vocabulary = {t.encode(): i for i, t in enumerate(names)}
    index = saved(_postings(docs, vocabulary))
    whole = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms")).alias("postings")).first()
    if not whole.postings:
        return None
    df = np.zeros(len(names), np.int64)
    for x in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        df[x.term] = x.df
    weight = np.array([math.floor(1000 * math.log((2 * whole.docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    searches = [np.array(sorted(vocabulary[t.encode()] for t in x.terms), np.int64) for x in found]
    best = _best(index, searches, weight, whole.docs, whole.terms, k, -(-whole.postings // shard))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    ranked = best.withColumn("rank", place).where(F.col("rank") <= k)
    numbered = spark.createDataFrame([(i, x.item_id) for i, x in enumerate(found)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
    return ranked.join(F.broadcast(numbered), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", shard: int = SHARD, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each query the k documents of the highest scores above 0, equal scores by id, null ids last.

    N documents have a term, L is the number of all terms, n of a document's; a term in df documents weighs
    floor(1000 ln((2N + 2) / (2 df + 1))), and a document's score sums weight * (10^9 tf div (1000 tf + 20 m)) over the
    query's terms, with m = 50 + 50 n N div L. Null and empty texts have no terms: such documents are in no result, such
    queries have none. Rows that repeat an id are documents of their own, each with its rank; query rows that repeat an id
    (null is one) are one query. Other columns are not read. Empty tables give an empty result.

    Queries go through the documents in blocks of at most about `block_terms` terms, so what is broadcast is bounded; each block
    reads the documents once and writes only the postings of its terms.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    lowered = F.translate(text_of(query_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = queries.select(quoted(item_col).alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))).alias("term"))
    items = saved(words.groupBy("item_id").agg(F.collect_set("term").alias("terms")))
    total = items.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    blocks = -(-total // block_terms)
    dealt = [items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [items] * blocks
    out = None
    for part in dealt:
        found = _block(rows, part, k, shard)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        schema = f"item_id {queries.schema[item_col].dataType.simpleString()}, rank int, doc_id {docs.schema[id_col].dataType.simpleString()}, score long"
        return docs.sparkSession.createDataFrame([], schema)
    return out
