"""Exact dedup: radix tries over full byte strings own the smallest identifier of each text."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh, let_go, quoted, saved, slices, text_of

#: Bytes of keys that a task's trie holds before it spills its heaviest subtree.
TRIE_BYTES = 16 << 20
#: Owners of several rows up to which their ids and digests are sent to all tasks; beyond it they are joined by a shuffle.
SENT = 1 << 18
OWNERS = "content_hash long, n_bytes int, text binary, keep_id {id}, n long"


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving on slices that compare at memory speed."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low + 1 < high:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low if a[low : low + 1] != b[low : low + 1] else low + 1


class PatriciaTrie:
    """A compressed radix trie; a terminal holds [smallest identifier, number of rows]. Nodes are [edge, children, terminal]."""

    def __init__(self) -> None:
        self.roots: dict[int, list] = {}
        self.held: dict[int, int] = {}  # bytes by subtree of the root

    def add(self, key: bytes, ident, n: int) -> None:
        top = key[0]
        level, at = self.roots, 0
        while True:
            rest = key[at:]
            node = level.get(rest[0])
            if node is None:
                level[rest[0]] = [rest, None, [ident, n]]
                self.held[top] = self.held.get(top, 0) + len(rest) + 200
                return
            k = _shared(node[0], rest)
            if k < len(node[0]):  # split the edge
                below = [node[0][k:], node[1], node[2]]
                node[0], node[1], node[2] = node[0][:k], {below[0][0]: below}, None
                self.held[top] += 200
            at += k
            if at == len(key):
                if node[2] is None:
                    node[2] = [ident, n]
                else:
                    kept = node[2]
                    kept[0] = ident if kept[0] is None else kept[0] if ident is None else min(kept[0], ident)
                    kept[1] += n
                return
            if node[1] is None:
                node[1] = {}
            level = node[1]

    def take(self, top: int) -> Iterator[tuple[bytes, object, int]]:
        """Terminals of one subtree of the root, which then leaves the trie."""
        self.held.pop(top, None)
        stack = [(b"", self.roots.pop(top))]
        while stack:
            prefix, (edge, children, terminal) = stack.pop()
            key = prefix + edge
            if terminal is not None:
                yield key, *terminal
            if children:
                stack.extend((key, child) for child in children.values())

    def size(self) -> int:
        return sum(self.held.values())

    def heaviest(self) -> int:
        return max(self.held, key=self.held.get)


def _key(content_hash: int, n_bytes: int, text: bytes) -> bytes:
    return (content_hash & (1 << 64) - 1).to_bytes(8, "big") + n_bytes.to_bytes(4, "big") + text


def _owners(sorted_by_hash: bool, budget: int):
    fields = [("content_hash", pa.int64()), ("n_bytes", pa.int32()), ("text", pa.binary()), ("n", pa.int64())]

    def batches(rows: Iterator[tuple[bytes, object, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        out, held = [], 0

        def batch():
            h = [int.from_bytes(k[:8], "big", signed=True) for k, _, _ in out]
            size = [int.from_bytes(k[8:12], "big") for k, _, _ in out]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((h, size, [k[12:] for k, _, _ in out], [i for _, i, _ in out], [n for _, _, n in out]), schema, strict=True)], schema=schema)

        for row in rows:
            out.append(row)
            held += len(row[0])
            if held > 2 << 20 or len(out) >= 2000:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, object, int]]:
        trie, current = PatriciaTrie(), None
        for b in slices(source, 1000, 1 << 20):
            for h, size, text, ident, n in zip(*(b.column(c).to_pylist() for c in ("content_hash", "n_bytes", "text", "keep_id", "n")), strict=True):
                if sorted_by_hash and h != current:  # the subtree of a hash is complete once the sorted rows have passed it
                    for top in list(trie.roots):
                        yield from trie.take(top)
                    current = h
                trie.add(_key(h, size, text), ident, n)
                if not sorted_by_hash and sum(trie.held.values()) > budget:
                    yield from trie.take(trie.heaviest())
        for top in list(trie.roots):
            yield from trie.take(top)

    def run(source):
        let_go()
        first = next(source, None)
        if first is not None:  # the ids' type is the column's
            schema = pa.schema([*fields[:3], ("keep_id", first.schema.field("keep_id").type), fields[3]])
            yield from batches(rows(chain([first], source)), schema)

    return run


def normalised(text_col: str) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(text_of(text_col), SPACE, " ")


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """One row for each distinct normalised text: text_sha256, text (bytes), keep_id (smallest id, nulls last), group_size.

    Each scan task folds its rows into a trie keyed by hash, length and full bytes; when the trie is over `budget`
    its heaviest subtree leaves as partial owners, into the shuffle. So a text with any number of copies reaches the
    next stage once for each task and spill. There, partitions by (hash, length) are sorted by Spark, and a second
    trie compares full bytes, letting go of a subtree as soon as the sorted rows have passed it.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text = normalised(text_col)
    rows = docs.select(F.xxhash64(text).alias("content_hash"), F.octet_length(text).alias("n_bytes"), F.encode(text, "UTF-8").alias("text"), quoted(id_col).alias("keep_id"), F.lit(1).cast("long").alias("n"))
    schema = OWNERS.format(id=id_type)
    partial = rows.mapInArrow(_owners(False, budget), schema)
    dealt = partial.repartition("content_hash", "n_bytes").sortWithinPartitions("content_hash", "n_bytes")
    whole = dealt.mapInArrow(_owners(True, budget), schema)
    return whole.select(F.sha2("text", 256).alias("text_sha256"), "text", "keep_id", F.col("n").alias("group_size"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays; of rows that repeat both id and text, one. A null id is larger
    than any other; a group of null ids keeps one row and has a null keep_id. Null texts equal empty ones. An empty
    table gives an empty result. Only the two named columns are read.

    The join of rows with owners carries ids and digests alone, and Spark may split a digest that many rows share.
    """
    sha = F.sha2(F.encode(normalised(text_col), "UTF-8"), 256)
    same_row = Window.partitionBy("text_sha256", "doc_id").orderBy("doc_id")
    rows = docs.select(quoted(id_col).alias("doc_id"), sha.alias("text_sha256")).withColumn("nth", F.row_number().over(same_row))
    joined = rows.join(owners(docs, id_col, text_col).drop("text"), "text_sha256")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `dedup` keeps, with all their columns: of equal texts the one with the smallest id (null ids last;
    null texts equal empty ones), of rows that repeat both id and text one. Extra columns may have any names and types. An empty
    table gives an empty one.

    Only (id, hash of the text) of owners of several rows is needed to tell which rows go; texts are compared in the tries alone,
    and whole rows are dealt out only for owners that repeat an id.
    """
    owned = owners(docs, id_col, text_col).where("group_size > 1").select("keep_id", F.unhex("text_sha256").alias("sha"))
    keep, sha = fresh(docs, "keep", "sha")
    several = saved(owned.select(F.col("keep_id").alias(keep), F.col("sha").alias(sha)))
    if several.count() <= SENT:
        several = F.broadcast(several)
    digest = F.unhex(F.sha2(F.encode(normalised(text_col), "UTF-8"), 256))
    same_text, same_id = digest == F.col(sha), quoted(id_col).eqNullSafe(F.col(keep))
    # Rows that go: their text has an owner of another id.
    rows = docs.join(several, same_text & ~same_id, "left_anti")
    first = docs.join(several, same_text & same_id, "left_semi").select(quoted(id_col).alias(keep), digest.alias(sha))
    again = saved(first.groupBy(keep, sha).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if again.isEmpty():
        return rows
    once = rows.join(again, same_text & same_id, "left_semi").withColumn(sha, digest).dropDuplicates([id_col, sha]).drop(sha)
    return rows.join(again, same_text & same_id, "left_anti").union(once)
