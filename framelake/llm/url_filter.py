"""URL filters: a broadcast trie over reversed host labels and path segments; the longest matching rule wins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_of

#: Rules are broadcast; more bytes than this are refused (a larger list belongs in a join on host suffixes).
MAX_RULE_BYTES = 64 << 20


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules (fixed values).
RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))
HOST_END, PATHS = "", "/"


def build(rules: tuple[UrlRule, ...]) -> dict:
    """Nested dicts: host labels from the top-level domain down, then under PATHS whole path segments, then the last,
    perhaps partial, segment with (length of the rule, blocks, name, verdict)."""
    if sum(len(r.name) for r in rules) > MAX_RULE_BYTES:
        raise ValueError(f"the rules hold more than {MAX_RULE_BYTES} bytes")
    trie: dict = {}
    for r in rules:
        node = trie
        for label in reversed(r.host.lower().split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(PATHS, {})
        *whole, last = r.path.split("/")
        for segment in whole:
            node = node.setdefault("s" + segment, {})
        node.setdefault(HOST_END, []).append((last, (len(r.name), r.verdict == "block", r.name, r.verdict)))
    return trie


def longest(trie: dict, host: str, path: str) -> tuple | None:
    """The longest rule that fits; of equally long ones a block, then the name that sorts last."""
    best, node, segments = None, trie, path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        at = node.get(PATHS)
        for segment in segments:
            if at is None:
                break
            for last, found in at.get(HOST_END, ()):
                if segment.startswith(last) and (best is None or found > best):
                    best = found
            at = at.get("s" + segment)
    return best


SCHEMA = "page_id {id}, host string, path string, rule string, verdict string"


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule (null if none fits) and verdict (the rule's, else `default`).

    A null url or one without :// has an empty host and path, which no rule fits. Repeated rows each get a verdict;
    an empty table gives an empty result; only the two named columns are read. The trie travels with the task, its
    size bounded by MAX_RULE_BYTES; pages are not shuffled.
    """
    sent = pages.sparkSession.sparkContext.broadcast(build(rules))
    url = text_of(url_col)
    authority = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = pages.select(quoted(id_col).alias("page_id"), F.translate(authority, upper, lower).alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = sent.value
        for b in batches:
            found = [longest(trie, h, p) if h else None for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            rule = pa.array([f and f[2] for f in found], pa.string())
            verdict = pa.array([f[3] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, SCHEMA.format(id=pages.schema[id_col].dataType.simpleString()))
