"""Secret scans: fixed patterns, and strings that a token vocabulary compresses as badly as noise."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, slices, text_of
from .vocab import default_path, rank_encoding

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?a)(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: What the token test looks at, and what it leaves out: digests of the usual lengths, UUIDs, numbers, and words.
LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[A-Za-z0-9+]{20,}")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})=*")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
IDENTIFIER = re.compile(r"[0-9_+/=-]+|(?:[_/+=-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?=$|[_/+=-]))+[_/+=-]*|[A-Z]?[a-z]+[0-9]*|[A-Z]+[0-9]*")
#: Digests and UUIDs that stand between separators in a longer run.
INSIDE = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID.pattern}|{DIGEST.pattern})(?![A-Za-z0-9])")
#: Characters a token at or below which a string counts as random (prose has about four, random base64 under two).
MAX_CHARS_PER_TOKEN = 2.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; leftmost matches that do not overlap, of each kind, without those that are too short."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def outside(a: int, b: int, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The pieces of a:b of at least LEAST characters that no span (disjoint, in order) touches."""
    k = bisect_left(spans, a, key=lambda x: x[1])
    while a < b:
        x, y = spans[k] if k < len(spans) and spans[k][0] < b else (b, b)
        if x - a >= LEAST:
            yield a, x
        a, k = max(a, y), k + 1


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def low_windows(s: str, encoding, most: float) -> Iterator[tuple[int, int]]:
    """For each token of `s` the longest window that ends with it and has at most `most` characters a token.

    A token adds `most` less its length, so such a window's sum is not negative: it begins at the first place where
    the running sum is no higher than at its end, found in the running minimum. Long tokens at its ends are cut off.
    """
    sizes = [len(x) for x in encoding.decode_tokens_bytes(encoding.encode_ordinary(s))]
    ends, least, at, total = [0], [0.0], 0, 0.0
    for k, n in enumerate(sizes):
        at, total = at + n, total + most - n
        i, j = bisect_left(least, -total, key=lambda x: -x), k + 1
        ends.append(at)
        least.append(min(least[-1], total))
        if n > most or i == j or at - ends[i] < LEAST:
            continue
        while i < k and sizes[i] > most:
            i += 1
        if at - ends[i] >= LEAST:
            yield ends[i], at


def random_spans(text: str, known: list[tuple[int, int, int]], encoding, most: float) -> list[tuple[int, int, int]]:
    """Strings that touch no known span, are no digest or identifier, and have at most `most` characters a token.

    What the known spans leave of a run is judged whole; if it passes for readable, so are its parts between
    separators and its windows of low ratio, without the digests and UUIDs in it. Windows that overlap are one span.
    """
    plain = lambda s: DIGEST.fullmatch(s) or UUID.fullmatch(s) or IDENTIFIER.fullmatch(s)
    low = lambda s: len(s) <= most * len(encoding.encode_ordinary(s))
    found, taken = [], joined([(x, y) for x, _, y in known])
    for m in CANDIDATE.finditer(text):
        for a, b in outside(m.start(), m.end(), taken):
            s = text[a:b]
            if plain(s):
                continue
            if low(s):
                found.append((a, 3, b))
                continue
            some = []
            for c, d in outside(0, len(s), [x.span() for x in INSIDE.finditer(s)]):
                t = s[c:d]
                some += [(c + x.start(), c + x.end()) for x in PART.finditer(t) if not plain(x.group()) and low(x.group())]
                some += [(c + x, c + y) for x, y in low_windows(t, encoding, most) if not plain(t[x:y])]
            found += [(a + x, 3, a + y) for x, y in joined(some)]
    return found


SCHEMA = "doc_id {id}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, most: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """One row per row of `docs`: counts by kind, a digest of the base spans, and all spans in code points (end exclusive).

    Null counts as empty: no spans, and the digest of the empty string. Repeated rows each get a result, an empty
    table gives an empty one, and only the two named columns are read. Texts are scanned whole, where they are.
    """
    path = vocabulary or default_path("byte_bpe_50k.tiktoken")
    id_type = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(path)
        for b in slices(batches):
            counts, digests, spans = [[] for _ in KINDS], [], []
            for text in b.column(1):
                t = text.as_py()
                base = base_spans(t)
                more = random_spans(t, base, encoding, most)
                every = sorted(base + more)
                for k in range(len(KINDS)):
                    counts[k].append(sum(x[1] == k for x in every))
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{x}:{y}" for x, k, y in base).encode()).hexdigest())
                spans.append([{"kind": KINDS[k], "start": x, "end": y} for x, k, y in every])
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select(quoted(id_col).alias("doc_id"), text_of(text_col).alias("t")).mapInArrow(run, SCHEMA.format(id=id_type))
