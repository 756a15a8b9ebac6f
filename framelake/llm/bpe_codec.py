"""Byte-pair encoding by forced boundaries, and decoding.

A pair of symbols (bytes, the last one of a word marked as such) that stands side by side in no token of the vocabulary can
never end up inside one token: no merge reaches across it. Such pairs are certain cuts. The fragments between them are
encoded independently of each other and their ids put one after the other. The end of a word is a certain cut for the same
reason, as no token goes on after it, so texts may also be cut before any white space and their parts encoded by different tasks.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..lineage import cut
from .common import kept, quoted, slices, text_of, widened
from .vocab import default_path

VOCABULARY = "word_bpe_49k.json"
#: Characters of a part; longer texts are encoded in parts, which any executor may take.
PART = 65_536
#: Recent words (and as many older ones and fragments) whose ids a worker keeps, and the length of those.
CACHE, LONGEST = 150_000, 64
#: Characters whose classes, cases and compositions have long been settled. Texts with others are normalised and split by the
#: vocabulary file's own rules as its library reads them, whose Unicode tables are not Python's.
SETTLED = ((0x0, 0x557), (0x1E00, 0x1EFF), (0x2000, 0x2063), (0x20A0, 0x20BE), (0x2100, 0x2188), (0x2190, 0x23FE), (0x2460, 0x2B73), (0x3000, 0x303F), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x1F300, 0x1F64F))


def _class(kind: str) -> str:
    """The settled characters of a general category, as ranges for a pattern."""
    out: list[list[int]] = []
    for low, high in SETTLED:
        for c in range(low, high + 1):
            if unicodedata.category(chr(c))[0] == kind:
                if out and out[-1][1] == c - 1:
                    out[-1][1] = c
                else:
                    out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _byte_names() -> list[str]:
    """The character by which vocabularies of bytes write each byte: itself where it is seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class Codec:
    """Tokens of one vocabulary file, its merges by rank, and the pairs of symbols that tokens hold."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.path, model = path, data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: name for name, i in [*self.ids.items(), *self.special.items()]}
        self.ranks = {tuple(m): r for r, m in enumerate(model["merges"])}
        self.inside = {pair for token in self.ids for s in [self.symbols(token)] for pair in zip(s, s[1:])}
        self.byte_names = _byte_names()
        letters, numbers = _class("L"), _class("N")
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")
        self.unsettled = re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SETTLED) + "]")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words: dict[str, array] = {}
        self.older: dict[str, array] = {}
        self.fragments: dict[str, list[int]] = {}

    def symbols(self, name: str) -> list[str]:
        """Symbols of a token or of a word in the vocabulary's writing: bytes, the last one with the mark of the word's end."""
        if not name.endswith(self.end):
            return list(name)
        body = name[: -len(self.end)]
        return [*body[:-1], body[-1:] + self.end]

    @property
    @lru_cache(maxsize=1)  # noqa: B019
    def rules(self):
        """The library's reading of the file, for texts with characters that are not settled."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def cuts(self, symbols: list[str]) -> list[int]:
        """Where the fragments of a word begin, and its end."""
        inside = self.inside
        return [0, *(i for i in range(1, len(symbols)) if (symbols[i - 1], symbols[i]) not in inside), len(symbols)]

    def merged(self, symbols: list[str]) -> list[int]:
        """Ids of a fragment: the pair of the lowest rank merges first, the leftmost of equals."""
        s, n, ranks = list(symbols), len(symbols), self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or ranks.get((s[i], s[j])) != r:  # one of the two has merged with another since
                continue
            s[i] += s[j]
            s[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((s[i], s[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((s[h], s[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [self.ids[x] for x in s if x]

    def encode_word(self, name: str) -> array:
        """Ids of a word in the vocabulary's writing, without the mark of its end: those of its fragments in a row."""
        out, symbols = array("i"), self.symbols(name + self.end)
        at = self.cuts(symbols)
        for a, b in zip(at, at[1:]):
            key = "".join(symbols[a:b])
            got = self.fragments.get(key)
            if got is None:
                got = self.merged(symbols[a:b])
                if b - a < LONGEST:
                    if len(self.fragments) >= CACHE:
                        self.fragments.clear()
                    self.fragments[key] = got
            out.extend(got)
        return out

    def remembered(self, word: str) -> array:
        """Ids of a word as it stands in the text, which is not among the recent ones; those of the last generation come back."""
        got = self.older.get(word)
        if got is None:
            names = self.byte_names
            got = self.encode_word("".join([names[b] for b in word.encode()]))
        if len(word) < LONGEST:
            if len(self.words) >= CACHE:
                self.words, self.older = {}, self.words
            self.words[word] = got
        return got

    def encode_plain(self, text: str, out: array) -> None:
        """Adds the ids of a text without special tokens: normalised (composed, lower case), split into words, each encoded."""
        if text.isascii():
            low = text.lower()
        else:
            # Cases go by character: a sigma's does not depend on its place.
            low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            if self.unsettled.search(text) or self.unsettled.search(low):
                for name, _ in self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(text)):
                    out.extend(self.encode_word(name))
                return
        words, told = self.words, self.remembered
        for w in self.word.findall(low):
            out.extend(words.get(w) or told(w))

    def encode(self, text: str) -> array:
        """Ids of a text; strings of special tokens in it are those tokens."""
        out = array("i")
        if "<|" not in text:
            self.encode_plain(text, out)
            return out
        for k, part in enumerate(self.specials.split(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                self.encode_plain(part, out)
        return out

    def decode(self, ids) -> str:
        """The tokens' strings, one space apart; ids without a token say nothing."""
        names = self.names
        return " ".join([names[i] for i in ids if i in names])


@kept
@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(found: list[array]) -> pa.Array:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    values = np.frombuffer(b"".join(x.tobytes() for x in found), np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, part: int = PART, decoded: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id and ids, the token ids of the whole text; with `decoded` also that: the ids' text.

    Null and empty texts have no ids and decode to nothing. Only the two named columns are read, whatever others there are;
    repeated rows and ids each get a row, and an empty table gives an empty one. Texts of `part` characters or more are cut
    before white space once so many have passed, their parts encoded by other tasks and put together again; only what is
    one row of the result, the ids of one document, ever meets in one place.
    """
    path = vocabulary or default_path(VOCABULARY)
    rows = docs.select(quoted(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, ids array<int>" + (", decoded string" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, 256, 1 << 20):
            found = [c.encode(t) for t in b.column(1).to_pylist()]
            columns, names = [b.column(0), _lists(found)], ["doc_id", "ids"]
            if decoded:
                columns, names = [*columns, pa.array(list(map(c.decode, found)), pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, 16, 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists([c.encode(t) for t in b.column(2).to_pylist()])], names=["row", "nth", "ids"])

    is_long = F.length("text") >= part
    plain = rows.where(~is_long).mapInArrow(run, schema)
    # The few long rows are written once, so that their numbers stay the same through all that follows.
    long = cut(rows.where(is_long).withColumn("row", F.monotonically_increasing_id()))
    texts = F.regexp_extract_all("text", F.lit(rf"(?s).{{{part}}}[^ \n]*|.+"), F.lit(0))
    parts = long.select("row", F.posexplode(texts).alias("nth", "text")).repartition("row", "nth").mapInArrow(run_parts, "row long, nth int, ids array<int>")
    whole = parts.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("nth", "ids"))), lambda x: x.ids)).alias("ids"))
    done = long.select("doc_id", "row").join(whole, "row").select("doc_id", "ids")
    if decoded:
        done = decode(done, vocabulary=path)
    return plain.unionByName(done)


def decode(encoded: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """`encoded` with the column decoded (replaced if there is one): the strings of its ids' tokens, one space apart, special tokens
    among them. Null lists, null ids and ids without a token say nothing; an empty table gives an empty one."""
    path = vocabulary or default_path(VOCABULARY)
    rows = encoded.drop("decoded")
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, 256):
            texts = [c.decode(x or ()) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    return rows.mapInArrow(run, widened(rows, decoded=StringType()))
