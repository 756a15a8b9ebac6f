"""Language identification: piece probabilities of each language, with all segmentations of a word summed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .common import fresh, kept, let_go, quoted, slices, widened
from .vocab import default_path, pieces

MARK = "▁"
#: Letters of a word; longer runs count as several words.
LETTERS = r"\p{L}{1,32}"
#: Sums over segmentations carry this factor for each character: all segmentations of a word have the same number of characters,
#: so it cancels out, and the sums of 33 characters stay within double precision. What still is smaller counts as LEAST.
FACTOR, LEAST = float(1 << 25), 1e-300
#: Bounds of the fit: documents of each language (chosen by a hash of their id), languages, and rounds.
TRAIN_DOCS, MAX_LANGUAGES, ROUNDS, PSEUDO = 1500, 200, 4, 0.05
WORD_CACHE = 250_000
UNKNOWN = "und"


class Vocabulary:
    """Ids of the letter pieces of a public vocabulary; one more id for any other letter, and one of probability 0."""

    def __init__(self, path: str) -> None:
        names, _, is_byte = pieces(path)
        letters = regex.compile(rf"{MARK}?\p{{L}}*")
        kept = [p for i, p in enumerate(names) if i > 2 and not is_byte[i] and letters.fullmatch(p)]
        self.ids = {p: i for i, p in enumerate(kept)}
        self.other, self.none = len(kept), len(kept) + 1
        self.longest = max(map(len, kept))
        self.factor = FACTOR ** np.array([*map(len, kept), 1, 0], float)
        # Edges of the tree of all pieces, in order: (node, character) as one number, the child, and the piece that ends there (or none).
        nodes, edges = {"": 0}, {}
        for piece in kept:
            for k in range(1, len(piece) + 1):
                edges.setdefault(nodes[piece[: k - 1]] << 21 | ord(piece[k - 1]), nodes.setdefault(piece[:k], len(nodes)))
        names = list(nodes)
        self.edges = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[e] for e in self.edges.tolist()], np.int64)
        self.piece = np.array([self.ids.get(names[c], self.none) for c in self.child.tolist()], np.int32)

    def lattice(self, words: list[str]) -> np.ndarray:
        """Ids of words of one length n, as [word, end, size]: the piece of that size that ends there. The words go down the tree of pieces
        together, from each place in them, as far as pieces begin so."""
        n = len(words[0])
        codes = np.array(words, f"<U{n}").view(np.uint32).reshape(len(words), n).astype(np.int64)
        out = np.full((len(words), n, min(n, self.longest)), self.none, np.int32)
        out[:, :, 0] = self.other
        for start in range(n):
            on, node = np.arange(len(words)), np.zeros(len(words), np.int64)
            for k in range(min(n - start, self.longest)):
                edge = node << 21 | codes[on, start + k]
                at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
                there = np.flatnonzero(self.edges[at] == edge)
                if not len(there):
                    break
                on, at = on[there], at[there]
                ends = np.flatnonzero(self.piece[at] != self.none)
                out[on[ends], start + k, k] = self.piece[at[ends]]
                node = self.child[at]
        return out


def forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each prefix, as [word, end, language]; p is [piece, language], with or without factors."""
    w, n, top = ids.shape
    a = np.zeros((w, n + 1, p.shape[1]))
    a[:, 0] = 1
    for end in range(1, n + 1):
        for k in range(1, min(end, top) + 1):
            a[:, end] += a[:, end - k] * p[ids[:, end - 1, k - 1]]
    return a


def expected(ids: np.ndarray, p: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> None:
    """Adds to `counts` how often each piece is expected in the words, over all their segmentations; p has one language."""
    w, n, top = ids.shape
    a, q = forward(ids, p[:, None])[:, :, 0], p[ids]
    b = np.zeros((w, n + 1))
    b[:, n] = 1
    for start in range(n - 1, -1, -1):
        for k in range(1, min(n - start, top) + 1):
            b[:, start] += q[:, start + k - 1, k - 1] * b[:, start + k]
    scale = weight / np.maximum(a[:, n], LEAST)
    for end in range(1, n + 1):
        for k in range(1, min(end, top) + 1):
            np.add.at(counts, ids[:, end - 1, k - 1], scale * a[:, end - k] * q[:, end - 1, k - 1] * b[:, end])


def by_length(words: list[str], most: int = 20_000) -> Iterator[list[int]]:
    """Positions of words of equal length, in parts of bounded size."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for g in groups.values():
        yield from (g[k : k + most] for k in range(0, len(g), most))


@kept
@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None, most: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Piece probabilities by language, from the labelled rows of `docs` with a text.

    The fit takes about `most` documents of each language, chosen by a hash of their id; everything it gathers is
    bounded by that. Words are counted in Spark, and each language's probabilities are fitted by expectation
    maximisation in one task. The model that reaches the driver has at most MAX_LANGUAGES rows of one number a piece.
    """
    path = path or default_path("piece_bpe_32k.model")
    labelled = docs.select(quoted(id_col).alias("id"), quoted(lang_col).cast("string").alias("lang"), quoted(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, most / n))).otherwise(share)
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1 << 30)) / F.lit(1 << 30) < share)
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), 0)).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        v = vocabulary(path)
        words, n = [MARK + w for w in rows["word"]], rows["n"].to_numpy(float)
        parts = [(v.lattice([words[i] for i in g]), n[g]) for g in by_length(words, 5000)]
        p = np.full(v.none + 1, 1.0 / v.none)
        p[v.none] = 0
        for _ in range(ROUNDS):
            c = np.full(v.none + 1, PSEUDO)
            for ids, weight in parts:
                expected(ids, p * v.factor, weight, c)
            c[v.none] = 0
            p = c / c.sum()
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "p": [p]})

    rows = counts.groupBy("lang").applyInPandas(fit, "lang string, p array<double>").collect()
    return {r.lang: np.array(r.p) for r in sorted(rows)}


def predictor(model: dict[str, np.ndarray], path: str):
    """A function from a list of texts to (languages, scores); it keeps the scores of recent words."""
    langs = sorted(model)
    v, letters = vocabulary(path), regex.compile(LETTERS)
    p = np.stack([model[x] for x in langs], axis=1) * v.factor[:, None] if langs else None
    known: dict[str, int] = {}
    table = np.zeros((0, len(langs)))

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        nonlocal table
        words = [letters.findall(t.lower()) if t else [] for t in texts]
        if len(known) > WORD_CACHE:
            known.clear()
            table = table[:0]
        new = list({w for ws in words for w in ws}.difference(known)) if langs else []
        if new:
            scores = np.empty((len(new), len(langs)))
            for g in by_length(new, 2000):
                sums = forward(v.lattice([MARK + new[i] for i in g]), p)[:, -1]
                scores[g] = np.log(np.maximum(sums, LEAST)) - (1 + len(new[g[0]])) * np.log(FACTOR)
            known.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
            table = np.concatenate([table, scores])
        tags, marks = [], []
        for ws in words:
            if not ws or not langs:
                tags.append(UNKNOWN)
                marks.append(0.0)
                continue
            total = table[[known[w] for w in ws]].sum(0)
            best = int(total.argmax())
            tags.append(langs[best])
            marks.append(float(1 / np.exp(total - total[best]).sum()))
        return tags, marks

    return predict


def predict(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", path: str | None = None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns of `docs`, with the most likely language of each whole text and its posterior probability.

    Words are lower-cased runs of letters. A text that is null or has no letter is `und` with score 0, and so is every
    text under a model without languages. Of equal likelihoods the language that sorts first wins. Columns that are
    already named as the two results are replaced. Rows stay where they are; repeated rows each get a result.
    """
    path = path or default_path("piece_bpe_32k.model")
    kept = docs.drop(lang, score)
    at = kept.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES times the pieces, eight bytes each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(vocabulary)
        tell = predictor(sent.value, path)
        for b in slices(batches, 500, 1 << 20):
            tags, marks = tell(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tags, pa.string()), pa.array(marks, pa.float64())], names=[*b.schema.names, lang, score])

    return kept.mapInArrow(run, widened(kept, **{lang: StringType(), score: DoubleType()}))


def held_out(id_col: str = "doc_id") -> Column:
    """The contract's fold: crc32 of the id as text, mod 4, is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(quoted(id_col).cast("string"), F.lit(""))) % 4 == 2


def accept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.5) -> DataFrame:
    """The rows of `docs`, unchanged, whose language is told with at least `min_score`; the rest (null or empty texts, no letters,
    no likely language) is rejected. The model is fitted on the labelled rows of `docs` outside the held-out fold; where there
    are none, no language can be told, and all rows with a letter are kept. Repeated rows are told alike; an empty table gives
    an empty one. Extra columns may have any names and types.
    """
    model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    if not model:
        return docs.where(F.coalesce(quoted(text_col).rlike(r"\p{L}"), F.lit(False)))
    lang, score = fresh(docs, "lang_pred", "score")
    told = predict(docs, model, text_col, lang=lang, score=score)
    return told.where((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).drop(lang, score)
