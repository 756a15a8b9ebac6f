"""SentencePiece encoding and decoding as a max-plus scan over the lattice of pieces.

A segmentation is the model's own exactly when each two neighbours, encoded together, come out as they are; the
weight of such a step is 0 and of any other minus infinity, so the best path of the lattice is the only one of finite
weight. The state at a position is the piece that covers or ends at it. A chunk of a giant document maps the states at
its start to those at its end; that is its transfer matrix, kept as the list of its finite entries. Matrices combine
associatively (`compose`), the scan fixes the state at every boundary, and each chunk is then traced back by itself.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..lineage import cut
from .common import kept, let_go, quoted, slices, text_of, widened
from .vocab import default_path, pieces

MARK = "▁"
#: Characters of a chunk; longer texts are encoded by chunks that any executor may take.
CHUNK = 32_768
#: Strings whose ids a worker keeps; twice as many steps as CACHE and a quarter as many prefixes, and the length of those.
WORDS, CACHE, PREFIX = 300_000, 120_000, 6
#: Matrices that one task combines.
FAN = 64
START = (0, 0)  # the state before a text; a state is (characters before the boundary, after it) of a piece


class Follow(dict):
    """Which pieces may follow one piece, worked out when first asked."""

    __slots__ = ("lattice", "left")

    def __init__(self, lattice: Lattice, left: str) -> None:
        self.lattice, self.left = lattice, left

    def __missing__(self, right: str) -> bool:
        return self.lattice.step(self, right)


class Words(dict):
    """Ids (as bytes) of recent strings; those of the last generation come back, others are told anew."""

    __slots__ = ("lattice", "older")

    def __init__(self, lattice: Lattice) -> None:
        self.lattice, self.older = lattice, {}

    def __missing__(self, u: str) -> bytes:
        got = self.older.get(u) or self.lattice.unit(u).tobytes()
        if len(u) < 64:
            if len(self) > WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[u] = got
        return got


class Lattice:
    """Pieces of one model file, the steps between them, and the best paths of strings."""

    def __init__(self, path: str) -> None:
        names, scores, is_byte = pieces(path)
        self.names = names
        self.ids = {p: i for i, p in enumerate(names) if i > 2 and not is_byte[i]}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.bytes = [next(i for i, p in enumerate(names) if is_byte[i] and p == f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        #: Ends of pieces, without the whole ones: what may become a piece by characters in front.
        self.endings = frozenset(p[k:] for p in self.ids for k in range(1, len(p)))
        self.steps: dict[str, Follow] = {}
        self.opening = Follow(self, "")
        self.n_steps = 0
        self.words = Words(self)
        self.prefixes: dict[str, tuple[list[Follow], list[int], list[int]]] = {}
        # No piece holds a mark after another character, a character without a piece, or a letter beside one of the
        # signs that no piece joins to letters: texts fall apart there.
        pairs = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        single = [p for p in self.ids if len(p) == 1 and p != MARK]
        bound = {x for pair in pairs if pair[0].isalpha() != pair[1].isalpha() for x in pair if not x.isalpha()}
        free = [c for c in single if not c.isalpha() and c not in bound]
        joined = "".join(re.escape(c) for c in single if c not in free)
        self.units = re.compile(f"{MARK}*(?:[{joined}]+|[{''.join(map(re.escape, free))}]+)|{MARK}+|.", re.S)
        self.free, self.single = frozenset(free), frozenset(single)

    def apart(self, left: str, right: str) -> bool:
        """Whether no piece can hold the two characters side by side, as `units` tells it."""
        if right == MARK:
            return left != MARK
        if right not in self.single or left not in self.single and left != MARK:
            return True
        return left != MARK and (left in self.free) != (right in self.free)

    def merged(self, text: str) -> list[str]:
        """A short string's pieces: the best neighbours merge first, the leftmost of equals."""
        out = list(text)
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                s = self.score.get(out[i] + out[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def follow(self, left: str) -> Follow:
        """What may follow a piece; anything may follow the empty one."""
        if not left:
            return self.opening
        found = self.steps.get(left)
        if found is None:
            found = self.steps[left] = Follow(self, left)
        return found

    def step(self, known: Follow, right: str) -> bool:
        """Whether the two pieces may follow each other; `known` is the row of the left one, which learns it."""
        if not known.left:
            return True
        if self.n_steps > 2 * CACHE:
            self.steps.clear()
            self.n_steps = 0
        self.n_steps += 1
        found = known[right] = self.merged(known.left + right) == [known.left, right]
        return found

    def is_piece(self, s: str) -> bool:
        return s in self.ids or len(s) == 1

    def forward(self, text: str, last: dict[int, int]) -> dict[int, int]:
        """`last`: length of the piece that ends at some positions already (all later than the start of `text`).
        Adds to it, for each position reached, the length of the piece that ends there on the path of finite weight."""
        ids, first, longest = self.ids, min(last), self.longest
        rows = {end: self.follow(text[end - size : end]) for end, size in last.items()}
        for end in range(first + 1, len(text) + 1):
            if end in last:
                continue
            for start in range(end - 1, max(first, end - longest) - 1, -1):
                piece = text[start:end]
                # A character without a piece stands alone, written as bytes.
                if start in rows and (piece in ids or end - start == 1) and rows[start][piece]:
                    last[end] = end - start
                    rows[end] = self.follow(piece)
                    break
        return last

    @staticmethod
    def back(last: dict[int, int], end: int, start: int) -> list[int]:
        """Cuts from `end` back to `start`, both included, in order."""
        cuts = [end]
        while cuts[-1] > start:
            cuts.append(cuts[-1] - last[cuts[-1]])
        return cuts[::-1]

    def codes(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]

    def unit(self, text: str) -> array:
        """Ids of a string that shares no piece with its neighbours: `forward` and `back` from its start, on lists."""
        n = len(text)
        if n == 1:
            return array("i", self.codes(text))
        ids, steps, endings = self.ids, self.steps, self.endings
        # Paths of a prefix do not depend on what follows, so words share those of their first characters.
        first = text[:PREFIX]
        known = self.prefixes.get(first) if n > PREFIX else None
        rows, size, code = known or ([self.opening], [0], [0])
        begin, rows, size, code = len(rows), rows + [None] * (n + 1 - len(rows)), size + [0] * (n + 1 - len(size)), code + [0] * (n + 1 - len(code))
        for end in range(begin, n + 1):
            # From the shortest piece that ends here on, as far as longer ones do.
            start = end - 1
            piece = text[start]
            while True:
                if piece in ids and rows[start][piece]:
                    size[end], code[end] = end - start, ids[piece]
                    rows[end] = steps.get(piece) or self.follow(piece)
                    break
                if not start or piece not in endings:
                    break
                start -= 1
                piece = text[start:end]
        if known is None and n > PREFIX:
            if len(self.prefixes) > CACHE // 4:
                self.prefixes.clear()
            self.prefixes[first] = rows[: PREFIX + 1], size[: PREFIX + 1], code[: PREFIX + 1]
        out = array("i")
        while n:
            out.append(code[n])
            n -= size[n]
        out.reverse()
        return out

    def encode(self, escaped: str) -> array:
        """Ids of a string that starts and ends where texts fall apart."""
        return array("i", b"".join(map(self.words.__getitem__, self.units.findall(escaped))))

    # Chunks of giant documents. `left` and `right` are the neighbouring characters, up to the longest piece.

    def states(self, left: str, right: str) -> list[tuple[int, int]]:
        """States at a boundary: pieces with a character before it that end at it or later."""
        top = self.longest
        return [(a, b) for a in range(1, min(top, len(left)) + 1) for b in range(0, min(top - a, len(right)) + 1) if self.is_piece(left[len(left) - a :] + right[:b])]

    def seams(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """The first and the last place from `low` to `high` where the text falls apart."""
        first = next((i for i in range(max(1, low), min(high, len(text) - 1) + 1) if self.apart(text[i - 1], text[i])), None)
        if first is None:
            return None
        return first, next(i for i in range(min(high, len(text) - 1), first - 1, -1) if self.apart(text[i - 1], text[i]))

    def transfer(self, left: str, body: str, right: str, is_first: bool, is_last: bool) -> list[tuple[int, int, int, int]]:
        """Finite entries of the chunk's matrix, as (state at its start, state at its end).

        Paths from all states meet wherever the text falls apart, so only the part before the first such place depends
        on the state at the start, and only the part after the last one decides the state at the end.
        """
        entries = [START] if is_first else self.states(left, body + right)
        text, low = left + body + right, len(left)
        whole = low + len(body)
        seams = self.seams(text, low, whole - 1)
        tail = self.leaves(text, whole, self.forward(text[: whole + self.longest], {seams[1]: 0}), is_last) if seams else []
        out = []
        for entry in entries:
            at = low + entry[1]
            if seams:
                if at <= seams[0] and seams[0] in self.forward(text[: seams[0]], {at: sum(entry)}):
                    out.extend((*entry, *leave) for leave in tail)
            elif at > whole:
                if entry[0] + len(body) <= self.longest:  # one piece spans the whole chunk
                    out.append((*entry, entry[0] + len(body), at - whole))
            else:
                out.extend((*entry, *leave) for leave in self.leaves(text, whole, self.forward(text, {at: sum(entry)}), is_last))
        return out

    def leaves(self, text: str, whole: int, last: dict[int, int], is_last: bool) -> list[tuple[int, int]]:
        """States at the end of a chunk that its lattice reaches."""
        if is_last:
            return [(last[whole], 0)] if whole in last else []
        ends = ((end, last.get(end, 0)) for end in range(whole, min(len(text), whole + self.longest) + 1))
        return [(size - (end - whole), end - whole) for end, size in ends if size and end - size < whole]

    def trace(self, left: str, body: str, right: str, entry: tuple[int, int], leave: tuple[int, int]) -> array:
        """Ids of the pieces that begin in the chunk, given the states at both ends."""
        text, at = left + body + right, len(left) + entry[1]
        whole = len(left) + len(body)
        end = whole + leave[1]
        if at >= end:
            return array("i")
        seams = self.seams(text, len(left), whole - 1)
        if not seams:
            return self.between(text[:end], at, end, sum(entry))
        out = self.between(text[: seams[0]], at, seams[0], sum(entry))
        out.extend(self.encode(text[seams[0] : seams[1]]))
        out.extend(self.between(text[:end], seams[1], end, 0))
        return out

    def between(self, text: str, at: int, end: int, size: int) -> array:
        """Ids of the path from `at`, where a piece of `size` ends, to `end`."""
        cuts = self.back(self.forward(text, {at: size}), end, at)
        return array("i", [i for a, b in zip(cuts, cuts[1:]) for i in self.codes(text[a:b])])


Entry = tuple[int, int, int, int]


def compose(a: list[Entry], b: list[Entry]) -> list[Entry]:
    """The max-plus product of two transfer matrices with weights 0 and minus infinity."""
    by_entry: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x in b:
        by_entry.setdefault(x[:2], []).append(x[2:])
    return sorted({(*x[:2], *leave) for x in a for leave in by_entry.get(x[2:], ())})


@kept
@lru_cache(maxsize=1)
def lattice(path: str) -> Lattice:
    return Lattice(path)


@lru_cache(maxsize=1)
def pieces_of(path: str) -> list[bytes]:
    """What each id stands for, in UTF-8; decoding needs no more."""
    names, _, is_byte = pieces(path)
    return [bytes([int(p[3:5], 16)]) if is_byte[i] else p.encode() for i, p in enumerate(names)]


@lru_cache(maxsize=1)
def longest_piece(path: str) -> int:
    names, _, is_byte = pieces(path)
    return max(len(p) for i, p in enumerate(names) if i > 2 and not is_byte[i])


def decoded(raw: list[bytes], ids: Iterable[int]) -> str:
    """The text of some ids: marks become spaces, and the one in front goes."""
    return b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")[1:]


def escaped(text: str) -> str:
    """The model's normalisation: spaces become marks and one mark goes in front; nothing else changes."""
    return MARK + text.replace(" ", MARK) if text else ""


def _int_lists(rows: list[array]) -> pa.ListArray:
    offsets, flat = array("i", [0]), array("i")
    for r in rows:
        flat.extend(r)
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(memoryview(offsets), pa.int32()), pa.array(memoryview(flat), pa.int32()))


def _fold(matrices: list[list[Entry]]) -> list[Entry]:
    """The product of neighbouring matrices, combined in pairs of pairs."""
    while len(matrices) > 1:
        matrices = [compose(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def _path(matrices: list[list[Entry]], entry: tuple[int, int], leave: tuple[int, int]) -> list[Entry]:
    """The states at both ends of each of some neighbouring chunks, given those at the ends of all: forward, then the one path back."""
    reached, ahead = [], {entry}
    for m in matrices:
        ahead = {x[2:] for x in m if x[:2] in ahead}
        reached.append(ahead)
    states = []
    for k in range(len(matrices) - 1, -1, -1):
        before = reached[k - 1] if k else {entry}
        first = next(x[:2] for x in matrices[k] if x[2:] == leave and x[:2] in before)
        states.append((*first, *leave))
        leave = first
    return states[::-1]


MATRIX = "doc long, chunk int, matrix array<array<int>>"
STATES = "doc long, chunk int, entry_a int, entry_b int, leave_a int, leave_b int"


def _ordered(t: pa.Table) -> tuple[list[dict], list[list[Entry]]]:
    rows = sorted(t.to_pylist(), key=lambda r: r["chunk"])
    return rows, [[tuple(x) for x in r["matrix"]] for r in rows]


def _scan(matrices: DataFrame, most: int, fan: int) -> DataFrame:
    """STATES of each chunk: a parallel scan. Going up, a task multiplies `fan` neighbouring matrices into one, until each document
    has one; going down, the states at the ends of a product give those at the ends of its factors."""

    def up(t: pa.Table) -> pa.Table:
        rows, found = _ordered(t)
        return pa.table([pa.array([rows[0]["doc"]], pa.int64()), pa.array([rows[0]["chunk"] // fan], pa.int32()), pa.array([[list(x) for x in _fold(found)]], pa.list_(pa.list_(pa.int32())))], names=["doc", "chunk", "matrix"])

    def down(t: pa.Table) -> pa.Table:
        rows, found = _ordered(t)
        first = rows[0]
        states = _path(found, (first["entry_a"], first["entry_b"]), (first["leave_a"], first["leave_b"]))
        columns = [pa.array([r[c] for r in rows], kind) for c, kind in (("doc", pa.int64()), ("chunk", pa.int32()))]
        return pa.table([*columns, *(pa.array([x[i] for x in states], pa.int32()) for i in range(4))], names=["doc", "chunk", "entry_a", "entry_b", "leave_a", "leave_b"])

    levels = [matrices]
    while most > 1:
        levels.append(cut(levels[-1].groupBy("doc", F.floor(F.col("chunk") / fan).alias("part")).applyInArrow(up, MATRIX)))
        most = -(-most // fan)
    # A document's one product starts at START and has one finite entry from there.
    end = lambda i: F.col("matrix")[0][i]
    states = levels[-1].select("doc", "chunk", *[end(i).alias(c) for i, c in enumerate(("entry_a", "entry_b", "leave_a", "leave_b"))])
    for level in levels[-2::-1]:
        states = level.withColumn("part", F.floor(F.col("chunk") / fan).cast("int")).join(states.withColumnRenamed("chunk", "part"), ["doc", "part"]).groupBy("doc", "part").applyInArrow(down, STATES)
    return states


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, chunk: int = CHUNK, fan: int = FAN, verify: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, text (null as empty), n_chunks, ids; with `verify`, instead of the text, round_trip:
    whether the ids, decoded by the worker that made them, are the text. Only the two named columns are read.

    Texts of fewer than `chunk` characters are encoded where they are. Longer ones are cut at fixed places, their chunks
    dealt out for the matrices, the matrices combined `fan` at a time (states only, no text), and chunks dealt out again
    for the traces. An empty text has no ids; repeated rows each get a result; an empty table gives an empty one.
    """
    path = vocabulary or default_path("piece_bpe_32k.model")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(quoted(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    schema = f"doc_id {id_type}, n_chunks int, ids array<int>, round_trip boolean" if verify else f"doc_id {id_type}, text string, n_chunks int, ids array<int>"

    def told(b: pa.RecordBatch, n_chunks: pa.Array, lists: list[array], ids: pa.Array) -> pa.RecordBatch:
        if not verify:
            return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), n_chunks, ids], names=["doc_id", "text", "n_chunks", "ids"])
        raw = pieces_of(path)
        same = [decoded(raw, x) == t for x, t in zip(lists, b.column("text").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), n_chunks, ids, pa.array(same, pa.bool_())], names=["doc_id", "n_chunks", "ids", "round_trip"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(lattice)
        codec = lattice(path)
        for b in slices(batches, 256, 1 << 20):
            lists = [codec.encode(escaped(t)) for t in b.column("text").to_pylist()]
            yield told(b, pa.array([1] * b.num_rows, pa.int32()), lists, _int_lists(lists))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = longest_piece(path)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = escaped(text.as_py())
                for k in range(0, len(t), chunk):
                    row = [doc], [k // chunk], [-(-len(t) // chunk)], [t[max(0, k - reach) : k]], [t[k : k + chunk]], [t[k + chunk : k + chunk + reach]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, x) for v, x in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["doc", "chunk", "n_chunks", "left", "body", "right"])

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = lattice(path)
        for b in slices(batches, 16):
            matrices = [codec.transfer(r["left"], r["body"], r["right"], r["chunk"] == 0, r["chunk"] == r["n_chunks"] - 1) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("chunk"), pa.array([[list(x) for x in m] for m in matrices], pa.list_(pa.list_(pa.int32())))], names=["doc", "chunk", "matrix"])

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = lattice(path)
        for b in slices(batches, 16):
            ids = [codec.trace(r["left"], r["body"], r["right"], (r["entry_a"], r["entry_b"]), (r["leave_a"], r["leave_b"])) for r in b.select(["left", "body", "right", "entry_a", "entry_b", "leave_a", "leave_b"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("chunk"), _int_lists(ids)], names=["doc", "chunk", "ids"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64, 1 << 20):
            yield told(b, b.column("n_chunks"), [array("i", x.values.to_numpy().tobytes()) for x in b.column("ids")], b.column("ids"))

    is_long = F.length("text") > chunk - 1
    plain = rows.where(~is_long).mapInArrow(short, schema)
    # The few giant rows are written once: their number in the table then stays the same through all that follows.
    giant = cut(rows.where(is_long).withColumn("doc", F.monotonically_increasing_id()))
    longest = giant.agg(F.max(F.length("text")).alias("n")).first().n or 0
    chunks = giant.select("doc", "text").mapInArrow(split, "doc long, chunk int, n_chunks int, left string, body string, right string").repartition("doc", "chunk")
    states = _scan(cut(chunks.mapInArrow(transfers, MATRIX)), max(2, longest // chunk + 1), fan)
    traced = chunks.join(states, ["doc", "chunk"]).mapInArrow(traces, "doc long, chunk int, ids array<int>")
    whole = traced.groupBy("doc").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda x: x.ids)).alias("ids"))
    done = giant.join(whole, "doc").select("doc_id", "text", "n_chunks", "ids")
    return plain.unionByName(done.mapInArrow(checked, schema) if verify else done)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """`encoded` with the column decoded (replaced if there is one): the text of its ids. Null ids count as none, and so do null
    lists. A text with U+2581 comes back with a space there. An empty table gives an empty one."""
    path = vocabulary or default_path("piece_bpe_32k.model")
    rows = encoded.drop("decoded")
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = pieces_of(path)
        for b in slices(batches, 256):
            texts = [decoded(raw, x.values.drop_null().to_pylist() if x.is_valid else []) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    return rows.mapInArrow(run, widened(rows, decoded=StringType()))
