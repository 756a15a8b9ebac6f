"""Hard negatives by a Voronoi-partitioned nearest-neighbour join over inner products.

A vector x is given one more component, the root of M^2 - |x|^2 with M the greatest norm, and an anchor q a zero: then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the highest inner products are the nearest neighbours. Every vector belongs to the cell of
its nearest pivot. The anchors of a cell need only vectors within a band of distances: by the triangle inequality, those
whose distance from the cell's pivot is in the band, give or take the distance of the cell's farthest anchor. Vectors are
copied to the groups of anchors that they might serve, and to no others; each block of them is joined exactly with its anchors.
Cells whose anchors need the same vectors form one group, so where bounds tell nothing apart, vectors are not copied either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, saved, slices

#: Pivots; anchors of a part of a group, and vectors of a block: one of each meet in one place.
PIVOTS, ANCHORS, ROWS = 64, 8192, 8192
#: Labels are dealt into so many buckets for the join of equal labels.
BUCKETS = 64
#: Largest size of a component times 256; a row with a greater one counts as not finite.
LARGEST = 1 << 20
#: Rounding, in parts of the greatest norm.
SLACK = 1e-6
#: A cell joins a group if neither then needs more than so many times its vectors.
WIDER = 1.25


def _packed(rows: DataFrame, scale: int) -> DataFrame:
    """Rows (id, label, vector, anchor) that take part, as row, id, label, anchor, v (whole components as 16- or 32-bit numbers,
    wide in the second case), dim, norm (squared)."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            kept, packed, wide, dim, norm = [], [], [], [], []
            flat = b.column(2)
            for k, x in enumerate(flat):
                if not x.is_valid or not b.column(1)[k].is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(v).all():
                    continue
                v = np.floor(scale * v)
                top = np.abs(v).max(initial=0)
                if top > LARGEST:
                    continue
                kept.append(k)
                wide.append(bool(top >= 1 << 15))
                packed.append(v.astype("<i4" if wide[-1] else "<i2").tobytes())
                dim.append(len(v))
                norm.append(int((v * v).sum()))
            at = pa.array(kept, pa.int64())
            made = [pa.array(x, kind) for x, kind in ((packed, pa.binary()), (wide, pa.bool_()), (dim, pa.int32()), (norm, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(3).take(at), *made], names=["id", "label", "anchor", "v", "wide", "dim", "norm"])

    done = rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, anchor boolean, v binary, wide boolean, dim int, norm long")
    return done.withColumn("row", F.monotonically_increasing_id())


def unpacked(t: pa.Table | pa.RecordBatch, dim: int) -> np.ndarray:
    """Vectors of a table of packed rows, one a line; shorter ones end in zeros."""
    raw, wide = t.column("v").to_pylist(), t.column("wide").to_pylist()
    if not any(wide) and all(len(x) == 2 * dim for x in raw):
        return np.frombuffer(b"".join(raw), "<i2").reshape(len(raw), dim).astype(np.float64)
    out = np.zeros((len(raw), dim))
    for k, (x, w) in enumerate(zip(raw, wide, strict=True)):
        v = np.frombuffer(x, "<i4" if w else "<i2")
        out[k, : len(v)] = v
    return out


class Cells:
    """Pivots, augmented, with the greatest squared norm."""

    def __init__(self, pivots: np.ndarray, most: int) -> None:
        self.most, self.dim = most, pivots.shape[1]
        self.pivots = self.augmented(pivots)
        self.apart = self._distances(self.pivots)

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.most - (x * x).sum(axis=1)))[:, None]])

    def _distances(self, x: np.ndarray) -> np.ndarray:
        square = (x * x).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(0.0, square))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of vectors from all pivots."""
        return self._distances(self.augmented(x))

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return self._distances(np.hstack([x, np.zeros((len(x), 1))]))


class Groups:
    """Groups of cells by what their anchors need: `bands` has (cell, least and greatest distance needed, farthest anchor, number
    of anchors), `cells` (cell, number of vectors, farthest vector). Both are at most as many as there are pivots."""

    def __init__(self, cells: Cells, bands: list[tuple], sizes: list[tuple], anchors: int, rows: int) -> None:
        slack = SLACK * (1 + cells.most**0.5)
        n, far = np.zeros(len(cells.pivots)), np.full(len(cells.pivots), -np.inf)
        for j, count, farthest in sizes:
            n[j], far[j] = count, farthest
        self.cells, self.group_of, self.low, self.high = cells, {}, {}, {}
        members: list[list[int]] = []
        needs, held = [], []
        wanted = {}
        for i, low, high, reach, count in bands:
            self.low[i], self.high[i] = low - reach - slack, high + reach + slack
            wanted[i] = (n > 0) & (cells.apart[i] - far <= self.high[i]) & (cells.apart[i] + far >= self.low[i])
        for i, *_, count in sorted(bands, key=lambda x: -n[wanted[x[0]]].sum()):
            mine = n[wanted[i]].sum()
            for g, need in enumerate(needs):
                whole = n[need | wanted[i]].sum()
                if held[g] + count <= anchors and whole <= WIDER * min(mine, n[need].sum()):
                    members[g].append(i)
                    needs[g], held[g] = need | wanted[i], held[g] + count
                    break
            else:
                g = len(members)
                members.append([i])
                needs.append(wanted[i])
                held.append(count)
            self.group_of[i] = g
        self.members = members
        #: Parts of a group's anchors, and blocks of its vectors.
        self.parts = [max(1, -(-int(c) // anchors)) for c in held]
        self.blocks = [max(1, -(-int(n[need].sum()) // rows)) for need in needs]

    def served(self, distances: np.ndarray) -> list[np.ndarray]:
        """For each group, which vectors it might need."""
        out = []
        for cells in self.members:
            d = distances[:, cells]
            out.append(((d >= [self.low[i] for i in cells]) & (d <= [self.high[i] for i in cells])).any(axis=1))
        return out


def _placed(base: DataFrame, cells: Cells) -> DataFrame:
    """Row, label, cell and far (distance from its pivot) as a vector, and as an anchor (null for others)."""
    shared = base.sparkSession.sparkContext.broadcast(cells)
    label = base.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in slices(batches, 4096):
            x = unpacked(b, c.dim)
            d, a = c.of_rows(x), c.of_anchors(x)
            cell, own = d.argmin(axis=1), a.argmin(axis=1)
            line, other = np.arange(len(x)), ~b.column("anchor").to_numpy(zero_copy_only=False)
            columns = [pa.array(cell, pa.int32()), pa.array(d[line, cell], pa.float64()), pa.array(own, pa.int32(), mask=other), pa.array(a[line, own], pa.float64(), mask=other)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("label"), b.column("norm"), *columns], names=["row", "label", "norm", "cell", "far", "own", "reach"])

    return base.select("row", "label", "norm", "anchor", "v", "wide").mapInArrow(run, f"row long, label {label}, norm long, cell int, far double, own int, reach double")


def _copied(base: DataFrame, groups: Groups) -> DataFrame:
    """Vectors with the column group, once for each group that they might serve."""
    shared = base.sparkSession.sparkContext.broadcast(groups)
    kinds = {c: base.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in slices(batches, 4096):
            for k, hit in enumerate(g.served(g.cells.of_rows(unpacked(b, g.cells.dim)))):
                t = b.filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(t.num_rows, k), pa.int32()), *t.columns], names=["group", *t.schema.names])

    return base.select("row", "id", "label", "v", "wide").mapInArrow(run, f"group int, row long, id {kinds['id']}, label {kinds['label']}, v binary, wide boolean")


def _by_group(values: list[int], group: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), group)


def _joined(anchors: DataFrame, rows: DataFrame, keys: list[str], local: Callable, schema: str) -> DataFrame:
    """Rows that `local` makes of each block's anchors and vectors."""
    return anchors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(local, schema)


def _sides(left: pa.Table, right: pa.Table, dim: int, exact: bool):
    """Vectors, ids' order and labels of both sides. Vectors of a block are put in the order of their ids, null ids last, then of
    their rows, so that a stable sort by score leaves equal scores in that order."""
    place = pc.sort_indices(right, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end")
    right = right.take(place)
    codes, _ = pd.factorize(pd.Series(left.column("label").to_pylist() + right.column("label").to_pylist(), dtype=object))
    kind = np.float64 if exact else np.int64
    return unpacked(left, dim).astype(kind), right, unpacked(right, dim).astype(kind), codes[: left.num_rows], codes[left.num_rows :]


def _scores(q: np.ndarray, x: np.ndarray, at_once: int = 128) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the anchor, its whole scores); some anchors at once."""
    for k in range(0, len(q), at_once):
        yield from enumerate((q[k : k + at_once] @ x.T).astype(np.int64), k)


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None,
         n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, pivots: int = PIVOTS, anchors: int = ANCHORS, rows: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its `n_positives` best other
    rows of the same label, the `n_negatives` best rows of other labels whose score is from `low` to `high` percent of the positive's.

    Components become floor(`scale` * x), and a score is the integer inner product with the anchor; equal scores go by id, null
    ids last, then by the place in the input. Rows with a null label or vector, or a null, not finite or (scaled) over 2^20
    large component take no part. Of vectors of different lengths the shorter one ends in zeros. Rows that repeat an id or a
    vector are rows of their own. `is_anchor` is null or false for rows that are no anchors; `label` replaces the column's values.
    Columns other than the three are not read; without anchors, or with an empty table, the result is empty.

    Pivots are a sample of `pivots` different vectors, by hash. Bounds that tell cells apart keep copies few; where they do not
    (vectors without clusters), the work is that of comparing all anchors with all vectors, by blocks, and copies of vectors grow
    with the number of parts of `anchors` anchors.
    """
    spark = vectors.sparkSession
    given = quoted(label_col) if label is None else label
    base = saved(_packed(vectors.select(quoted(id_col).alias("id"), given.alias("label"), quoted(vector_col).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")), scale))
    id_type, label_type = (base.schema[c].dataType.simpleString() for c in ("id", "label"))
    whole = base.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.max("norm").alias("norm"), F.max("dim").alias("dim")).first()
    nothing = spark.createDataFrame([], f"anchor_id {id_type}, positive_id {id_type}, rank int, negative_id {id_type}, positive_score long, negative_score long")
    if not whole.anchors:
        return nothing
    dim = max(1, whole.dim)
    exact = whole.norm < 1 << 53  # no inner product is larger
    hashed = F.xxhash64("v")
    sample = base.where(F.pmod(hashed, F.lit(1 << 20)) <= (1 << 20) * 32 * pivots // whole.n).select("v", "wide").distinct().orderBy(hashed, "v").limit(pivots)
    found = sample.toArrow()
    if not found.num_rows:  # few different vectors, none of them in the sample
        found = base.select("v", "wide").limit(1).toArrow()
    cells = Cells(unpacked(found, dim), whole.norm)
    placed = saved(_placed(base, cells))

    # Positives. A cell with enough vectors of the label bounds how far the last of an anchor's positives can be.
    by_label = placed.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"))
    own = placed.where(F.col("own").isNotNull()).groupBy("label", "own").agg(F.max("reach").alias("reach"), F.count(F.lit(1)).alias("anchors"))
    apart = spark.createDataFrame([(i, j, float(d)) for i, line in enumerate(cells.apart) for j, d in enumerate(line)], "own int, cell int, apart double")
    bound = own.join(by_label.where(F.col("n") > n_positives), "label").join(F.broadcast(apart), ["own", "cell"]).groupBy("label", "own").agg(F.min(F.col("reach") + F.col("apart") + F.col("far")).alias("theta"))
    reach = own.join(bound, ["label", "own"], "left").groupBy("own").agg(F.max(F.coalesce("theta", F.lit(float("inf")))).alias("theta"), F.max("reach").alias("reach"), F.sum("anchors").alias("anchors")).collect()
    sizes = [tuple(x) for x in by_label.groupBy("cell").agg(F.sum("n"), F.max("far")).collect()]
    near = Groups(cells, [(x.own, 0.0, x.theta, x.reach, x.anchors) for x in reach], sizes, anchors, rows)
    bucket = F.pmod(F.hash("label"), F.lit(BUCKETS))
    count = {x.bucket: x.n for x in by_label.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect()}
    salts = _by_group([max(1, -(-count.get(b, 0) // rows)) for b in range(BUCKETS)], F.col("bucket"))

    asked = base.where("anchor").select("row", "id", "label", "v", "wide", "norm").join(placed.select("row", "own"), "row")

    def grouped(a: DataFrame, groups: Groups) -> DataFrame:
        """Anchors with their group and their part of it."""
        of_cell = [groups.group_of.get(i, -1) for i in range(len(cells.pivots))]
        a = a.withColumn("group", _by_group(of_cell, F.col("own")))
        return a.withColumn("part", F.pmod(F.hash("row"), _by_group(groups.parts, F.col("group"))))

    def dealt(groups: Groups) -> DataFrame:
        """Vectors, copied to the groups and to all parts of each."""
        return _copied(base, groups).withColumn("part", F.explode(F.sequence(F.lit(0), _by_group(groups.parts, F.col("group")) - 1)))

    def positives(left: pa.Table, right: pa.Table) -> pa.Table:
        q, right, x, own_label, labels = _sides(left, right, dim, exact)
        arow, line = left.column("row").to_numpy(), right.column("row").to_numpy()
        found = []  # anchor, places of its best, their scores
        for k, s in _scores(q, x):
            at = np.flatnonzero((labels == own_label[k]) & (line != arow[k]))
            if len(at) > n_positives:
                at = at[s[at] >= np.partition(s[at], len(at) - n_positives)[len(at) - n_positives]]
            at = at[np.argsort(-s[at], kind="stable")[:n_positives]]
            found.append((np.full(len(at), k), at, s[at]))
        k, at, s = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 3
        return pa.table([pa.array(arow[k]), pa.array(line[at]), right.column("id").take(pa.array(at)), pa.array(s)], names=["arow", "prow", "positive_id", "positive_score"])

    key = ["group", "part", "bucket", "salt"]
    left = grouped(asked, near).withColumn("bucket", bucket).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    right = dealt(near).withColumn("bucket", bucket).withColumn("salt", F.pmod(F.xxhash64("row"), salts).cast("int"))
    first = _joined(left.select(*key, "row", "label", "v", "wide"), right, key, positives, f"arow long, prow long, positive_id {id_type}, positive_score long")
    order = F.row_number().over(Window.partitionBy("arow").orderBy(F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last(), "prow"))
    best = saved(first.withColumn("nth", order).where(F.col("nth") <= n_positives).drop("nth"))

    # Negatives: scores from `low` percent of an anchor's least positive to `high` percent of its greatest are a band of distances.
    each = best.where("positive_score >= 0").groupBy("arow").agg(F.collect_list(F.struct("prow", "positive_id", "positive_score")).alias("positives"), F.min("positive_score").alias("least"), F.max("positive_score").alias("most"))
    armed = asked.join(each, asked["row"] == each["arow"]).drop("arow")
    distance = lambda score, percent: F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + F.lit(float(whole.norm)) - 2 * percent / 100 * F.col(score)))
    bands = armed.join(placed.select("row", "reach"), "row").groupBy("own").agg(F.min(distance("most", high)).alias("low"), F.max(distance("least", low)).alias("high"), F.max("reach").alias("reach"), F.count(F.lit(1)).alias("n")).collect()
    if not bands:
        return nothing
    far = Groups(cells, [tuple(x) for x in bands], sizes, anchors, rows)

    def negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        q, right, x, own_label, labels = _sides(left, right, dim, exact)
        wanted = left.column("positives").to_pylist()
        found, told = [], []  # (anchor, places, scores) and the positive of each place
        for k, s in _scores(q, x):
            scores = [p["positive_score"] for p in wanted[k]]
            at = np.flatnonzero((labels != own_label[k]) & (100 * s <= high * max(scores)) & (100 * s >= low * min(scores)))
            at = at[np.argsort(-s[at], kind="stable")]
            falling = -100 * s[at]
            for p in wanted[k]:
                begin = np.searchsorted(falling, -high * p["positive_score"], "left")
                some = at[begin : min(begin + n_negatives, np.searchsorted(falling, -low * p["positive_score"], "right"))]
                found.append((np.full(len(some), k), some, s[some]))
                told += [p] * len(some)
        k, at, s = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 3
        positive = [pa.array([p[c] for p in told], kind) for c, kind in (("prow", pa.int64()), ("positive_id", left.column("id").type), ("positive_score", pa.int64()))]
        columns = [left.column("row").take(pa.array(k)), left.column("id").take(pa.array(k)), *positive, right.column("row").take(pa.array(at)), right.column("id").take(pa.array(at)), pa.array(s)]
        return pa.table(columns, names=["arow", "anchor_id", "prow", "positive_id", "positive_score", "nrow", "negative_id", "negative_score"])

    key = ["group", "part", "block"]
    blocks = _by_group(far.blocks, F.col("group"))
    left = grouped(armed, far).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    right = dealt(far).withColumn("block", F.pmod(F.xxhash64("row"), blocks).cast("int"))
    schema = f"arow long, anchor_id {id_type}, prow long, positive_id {id_type}, positive_score long, nrow long, negative_id {id_type}, negative_score long"
    last = _joined(left.select(*key, "row", "id", "label", "v", "wide", "positives"), right, key, negatives, schema)
    order = F.row_number().over(Window.partitionBy("arow", "prow").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last(), "nrow"))
    return last.withColumn("rank", order).where(F.col("rank") <= n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
