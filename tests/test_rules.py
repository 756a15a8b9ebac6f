"""The hand-derived cases F1-F30, and grouping against a brute-force version."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from framelake.config import GroupingConfig
from framelake.functions import scalar, similarity
from framelake.operators import candidates, cluster, entries, numbering, portrait, rank
from framelake.plans import actions
from framelake.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_windows_and_horizon(spark):
    close = lambda d, w: one(spark, similarity.seconds_close(F.lit(0), F.lit(d), w))
    assert close(15, 15) and not close(16, 15)  # F1
    rows = spark.createDataFrame([(1, 0), (2, 659), (3, 1319), (4, None)], "key long, t long")
    got = {tuple(x) for x in candidates.candidate_pairs(rows).select("a.key", "b.key").collect()}
    assert {tuple(sorted(x)) for x in got} == {(1, 2), (1, 4), (2, 4), (3, 4)} and len(got) == 4  # F2, F3


def test_phash(spark):
    half = lambda h: [similarity.hash_half(F.lit(h), True), similarity.hash_half(F.lit(h), False)]
    assert one(spark, similarity.hamming(half("ffffffffffffffff"), half("1"))) == 63  # F11
    assert not one(spark, similarity.phash_close(half("0" * 16), half("0" * 16), 14))  # F8
    assert one(spark, similarity.phash_close(half("f" * 16), half("f" * 13 + "c00"), 14))
    assert not one(spark, similarity.phash_close(half("f" * 16), half("f" * 12 + "0001"), 14))  # F3


def array(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_colour(spark):
    d = lambda p, q: one(spark, similarity.bhattacharyya(array(p), array(q)))
    assert d([0.5, 0.5], [0.25, 0.75]) == pytest.approx(0.184591912512) and d([1, 0], [0, 1]) == 1 and d([0, 0], [0, 0]) == 1  # F9
    assert d([1], [1, 0]) == 1
    weights = lambda m: [one(spark, w) for w in similarity.hsv_weights(F.lit(float(m)))]
    assert weights(0) == weights(15) == [0, 0.5, 0.5] and weights(50) == [0.95, 0.03, 0.02]
    assert weights(32.5) == pytest.approx([0.475, 0.265, 0.26])  # F10
    veto = lambda p, q, c=GroupingConfig(): one(spark, similarity.color_veto(p, q, c))
    assert veto(array([1, 0]), array([0, 1]))  # F5
    zeros = array([0] * 692)
    assert veto(zeros, zeros) and not veto(zeros, zeros, GroupingConfig(empty_hist="skip_veto"))  # F6
    assert not veto(F.lit(None).cast("array<double>"), array([0, 1]))  # F7


def box(x, y, w, h, label="a"):
    return F.struct(F.lit(label).alias("label"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h"))


def test_boxes(spark):
    iou = lambda a, b: one(spark, similarity.iou(box(*a), box(*b)))
    assert iou((0, 0, 0.5, 0.5), (0.25, 0, 0.5, 0.5)) == pytest.approx(1 / 3) and iou((0, 0, 1, 1), (1, 0, 1, 1)) == 0 and iou((0, 0, 1, 1), (0, 0, 1, 1)) == 1  # F12
    two = F.array(box(0, 0, 1, 1), box(0, 0, 1, 0.9))
    assert one(spark, similarity.object_matches(two, two, 0.4)) == 4  # an object may count more than once
    assert one(spark, similarity.semantic_similar(F.lit(0), F.lit(180), two, two)) and not one(spark, similarity.semantic_similar(F.lit(0), F.lit(181), two, two))


def test_descriptors(spark):
    row = lambda *w: F.array(*[F.lit(x).cast("long") for x in w])
    a, b = F.array(row(0, 0), row(-1, -1)), F.array(row(0, 1))
    assert one(spark, similarity.descriptor_matches(a, b, 1)) == 1 and one(spark, similarity.descriptor_matches(b, a, 1)) == 1


ROWS = [(1, "g", 100.0, 1600, 0.9, 0.0, 1), (2, "g", 95.0, 100, 0.5, 0.0, 2), (3, "g", 60.0, None, 1.0, 0.0, 3)]
MEMBERS = "key long, component string, sharpness double, iso int, exposure double, face double, input_ord long"


@pytest.mark.parametrize(
    ("burst", "face", "want"),
    [(False, 0.0, [0.931880, 0.9, 0.705263]), (True, 0.0, [0.939850, 1, 0.631579]), (False, 0.5, [0.673947, 0.675, 0.571053])],
)
def test_scores(spark, burst, face, want):
    rows = spark.createDataFrame(ROWS, MEMBERS).withColumn("is_burst", F.lit(burst)).withColumn("face", F.lit(face))
    got = sorted(rank.ranked(rank.with_scores(rows)).collect(), key=lambda x: x.key)
    assert [x.score for x in got] == pytest.approx(want, abs=1e-6)  # F14-F16
    assert [x.key for x in got if x["rank"] == 1] == [max(zip(want, [1, 2, 3], strict=True))[1]]


def test_iso_and_faces(spark):
    adjusted = lambda iso: one(spark, rank.iso_adjusted(F.lit(100.0), F.lit(iso).cast("int")))
    assert [adjusted(x) for x in (800, 1600, 6400, None)] == pytest.approx([100, 89.285714, 54.347826, 100])  # F13
    closed = lambda a, b: one(spark, portrait.eyes_closed(F.lit(a).cast("double"), F.lit(b).cast("double")))
    assert [closed(*x) for x in ((0.5, 0.19), (0.4, 0.4), (0.39, 0.39), (0.39, None), (0.4, None), (None, None))] == [True, False, True, True, False, False]  # F20
    face = lambda *v: F.struct(*[F.lit(x).cast("double").alias(n) for x, n in zip(v, ("smile", "left_open", "right_open"), strict=True)])
    assert one(spark, portrait.face_quality(F.array(face(0.2, 0.8, None), face(None, None, None)))) == 0.5  # F21
    blend = lambda fs, es, c: one(spark, portrait.portrait_blend(F.lit(100.0), F.lit(True), F.lit(float(fs)), F.lit(es).cast("double"), F.lit(c)))
    assert [blend(300, None, False), blend(300, 0.5, False), blend(300, 0.5, True), blend(0, None, True)] == pytest.approx([300, 120.3, 24.06, 20])  # F18
    assert one(spark, portrait.mean_top4(array([10, 20, 30, 40] * 4))) == 40  # F19


def test_exposure(spark):
    hist = lambda clip, n: F.array(*[F.lit(int(clip * n) if i == 0 else n - int(clip * n) if i == 127 else 0).cast("long") for i in range(256)])
    score = lambda clip, mean: one(spark, portrait.exposure_score(hist(clip, 100), F.lit(float(mean))))
    assert [score(0, 127), score(0.1, 200), score(1, 127)] == pytest.approx([1, 0.822402, 0], abs=1e-6)  # F17


def test_metadata(spark):
    f = lambda t: one(spark, scalar.parse_f_number(F.lit(t)))
    assert [f("1/2/3"), f("1e1"), f(".5"), f("28e-1/1"), f("5."), f("/2")] == ["1/2/3", "10", "0.5", "2.8", "5.", "/2"]
    assert [f("14/5"), f("4/1"), f("2.8"), f("f/x"), f(" "), f("1/0")] == ["2.8", "4", "2.8", "f/x", None, "1/0"]  # F22
    t = lambda s: str(one(spark, scalar.parse_exif_time(F.lit(s))))
    assert t("2026:03:19 12:34:56") == t("2026-03-19T12:34:56+09:00") == "2026-03-19 12:34:56" and t("x") == "None" and t("0000:00:00 00:00:00") == "None"  # F23
    iso = lambda s: one(spark, scalar.parse_iso(F.lit(s)))
    assert [iso("ISO 1600, 0"), iso(None), iso("auto")] == [1600, None, None]  # F24
    shown = lambda n: one(spark, scalar.format_window(F.lit(n)))
    assert [shown(59), shown(60), shown(61), shown(3600)] == ["59s", "1m", "1m 1s", "1h"]  # F25
    assert one(spark, scalar.exif_caption(F.expr("timestamp_ntz'2024-01-01 10:11:12'"), F.lit("2.8"), F.lit(""), F.lit("100"))) == "10:11:12  F2.8  ISO100"


def test_group_numbers_and_order(spark):
    rows = spark.createDataFrame([("late", 1, 500, 1), ("late", 2, 505, 2), ("early", 3, 10, 3), ("none", 4, None, 4)], "component string, key long, t long, input_ord long")
    got = {x.component: (x.group_id, x.position, x.is_burst) for x in rank.numbered(rank.groups_of(rows, 15)).collect()}
    assert got == {"late": ("G1", 2, True), "early": ("G2", 1, False), "none": ("G3", 3, False)}  # F26, F27


def test_chain_is_no_burst(spark):
    rows = spark.createDataFrame([(1, 0), (2, 10), (3, 20)], "key long, t long")  # F4
    islands = numbering.islands(rows, 15)
    got = rank.groups_of(islands.withColumn("input_ord", F.col("key")), 15, "island").collect()
    assert len(got) == 1 and got[0]["size"] == 3 and not got[0].is_burst


def test_islands_match_components(spark):
    r = random.Random(1)
    rows = spark.createDataFrame([(i, r.randint(0, 400_000)) for i in range(3000)], "key long, t long")
    pairs = candidates.band_join(rows, 61).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))
    by_links = {x.key: x.component for x in cluster.label_all(rows, pairs).collect()}
    least = {}
    for x in numbering.islands(rows, 60).collect():
        least.setdefault(x.island, []).append(x.key)
    assert by_links == {k: min(v) for v in least.values() for k in v}


def test_components_of_random_graphs(spark):
    r = random.Random(7)
    for n, m in ((60, 40), (200, 190)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1040)]
        label = {x: x for e in edges for x in e}
        for _ in range(60):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        got = {x.node: x.label for x in cluster.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: y for x, y in label.items() if x in got} and all(a == b or a in got for a, b in edges)
    assert cluster.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_numbering_over_buckets(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "key long, v long")
    got = numbering.ordinal(rows, [F.floor(F.col("v") / 10), F.col("v")], "n").collect()
    assert all(x.n == x.v + 1 for x in got)


def test_files_and_plans(spark, tmp_path):
    for name in ("a.JPG", "b.txt", "c.cr2"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.png").write_bytes(b"xy")
    found = files.scan(spark, str(tmp_path))
    assert sorted(x.ext for x in found.collect()) == ["cr2", "jpg", "png"] and files.day_facets(found).first().n_files == 3
    days = spark.createDataFrame([(f"/{d}/{i}.jpg", f"2024-01-0{d}") for d in (1, 2, 3) for i in (1, 2)], "path string, day string")
    assert [x.path for x in files.capped(days.withColumn("day", F.col("day").cast("date")), 3).collect()] == ["/3/1.jpg", "/3/2.jpg", "/2/1.jpg"]  # F28
    photos = spark.createDataFrame([(1, "/x/n.jpg"), (2, "/y/n.jpg"), (3, None)], "key long, path string")
    plan = actions.export_plan(photos.select("key"), photos, "/out")
    assert sorted(x.dst for x in plan.collect()) == ["/out/n.jpg", "/out/n_1.jpg"]  # F29
    held = spark.createDataFrame([("/out", "n.jpg")], "dir string, name string")
    assert sorted(x.dst for x in actions.export_plan(photos.select("key"), photos, "/out", held).collect()) == ["/out/n_1.jpg", "/out/n_2.jpg"]
    kept = actions.delete_plan(photos.select("key"), photos.fillna("/z/m.jpg"), unmarked=photos.where("key = 2").select("key"))
    assert sorted(x.key for x in kept.collect()) == [1, 3]  # F30
    outcome = actions.filing_report(photos, photos, spark.createDataFrame([("/x/n.jpg",)], "path string"))
    assert {x.key: x.outcome for x in outcome.collect()} == {1: "failed", 2: "done", 3: "skipped"}


def test_entries(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "key long, path string, sharpness double")
    new = spark.createDataFrame([(1, None, 9.0), (3, "z", 3.0)], "key long, path string, sharpness double")
    assert sorted(map(tuple, entries.updated(rows, new).collect())) == [(1, "a", 9.0), (2, "b", 2.0)]
    assert [x.key for x in entries.without(rows, new).collect()] == [2]
    assert sorted(x.key for x in entries.toggled(rows, new).collect()) == [2, 3]


def test_composite_groups_match_brute_force(spark):
    """Random photos under the whole rule: candidates, veto, burst or hash, components."""
    r, config = random.Random(3), GroupingConfig()
    photos = []
    for i in range(120):
        hist = r.choice([[1.0, 0.0, 0.0], [0.9, 0.1, 0.0], [0.0, 0.0, 1.0], None])
        photos.append((i, r.choice([None] + [r.randrange(4000)] * 40), r.getrandbits(6), 1, hist))
    rows = spark.createDataFrame(photos, "key long, t long, high long, low long, hist array<double>")
    words = lambda s: [F.col(f"{s}.high"), F.col(f"{s}.low")]
    no = F.lit(False)
    rule = similarity.similar(similarity.color_veto(F.col("a.hist"), F.col("b.hist")), similarity.seconds_close(F.col("a.t"), F.col("b.t"), 15), no, no, similarity.phash_close(words("a"), words("b"), 1))
    links = candidates.candidate_pairs(rows, config.horizon_s).where(rule).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))
    got = {x.key: x.component for x in cluster.label_all(rows.select("key"), links).collect()}

    def linked(p, q):
        if p[1] is not None and q[1] is not None and abs(p[1] - q[1]) >= 660:
            return False
        if p[4] and q[4] and (1 - sum((x * y) ** 0.5 for x, y in zip(p[4], q[4], strict=True))) ** 0.5 > 0.5:
            return False
        burst = p[1] is not None and q[1] is not None and abs(p[1] - q[1]) <= 15
        return burst or (p[2] ^ q[2]).bit_count() <= 1

    label = {p[0]: p[0] for p in photos}
    for _ in photos:
        for p, q in itertools.combinations(photos, 2):
            if linked(p, q):
                label[p[0]] = label[q[0]] = min(label[p[0]], label[q[0]])
    assert got == label
