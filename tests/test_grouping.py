"""Grouping in one call, its grounds and its stages against brute force in plain Python."""

import math
import random

from pyspark.sql import functions as F

from framelake.config import GroupingConfig
from framelake.functions import similarity
from framelake.operators import colors, grouping, hashes, objects

CONFIG = GroupingConfig(max_color_distance=0.4, orb_min_matches=2, orb_max_hamming=20)
SCHEMA = """key long, input_ord long, t long, high long, low long, hist array<double>, objects array<struct<ord:int,label:string,x:double,y:double,w:double,h:double>>,
  descriptors array<array<long>>, sharpness double, iso int, exposure double, face double"""


def entries(n, seed):
    """Photos of a few scenes: near hashes, boxes, descriptors and colours inside a scene; some parts unknown or empty."""
    r = random.Random(seed)
    scenes = [([r.getrandbits(32), r.getrandbits(32)], [r.random() for _ in range(8)], [[r.getrandbits(32), r.getrandbits(32)] for _ in range(3)], [("AB"[i % 2], r.random() / 2, r.random() / 2) for i in range(3)]) for _ in range(7)]
    out = []
    for i in range(n):
        h, c, d, o = r.choice(scenes)
        flip = lambda w, k: w ^ sum(1 << b for b in r.sample(range(32), k))
        hist = [x * r.uniform(0.5, 1.5) for x in c]
        hist = [x / sum(hist) for x in hist]
        boxes = [(k, label, x + r.uniform(-0.1, 0.1), y, 0.4, 0.4) for k, (label, x, y) in enumerate(o)]
        out.append((
            i, r.randint(0, 10**6), r.choice((r.randint(0, 6000), r.randint(0, 6000), 3000 + r.randint(0, 20), None)), *(r.choice(([flip(x, r.randint(0, 9)) for x in h], [flip(x, r.randint(0, 9)) for x in h], [0, 0], [None, None]))),
            r.choice((hist, hist, hist, None, [], hist[:5])), r.choice((boxes, boxes, None, [], [(0, None, 0.1, 0.1, 0.0, 0.3)])), r.choice(([[flip(w, r.randint(0, 12)) for w in x] for x in d], None, [])),
            r.uniform(0, 500), r.choice((100, 1600, 6400)), r.random(), r.choice((0.0, 0.0, r.random())),
        ))
    return out


def bhattacharyya(p, q):
    return math.sqrt(max(0.0, 1 - sum(math.sqrt(x * y) for x, y in zip(p, q)))) if p and len(p) == len(q) else 1.0


def brute_iou(a, b):
    w, h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    return w * h / (a[4] * a[5] + b[4] * b[5] - w * h) if w > 0 and h > 0 else 0.0


def brute_links(rows, c=CONFIG):
    out = set()
    order = sorted(rows, key=lambda x: (x[2] is not None, x[2] or 0, x[0]))
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            gap = None if a[2] is None or b[2] is None else b[2] - a[2]
            if gap is not None and gap >= c.horizon_s or a[5] and b[5] and bhattacharyya(a[5], b[5]) > c.max_color_distance:
                continue
            bits = lambda x, y: sum((u ^ v).bit_count() for u, v in zip(x, y))
            known = lambda x: x[3] is not None and (x[3] or x[4])
            burst = gap is not None and gap <= c.burst_window_s
            close = known(a) and known(b) and bits(a[3:5], b[3:5]) <= c.max_phash
            matches = sum(p[1] is not None and p[1] == q[1] and brute_iou(p, q) >= c.semantic_min_iou for p in a[6] or () for q in b[6] or ())
            semantic = gap is not None and gap <= 60 * c.semantic_window_min and matches >= c.semantic_min_matches
            orb = sum(any(bits(x, y) <= c.orb_max_hamming for y in b[7] or ()) for x in a[7] or ()) >= c.orb_min_matches
            if burst or close or semantic or orb:
                out.add((a[0], b[0]))
    return out


def brute_groups(rows, links):
    root = {x[0]: x[0] for x in rows}
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    groups = {}
    for x in sorted(rows, key=lambda x: x[1]):
        groups.setdefault(root[x[0]], []).append(x)
    told = []
    for n, members in enumerate(groups.values(), 1):
        times = [x[2] for x in members if x[2] is not None]
        burst = len(times) >= 2 and max(times) - min(times) <= 15
        sharp = {x[0]: x[8] / (1 + (x[9] - 800) * 0.00015) if x[9] > 800 else x[8] for x in members}
        top = max(0.01, *sharp.values())

        def score(x):
            s = min(1.0, sharp[x[0]] / top)
            return s if burst else 0.6 * x[11] + 0.35 * s + 0.05 * x[10] if x[11] > 0 else 0.8 * s + 0.2 * x[10]

        ranked = sorted(members, key=lambda x: (-score(x), x[1]))
        told.append((min(times) if times else math.inf, n, burst, [(x[0], round(score(x), 9)) for x in ranked]))
    return {(f"G{n}", place, burst, tuple(ranked)) for place, (_, n, burst, ranked) in enumerate(sorted(told), 1)}


def test_links_and_groups(spark):
    for seed, crowded in ((1, 4096), (2, 10)):
        rows = entries(110, seed)
        df = spark.createDataFrame(rows, SCHEMA)
        want = brute_links(rows)
        got = grouping.photo_links(df, CONFIG, crowded=crowded)
        assert sorted((x.a, x.b) for x in got.collect()) == sorted(want)
        groups, members = grouping.group_photos(df, CONFIG, crowded=crowded)
        by_group = {}
        for x in sorted(members.collect(), key=lambda x: x["rank"]):
            by_group.setdefault((x.group_id, x.position, x.is_burst), []).append((x.key, round(x.score, 9)))
        assert {(*k, tuple(v)) for k, v in by_group.items()} == brute_groups(rows, want)
        shown = {(x.group_id, x.position, x.is_burst): (x["size"], x.best_key) for x in groups.collect()}
        assert shown == {k: (len(v), v[0][0]) for k, v in by_group.items()}


def test_each_ground_is_needed(spark):
    """The random photos have links of every ground alone, and a veto that matters."""
    rows = entries(110, 1)
    whole = brute_links(rows)
    off = [dict(burst_window_s=-1), dict(max_phash=-1), dict(semantic_window_min=-1), dict(orb_min_matches=99)]
    assert all(brute_links(rows, GroupingConfig(**{"max_color_distance": 0.4, "orb_min_matches": 2, "orb_max_hamming": 20} | x)) < whole for x in off)
    assert brute_links(rows, GroupingConfig(max_color_distance=1.0, orb_min_matches=2, orb_max_hamming=20)) > whole


def test_missing_columns_and_empty_tables(spark):
    rows = entries(60, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    bare = [(*x[:5], None, None, None, *x[8:]) for x in rows]
    got = grouping.photo_links(df.drop("hist", "objects", "descriptors"), CONFIG)
    assert sorted((x.a, x.b) for x in got.collect()) == sorted(brute_links(bare))
    assert [x.collect() for x in grouping.group_photos(df.limit(0), CONFIG)] == [[], []]


def test_no_feature_is_copied_into_time_cells(spark):
    """Only keys, times, hashes and a count go through the join of times."""
    df = spark.createDataFrame(entries(20, 4), SCHEMA)
    assert grouping._narrow(df, "key").columns == ["key", "t", "high", "low", "n_descriptors"]


def test_hash_links(spark):
    r = random.Random(6)
    base = [(r.getrandbits(32), r.getrandbits(32)) for _ in range(12)]
    rows = [(i, *[w ^ sum(1 << b for b in r.sample(range(32), r.randint(0, 9))) for w in r.choice(base)]) for i in range(250)] + [(300 + i, 7, 7) for i in range(30)] + [(400, 0, 0), (401, 0, 0), (402, None, 5), (403, 5, None)]
    df = spark.createDataFrame(rows, "key long, high long, low long")
    known = [x for x in rows if None not in x and (x[1] or x[2])]
    for most, parts in ((14, 4), (14, 8), (3, 2), (0, 4), (20, 16)):
        want = sorted((a[0], b[0]) for a in known if a[0] % 5 == 0 for b in known if a[0] != b[0] and (a[1] ^ b[1]).bit_count() + (a[2] ^ b[2]).bit_count() <= most)
        got = sorted(tuple(x) for x in hashes.hash_links(df.where("key % 5 = 0"), df, most, parts=parts).collect())
        assert got == want and want


def test_object_links(spark):
    r = random.Random(8)
    photos = [(i, r.choice((r.randint(0, 2000), 660, 1320, None))) for i in range(60)]
    seen = [(r.randrange(60), k, r.choice("ABC") if k % 9 else None, r.uniform(-0.3, 1.2), r.uniform(-0.3, 1.2), r.choice((0.0, 0.2, 0.5, 0.6)), r.choice((0.3, 0.5))) for k in range(300)]
    p = spark.createDataFrame(photos, "key long, t long")
    o = spark.createDataFrame(seen, "key long, ord int, label string, x double, y double, w double, h double")
    time = dict(photos)
    want = set()
    for a in seen:
        for b in seen:
            (ta, ka), (tb, kb) = (time[a[0]], a[0]), (time[b[0]], b[0])
            if None not in (ta, tb, a[2]) and (ta, ka) < (tb, kb) and ka != kb and tb - ta < 660 and a[2] == b[2] and brute_iou((0, 0, *a[3:]), (0, 0, *b[3:])) >= 0.4:
                want.add((ka, kb, a[1], b[1], tb - ta))
    for tiles, crowded in ((1, 4096), (2, 4096), (5, 20)):
        got = [tuple(x)[:5] for x in objects.object_links(p, o, 660, 0.4, tiles=tiles, crowded=crowded).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_few_bins_settle_most_vetoes_and_never_wrongly(spark):
    r = random.Random(9)

    def hist(n, peak, width):
        raw = [math.exp(-(((i - peak) / width) ** 2)) + r.random() * 0.02 for i in range(n)]
        return [x / sum(raw) for x in raw]

    rows = []
    for i in range(60):
        peak, grey = r.randint(0, 179), r.random() < 0.3
        rows.append((i, hist(180, peak, 12) + hist(256, r.randint(0, 12) if grey else r.randint(60, 200), 20) + hist(256, r.randint(0, 255), 40)))
    rows += [(60, [0.0] * 692), (61, None), (62, []), (63, hist(180, 20, 5)), (64, hist(180, 150, 5)), (65, hist(180, 22, 5)), (66, hist(7, 3, 1))]
    photos = spark.createDataFrame(rows, "key long, hist array<double>")
    keys = [x[0] for x in rows]
    pairs = spark.createDataFrame([(a, b) for a in keys for b in keys if a < b], "a long, b long")
    for config in (GroupingConfig(), GroupingConfig(empty_hist="skip_veto")):
        side = lambda c: photos.select(F.col("key").alias(c), F.col("hist").alias(f"of_{c}"))
        whole = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", similarity.color_veto(F.col("of_a"), F.col("of_b"), config).alias("veto"))
        want = sorted(map(tuple, whole.collect()))
        assert sorted((x.a, x.b, x.veto) for x in colors.with_veto(pairs, photos, config).collect()) == want
        told = colors.bounded(pairs, colors.color_features(photos), config)
        vetoed = sum(v for *_, v in want)
        assert 0.8 * vetoed <= told.where("state = 1").count() <= vetoed < len(want)
