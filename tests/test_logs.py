"""Replays, facets, filing and faces against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import cascade, facets, replay
from framelake.plans import actions


def presses(log):
    out, held = [], {}
    for user, n, key, mouse in sorted(log, key=lambda x: x[1]):
        h = held.setdefault(user, [])
        evicted = None
        if key is None:
            action = "ignored"
        elif key in h:
            action = "removed"
            h.remove(key)
        elif len(h) < 4:
            action = "added"
            h.append(key)
        elif mouse:
            action, evicted = "added", h.pop(0)
            h.append(key)
        else:
            action = "ignored"
        out.append((n, action, evicted, tuple(h)))
    return sorted(out)


@pytest.mark.parametrize("share", [0.0, 0.5])
def test_long_logs_split_into_segments(spark, share):
    """Mouse only, keyboard only (a set that is held over many segments) and mixed logs, one of them with most of the rows."""
    r = random.Random(int(share * 10))
    log = [(r.choice((1, 1, 1, 2, None)), n, r.choice((*range(9 if share else 40), None)), r.random() < share if n % 50 else None) for n in range(150)]
    df = spark.createDataFrame(log, "user int, n int, key int, mouse boolean")
    want = presses(log)
    for segment in (4096, 30):
        got = replay.replayed(df, "user", [F.col("n")], segment=segment)
        assert sorted((x.n, x.action, x.evicted, tuple(x.held)) for x in got.collect()) == want
        assert set(got.columns) == {"user", "n", "key", "mouse", "action", "evicted", "held"}
    assert replay.replayed(df.limit(0), "user", [F.col("n")]).collect() == []


def test_toggles_and_caps(spark):
    r = random.Random(2)
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    files = [(i, day(r.randint(0, 9)) if i % 40 else None, f"/p/{r.randint(0, 999):03d}_{i}") for i in range(300)]
    df = spark.createDataFrame(files, "key int, day date, path string")
    logs = [[], [("toggle", 3, None)] * 2 + [("toggle", 5, None)], [("clear", None, None), ("toggle", 4, None), ("toggle", 30, None)], [("toggle", 1, None), ("range", 2, 7), ("toggle", 3, None), ("toggle", 9, None)], [("clear", None, None), ("all", None, None), ("toggle", 9, None)]]
    for actions_ in logs:
        on = {day(n) for n in range(10)}
        for action, a, b in actions_:
            if action == "all":
                on = {day(n) for n in range(10)}
            elif action == "clear":
                on = set()
            elif action == "range":
                on = {day(n) for n in range(10) if a <= n <= b}
            else:
                on ^= {day(a)} & {day(n) for n in range(10)}
        dates = lambda n: None if n is None else day(n)
        toggles = spark.createDataFrame([(k, x, dates(a), dates(b)) for k, (x, a, b) in enumerate(actions_)], "seq int, action string, day date, day_to date") if actions_ else None
        chosen = sorted((x for x in files if x[1] in on), key=lambda x: (-x[1].toordinal(), x[2]))
        for most in (50, 10_000):
            got = facets.imported(df, toggles, most)
            assert sorted(x.key for x in got.collect()) == sorted(x[0] for x in chosen[:most])
            told = facets.import_facets(df, toggles, most, descending=False).collect()
            assert {x.day for x in told if x.chosen} == {d for d in on if any(f[1] == d for f in files)}
            assert all(x.selected_total == len(chosen) and x.over_limit == (len(chosen) > most) for x in told)
            assert {x.day: x.n_imported for x in told if x.n_imported} == {d: sum(f[1] == d for f in chosen[:most]) for d in {f[1] for f in chosen[:most]}}
            assert [x.day for x in sorted(told, key=lambda x: x.place)] == sorted(x.day for x in told)
    assert facets.import_facets(df.limit(0)).collect() == [] and facets.imported(df.limit(0)).collect() == []


def test_filing_ends_at_the_first_failure(spark):
    r = random.Random(4)
    photos = [(i, f"/d{r.randint(0, 3)}/{i}.jpg" if r.random() < 0.9 else None) for i in range(200)]
    wanted = [(r.choice(("a", "b", "c", None)), i, r.randint(0, 40)) for i in range(230)]
    gone, bad = {p for _, p in photos if p and r.random() < 0.2}, {p for _, p in photos if p and r.random() < 0.03}
    path = dict(photos)
    for closed in (set(), {"/d1"}):
        want = set()
        for job in ("a", "b", "c", None):
            rows = [(o, k) for j, k, o in wanted if j == job and path.get(k)]
            over = None
            for _, k in sorted(rows):
                if any(path[x].rsplit("/", 1)[0] in closed for _, x in rows):
                    outcome = "refused"
                elif over:
                    outcome = "not_reached"
                elif path[k] in gone:
                    outcome = "missing"
                elif path[k] in bad:
                    outcome = over = "failed"
                else:
                    outcome = "done"
                want.add((job, k, outcome))
        table = lambda values, name: spark.createDataFrame([(x,) for x in values], f"{name} string")
        got = actions.filing_outcome(spark.createDataFrame(wanted, "job string, key int, ord int"), spark.createDataFrame(photos, "key int, path string"), unwritable=table(closed, "dir"), missing=table(gone, "path"), faulty=table(bad, "path"))
        assert {(x.job, x.key, x.outcome) for x in got.collect()} == want
    plain = actions.filing_outcome(spark.createDataFrame(wanted, "job string, key int, ord int"), spark.createDataFrame(photos, "key int, path string"))
    assert {x.outcome for x in plain.collect()} == {"done"}


def test_folders_once_valid_and_few(spark):
    asked = [("u", i, x) for i, x in enumerate([" a ", "a", "b/c", "", None, "x" * 30, "x" * 31, *[f"n{k}" for k in range(12)]])]
    got = actions.accepted_folders(spark.createDataFrame(asked, "user string, n int, name string"), "user", "n").collect()
    assert [x.folder for x in sorted(got, key=lambda x: x.place)] == ["a", "x" * 30, *[f"n{k}" for k in range(8)]]


def test_eyes_in_faces(spark):
    rows = [
        (1, 1, "face", 0.0, 0.0, 200.0, 200.0, 50.0), (1, 2, "face", 300.0, 0.0, 130.0, 130.0, 70.0), (1, 3, "face", 0.0, 0.0, 60.0, 60.0, 9.0),  # the third is no main face
        (1, 4, "eye", 20.0, 20.0, 30.0, 30.0, 900.0), (1, 5, "eye", 100.0, 20.0, 30.0, 30.0, -5.0), (1, 6, "eye", 190.0, 20.0, 30.0, 30.0, 800.0), (1, 7, "eye", 30.0, 30.0, 15.0, 30.0, 700.0),
        (2, 1, "face", 0.0, 0.0, 119.0, 200.0, None), (3, 1, "face", 0.0, 0.0, 47.0, 300.0, 5.0), (3, 2, "eye", 0.0, 0.0, 20.0, 20.0, 5.0), (4, 1, "face", None, 0.0, 99.0, 99.0, 5.0),
        (5, 1, "face", 0.0, 0.0, 100.0, 100.0, 10.0), (5, 2, "face", 50.0, 0.0, 100.0, 100.0, 20.0), (5, 3, "eye", 60.0, 10.0, 16.0, 16.0, 5000.0), (5, 4, "eye", 80.0, 10.0, 16.0, 16.0, 3000.0),  # eyes in both faces
    ]
    d = spark.createDataFrame(rows, "key int, id int, kind string, x double, y double, w double, h double, sharpness double")
    got = {x.key: x for x in cascade.cascade_photos(spark.range(1, 7).select(F.col("id").cast("int").alias("key")), d).collect()}
    one = got[1]
    assert (one.has_face, one.n_faces, one.face_x, one.face_w, one.face_sharpness, one.eyes_closed, one.both_eyes, one.eye_sharpness) == (True, 2, 0.0, 200.0, 60.0, True, False, 0.9)
    assert (got[2].has_face, got[2].eyes_closed, got[2].eye_sharpness, got[2].face_sharpness) == (True, False, None, None)
    assert [got[k].has_face for k in (3, 4, 6)] == [False] * 3 and not got[6].both_eyes
    assert (got[5].both_eyes, got[5].eye_sharpness, got[5].face_x) == (True, 1.0, 0.0)


def test_selected_files_come_from_a_table(spark, tmp_path):
    from framelake.sources import files

    for i in range(5):
        (tmp_path / f"{i}.jpg").write_bytes(bytes([i]) * (i + 1))
    listing = files.scan(spark, str(tmp_path))
    some = listing.where("length > 3").select("path")
    got = files.load_selected(some.union(some), str(tmp_path)).collect()
    assert sorted((x.key == "file:" + x.path, bytes(x.content)) for x in got) == [(True, bytes([3]) * 4), (True, bytes([4]) * 5)]
