"""Quality rules, mixing and license scans."""

import random
import re
from collections import Counter

from framelake.llm import license_scan, mixing, quality

from .conftest import prose


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_matches_brute_force(make, odd_rows):
    more = [(100 + i, t, "en", "a") for i, t in enumerate(["a b c a b c d", "x\nx\n \ny\nx", "# a | b <c> 100%", "a a a a a", prose(3, 80)])]
    rows = odd_rows + more
    got = quality.assess(make(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = []
    for i, t, _, _ in rows:
        m = brute_quality(t)
        want.append((i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_quality_verdict(make):
    clean = "the cat and the dog went to the park with a ball for the afternoon and it was good . " * 1 + prose(5, 60)
    rows = [(1, clean, "en", "a"), (2, clean.upper(), "en", "a"), (3, " ".join(x + "%%%" for x in clean.split()), "en", "a"), (4, prose(5, 200).replace("a", "x"), "en", "a")]
    kept = {r.doc_id: r.kept for r in quality.assess(make(rows)).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}


def test_native_plans_have_no_python(make, odd_rows):
    for df in (quality.assess(make(odd_rows)), license_scan.scan(make(odd_rows))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def brute_targets(sizes):
    """Repeated resharing of what is above three times a source's size."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in names if s not in capped)
        level = {s: 3 * sizes[s] if s in capped else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in capped and level[s] > 3 * sizes[s]}
        if not over:
            return level
        capped |= over


def test_mixing_meets_targets(make, odd_rows):
    r = random.Random(4)
    rows = odd_rows[:5] + [(1000 + i, prose(i, r.randint(1, 60)), "en", r.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(600)] + [(5000, "tiny source", "en", "zz")]
    got = mixing.mix(make(rows)).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for x in got:
        sizes[x.source] += x["size"]
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], x["size"])
        assert 0 <= x.copies <= 3 and x.taken == x.copies * x["size"]
    assert len(got) == len(rows)
    want = brute_targets(sizes)
    for x in got:
        assert abs(x.target - want[x.source]) < 1e-6 and x.source_size == sizes[x.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(make(rows)).collect()))
    kept = mixing.mixture(make(rows))
    assert kept.columns == make(rows).columns and kept.count() == sum(x.copies for x in got)


def test_mixing_of_nothing(make):
    assert mixing.mix(make([])).collect() == []
    assert {x.taken for x in mixing.mix(make([(1, None, None, None), (2, "", "en", "a")])).collect()} == {0}


def test_licenses_match_brute_force(make, odd_rows):
    body = [prose(i, 40) for i in range(6)]
    mit = license_scan.TEMPLATES["mit"]
    edited = mit.replace("merge", "blend")
    half = " ".join(mit.split()[:60])
    rows = odd_rows + [(100 + i, f"{b}\n{x}\n{b}", "en", "a") for i, (b, x) in enumerate(zip(body, [mit, edited, half, "Released under the MIT License.", "licensed under cc-by nc 4.0", "none"], strict=True))]
    got = {(x.doc_id, x.template): round(x.containment, 6) for x in license_scan.scan(make(rows)).collect()}

    def five(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = {}
    for i, t, _, _ in rows:
        s = set(five(t or ""))
        for name, template in license_scan.TEMPLATES.items():
            ts = set(five(template))
            if len(ts & s) >= 0.8 * len(ts):
                want[i, name] = round(len(ts & s) / len(ts), 6)
    assert got == want and (100, "mit") in got and (101, "mit") in got and (102, "mit") not in got and (103, "mit-notice") in got and (104, "cc-by-nc-4.0-notice") in got
    assert license_scan.scan(make([])).collect() == []
    assert license_scan.scan(make(rows), {}).collect() == []
