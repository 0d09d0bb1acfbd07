"""Periodic runs, license scan and hard negatives against plain versions, and on rows of every odd kind."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from conftest import LONG, ODD
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.llm import hard_negatives, license_scan, periodic_runs
from docquarry.llm.license_rules import read_rules


def brute_runs(words: list, shortest: int = 12) -> list[tuple[int, int, int]]:
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j - i + p >= shortest:
                best.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((b, e - b, p) for (b, e), p in best.items())


def repetitive(draw: random.Random) -> list[bytes]:
    letters = draw.choice([1, 2, 2, 3, 5, 30])
    words = [draw.randrange(letters) for _ in range(draw.randint(0, 200))]
    for _ in range(draw.randint(0, 5)):
        if words:
            a = draw.randrange(len(words))
            p = draw.randint(1, max(1, min(50, len(words) - a)))
            words[a:a] = (words[a : a + p] * 6)[: draw.randint(1, 6 * p)]
    if draw.random() < 0.4:
        # highly periodic halves around a break: squares whose only evidence is where regions end
        half = (list(map(int, draw.choice(["01", "0", "011", "01012"]))) * 40)[: draw.randint(12, 90)]
        words[len(words) // 2 : len(words) // 2] = (half + [draw.randrange(3)] * draw.randint(0, 2)) * draw.randint(2, 3)
    return [b"%d" % w for w in words]


def test_all_runs_are_found():
    draw = random.Random(3)
    for _ in range(300):
        texts = [repetitive(draw) for _ in range(draw.randint(1, 4))]
        counts, runs, collapsed = periodic_runs.block_runs(texts)
        at = 0
        for words, n, rest in zip(texts, counts, collapsed, strict=True):
            expected = brute_runs(words)
            assert [tuple(r) for r in runs[at : at + n].tolist()] == expected
            gone = {i for s, length, p in expected for i in range(s + p, s + length)}
            assert rest == b" ".join(w for i, w in enumerate(words) if i not in gone)
            at += n


def test_runs_of_one_very_long_text_take_linear_time():
    draw = np.random.default_rng(1)
    head = draw.integers(0, 50_000, 300_000)
    words = [b"%d" % w for w in head.tolist() + head[:150_000].tolist() + head[:150_000].tolist()]
    _, runs, _ = periodic_runs.block_runs([words])
    assert (300_000, 300_000, 150_000) in [tuple(r) for r in runs.tolist()]


def test_runs_of_odd_rows(odd, empty):
    found = {r.doc_id: r for r in periodic_runs.periodic_runs(odd, block_words=64).collect()}
    assert periodic_runs.periodic_runs(odd).count() == len(ODD)
    assert found[4].runs == [] and found[4].collapsed == "" and found[4].n_words == 0
    assert found[5].n_words == 0 and found[8].collapsed == "one"
    # every second word of the long text is the same, the others come back after 977 places
    assert [(r.start, r.length, r.period) for r in found[6].runs] == brute_runs(LONG.split()[:6000])[:0] + [(0, 80_000, 1954)]
    assert found[6].collapsed == " ".join(LONG.split()[:1954])
    assert None in found and periodic_runs.periodic_runs(empty).count() == 0


RULES = read_rules()


def test_rules_are_hundreds_and_ordered():
    assert len(RULES) > 200 and [r.number for r in RULES] == list(range(len(RULES)))
    assert {r.priority for r in RULES} <= {3, 5, 7, 8, 9}
    assert len({r.expression for r in RULES}) == len(RULES)


@pytest.mark.parametrize("rule", RULES, ids=lambda r: f"{r.number}-{r.label}")
def test_keywords_are_in_every_match(rule):
    expression = re.compile(rule.expression.replace("[^ ]+", "[a-z]+"))

    @settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck), database=None)
    @given(st.from_regex(expression, fullmatch=True))
    def check(text):
        words = license_scan.words_of(text.encode())
        assert set(k.encode() for k in rule.keywords) <= set(words)
        spans = license_scan.Scanner([rule], {}).scan([b"before", *words, b"after"])[1]
        assert spans and spans[0][0] == 1

    check()


def test_suppression_against_all_pairs():
    draw = random.Random(5)
    for _ in range(300):
        found = []
        for r in range(draw.randint(0, 25)):
            a = draw.randint(0, 20)
            found.append((a, a + draw.randint(1, 8), draw.choice([3, 5, 9]), r))

        def beats(x, y):
            covers = x[0] <= y[0] and x[1] >= y[1]
            return covers and (x[2] > y[2] or (x[2] == y[2] and ((x[1] - x[0], -x[3]) > (y[1] - y[0], -y[3]))))

        expected = {y for y in found if not any(beats(x, y) for x in found)}
        assert set(license_scan.surviving(found)) == expected


def test_licenses_in_plain_sentences(spark, odd, empty):
    rows = [
        (1, "Released under the MIT License."),
        (2, "licensed under the GNU General Public License, version 3 or (at your option) any later version"),
        (3, "CC-BY-NC 4.0; see the Apache License, Version 2.0"),
        (4, "Permission is hereby granted, free of charge, to nobody. The committee met."),
        (5, None),
        (6, "MIT License mit licensex admit license"),
    ]
    found = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    labels = {i: {d.label for d in r.detections} for i, r in found.items()}
    assert labels[1] == {"mit"} and [tuple(p) for p in found[1].places] == [(3, "mit")]
    assert "gpl-3.0-or-later" in labels[2] and "gpl" not in labels[2]
    assert {"cc-by-nc-4.0", "apache-2.0"} <= labels[3] and {p.label for p in found[3].places} == {"cc-by", "apache"}
    assert labels[4] == labels[5] == labels[6] == set() and found[5].n_words == 0 and found[6].places == []
    assert license_scan.scan_licenses(odd).count() == len(ODD)
    assert license_scan.scan_licenses(empty).count() == 0


def brute_negatives(rows, anchors, positives=5, negatives=10):
    """Rows are ``(row, id, label, x)``; ids may repeat or be missing."""
    last = (1 << 63) - 1
    order = lambda s, r: (-s, last if r[1] is None else r[1])
    out = []
    for a in rows:
        if not anchors(a):
            continue
        scored = [(int(np.dot(a[3], b[3])), b) for b in rows if b[0] != a[0] and len(a[3]) == len(b[3])]
        best = sorted(((s, b) for s, b in scored if b[2] == a[2]), key=lambda t: order(*t))[:positives]
        for ps, p in best:
            fit = [(s, b) for s, b in scored if b[2] != a[2] and 30 * ps <= 100 * s <= 90 * ps]
            for rank, (s, b) in enumerate(sorted(fit, key=lambda t: order(*t))[:negatives], 1):
                out.append((a[1], p[1], rank, b[1], ps, s))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows", [4, 1024])
def test_negatives_against_all_pairs(spark, block_rows):
    draw = np.random.default_rng(block_rows)
    centers = draw.normal(size=(6, 24)) / 5
    rows = []
    for i in range(400):
        x = centers[i % 6] + draw.normal(scale=0.05 if i % 3 else 0.3, size=24) + (0.4 if i % 2 else 0.0)
        rows.append((i, x.astype(np.float32).tolist(), i % 4))
    rows += [(7, rows[0][1], 1), (20, rows[40][1], 2), (20, rows[40][1], 2), (None, rows[3][1], 1)]  # ties, repeated rows
    rows += [(500 + i, rows[i][1][:5], i % 2) for i in range(20)]  # another length
    odd = [
        (600, None, 1), (620, [0.0, None], 1), (640, [float("nan")] * 24, 1), (660, rows[5][1], None),
        (680, [float("inf")] * 24, 0), (700, [1e30] * 24, 0),
    ]
    more = [(720, [], 1), (721, [], 1), (722, [], 2)]
    names = "vec_id long, embedding array<float>, label int"
    frame = spark.createDataFrame(rows + odd + more, names).selectExpr("*", "1 as row", "'x' as x", "2 as id", "3 as score")
    found = hard_negatives.hard_negatives(frame, F.col("vec_id") % 20 == 0, block_rows=block_rows)
    x = [(k, i, v, np.floor(256 * np.array(e, np.float32).astype(float)).astype(np.int64)) for k, (i, e, v) in enumerate(rows + more)]
    expected = brute_negatives(x, lambda r: r[1] is not None and r[1] % 20 == 0)
    assert len(expected) > 100
    assert sorted(map(tuple, found.collect()), key=repr) == expected
    assert hard_negatives.hard_negatives(frame.limit(0), F.lit(True)).count() == 0


def test_segment_bounds_hold_and_prune():
    draw = np.random.default_rng(0)
    x = np.concatenate([np.repeat(draw.integers(-200, 200, (40, 8)), 8, axis=1) + draw.integers(-9, 9, (40, 64)), draw.integers(-300, 300, (40, 64))])
    rows = hard_negatives._Rows(np.zeros(80), np.arange(80), np.arange(80), x, 8)
    exact = rows.scores(rows)
    widths = []
    for mean, deviation in rows.levels:
        middle, spread = mean @ mean.T, deviation @ deviation.T
        assert (np.abs(exact - middle) <= spread * (1 + 1e-9) + 1e-3).all()
        widths.append(spread.mean())
    assert widths == sorted(widths, reverse=True)
    low = np.quantile(exact, 0.95, axis=1)
    left = hard_negatives._survivors(rows, rows, np.ones_like(exact, bool), low, np.full(80, np.inf))
    assert left[exact >= low[:, None]].all() and left[:40, :40].mean() < 0.2
