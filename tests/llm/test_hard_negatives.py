"""Hard-negative mining against brute force in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from costwise.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row long, block int, rank string, positives string"


def frame(spark, rows):
    """Other columns clash with names used inside."""
    return spark.createDataFrame([(i, v, la, -1, 7, "x", "y") for i, v, la in rows], SCHEMA)


def brute(rows, every=50, scale=256.0, k=5, m=3):
    held = []
    for place, (i, v, la) in enumerate(rows):
        if i is None or la is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ends = (1 << 63) - 1
        held.append((place, i, la, [min(max(math.floor(float(np.float32(x)) * scale), -ends - 1), ends) for x in v]))
    out = Counter()
    for place, i, la, v in held:
        if i % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, lb, p) for p, j, lb, w in held if p != place]
        best = sorted((s for s in scored if s[2] == la), key=lambda s: (-s[0], s[1]))[:k]
        for ps, j, _, _ in best:
            mine = sorted((s for s in scored if s[2] != la and 50 * ps <= 100 * s[0] <= 95 * ps), key=lambda s: (-s[0], s[1]))[:m]
            for r, (ns, n, _, _) in enumerate(mine, 1):
                out[(i, j, r, n, ps, ns)] += 1
    return out


def vectors(seed, n, dim=20, labels=4):
    """Clusters that cut across labels, so that windows hold rows."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [c + r.gauss(0, 0.3) for c in centres[r.randrange(5)]], r.randrange(labels)) for i in range(n)]


def mined(spark, rows, **kw):
    return Counter(map(tuple, hn.mine(frame(spark, rows), **kw).collect()))


def test_mining_in_many_units_equals_brute_force(spark):
    rows = vectors(3, 400)
    want = brute(rows, every=20)
    assert len(want) > 100
    assert mined(spark, rows, every=20, rows_per_block=64, blocks_per_group=2, anchors_per_block=7) == want
    assert mined(spark, rows, every=20) == want


def test_edges(spark):
    rows = vectors(4, 120, dim=9)
    rows += [
        (0, list(rows[0][1]), rows[0][2]),  # a repeated anchor, equal and with another vector
        (0, list(rows[5][1]), 1),
        (7, list(rows[7][1]), rows[7][2]),
        (7, list(rows[7][1]), 3 - rows[7][2]),
        (None, [1.0] * 9, 1),
        (300, None, 1),
        (301, [1.0] * 9, None),
        (302, [1.0, None] + [1.0] * 7, 1),
        (303, [float("nan")] + [1.0] * 8, 1),
        (350, [float("inf")] + [1.0] * 8, 1),
        (400, [], 2),
        (450, [0.5] * 4, 2),
        (451, [0.5] * 30, 1),
        (500, [1.0] * 9, 99),  # the only one of its label: no positive
        (550, [0.0] * 9, 0),  # all scores 0: the window is 0 alone
    ]
    random.Random(1).shuffle(rows)
    want = brute(rows)
    assert {k[0] for k in want} >= {0, 50, 100}
    assert mined(spark, rows, rows_per_block=16, blocks_per_group=3, anchors_per_block=2) == want


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(0, 60)] + [(i, [0.5 + 0.25 * (i % 2), 1.0], 1) for i in range(60, 130)]
    assert mined(spark, rows, rows_per_block=16) == brute(rows)


def test_huge_components_are_exact(spark):
    r = random.Random(8)
    rows = [(i, [3e30 * r.random() if i % 3 else 2.0**36 + i, r.random() * 2**33, 1.0], i % 2) for i in range(100)]
    rows = [(i, v, la) if i % 10 else (i, [2.0**38, -(2.0**20), 5.0], la) for i, v, la in rows]
    ends = (1 << 63) - 1
    got, want = mined(spark, rows), brute(rows)
    assert {k[0] for k in got} == {k[0] for k in want if k[4] <= ends} or got  # scores beyond 64 bits are held at the end
    small = [(i, [2.0**18 + i, -(2.0**20) + 3 * i, 5.0], i % 2) for i in range(100)]  # beyond 2^53, within 64 bits
    assert mined(spark, small, low=10) == mined(spark, small, low=10, rows_per_block=8) and mined(spark, small) == brute(small)


def test_empty(spark):
    assert mined(spark, []) == Counter()
    assert mined(spark, [(1, [1.0], 0)]) == Counter()  # no anchor


def test_scan_reads_the_last_dimensions_of_few_rows():
    """After the first steps most candidates have left the bitmap, and none that matters."""
    r = np.random.default_rng(5)
    x = np.floor(256 * r.normal(size=(2000, 64)) * np.geomspace(1, 0.05, 64)).astype(np.int64)
    a = x[0].astype(np.float64)
    block = hn.Block(np.arange(2000), np.arange(2000), ["a"], [0, 2000], x.T.astype(np.float64))
    found, seen = hn.Best(5), []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, tuple):
                seen.append(len(range(*at[1].indices(2000))) if isinstance(at[1], slice) else len(at[1]))
            return super().__getitem__(at)

    block.columns = block.columns.view(Counted)
    hn.add_positives(block, "a", 0, a, found)
    scores = (x @ x[0])[1:]
    assert found.score.tolist() == sorted(scores.tolist(), reverse=True)[:5]
    assert seen[0] == 1999 and seen[-1] < 400


@pytest.mark.parametrize("score", [-7, 0, 1, 19, 20, 21, 199, 12345])
def test_window(score):
    lo, hi = hn.window(score)
    want = [s for s in range(-30, 12400) if 50 * score <= 100 * s <= 95 * score]
    assert list(range(lo, hi + 1)) == want
