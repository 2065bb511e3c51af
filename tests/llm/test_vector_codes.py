"""Vector code compression against plain k-means in Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np

from costwise.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, ints string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, la, "x", -1, "y") for i, v, la in rows], SCHEMA)


def brute(rows, parts=8, entries=16, rounds=6, scale=4096.0):
    ends = (1 << 63) - 1
    held = [(i, la, [min(max(math.floor(float(np.float32(x)) * scale), -ends - 1), ends) for x in v]) for i, v, la in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not held:
        return Counter()
    width = max(parts, -(-max(len(v) for *_, v in held) // parts) * parts)
    held = [(i, la, v + [0] * (width - len(v))) for i, la, v in held]
    d = width // parts
    cut = lambda v: [tuple(v[p * d : (p + 1) * d]) for p in range(parts)]
    order = sorted(held, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    books = [[cut(v)[p] for *_, v in order[:entries]] for p in range(parts)]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (dist(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for *_, v in held:
                x = cut(v)[p]
                members[nearest(p, x)].append(x)
            for e, xs in members.items():
                books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs))
    out, by_label = [], Counter()
    for i, la, v in held:
        codes = [nearest(p, x) for p, x in enumerate(cut(v))]
        error = min(sum(dist(x, books[p][codes[p]]) for p, x in enumerate(cut(v))), ends)
        by_label[la] += error
        out.append((i, la, "".join(f"{c:02x}" for c in codes), error))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((*row, min(by_label[row[1]], ends), sha) for row in out)


def coded(spark, rows, **kw):
    return Counter(map(tuple, vc.compress(frame(spark, rows), **kw).collect()))


def vectors(seed, n, dim=16):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 0.2) for _ in range(dim)], r.choice([None, 0, 1, 2])) for i in range(n)]


def test_codes_equal_plain_k_means(spark):
    rows = vectors(1, 300)
    want = brute(rows)
    assert coded(spark, rows) == want
    assert coded(spark, rows, block_rows=16) == want
    other = {"parts": 4, "entries": 5, "rounds": 3, "scale": 100.0}
    assert coded(spark, rows, **other) == brute(rows, **other)


def test_edges(spark):
    rows = vectors(2, 60, dim=11)
    rows += [
        (3, list(rows[3][1]), 1),  # repeated ids, one an equal row
        (3, [0.5] * 11, 1),
        (None, [0.1] * 11, 1),
        (None, [0.2] * 11, None),
        (-5, [0.25] * 11, 4),  # the first entries are equal: ties, unused entries
        (-4, [0.25] * 11, 4),
        (-3, [0.25] * 11, 4),
        (100, None, 1),
        (101, [None] + [0.1] * 10, 1),
        (102, [float("nan")] * 11, 1),
        (103, [float("-inf")] * 11, 1),
        (104, [], 1),
        (105, [0.3] * 3, 1),
        (106, [0.3] * 13, 1),
    ]
    random.Random(3).shuffle(rows)
    assert coded(spark, rows, block_rows=7) == brute(rows)


def test_few_and_none(spark):
    assert coded(spark, []) == Counter()
    assert coded(spark, [(1, None, 2)]) == Counter()
    rows = vectors(4, 3)
    assert coded(spark, rows) == brute(rows)
    assert coded(spark, rows[:1]) == brute(rows[:1])


def test_huge_components_are_exact(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([1.0, 2.0**20, 2.0**30]) * r.random() for _ in range(8)], 0) for i in range(40)]
    assert coded(spark, rows) == brute(rows)


def plain(x, books):
    return np.stack([vc.distances(x[:, p], books[p]).argmin(axis=1) for p in range(x.shape[1])], axis=1)


def run_rounds(x, history, rounds, stamps=True):
    """Codes after every round equal a full search; returns the parts searched per round."""
    bounds, searched = vc.Bounds.none(len(x), x.shape[1]), []
    for _ in range(rounds):
        searched.append(vc.assign(x, bounds, history))
        assert (bounds.code == plain(x, history[-1])).all()
        history = np.concatenate([history, vc.next_book(history[-1], vc.part_sums(x, bounds.code, history.shape[2]))[None]])
    return searched, history


def test_bounds_spare_most_searches_and_change_nothing():
    r = np.random.default_rng(7)
    x = np.floor(4096 * r.normal(size=(2000, 8, 8)) * 0.1 + 1500 * r.integers(0, 4, size=(2000, 8, 1))).astype(np.float64)
    history = x[:16].transpose(1, 0, 2).astype(np.int64)[None]
    searched, _ = run_rounds(x, history, 12)
    assert searched[0] == 16000 and searched[-1] < 8000


def test_net_displacement_is_tighter_than_summed_moves():
    """An entry that moves away and back has no net way: the old bound holds, and no part is searched."""
    r = np.random.default_rng(9)
    x = np.floor(r.normal(size=(500, 1, 4)) * 50).astype(np.float64)
    x[250:] += 1000
    home = np.array([[[0, 0, 0, 0], [1000, 1000, 1000, 1000]]], np.int64)
    away = home + 400
    history = home[None]
    bounds = vc.Bounds.none(500, 1)
    assert vc.assign(x, bounds, history) == 500
    stale = vc.Bounds(*[a.copy() for a in bounds.arrays()])
    history = np.stack([home, away, home])
    own, other = vc.displacements(history)
    assert own[0].max() == 0 and other[0].max() == 0 and own[1].min() == 800
    assert vc.assign(x, stale, history) == 0
    assert (stale.upper_at == 0).all()
