"""Huffman codes and the perfect hash against plain definitions."""

import heapq

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from costwise.llm import huffman
from costwise.llm.perfect_hash import PerfectHash


def plain_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=300), st.integers(0, 2**32 - 1))
def test_round_trip_and_limit(counts, seed):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, 12)
    used = np.flatnonzero(counts)
    assert (lengths[counts == 0] == 0).all() and lengths.max(initial=0) <= 12
    if len(used) > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1.0
    if not len(used):
        return
    ids = np.random.default_rng(seed).choice(used, 1000)
    payload, points = huffman.encode(ids, lengths, huffman.canonical(lengths), 16)
    assert len(points) == -(-1000 // 16)
    table = huffman.decode_table(lengths)
    assert (huffman.decode(payload, 1000, points, table, 16) == ids).all()
    # from any checkpoint alone
    assert (huffman.decode(payload, 16, points[3:4], table, 16) == ids[48:64]).all()


def test_unlimited_cost_is_huffmans():
    counts = np.random.default_rng(1).zipf(1.3, 500) % 100_000
    lengths = huffman.code_lengths(counts, 40)
    assert int((counts * lengths).sum()) == plain_cost(counts.tolist())


def test_limit_is_optimal_against_enumeration():
    counts = np.array([1, 2, 4, 8, 16, 32])
    lengths = huffman.code_lengths(counts, 3)
    assert lengths.max() == 3
    import itertools

    best = min(int((counts * np.array(x)).sum()) for x in itertools.product([1, 2, 3], repeat=6) if sum(2.0**-i for i in x) <= 1)
    assert int((counts * lengths).sum()) == best


def test_limit_is_raised_for_many_ids_and_single_id():
    assert huffman.code_lengths(np.ones(1000), 4).max() == 10
    assert huffman.code_lengths(np.array([0, 7])).tolist() == [0, 1]
    assert huffman.encode(np.empty(0, int), np.zeros(2, np.uint8), np.zeros(2, np.uint32)) [0] == b""


def test_perfect_hash_is_minimal_and_survives_a_dump():
    keys = np.random.default_rng(3).integers(0, 2**63, (50_000, 2)).astype(np.uint64)
    h = PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(50_000))
    assert (PerfectHash.load(h.dump()).slots(keys) == h.slots(keys)).all()
    assert PerfectHash.build(keys[:0]).slots(keys[:5]).tolist() == [-1] * 5
    with pytest.raises(ValueError):
        PerfectHash.build(np.concatenate([keys[:2], keys[:2]]))
