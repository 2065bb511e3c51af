"""Canonical length-limited Huffman codes over token ids, in numpy.

Only code lengths need storing: codes of one length are consecutive, in id
order. Blocks are bit strings (high bit first) with the bit offset of every
``EVERY``-th id, so a decoder starts at all checkpoints at once and walks them
in step, one table look-up for each id.
"""

from __future__ import annotations

import numpy as np

MAX_BITS = 16
EVERY = 64


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); 0 for ids that do not occur.

    The limit is raised to what the number of distinct ids needs. One single
    id gets one bit.
    """
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    limit = max(max_bits, int(n - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    single = counts[used].astype(np.float64)
    merged, is_single = single, [np.ones(n, bool)]
    for _ in range(limit - 1):  # from the deepest level up
        even = len(merged) // 2 * 2
        weights = np.concatenate([single, merged[:even:2] + merged[1:even:2]])
        order = np.argsort(weights, kind="stable")
        merged = weights[order]
        is_single.append(order < n)
    take, length = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(is_single):  # back down: the cheapest items of each level
        singles = int(flags[:take].sum())
        length[:singles] += 1
        take = 2 * (take - singles)
    out[used] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes (uint32) from lengths: shorter first, equal lengths in id order."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint32)
    top = int(lengths.max(initial=0))
    width = (1 << (top - lengths[order].astype(np.int64))) if len(order) else np.empty(0, np.int64)
    first = np.concatenate(([0], np.cumsum(width)[:-1])) if len(order) else width
    codes[order] = first >> (top - lengths[order].astype(np.int64))
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each ``top`` next bits: the id and its length."""
    top = int(lengths.max(initial=0))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    width = 1 << (top - lengths[order].astype(np.int64))
    ids, size = np.repeat(order.astype(np.uint32), width), np.repeat(lengths[order], width)
    short = (1 << top) - len(ids)
    return np.pad(ids, (0, short)), np.pad(size, (0, short), constant_values=1), top


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, every: int = EVERY) -> tuple[bytes, np.ndarray]:
    """(payload, bit offset of ids 0, every, 2 * every, ...)."""
    if not len(ids):
        return b"", np.empty(0, np.uint32)
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    begin = end - size
    # a code of up to 32 bits touches two 32-bit words at most
    word, room = begin >> 5, 64 - (begin & 31) - size
    both = codes[ids].astype(np.uint64) << room.astype(np.uint64)
    out = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    touched = word[starts]
    out[touched] |= np.bitwise_or.reduceat(both >> np.uint64(32), starts)
    out[touched + 1] |= np.bitwise_or.reduceat(both & np.uint64(0xFFFFFFFF), starts)
    payload = out.astype(">u4").tobytes()[: int(-(-end[-1] // 8))]
    return payload, begin[::every].astype(np.uint32 if end[-1] < 1 << 32 else np.uint64)


def decode(payload: bytes, n: int, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray, int], every: int = EVERY) -> np.ndarray:
    """The block's ``n`` ids, from all checkpoints in step."""
    if not n:
        return np.empty(0, np.uint32)
    ids, size, top = table
    # the 64 bits from every byte on, as one unaligned view
    words = np.ndarray((len(payload) + 1,), ">u8", payload + b"\0" * 16, strides=(1,))
    out = np.zeros((len(checkpoints), every), np.uint32)
    at = checkpoints.astype(np.int64)
    last = 8 * len(payload)
    shift_all, mask = 64 - top, np.uint64((1 << top) - 1)
    for step in range(every):
        window = words[np.minimum(at, last) >> 3].astype(np.uint64)
        peek = ((window >> (shift_all - (at & 7)).astype(np.uint64)) & mask).astype(np.int64)
        out[:, step] = ids[peek]
        at += size[peek]
    return out.reshape(-1)[:n]
