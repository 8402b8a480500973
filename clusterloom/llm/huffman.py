"""Canonical length-limited Huffman codes, bit packing and table-driven decoding, all in numpy."""

from __future__ import annotations

import numpy as np

MAX_BITS = 18  # a table of 2**18 entries; more than enough for 2**16 ids
STEP = 256  # ids between two bit-offset checkpoints
TOGETHER = 1 << 18  # ids coded or decoded at a time, a multiple of STEP


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code length of each symbol under ``limit`` (0 where it never occurs), by package-merge."""
    used = np.flatnonzero(counts)
    n = len(used)
    out = np.zeros(len(counts), np.uint8)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError("more symbols than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    leaf_of_level = []
    items = weights
    leaf_of_level.append(np.ones(n, bool))
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((weights, pairs))
        is_leaf = np.concatenate((np.ones(n, bool), np.zeros(len(pairs), bool)))
        place = np.argsort(both, kind="stable")
        items, is_leaf = both[place], is_leaf[place]
        leaf_of_level.append(is_leaf)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(leaf_of_level):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        if n := int(lengths[s]):
            code <<= n - last
            codes[s] = code
            code, last = code + 1, n
    return codes


def decode_table(lengths: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) by the next ``limit`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    symbols, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    filled = int(spans.sum())
    symbols[:filled], bits[:filled] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbols, bits


def _packed(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bytes of the ids' bits behind ``begin`` (0 to 7) empty bits, bit offset of each id, and all bits."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n) + begin
    at = ends - n
    value = codes[ids].astype(np.uint64) << (32 - n - (at & 7)).astype(np.uint64)
    total = int(ends[-1]) if len(ends) else begin
    size = (total + 7) // 8 + 4
    out = np.zeros(size, np.float64)
    for k in range(4):
        out += np.bincount((at >> 3) + k, weights=((value >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64), minlength=size)[:size]
    return out.astype(np.uint8), at, total


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Packed bits, and the bit offset of every ``STEP``-th id; worked on ``TOGETHER`` ids at a time."""
    out, checkpoints, done = bytearray(), [np.zeros(0, np.int64)], 0
    for first in range(0, len(ids), TOGETHER):
        data, at, total = _packed(ids[first : first + TOGETHER], codes, lengths, done & 7)
        checkpoints.append(at[::STEP] + (done & ~7))
        if done & 7:
            data[0] |= out.pop()
        done = (done & ~7) + total
        out += data[: (total + 7) // 8].tobytes()
    return bytes(out) + bytes(4), np.concatenate(checkpoints)


def decode(blocks: list[tuple[bytes, np.ndarray, int]], table: tuple[np.ndarray, np.ndarray], limit: int = MAX_BITS) -> list[np.ndarray]:
    """The ids of independent blocks (bits, checkpoints, number of ids), ``TOGETHER`` ids' segments in step."""
    if not blocks:
        return []
    symbols, bits = table
    data = np.frombuffer(b"".join(b for b, _, _ in blocks) + bytes(8), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(b) for b, _, _ in blocks])[:-1])) * 8
    begin = np.concatenate([np.asarray(c, np.int64) + s for (_, c, _), s in zip(blocks, starts, strict=True)])
    count = np.array([n for _, _, n in blocks], np.int64)
    segments = -(-count // STEP)
    size = np.minimum(STEP, np.repeat(count, segments) - (np.arange(len(begin)) - np.repeat(np.cumsum(segments) - segments, segments)) * STEP)
    flat = []
    for first in range(0, len(begin), TOGETHER // STEP):
        pos, left = begin[first : first + TOGETHER // STEP].copy(), size[first : first + TOGETHER // STEP]
        low = int(pos[0]) >> 3
        high = min(len(data), (int(pos[-1]) >> 3) + STEP * limit // 8 + 8)
        own = data[low:high].astype(np.uint32)
        window = own[:-3] << np.uint32(24) | own[1:-2] << np.uint32(16) | own[2:-1] << np.uint32(8) | own[3:]
        pos -= low * 8
        out = np.zeros((len(pos), STEP), np.uint16)
        for k in range(int(left.max(initial=0))):
            word = window[np.minimum(pos >> 3, len(window) - 1)]
            index = (word << (pos & 7).astype(np.uint32)) >> np.uint32(32 - limit)
            out[:, k] = symbols[index]
            pos += bits[index]
        flat.append(out[np.arange(STEP) < left[:, None]])
    return np.split(np.concatenate([np.zeros(0, np.uint16), *flat]), np.cumsum(count)[:-1])
