"""Canonical length-limited Huffman coding of token ids, in numpy."""

from __future__ import annotations

import numpy as np

LIMIT = 16  #: bits of the longest code, and of the decoding table's index
STEP = 256  #: ids between two bit-offset checkpoints


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Best code lengths of at most `limit` bits for symbols with a count (0: none), by package-merge.

    The work is (symbols x limit), whatever the counts' sum. More than 2 ** limit symbols can't be coded.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit codes of {limit} bits")
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, current = [], weights
    for _ in range(limit - 1):
        pairs = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weights))  # whether each item of the merged list is a symbol, else a package
        current = both[rank]
    take, total = 2 * (len(order) - 1), np.zeros(len(order), dtype=np.int64)
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:take].sum())
        total[:symbols] += 1
        take = 2 * (take - symbols)
    total[:take] += 1
    lengths[order] = total
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by (length, symbol), counting up."""
    out = np.zeros(len(lengths), dtype=np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        span = np.left_shift(np.int64(1), LIMIT - lengths[order].astype(np.int64))
        out[order] = (np.cumsum(span) - span) >> (LIMIT - lengths[order].astype(np.int64))
    return out


class Coder:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths, codes(lengths)
        self.symbol, self.width = np.zeros(1 << LIMIT, dtype=np.uint32), np.ones(1 << LIMIT, dtype=np.uint8)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        span = 1 << (LIMIT - lengths[order].astype(np.int64))
        filled = int(span.sum())
        self.symbol[:filled], self.width[:filled] = np.repeat(order, span), np.repeat(lengths[order], span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, high bits first, and the bit offset of every STEP-th id."""
        width = self.lengths[ids].astype(np.int64)
        end = np.cumsum(width)
        at, bits = end - width, int(end[-1]) if len(ids) else 0
        words = np.zeros(bits // 32 + 2, dtype=np.uint64)
        # a code lies in one or two 32-bit words; no two codes share a bit, so sums are unions
        shifted = self.codes[ids].astype(np.uint64) << (64 - (at & 31) - width).astype(np.uint64)
        word = at >> 5
        new = np.flatnonzero(np.diff(word, prepend=-1))
        if len(new):
            words[word[new]] += np.add.reduceat(shifted >> np.uint64(32), new)
            words[word[new] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), new)
        return words.astype(">u4").tobytes(), at[::STEP].copy()

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All checkpoints' runs in step, one table look-up an id."""
        out = np.zeros((len(checkpoints), STEP), dtype=np.uint32)
        if not n:
            return out.reshape(-1)[:0]
        raw = np.frombuffer(payload + b"\0\0\0\0", dtype=np.uint8)
        at = checkpoints.astype(np.int64)
        full = n // STEP  # checkpoints with a whole run
        for k in range(STEP):
            live = full + (k < n - full * STEP)
            if not live:
                break
            p = at[:live]
            byte = p >> 3
            window = (raw[byte].astype(np.uint32) << 16) | (raw[byte + 1].astype(np.uint32) << 8) | raw[byte + 2]
            index = (window >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF
            out[:live, k] = self.symbol[index]
            p += self.width[index]
        return out.reshape(-1)[:n]
