"""Words of many texts at once as 64-bit hashes, without a Python object a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of a filter that travel in one row, in bytes.
STRIPE = 1 << 14
#: Bytes whose words are hashed together.
TOGETHER = 4 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
SHUFFLE = np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * SHUFFLE
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def rolled(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n numbers on end."""
    m = max(0, len(x) - n + 1)
    h = np.full(m, n, np.uint64)
    for j in range(n):
        h = (h ^ x[j : j + m]) * BASE
        h ^= h >> np.uint64(29)
    h *= SHUFFLE
    return h ^ (h >> np.uint64(32))


class Words:
    """Hashes words (parted by white space of ASCII, A-Z as a-z) by polynomials in their bytes' values, taken out of one
    running sum over the batch."""

    def __init__(self) -> None:
        byte = np.arange(256, dtype=np.uint64)
        byte[65:91] += np.uint64(32)
        self.value = mixed(byte + np.uint64(1))
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.powers = self.inverse = np.ones(1, np.uint64)

    def cut(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and each text's number of words."""
        space = self.space[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = space[:-1]
        edge[offs] = True
        start = np.flatnonzero(edge[:-1] & ~space)
        edge[:-1] = space
        edge[offs] = True
        end = np.flatnonzero(edge[1:] & ~space) + 1
        return start, end, np.diff(np.searchsorted(start, offs))

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words at these places, which are in order."""
        out, at = np.zeros(len(start), np.uint64), 0
        while at < len(start):  # words within so many bytes, or one
            to = max(at + 1, int(np.searchsorted(end, start[at] + TOGETHER, "right")))
            a, b = int(start[at]), int(end[to - 1])
            if b - a > len(self.powers):
                self.powers, self.inverse = (_powers(x, b - a) for x in (int(BASE), pow(int(BASE), -1, 1 << 64)))
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(self.value[data[a:b]] * self.powers[: b - a], out=total[1:])
            out[at:to] = (total[end[at:to] - a] - total[start[at:to] - a]) * self.inverse[start[at:to] - a]
            at = to
        return mixed(out)

    def of(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and each text's number of words."""
        start, end, count = self.cut(data, offs)
        return self.hashes(data, start, end), count


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words at these places as binary values, A-Z as a-z."""
    offs = np.concatenate(([0], np.cumsum(end - start)))
    at = np.repeat(start - offs[:-1], end - start) + np.arange(offs[-1])
    body = LOWER[data[at]]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(body)]).cast(pa.binary())


def _bit(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys.view(np.uint64) * BASE >> np.uint64(64 - size)).astype(np.int64)


def bits_of(keys: DataFrame, size: int) -> np.ndarray:
    """A filter of 2^size bits with the bit of each of the keys (one long column) set. However many keys there are, the
    driver gets it once a task, in a fixed number of stripes that are merged on the way."""

    def mark(batches):
        out = np.zeros(1 << size, bool)
        for b in batches:
            out[_bit(b.column(0).to_numpy(zero_copy_only=False), size)] = True
        rows = np.packbits(out).reshape(-1, min(STRIPE, (1 << size) // 8))
        at = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([rows[i].tobytes() for i in at], pa.binary())], ["stripe", "bits"])

    def merge(batches):
        """Sorted by stripe: one is held."""
        now, bits = None, None
        for b in batches:
            for stripe, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(x, np.uint8)
                if stripe != now and now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["stripe", "bits"])
                now, bits = stripe, x if stripe != now else bits | x
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["stripe", "bits"])

    kind = "stripe int, bits binary"
    rows = keys.mapInArrow(mark, kind).repartition(8, "stripe").sortWithinPartitions("stripe").mapInArrow(merge, kind).collect()
    out = np.zeros((1 << size) // 8, np.uint8)
    for r in rows:
        x = np.frombuffer(r.bits, np.uint8)
        out[r.stripe * len(x) : (r.stripe + 1) * len(x)] |= x
    return out


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _bit(keys, len(bits).bit_length() + 2)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & np.uint8(1) != 0
