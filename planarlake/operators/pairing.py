"""Pairs of polygons that intersect by vertices, tile by tile, many tiles and pairs at once.

Rows come sorted by tile. Boxes that overlap are found by a sweep over their left sides, vertices are held against the other
polygon's box, and those in it against its edges, an edge a row of a matrix. Arithmetic is that of ring.contains, and so are
the results, pair by pair. Coordinates must be finite and below HUGE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions.point import FLOAT_EPSILON

#: Larger coordinates (and NaN, nulls) are left to the row-by-row test: differences and products would overflow.
HUGE = 1e100
#: Points of the tiles taken together, pairs of boxes looked at together, and numbers of a matrix worked on at once.
POINTS, PAIRS, CELLS = 1 << 18, 1 << 19, 1 << 16
#: Rings up to so many edges are together with their like, larger ones with those of up to twice their edges.
EXACT = 16
#: How far beside a box vertices are tested, as a share of its place: crossings are rounded.
BESIDE = 1e-13


class Rings:
    """Rings by their number of edges: matrices of their corners, a ring a column, from its last point to its last point."""

    def __init__(self, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        first, last = np.cumsum(size) - size, np.cumsum(size) - 1
        self.box = [f.reduceat(v, first) for f, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))]
        beside = BESIDE * np.maximum(np.abs(self.box[0]), np.abs(self.box[2]))
        self.wide = [self.box[0] - beside, self.box[2] + beside]
        closed = (size > 1) & (x[first] == x[last]) & (y[first] == y[last])
        edges = size - closed
        self.kind = np.where(edges <= EXACT, edges, 1 << np.ceil(np.log2(edges)).astype(np.int64))
        self.column = np.zeros(len(size), np.int64)
        self.corners = {}
        for k in np.unique(self.kind):
            rows = np.flatnonzero(self.kind == k)
            self.column[rows] = np.arange(len(rows))
            # One that isn't closed begins with its last point; short columns go on with the last point, as edges without length.
            at = np.arange(k + 1)[:, None] - ~closed[rows]
            at = np.where(at < 0, size[rows] - 1, np.minimum(at, size[rows] - 1)) + first[rows]
            self.corners[int(k)] = x[at], y[at]

    def _by_kind(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(kind, places) of the rows, so many that a matrix of them has CELLS numbers."""
        kind = self.kind[rows]
        for k in self.corners:
            found = np.flatnonzero(kind == k)
            step = max(1, CELLS // (k + 1))
            for start in range(0, len(found), step):
                yield k, found[start : start + step]

    def inside(self, rows: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """Whether the rings at rows contain the points, edges included."""
        out = np.zeros(len(rows), bool)
        for k, some in self._by_kind(rows):
            x, y = (v.take(self.column[rows[some]], axis=1) for v in self.corners[k])
            qx, qy = px[some], py[some]
            over = y > qy
            dx, dy = x[1:] - x[:-1], y[1:] - y[:-1]
            with np.errstate(all="ignore"):
                left = qx < dx * (qy - y[1:]) / dy + x[1:]
            hit = np.logical_xor.reduce((over[1:] != over[:-1]) & left, axis=0)
            e, i = np.divmod(np.flatnonzero(np.abs((qy - y[:-1]) * dx - (qx - x[:-1]) * dy) <= FLOAT_EPSILON), len(some))
            on = [(q[i] >= np.minimum(v[e, i], v[e + 1, i])) & (q[i] <= np.maximum(v[e, i], v[e + 1, i])) for v, q in ((x, qx), (y, qy))]
            hit[i[on[0] & on[1]]] = True
            out[some] = hit
        return out

    def reach(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the rings at b contain a vertex of those at a."""
        out = np.zeros(len(a), bool)
        found = []
        for k, some in self._by_kind(a):
            x, y = (v.take(self.column[a[some]], axis=1)[1:] for v in self.corners[k])
            r = b[some]
            met = x >= self.wide[0][r]
            for v in (x <= self.wide[1][r], y >= self.box[1][r], y <= self.box[3][r]):
                met &= v
            found.append((np.broadcast_to(some, met.shape)[met], x[met], y[met]))
        if found:
            i, px, py = (np.concatenate(v) for v in zip(*found))
            out[i[self.inside(b[i], px, py)]] = True
        return out

    def intersect(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = self.reach(a, b)
        left = np.flatnonzero(~out)
        out[left] = self.reach(b[left], a[left])
        return out


def _ranges(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, v): every v from low[i] up to high[i], without it, some PAIRS at a time."""
    n = np.maximum(high - low, 0)
    upto, lo = np.cumsum(n), 0
    while lo < len(n):
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
        i = np.repeat(np.arange(lo, hi), n[lo:hi])
        yield i, np.arange(len(i)) - np.repeat(upto[lo:hi] - n[lo:hi] - before, n[lo:hi]) + low[i]
        lo = hi


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _points(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = rows.column("points").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten()
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), *(flat.field(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in ("x", "y"))


def _new(rows: pa.Table) -> np.ndarray:
    """Where a tile begins."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in ("level", "tx", "ty", "p", "q"):
        v = _column(rows, k)
        new[1:] |= v[1:] != v[:-1]
    return new


def _pairs(rows: pa.Table, both: bool) -> Iterator[pa.RecordBatch]:
    new = _new(rows)
    tile = np.cumsum(new) - 1
    rings = Rings(*_points(rows))
    order = np.lexsort((rings.box[0], tile))  # tiles stay where they are
    x0, y0, x1, y1 = (v[order] for v in rings.box)
    own, in_x, in_y = (_column(rows, k)[order] for k in ("own", "in_x", "in_y"))
    left, right, part = (_column(rows, k)[order] for k in ("is_left", "is_right", "part"))
    split = (_column(rows, "p") != _column(rows, "q"))[order]
    ids = rows.column("elem_id").combine_chunks().take(pa.array(order))
    n = len(order)
    # The later of two rows has the larger left side; that one must begin in the tile, so that a pair counts in one tile.
    xs, rank = np.unique(x0, return_inverse=True)
    end = np.searchsorted(tile * (len(xs) + 1) + rank, tile * (len(xs) + 1) + np.searchsorted(xs, x1, "right"), "left")
    first = np.flatnonzero(new)
    low = np.maximum(np.arange(n) + 1, (first + np.add.reduceat(~in_x, first, dtype=np.int64))[tile])
    mine = np.flatnonzero(own)
    theirs = np.flatnonzero(~own)

    def made(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["a", "b"])

    def met() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in _ranges(low[mine], end[mine]):
            yield mine[i], j
        if len(theirs):  # rows of finer levels only meet those of the tile's own
            for i, j in _ranges(*(np.searchsorted(mine, v[theirs]) for v in (low, end))):
                yield theirs[i], mine[j]

    if both:
        alone = np.flatnonzero(left & right & own & in_x & in_y & ~split)
        if len(alone):
            yield made(alone, alone)
    for a, b in met():
        good = (y0[b] <= y1[a]) & (y0[a] <= y1[b]) & (in_y[a] | in_y[b])
        if both:
            good &= (left[a] & right[b]) | (left[b] & right[a])
        if split.any():
            good &= ~split[a] | (part[a] != part[b])
        a, b = a[good], b[good]
        hit = rings.intersect(order[a], order[b])
        a, b = a[hit], b[hit]
        if both:
            to, fro = left[a] & right[b], left[b] & right[a]
            a, b = np.concatenate((a[to], b[fro])), np.concatenate((b[to], a[fro]))
        if len(a):
            yield made(a, b)


def in_tiles(batches: Iterator[pa.RecordBatch], both: bool) -> Iterator[pa.RecordBatch]:
    """(a, b) ids of the polygons that meet, of rows sorted by tile: elem_id, points, the tile (level, tx, ty), the groups of
    its rows that are held against each other (p, q; part is the row's own), and whether the row is of the tile's level (own),
    begins in it (in_x, in_y), and is in the left and the right table. With both, pairs come by table, and rows that are in
    both tables pair with themselves; without, two rows pair once in any order."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += len(batch.column("points").flatten())
        if n < POINTS:
            continue
        rows = pa.Table.from_batches(held)
        last = int(np.flatnonzero(_new(rows))[-1])
        if last:
            yield from _pairs(rows.slice(0, last), both)
            rows = rows.slice(last)
        held, n = rows.to_batches(), sum(len(v.flatten()) for v in rows.column("points").chunks)
    if held:
        yield from _pairs(pa.Table.from_batches(held), both)
