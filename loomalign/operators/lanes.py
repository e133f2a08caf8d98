"""Many tiles of alignment matrices at once, a row of all of them a step.

Tiles lie side by side, each in stretches of ``STRETCH`` columns; the same place
of all stretches is one vector, so that a gap along the target is carried from
place to place by whole vectors, then from stretch to stretch by ever shorter
ones, instead of by a running maximum along the row.  Cells are lifted by the cost
of extending a gap to them, which then costs nothing, and taken relative to a
middle value of the tile's edges, so that 16 bits hold a band of rows wherever the
edges prove it, however large the scores are; 32 bits serve elsewhere.  Local
alignments of unlike texts score so low that a byte holds their cells: rows go by
bytes until a cell might not fit.

A gap down the query opens only where none along the target has just ended: the
two in the other order cost the same and end in the same cell.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import pairwise

import numpy as np

from loomalign.functions.scoring import GAP_EXTEND, GAP_OPEN, MATRIX
from loomalign.operators.kernels import TOP

#: Places in a stretch, and stretches that are chained by vectors of their own.
STRETCH, CHAIN = 8, 8
#: Rows that share a middle value.
BAND = 512
#: Columns of all tiles of a group (locally twice as many, in bytes): vectors long enough, arrays that stay in the cache.
COLUMNS = 1 << 17
#: What a cell may reach, by its type.
_LIMITS = ((np.int16, 32_000), (np.int32, 1 << 30))
#: The lowest score of the matrix.
_LOW = int(-MATRIX.min())
#: What each residue of a query can add at most.
_BEST = np.maximum(MATRIX.max(1), 0).astype(np.int64)


class Tile:
    """A tile to align: its residues and upper and left edges; then its lower and right ones and its best cell.

    An edge is (h, g): the cells along it, beginning with the corner, and the gap
    across it that each row or column behind it starts with.
    """

    def __init__(self, q: np.ndarray, t: np.ndarray, top: tuple, left: tuple):
        self.q, self.t, self.left = q, t, left
        self.lower = top
        # Cells along the edges are cells of the same matrix.
        self.row, self.best = 0, max(0, int(top[0].max()), int(left[0].max()))
        self._right, self._profiles = [], {}

    @property
    def right(self) -> tuple:
        h, g = zip(*self._right, strict=True)
        return np.concatenate((self._corner, *h)), np.concatenate(g)

    def begin(self) -> None:
        self._corner = self.lower[0][-1:]

    def profile(self, kind: type, extend: int, pad: int) -> list[np.ndarray]:
        """For each residue what it scores with all columns, lifted by two steps; columns past the end never matter."""
        small = -128 <= min(pad, 2 * extend - _LOW) and TOP + 2 * extend < 128
        if kind not in self._profiles:
            codes = np.full(-(-len(self.t) // (STRETCH * CHAIN)) * STRETCH * CHAIN, len(MATRIX), np.intp)
            codes[: len(self.t)] = self.t
            scores = np.hstack((MATRIX.astype(np.int64) + 2 * extend, np.full((len(MATRIX), 1), pad))).astype(np.int8 if small else kind)
            self._profiles[kind] = list(np.take(scores, np.ascontiguousarray(_laid(codes)), 1))
        return self._profiles[kind]


    def low_profile(self) -> list[np.ndarray]:
        """The same in bytes, for ``_low_band``: (place, stretch)."""
        if "low" not in self._profiles:
            codes = np.full((-(-len(self.t) // STRETCH) + _BETWEEN) * STRETCH, len(MATRIX), np.intp)
            codes[: len(self.t)] = self.t
            scores = np.hstack((MATRIX.astype(np.int64) + 2, np.full((len(MATRIX), 1), 2 - _LOW))).astype(np.int8)
            self._profiles["low"] = list(np.take(scores, np.ascontiguousarray(codes.reshape(-1, STRETCH).T), 1))
        return self._profiles["low"]


#: Rows by bytes that share a lift, stretches between two tiles (a gap of so many columns costs more than a byte's cell), what a byte is less than its cell.
_LIFTS, _BETWEEN, _BELOW = 16, 32, 128 - GAP_OPEN + GAP_EXTEND
#: The best cell of a row by bytes; where the next rows may begin by bytes.
_MOST = 127 + _BELOW - _LIFTS - STRETCH
_LOW_EDGE = _MOST - 60


def _laid(row: np.ndarray) -> np.ndarray:
    """(place, stretch of a chain, chain) of the columns of a row."""
    return row.reshape(-1, CHAIN, STRETCH).transpose(2, 1, 0)


def _pad(open_: int, extend: int) -> int:
    """A score so low that a column past the end never passes on what a gap into it does not."""
    return -(3 * open_ + TOP + 2 * extend + 20)


def _frame(x: Tile, rows: int, local: bool, open_: int, extend: int, wide: bool) -> tuple[int, int, type | None]:
    """(middle value, lowest value on the edges relative to it, type) of the next rows of a tile; no type if none is enough."""
    n, i = len(x.t), x.row
    edges = (
        x.lower[0] + extend * np.arange(-2, n - 1),
        x.lower[1] + extend * np.arange(n),
        x.left[0][i : i + rows + 1] + extend * np.arange(-2, rows - 1),
        x.left[1][i : i + rows] + extend * np.arange(rows),
    )
    low, high = min(int(e.min()) for e in edges), max(int(e.max()) for e in edges)
    # A lifted gap never falls, so no cell lies below the edges; each row adds at most one pair of residues.
    high = (max(high, extend * (rows + n + STRETCH)) if local else high) + (TOP + 2 * extend) * rows
    below = low - open_ + _pad(open_, extend) - _LOW
    base = (high + below) // 2
    kinds = (k for k, most in _LIMITS[wide:] if max(high - base, base - below, open_ + extend * n) < most)
    return base, low - base, next(kinds, None)


def _band(tiles: list[Tile], rows: int, frames: list[tuple], local: bool, open_: int, extend: int, right: bool) -> None:
    """The next rows of all tiles, whose cells are of one type."""
    kind, size = frames[0][2], STRETCH * CHAIN
    bases, lows = [f[0] for f in frames], [f[1] for f in frames]
    ends = np.cumsum([-(-len(x.t) // size) for x in tiles])
    spans = list(pairwise([0, *ends.tolist()]))
    first, width = np.array([a for a, _ in spans]), int(ends[-1])
    shape = (STRETCH, CHAIN, width)
    # Before the first place of a stretch stands the last one of the stretch before.
    h, f, p, gaps = np.empty((STRETCH + 1, *shape[1:]), kind), np.empty(shape, kind), np.empty(shape, kind), np.empty(shape, kind)
    left_h, left_g = np.empty((rows + 1, len(tiles)), kind), np.empty((rows, len(tiles)), kind)
    looks = []
    for k, (x, (a, b)) in enumerate(zip(tiles, spans, strict=True)):
        n, i = len(x.t), x.row
        cells = np.full((b - a) * size + 1, lows[k])
        cells[: n + 1] = x.lower[0] - bases[k] + extend * np.arange(-2, n - 1)
        h[1:, :, a:b], h[0, :, a:b] = _laid(cells[1:]), _laid(cells[:-1])[0]
        cells = np.full((b - a) * size, lows[k])
        cells[:n] = x.lower[1] - bases[k] + extend * np.arange(n)
        f[:, :, a:b] = _laid(cells)
        left_h[:, k] = x.left[0][i : i + rows + 1] - bases[k] + extend * np.arange(-2, rows - 1)
        left_g[:, k] = x.left[1][i : i + rows] - bases[k] + extend * np.arange(rows)
        looks.append((p[:, :, a:b], x.profile(kind, extend, _pad(open_, extend)), x.q[i : i + rows].tolist()))
    opening = np.array(open_ - extend, kind)
    if local:
        lifts = [extend * _laid(np.arange((b - a) * size)) for a, b in spans]
        lift = np.concatenate([x[0] for x in lifts], 1)
        # What is 0, for the places of twice as many rows as a stretch has places; cells never lie below the edges.
        zero, least = lift - np.repeat(bases, np.diff([0, *ends])), np.repeat(lows, np.diff([0, *ends]))
        floor, plain, step = np.empty((2 * STRETCH, *shape[1:]), kind), bool((zero >= least).all()), np.array(extend, kind)
        for k in range(STRETCH):
            floor[STRETCH + k] = np.maximum(zero + extend * k, least)
        lift = lift.astype(kind if min(lows) - int(lift.max()) > -_LIMITS[0][1] or kind is not np.int16 else np.int32)
        sums = [[0, *np.cumsum(_BEST[x.q[x.row : x.row + rows]]).tolist()] for x in tiles]
        due, dues = 0, [0] * len(tiles)
        entering = [int(x.left[0][x.row : x.row + rows + 1].max()) for x in tiles]
    carry, entry, leave = np.empty(shape[1:], kind), np.empty(width, kind), np.empty(width, kind)
    parts = [entry[a:b] for a, b in spans]
    places, last = list(pairwise(gaps)), gaps[-1]
    chain = list(zip(carry[1:-1], last[1:-1], carry[2:], strict=True))
    at = [len(x.t) - 1 for x in tiles]
    inner = np.array([k // STRETCH % CHAIN for k in at]), first + np.array([k // size for k in at])
    place = np.array([k % STRETCH for k in at])
    right_h, right_g = np.empty_like(left_g), np.empty_like(left_g)
    for i in range(rows):
        for row, profile, q in looks:
            np.copyto(row, profile[q[i]])
        np.add(p, h[:-1], p)
        np.maximum(p, f, p)
        if local:
            k = i % STRETCH
            if not k:
                floor[:STRETCH] = floor[STRETCH:]
            np.maximum(p, floor[k : k + STRETCH], p)
            if plain:
                np.add(floor[STRETCH + k - 1], step, floor[STRETCH + k])
            else:
                floor[STRETCH + k] = np.maximum(zero + extend * (i + STRETCH), least)
        # Gaps that open after a cell: down from it at once, along the target from place to place.
        np.subtract(p, opening, gaps)
        np.maximum(f, gaps, f)
        for before, after in places:
            np.maximum(before, after, after)
        np.copyto(carry[1], last[0])
        for before, after, out in chain:
            np.maximum(before, after, out)
        np.maximum(carry[-1], last[-1], leave)
        np.copyto(entry[1:], leave[:-1])
        entry[first] = left_g[i]
        for part in parts:
            np.maximum.accumulate(part, out=part)
        np.copyto(carry[0], entry)
        np.maximum(carry[1:], entry, carry[1:])
        np.maximum(p[1:], gaps[:-1], h[2:])
        np.copyto(h[1], p[0])
        np.maximum(h[1:], carry, h[1:])
        np.copyto(h[0, 1:], h[-1, :-1])
        np.copyto(h[0, 0, 1:], h[-1, -1, :-1])
        h[0, 0, first] = left_h[i + 1]
        if right:
            right_h[i], right_g[i] = h[place + 1, *inner], np.maximum(carry[inner], gaps[place, *inner])
        if local and i == due:
            # At most what the best cells of the tiles are; exact where it matters.
            bounds = np.maximum.reduce(p, 0) - lift
            tops = np.maximum.reduceat(bounds.max(0), first).tolist()
            for k, x in enumerate(tiles):
                if dues[k] == i:
                    shift = bases[k] - extend * i
                    top = tops[k] + shift
                    if top > x.best:
                        own = bounds[:, slice(*spans[k])]
                        over = own > x.best - shift
                        rest = int(own.max(where=~over, initial=-(1 << 15)))
                        top = int((looks[k][0][:, over] - lifts[k][:, over]).max())
                        x.best = max(x.best, top + shift)
                        top = max(top, rest) + shift
                    # Until then no cell can be better.
                    dues[k] = max(i + 1, bisect_right(sums[k], sums[k][i + 1] + x.best - max(top, entering[k])) - 1)
            due = min(dues)
    for k, (x, (a, b)) in enumerate(zip(tiles, spans, strict=True)):
        n, i = len(x.t), x.row + rows
        lower_h, lower_g = (y[:, :, a:b].transpose(2, 1, 0).reshape(-1)[:n].astype(np.int64) + bases[k] for y in (h[1:], f))
        x.lower = np.concatenate((x.left[0][i : i + 1], lower_h - extend * np.arange(rows - 1, rows - 1 + n))), lower_g - extend * np.arange(rows, rows + n)
        if right:
            side = right_h[:, k].astype(np.int64) + bases[k] - extend * np.arange(n - 1, n - 1 + rows)
            x._right.append((side, right_g[:, k].astype(np.int64) + bases[k] - extend * np.arange(n, n + rows)))
        x.row = i


def _low_band(tiles: list[Tile], rows: int, right: bool) -> None:
    """As many of the next rows of all tiles as bytes hold, one at least: local, default gap costs, edges below ``_LOW_EDGE``.

    Lifted within a stretch and for ``_LIFTS`` rows; from stretch to stretch a gap
    is paid, so that none is longer than a cell can pay for.
    """
    ends = np.cumsum([-(-len(x.t) // STRETCH) + _BETWEEN for x in tiles])
    spans = list(pairwise([0, *ends.tolist()]))
    first, width = np.array([a for a, _ in spans]), int(ends[-1])
    new = lambda n: np.empty((n, width), np.int8)
    h, f, p, gaps = new(STRETCH + 1), new(STRETCH), new(STRETCH), new(STRETCH)
    places = np.arange(STRETCH)
    left_h, left_g = np.empty((rows + 1, len(tiles)), np.int8), np.empty((rows, len(tiles)), np.int8)
    lifted = np.arange(rows + 1) % _LIFTS
    looks = []
    for k, (x, (a, b)) in enumerate(zip(tiles, spans, strict=True)):
        n, i = len(x.t), x.row
        cells = np.zeros((b - a) * STRETCH + 1, np.int64)
        cells[: n + 1] = x.lower[0]
        h[1:, a:b], h[0, a:b] = cells[1:].reshape(-1, STRETCH).T + places[:, None] - 1 - _BELOW, cells[:-1:STRETCH] - 2 - _BELOW
        cells = np.full((b - a) * STRETCH, -GAP_OPEN)
        cells[:n] = x.lower[1]
        f[:, a:b] = np.maximum(cells.reshape(-1, STRETCH).T + places[:, None] - _BELOW, -128)
        # As the diagonal of a row, the first of those that share a lift included.
        left_h[:, k] = x.left[0][i : i + rows + 1] + lifted - 2 - _BELOW
        left_g[:, k] = np.maximum(x.left[1][i : i + rows] + lifted[:-1] - _BELOW, -128)
        looks.append((p[:, a:b], x.low_profile(), x.q[i : i + rows].tolist()))
    floor = np.repeat(np.arange(_LIFTS + STRETCH, dtype=np.int8)[:, None] - np.int8(_BELOW), width, 1)
    opening, lifts = np.array(GAP_OPEN - GAP_EXTEND, np.int8), np.array(_LIFTS, np.int8)
    least = np.full((STRETCH, width), -128 + _LIFTS, np.int8)
    entry, less, over = np.empty(width, np.int8), np.empty(width, np.int8), np.empty(width, np.int8)
    # (stretches, their cost, what can pay it) of gaps that pass stretches.
    passes = [(k, np.array(k * STRETCH, np.int8) if k * STRETCH < 128 else None, np.full(width, k * STRETCH - 128, np.int8)) for k in (1, 2, 4, 8)]
    half = np.array(64, np.int8), np.zeros(width, np.int8)
    sums = [[0, *np.cumsum(_BEST[x.q[x.row : x.row + rows]]).tolist()] for x in tiles]
    entering = [int(x.left[0][x.row : x.row + rows + 1].max()) for x in tiles]
    due, dues = 0, [0] * len(tiles)
    at = [len(x.t) - 1 for x in tiles]
    place, lane = np.array([k % STRETCH for k in at]), first + np.array([k // STRETCH for k in at])
    right_h, right_g = np.empty_like(left_g), np.empty_like(left_g)
    chain = list(pairwise(gaps))
    for i in range(rows):
        up = i % _LIFTS
        if i and not up:
            np.subtract(h, lifts, h)
            np.maximum(f, least, f)
            np.subtract(f, lifts, f)
            h[0, first] = left_h[i]
        for row, profile, q in looks:
            np.copyto(row, profile[q[i]])
        np.add(p, h[:-1], p)
        np.maximum(p, f, p)
        np.maximum(p, floor[up : up + STRETCH], p)
        np.subtract(p, opening, gaps)
        np.maximum(f, gaps, f)
        for before, after in chain:
            np.maximum(before, after, after)
        # Into the next stretch, then on by twice as many stretches a step.
        np.maximum(gaps[-1], passes[0][2], less)
        np.subtract(less, passes[0][1], less)
        np.copyto(entry[1:], less[:-1])
        entry[first] = left_g[i]
        for k, cost, pays in passes:
            np.maximum(entry, pays, less)
            np.subtract(less, cost, less)
            np.maximum(entry[k:], less[:-k], entry[k:])
        np.maximum(entry, half[1], less)
        np.subtract(less, half[0], less)
        np.subtract(less, half[0], less)
        np.maximum(entry[16:], less[:-16], entry[16:])
        np.maximum(p[1:], gaps[:-1], h[2:])
        np.copyto(h[1], p[0])
        np.maximum(h[1:], entry, h[1:])
        np.copyto(h[0, 1:], h[-1, :-1])
        # The stretch before is lifted by as much as it is long.
        np.subtract(h[0], passes[0][1], h[0])
        h[0, first] = left_h[i + 1] if (i + 1) % _LIFTS else left_h[i + 1] + lifts
        if right:
            right_h[i], right_g[i] = h[place + 1, lane], np.maximum(entry[lane], gaps[place, lane])
        if i == due:
            np.maximum.reduce(p, 0, out=over)
            tops, safe = np.maximum.reduceat(over, first).tolist(), rows
            for k, x in enumerate(tiles):
                if dues[k] == i:
                    shift = _BELOW - up
                    top = tops[k] + shift
                    if top > x.best:
                        own = over[slice(*spans[k])]
                        exact = own > x.best - shift
                        rest = int(own.max(where=~exact, initial=-128))
                        top = int((looks[k][0][:, exact] - places[:, None]).max())
                        x.best = max(x.best, top + shift)
                        top = max(top, rest) + shift
                    top = max(top, entering[k])
                    safe = min(safe, bisect_right(sums[k], sums[k][i + 1] + _MOST - top) - 2)
                    better = max(i + 1, bisect_right(sums[k], sums[k][i + 1] + x.best - top) - 1)
                    dues[k] = min(better, max(i + 1, bisect_right(sums[k], sums[k][i + 1] + _MOST - top) - 2))
            due = min(dues)
            if safe <= i:
                rows = i + 1
                break
    up = (rows - 1) % _LIFTS
    lifted = lifted[:rows]
    for k, (x, (a, b)) in enumerate(zip(tiles, spans, strict=True)):
        n, i = len(x.t), x.row + rows
        lower_h, lower_g = (y[:, a:b].T.reshape(-1)[:n].astype(np.int64) + _BELOW - np.arange(n) % STRETCH - up for y in (h[1:], f))
        x.lower = np.concatenate((x.left[0][i : i + 1], lower_h)), lower_g - 1
        if right:
            lift = lifted - _BELOW + place[k]
            x._right.append((right_h[:rows, k] - lift, right_g[:rows, k] - lift - 1))
        x.row = i


def groups(tiles: list[Tile], columns: int = COLUMNS) -> list[list[Tile]]:
    """Tiles to align together: of like height, bounded in columns."""
    out, room = [], 0
    for x in sorted(tiles, key=lambda x: -len(x.q)):
        if len(x.t) > room:
            out.append([])
            room = columns
        out[-1].append(x)
        room -= len(x.t)
    return out


def align(tiles: list[Tile], local: bool, open_: int = GAP_OPEN, extend: int = GAP_EXTEND, wide: bool = False, right: bool = True, band: int = BAND) -> bool:
    """Give each tile its lower edge, its right one if asked for, and its best cell if local; False, and tiles half done, if 32 bits are not enough.

    wide: 32 bits in any case.  Opening a gap costs at least as much as extending it.
    """
    for x in tiles:
        x.begin()
    live, plain = list(tiles), local and not wide and (open_, extend) == (GAP_OPEN, GAP_EXTEND) == (10, 1)
    while live:
        rows = min(band, *(len(x.q) - x.row for x in live))
        low = [x for x in live if plain and x.lower[0].max() < _LOW_EDGE and x.left[0][x.row : x.row + rows + 1].max() < _LOW_EDGE]
        if low:
            _low_band(low, rows, right)
            chosen = set(map(id, low))
            live = [x for x in live if id(x) not in chosen]
        frames = [_frame(x, rows, local, open_, extend, wide) for x in live]
        for kind in {f[2] for f in frames}:
            if kind is None:
                return False
            same = [k for k, f in enumerate(frames) if f[2] is kind]
            _band([live[k] for k in same], rows, [frames[k] for k in same], local, open_, extend, right)
        live = [x for x in tiles if x.row < len(x.q)]
    return True
