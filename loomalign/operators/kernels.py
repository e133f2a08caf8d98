"""Alignment scores on NumPy arrays: global (nw) and local (sw), affine gaps.

``between``: many sequences at once.  Sequences lie side by side, longest first;
one step takes one column of all of them, so every operation runs over whole
vectors of cells and no cell is padding: a sequence leaves the front when it
ends.  Gaps down the query are a loop over its residues, each step a vector over
the sequences; all else of a column is two-dimensional.

``within``: one (long) sequence.  One step takes one query residue and all the
columns; gaps along the target come from a running maximum (with opening at
least extension, a gap may start from cells before gaps are considered).

``along``: the same for many sequences end to end, each lifted above the one
before, so that the running maximum begins anew with each.

``beside``: many pairs, each of a query and a target of its own, local only.  As
``within``, a row of all targets at a time; a gap along the target lengthens by
doubling, no further than the best cell of the row can pay for.

``scalar``: plain Python, the definition itself, for tests and as an engine.

Cells are 16 bits wide where bounds on the score prove that they suffice, else 32
(``along``: always 32, ``beside``: always 16).
"""

from __future__ import annotations

import numpy as np

from loomalign.functions.scoring import GAP_EXTEND, GAP_OPEN, MATRIX, NARROW_LIMIT, algorithm_name

#: Cells of one batch's column: long vectors, in arrays of a few MB.
COLUMN_CELLS = 1 << 22
#: Cells of a column that are worked on at a time.
BLOCK_CELLS = 1 << 17
TOP = int(MATRIX.max())
#: A matrix with a lower score than this never takes 16 bits.
_LOWEST = -2000
_NEG = -(1 << 29)


def gap(k, open_=GAP_OPEN, extend=GAP_EXTEND):
    """The cost of a gap of k residues; of none, nothing."""
    return np.where(np.asarray(k) > 0, open_ + (np.asarray(k) - 1) * extend, 0)


def top_of(matrix: np.ndarray) -> int:
    """What a pair of residues can add to a score."""
    return max(0, int(matrix.max()))


def narrow(algorithm: str, m: int, n: int, open_: int = GAP_OPEN, extend: int = GAP_EXTEND, matrix: np.ndarray = MATRIX) -> bool:
    """Whether 16 bits hold every cell of a query of m and a target of n residues."""
    if int(matrix.min()) < _LOWEST:
        return False
    high = top_of(matrix) * (min(m, n) + 1)
    low = 0 if algorithm == "sw" else 2 * open_ + (m + n) * extend
    return high < NARROW_LIMIT and low + 2 * open_ + extend < NARROW_LIMIT


def scalar(algorithm: str, q: np.ndarray, t: np.ndarray, open_: int = GAP_OPEN, extend: int = GAP_EXTEND, matrix: np.ndarray = MATRIX) -> int:
    """One pair, cell by cell."""
    local = algorithm_name(algorithm) == "sw"
    m, n = len(q), len(t)
    h = [0 if local else -int(gap(j, open_, extend)) for j in range(n + 1)]
    f = [_NEG] * (n + 1)
    best = 0
    for i in range(1, m + 1):
        diagonal, h[0] = h[0], 0 if local else -int(gap(i, open_, extend))
        e = _NEG
        row = matrix[q[i - 1]]
        for j in range(1, n + 1):
            e = max(h[j - 1] - open_, e - extend)
            f[j] = max(h[j] - open_, f[j] - extend)
            cell = max(diagonal + int(row[t[j - 1]]), e, f[j])
            if local:
                cell = max(cell, 0)
                best = max(best, cell)
            diagonal, h[j] = h[j], cell
    return best if local else h[n]


def _empty_side(algorithm: str, m: int, n: int, open_: int, extend: int) -> int:
    return 0 if algorithm == "sw" else -int(gap(max(m, n), open_, extend))


def between(algorithm: str, q: np.ndarray, targets: list[np.ndarray], open_: int = GAP_OPEN, extend: int = GAP_EXTEND, wide: bool = False, matrix: np.ndarray = MATRIX) -> np.ndarray:
    """Scores of all targets; best when they are many and of like length.  wide: 32 bits in any case."""
    local = algorithm_name(algorithm) == "sw"
    m, size = len(q), len(targets)
    out = np.zeros(size, np.int64)
    lengths = np.array([len(t) for t in targets], np.int64)
    order = np.argsort(-lengths, kind="stable")
    if m == 0 or size == 0 or lengths.max() == 0:
        return np.array([_empty_side(algorithm, m, int(n), open_, extend) for n in lengths], np.int64)
    longest = int(lengths.max())
    kind = np.int16 if not wide and narrow(algorithm, m, longest, open_, extend, matrix) else np.int32
    codes = np.zeros((longest, size), np.uint8)
    for k, i in enumerate(order.tolist()):
        codes[: lengths[i], k] = targets[i]
    live = np.searchsorted(-lengths[order], -np.arange(1, longest + 1), "right")
    for i in np.flatnonzero(lengths == 0):
        out[i] = _empty_side(algorithm, m, 0, open_, extend)
    matrix = matrix.astype(kind)
    cost, step = kind(open_), kind(extend)
    border = np.zeros(m + 1, kind) if local else (-gap(np.arange(m + 1), open_, extend)).astype(kind)
    h = np.repeat(border[:, None], size, 1)  # column before, border row first
    e = np.repeat((border - cost)[1:, None], size, 1)
    best, above = np.zeros(size, kind), np.empty(size, kind)
    rows = q.astype(np.intp)
    # Rows are taken in blocks whose cells stay in the cache through all the operations on them.
    high = min(m, max(1, BLOCK_CELLS // size))
    room, more = np.empty(high * size, kind), np.empty((high + 1) * size, kind)
    zeros = np.zeros(high * size if local else 0, kind)  # an array: a scalar would not go by vectors
    for j in range(longest):
        b = int(live[j])
        look = np.take(matrix, codes[j, :b], 1)
        top, diagonal = best[:b], above[:b]
        diagonal[:] = h[0, :b]
        if not local:
            h[0, :b] = -gap(j + 1, open_, extend)
        f = more[:b]
        np.subtract(h[0, :b], cost, out=f)
        for r in range(0, m, high):
            n = min(high, m - r)
            old, eb = h[r + 1 : r + 1 + n, :b], e[r : r + n, :b]
            score, down = room[: n * b].reshape(n, b), more[: (n + 1) * b].reshape(n + 1, b)
            if j:
                # Gap along the target: extend, or open after the column before.
                np.subtract(eb, step, out=eb)
                np.subtract(old, cost, out=score)
                np.maximum(eb, score, out=eb)
            np.take(look, rows[r : r + n], 0, out=score, mode="clip")
            score[0] += diagonal
            score[1:] += old[:-1]
            diagonal[:] = old[-1]
            np.maximum(score, eb, out=score)
            if local:
                np.maximum(score, zeros[: n * b].reshape(n, b), out=score)
            # Gap down the query: extend, or open after a cell above; a gap opened after such a gap never wins.
            if r:
                down[0] = f  # of the block before, in the same room
            np.subtract(score, cost, out=down[1:])
            for i in range(n):
                f = down[i]
                np.maximum(score[i], f, out=old[i])
                np.subtract(f, step, out=f)
                np.maximum(down[i + 1], f, out=down[i + 1])
            f = down[n]
            if local:
                for i in range(n):
                    np.maximum(top, old[i], out=top)
        after = int(live[j + 1]) if j + 1 < longest else 0
        if after < b:
            out[order[after:b]] = best[after:b] if local else h[m, after:b]
    return out


def within(algorithm: str, q: np.ndarray, t: np.ndarray, open_: int = GAP_OPEN, extend: int = GAP_EXTEND, wide: bool = False, matrix: np.ndarray = MATRIX) -> int:
    """The score of one pair, a row of the target at a time.

    16 bits also have to hold a cell and the cost of extending a gap to its
    column, which the running maximum adds.
    """
    local = algorithm_name(algorithm) == "sw"
    m, n = len(q), len(t)
    if m == 0 or n == 0:
        return _empty_side(algorithm, m, n, open_, extend)
    fits = narrow(algorithm, m, n, open_, extend, matrix) and top_of(matrix) * min(m, n) + n * extend < NARROW_LIMIT
    kind = np.int16 if fits and not wide else np.int32
    profile = np.take(matrix.astype(kind), t.astype(np.intp), 1, mode="clip")
    steps = (np.arange(n + 1) * extend).astype(kind)
    opened = steps + kind(open_)
    h = np.zeros(n + 1, kind) if local else (-gap(np.arange(n + 1), open_, extend)).astype(kind)
    opening, extending, zeros = kind(open_), kind(extend), np.zeros(n + 1, kind)
    f = h[1:] - opening  # no gap can have been opened before the first row: extending this one never wins
    p = np.empty(n + 1, kind)
    x = np.empty(n, kind)
    best = 0
    for i in range(m):
        np.subtract(f, extending, out=f)
        np.subtract(h[1:], opening, out=x)
        np.maximum(f, x, out=f)
        np.add(h[:-1], profile[q[i]], out=p[1:])
        np.maximum(p[1:], f, out=p[1:])
        if local:
            np.maximum(p, zeros, out=p)
            p[0] = 0
        else:
            p[0] = -gap(i + 1, open_, extend)
        np.add(p[:-1], steps[:-1], out=x)
        np.maximum.accumulate(x, out=x)
        np.subtract(x, opened[:-1], out=x)
        h[0] = p[0]
        np.maximum(p[1:], x, out=h[1:])
        if local:
            best = max(best, int(h.max()))
    return best if local else int(h[n])


def _lift(algorithm: str, m: int, n: int, open_: int, extend: int, matrix: np.ndarray) -> int:
    """More than the cells of one sequence, with gaps extended to their column, can differ by."""
    return top_of(matrix) * min(m, n) + 3 * open_ + (m + 2 * n) * extend + 1


def along(algorithm: str, q: np.ndarray, targets: list[np.ndarray], open_: int = GAP_OPEN, extend: int = GAP_EXTEND, matrix: np.ndarray = MATRIX) -> np.ndarray:
    """Scores of all targets, laid end to end with a border cell before each; best for short queries."""
    local = algorithm_name(algorithm) == "sw"
    m = len(q)
    lengths = np.array([len(t) for t in targets], np.int64)
    if m == 0 or not len(targets):
        return np.array([_empty_side(algorithm, m, int(n), open_, extend) for n in lengths], np.int64)
    first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    total = int((lengths + 1).sum())
    column = (np.arange(total) - np.repeat(first, lengths + 1)).astype(np.int32)
    codes = np.full(total, 23, np.uint8)
    inside = np.ones(total, bool)
    inside[first] = False
    codes[inside] = np.concatenate(targets)
    profile = np.take(matrix.astype(np.int32), codes.astype(np.intp), 1, mode="clip")
    lift = _lift(algorithm, m, int(lengths.max()), open_, extend, matrix)
    steps = column * np.int32(extend) + np.repeat(np.arange(len(targets), dtype=np.int32) * np.int32(lift), lengths + 1)
    opened = steps + np.int32(open_)
    h = np.zeros(total, np.int32) if local else (-gap(column, open_, extend)).astype(np.int32)
    f = h - np.int32(open_)
    p, x, best, zeros = np.empty(total, np.int32), np.empty(total, np.int32), np.zeros(total, np.int32), np.zeros(total, np.int32)
    for i in range(m):
        np.subtract(f, extend, out=f)
        np.subtract(h, open_, out=x)
        np.maximum(f, x, out=f)
        np.add(h[:-1], profile[q[i], 1:], out=p[1:])
        np.maximum(p, f, out=p)
        if local:
            np.maximum(p, zeros, out=p)
            p[first] = 0
        else:
            p[first] = -gap(i + 1, open_, extend)
        np.add(p, steps, out=x)
        np.maximum.accumulate(x, out=x)
        np.subtract(x, opened, out=x)
        # A gap that ends in a cell began before it: the maximum up to the cell on the left.
        np.maximum(p[1:], x[:-1], out=h[1:])
        h[first] = p[first]
        if local:
            np.maximum(best, h, out=best)
    if local:
        return np.maximum.reduceat(best, first).astype(np.int64)
    return h[first + lengths].astype(np.int64)


#: Cells of a row of all targets that ``beside`` takes at a time, those past a target's end, and what they score with all.
BESIDE_CELLS, _END, _PAST = 1 << 17, 65, -(1 << 14)


def _side_by_side(queries: list[np.ndarray], targets: list[np.ndarray], open_: int, extend: int, matrix: np.ndarray) -> list[int]:
    """Local scores of pairs of like length, longest query first; no query or target is empty.

    Targets lie end to end, each with ``_END`` cells more, the last of which stays 0
    and is the border of the next: all operations run over one vector.  Gaps that
    could pass those cells are cut there.
    """
    size, width = len(targets), max(map(len, targets)) + _END
    lengths = np.array([len(q) for q in queries])
    rows = np.zeros((lengths[0], size), np.intp)
    codes = np.full((size, width), len(matrix), np.uint8)
    for k, (q, t) in enumerate(zip(queries, targets, strict=True)):
        rows[: len(q), k], codes[k, : len(t)] = q, t
    profile = np.take(np.hstack((matrix, np.full((len(matrix), 1), _PAST))).astype(np.int16), codes, 1, mode="clip")
    opening, extending = np.int16(open_), np.int16(extend)
    live, lanes = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right").tolist(), np.arange(size)
    best = np.zeros(size, np.int16)
    h, f = np.zeros(size * width + 1, np.int16), np.full(size * width, -opening)
    room, gaps = np.empty_like(f), np.empty_like(f)
    zeros = np.zeros_like(f)  # an array: a scalar would not go by vectors
    inside, cut = np.where(codes < len(matrix), np.int16(NARROW_LIMIT), np.int16(0)).ravel(), extend == 0
    for i, b in enumerate(live):
        cells = b * width
        fb, x, e = f[:cells], room[:cells], gaps[:cells]
        p = profile[rows[i, :b], lanes[:b]].reshape(cells)
        np.subtract(fb, extending, out=fb)
        np.subtract(h[1 : cells + 1], opening, out=x)
        np.maximum(fb, x, out=fb)
        np.add(p, h[:cells], out=p)
        np.maximum(p, fb, out=p)
        np.maximum(p, zeros[:cells], out=p)
        top = p.reshape(b, width).max(1)
        np.maximum(best[:b], top, out=best[:b])
        most = int(top.max()) - open_
        if most <= 0:
            h[1 : cells + 1] = p
            continue
        # What gaps of up to ``far`` residues leave of the cell that they began after.
        np.subtract(p, opening, out=e)
        far, reach = 1, width if extend == 0 else (most - 1) // extend + 1
        while far < min(reach, _END - 1):
            np.subtract(e[:-far], np.int16(far * extend), out=x[far:])
            np.maximum(e[far:], x[far:], out=e[far:])
            far *= 2
        if far < reach:  # target by target
            cut = True
            for k in np.flatnonzero((top > open_ + (far - 1) * extend)).tolist():
                own, step = e[k * width : (k + 1) * width - 1], far
                while step < min(reach, width - 1):
                    np.maximum(own[step:], own[:-step] - np.int16(step * extend), out=own[step:])
                    step *= 2
        h[1] = p[0]
        np.maximum(p[1:], e[:-1], out=h[2 : cells + 1])
        if cut:
            np.minimum(h[1 : cells + 1], inside[:cells], out=h[1 : cells + 1])
    return best.tolist()


def beside(queries: list[np.ndarray], targets: list[np.ndarray], open_: int = GAP_OPEN, extend: int = GAP_EXTEND, matrix: np.ndarray = MATRIX) -> np.ndarray:
    """Local scores of each query with the target beside it; pairs that 16 bits may not hold go by themselves."""
    out = np.zeros(len(targets), np.int64)
    low = int(matrix.min()) < _LOWEST
    group: list[int] = []

    def solve():
        order = sorted(group, key=lambda i: -len(queries[i]))
        out[order] = _side_by_side([queries[i] for i in order], [targets[i] for i in order], open_, extend, matrix)
        group.clear()

    for i in np.argsort([-len(t) for t in targets], kind="stable").tolist():
        m, n = len(queries[i]), len(targets[i])
        if not m or not n:
            continue
        if low or top_of(matrix) * (min(m, n) + 1) + 2 * open_ + extend >= -_PAST:
            out[i] = within("sw", queries[i], targets[i], open_, extend, False, matrix)
            continue
        # The first is the longest; ends of the others are cells for nothing.
        if group and ((len(group) + 1) * len(targets[group[0]]) > BESIDE_CELLS or 2 * n <  len(targets[group[0]])):
            solve()
        group.append(i)
    if group:
        solve()
    return out


def batches(lengths: list[int], m: int, most: int = 16384, cells: int = COLUMN_CELLS, residues: int = 1 << 25, table: int = 1 << 26) -> list[tuple[int, int]]:
    """Stretches of a sorted list to score together: bounded in sequences, cells of a column, residues, and in sequences times the longest; never empty."""
    limit = max(1, min(most, cells // max(m, 1)))
    out, start, total = [], 0, 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= limit or total + n > residues or (i - start + 1) * n > table):
            out.append((start, i))
            start, total = i, 0
        total += n
    return [*out, (start, len(lengths))] if lengths else out


#: Cells that ``along`` takes at a time, to stay in the cache.
ALONG_CELLS = 1 << 13


def _in_rows(algorithm: str, q: np.ndarray, targets: list[np.ndarray], open_: int, extend: int, wide: bool, matrix: np.ndarray) -> np.ndarray:
    """Scores by whole rows of the target: short ones end to end, long ones by themselves."""
    out = np.zeros(len(targets), np.int64)
    lengths = [len(t) for t in targets]
    order = np.argsort(lengths, kind="stable").tolist()
    start = 0
    while start < len(order):
        end, cells = start, 0
        while end < len(order):
            n = lengths[order[end]]
            if end > start and (cells + n + 1 > ALONG_CELLS or (end - start + 1) * _lift(algorithm, len(q), n, open_, extend, matrix) >= 1 << 30):
                break
            cells += n + 1
            end += 1
        part = order[start:end]
        if len(part) == 1:
            out[part[0]] = within(algorithm, q, targets[part[0]], open_, extend, wide, matrix)
        else:
            out[part] = along(algorithm, q, [targets[i] for i in part], open_, extend, matrix)
        start = end
    return out


def scores(algorithm: str, q: np.ndarray, targets: list[np.ndarray], threshold: int, open_: int = GAP_OPEN, extend: int = GAP_EXTEND, wide: bool = False, matrix: np.ndarray = MATRIX) -> np.ndarray:
    """Scores of all targets; those of ``threshold`` residues and more by rows of the target, the others side by side."""
    lengths = np.array([len(t) for t in targets], np.int64)
    out = np.zeros(len(targets), np.int64)
    large = np.flatnonzero(lengths >= threshold)
    small = np.flatnonzero(lengths < threshold)
    small = small[np.argsort(lengths[small], kind="stable")]
    for a, b in batches(lengths[small].tolist(), len(q)):
        part = small[a:b]
        if b - a < 24:  # too few to fill vectors
            large = np.concatenate((large, part))
        else:
            out[part] = between(algorithm, q, [targets[i] for i in part.tolist()], open_, extend, wide, matrix)
    if len(large):
        out[large] = _in_rows(algorithm, q, [targets[i] for i in large.tolist()], open_, extend, wide, matrix)
    return out
