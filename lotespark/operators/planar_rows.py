"""Repair of many small shapes at once, each within its row: the steps of `planar.repair` on flat arrays of numpy.

A batch of rows comes as one array for each coordinate and counts of points, rings and
polygons, and all shapes of a block are worked on together. A step that meets all pairs
within a shape goes over blocks of BLOCK pairs, so memory is bounded by one shape's pairs.
Numbers are made by the same arithmetic, and put in the same order, as `functions.geometry`
and `planar` do it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of edges, or of a walk and a piece, that are compared at once.
BLOCK = 1 << 17
_WIDE = Context(prec=800)


class Polygons(NamedTuple):
    """Polygons of rows, in order: each one's row, each ring's polygon (by number) and count of points, and the points."""

    row: np.ndarray
    ring: np.ndarray
    size: np.ndarray
    x: np.ndarray
    y: np.ndarray


# Ragged arrays


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _run(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each size."""
    return np.arange(sizes.sum()) - np.repeat(_starts(sizes), sizes)


def _take(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each size."""
    return np.repeat(first, sizes) + _run(sizes)


def _blocks(costs: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive items that cost about `most` together, one at least."""
    block = np.cumsum(costs) // most
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(costs)], strict=True):
        if b > a:
            yield slice(a, b)


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All i < j within each group of so many items."""
    i = np.arange(sizes.sum())
    later = np.repeat(np.cumsum(sizes), sizes) - i - 1
    left = np.repeat(i, later)
    return left, left + 1 + _run(later)


def _firsts(group: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """The first item that equals each, in its group and all values. Items are sorted by a hash; if one hash has different values, by the values."""
    if not len(group):
        return np.arange(0)
    h = np.zeros(len(group), np.uint64)
    for v in values:
        bits = v.view(np.uint64) if v.dtype == np.float64 else v.astype(np.uint64)
        h = (h ^ bits) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    key = ((group - group[0]).astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    order = np.argsort(key, kind="stable")
    same = _as_before(order, group, *values)
    if (~same[1:] & (key[order[1:]] == key[order[:-1]])).any():
        order = np.lexsort((*values[::-1], group))
        same = _as_before(order, group, *values)
    first = np.empty(len(group), np.int64)
    first[order] = order[~same][np.cumsum(~same) - 1]
    return first


def _as_before(order: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Which items equal the one before in this order?"""
    same = np.zeros(len(order), bool)
    same[1:] = True
    for v in values:
        same[1:] &= v[order[1:]] == v[order[:-1]]
    return same


def _snapped(v: np.ndarray, digits: int) -> np.ndarray:
    """Rounded half up by their decimal text, as Spark's round does. What scaling can't decide goes by the text itself."""
    scaled = v * 10.0**digits
    out = np.rint(scaled) / 10.0**digits
    unsure = ~(np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) > 4 * np.spacing(np.abs(scaled)))
    for i in np.flatnonzero(unsure):
        out[i] = float(Decimal(repr(float(v[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, _WIDE))
    return out + 0.0


# Sound shapes


def _closed(size: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rings with their first point at the end too. Rings without points stay so."""
    start, some = _starts(size), size > 0
    first, last = start[some], (start + size - 1)[some]
    more = np.zeros(len(size), np.int64)
    more[some] = (x[first] != x[last]) | (y[first] != y[last])
    k = _run(size + more)
    at = np.repeat(start, size + more) + np.where(k < np.repeat(size, size + more), k, 0)
    return size + more, x[at], y[at]


def _edges(size: np.ndarray) -> np.ndarray:
    """The numbers of the points of rings that an edge begins at; it ends at the next."""
    return _take(_starts(size), np.maximum(size - 1, 0))


def _side(px, py, qx, qy, rx, ry) -> np.ndarray:
    return np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))


def _clean(p: Polygons) -> tuple[Polygons, np.ndarray]:
    """Rings closed and without repeated points, those of under four points left out; and which polygons have rings left that neither cross nor run back (`geometry.repaired`)."""
    size, x, y = _closed(p.size, p.x, p.y)
    ring = np.repeat(np.arange(len(size)), size)
    keep = np.ones(len(x), bool)
    keep[1:] = (ring[1:] != ring[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    size = np.bincount(ring[keep], minlength=len(size))
    keep &= (size >= 4)[ring]
    x, y, owner, size = x[keep], y[keep], p.ring[size >= 4], size[size >= 4]
    sound = np.bincount(owner, minlength=len(p.row)) > 0
    sound[owner[np.repeat(np.arange(len(size)), size)[~(np.isfinite(x) & np.isfinite(y))]]] = False
    a = _edges(size)
    b, ring, k = a + 1, np.repeat(np.arange(len(size)), size - 1), _run(size - 1)
    # a corner at which a ring turns straight back
    before = np.where(k == 0, a + size[ring] - 2, a - 1)
    dot = (x[a] - x[before]) * (x[b] - x[a]) + (y[a] - y[before]) * (y[b] - y[a])
    back = (_side(x[before], y[before], x[a], y[a], x[b], y[b]) == 0) & (dot < 0)
    sound[owner[ring[back]]] = False
    of = np.bincount(owner[ring], minlength=len(p.row))
    first = _starts(of)
    for part in _blocks(of * of // 2 + 1, BLOCK):
        i, j = _pairs(of[part])
        i, j = i + first[part.start], j + first[part.start]
        apart = (ring[i] != ring[j]) | ((k[j] > k[i] + 1) & ~((k[i] == 0) & (k[j] == size[ring[i]] - 2)))
        i, j = i[apart], j[apart]
        e, f = (x[a[i]], y[a[i]], x[b[i]], y[b[i]]), (x[a[j]], y[a[j]], x[b[j]], y[b[j]])
        meet = np.ones(len(i), bool)
        for c in (0, 1):
            meet &= np.maximum(np.minimum(e[c], e[c + 2]), np.minimum(f[c], f[c + 2])) <= np.minimum(np.maximum(e[c], e[c + 2]), np.maximum(f[c], f[c + 2]))
        meet[meet] = ~((_side(*(v[meet] for v in (*e, *f[:2]))) * _side(*(v[meet] for v in (*e, *f[2:]))) > 0) | (_side(*(v[meet] for v in (*f, *e[:2]))) * _side(*(v[meet] for v in (*f, *e[2:]))) > 0))
        sound[owner[ring[i[meet]]]] = False
    return Polygons(p.row, owner, size, x, y), sound


# Noding


class _Edges(NamedTuple):
    """Edges, the lesser end first, in order of their shapes."""

    shape: np.ndarray
    ax: np.ndarray
    ay: np.ndarray
    bx: np.ndarray
    by: np.ndarray

    def at(self, which: np.ndarray) -> _Edges:
        return _Edges(*(v[which] for v in self))


def _directed(shape, px, py, qx, qy) -> _Edges:
    turn = (px > qx) | ((px == qx) & (py > qy))
    return _Edges(shape, np.where(turn, qx, px), np.where(turn, qy, py), np.where(turn, px, qx), np.where(turn, py, qy))


def _on(near: float, px, py, e: _Edges) -> np.ndarray:
    """Do the places lie on the edges, between their ends?"""
    dx, dy, ox, oy = e.bx - e.ax, e.by - e.ay, px - e.ax, py - e.ay
    along, across, square = ox * dx + oy * dy, ox * dy - oy * dx, dx * dx + dy * dy
    end = ((px == e.ax) & (py == e.ay)) | ((px == e.bx) & (py == e.by))
    return ~end & (along > 0) & (across * across <= near * near * square) & (along < square)


def _meetings(edges: _Edges, counts: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge, x, y): the places at which edges are to be split. counts: edges of each shape."""
    near, first, found = 0.7 * 10.0**-digits, _starts(counts), []
    for part in _blocks(counts * counts // 2 + 1, BLOCK):
        i, j = _pairs(counts[part])
        i, j = i + first[part.start], j + first[part.start]
        for low, high in ((np.minimum(edges.ax, edges.bx), np.maximum(edges.ax, edges.bx)), (np.minimum(edges.ay, edges.by), np.maximum(edges.ay, edges.by))):
            close = (low[i] <= high[j] + near) & (low[j] <= high[i] + near)
            i, j = i[close], j[close]
        for way in (0, 1):
            e, f = edges.at((i, j)[way]), edges.at((j, i)[way])
            dx, dy = e.bx - e.ax, e.by - e.ay
            s, t = dx * (f.ay - e.ay) - dy * (f.ax - e.ax), dx * (f.by - e.ay) - dy * (f.bx - e.ax)
            slack = near * (np.abs(dx) + np.abs(dy))
            astride = (np.minimum(s, t) <= slack) & (np.maximum(s, t) >= -slack)
            i, j = i[astride], j[astride]
        e, f = edges.at(i), edges.at(j)
        ends = [(n, px, py, _on(near, px, py, g)) for n, g, px, py in ((i, e, f.ax, f.ay), (i, e, f.bx, f.by), (j, f, e.ax, e.ay), (j, f, e.bx, e.by))]
        found += [(n[on], px[on], py[on]) for n, px, py, on in ends]
        same = lambda p, q: (p[0] == q[0]) & (p[1] == q[1])
        joined = same((e.ax, e.ay), (f.ax, f.ay)) | same((e.ax, e.ay), (f.bx, f.by)) | same((e.bx, e.by), (f.ax, f.ay)) | same((e.bx, e.by), (f.bx, f.by))
        rx, ry, sx, sy = e.bx - e.ax, e.by - e.ay, f.bx - f.ax, f.by - f.ay
        turn = rx * sy - ry * sx
        t, u = ((f.ax - e.ax) * sy - (f.ay - e.ay) * sx) / turn, ((f.ax - e.ax) * ry - (f.ay - e.ay) * rx) / turn
        cross = ~(joined | ends[0][3] | ends[1][3] | ends[2][3] | ends[3][3]) & (turn != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        x, y = _snapped((e.ax + t * rx)[cross], digits), _snapped((e.ay + t * ry)[cross], digits)
        found += [(i[cross], x, y), (j[cross], x, y)]
    return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.arange(0), np.zeros(0), np.zeros(0))


def _pieces(edges: _Edges, shapes: int, digits: int) -> _Edges:
    """The edges split where those of a shape meet, without pieces that are run along an even number of times, in order of their first place."""
    same = _firsts(*edges)
    times = np.bincount(same, minlength=len(same))
    edges, times = edges.at(times > 0), times[times > 0]
    n, cx, cy = _meetings(edges, np.bincount(edges.shape, minlength=shapes), digits)
    cut = np.zeros(len(times), bool)
    cut[n] = True
    whole, split = np.flatnonzero(~cut), np.flatnonzero(cut)
    # places along the edges that are cut: their ends and the cuts, each once
    n, x, y = np.concatenate([split, split, n]), np.concatenate([edges.ax[split], edges.bx[split], cx]), np.concatenate([edges.ay[split], edges.by[split], cy])
    order = np.argsort(n, kind="stable")
    n, x, y = n[order], x[order], y[order]
    once = _firsts(n, x, y) == np.arange(len(n))
    n, x, y = n[once], x[once], y[once]
    dx, dy = edges.bx[n] - edges.ax[n], edges.by[n] - edges.ay[n]
    order = np.lexsort((y, x, ((x - edges.ax[n]) * dx + (y - edges.ay[n]) * dy) / (dx * dx + dy * dy), n))
    n, x, y = n[order], x[order], y[order]
    p = np.flatnonzero(n[1:] == n[:-1])
    made = _directed(edges.shape[n[p]], x[p], y[p], x[p + 1], y[p + 1])
    of = np.concatenate([whole, n[p]])
    order = np.argsort(of, kind="stable")
    pieces = _Edges(*(np.concatenate([v[whole], w])[order] for v, w in zip(edges, made, strict=True)))
    same = _firsts(*pieces)
    odd = np.bincount(same, weights=times[of[order]], minlength=len(same)) % 2 == 1
    return pieces.at(odd)


# Walks


def _follow(shape, node, angle) -> np.ndarray:
    """The half-edge that follows each, with the face on its left: at the end of h, the one before its twin against the clock."""
    order = np.lexsort((angle, node))
    opens = np.ones(len(order), bool)
    opens[1:] = node[order[1:]] != node[order[:-1]]
    start = np.flatnonzero(opens)
    before = np.arange(len(order)) - 1
    before[start] = np.r_[start[1:], len(order)] - 1
    previous = np.empty(len(order), np.int64)
    previous[order] = order[before]
    return previous[np.arange(len(order)) ^ 1]


def _walked(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The half-edges walk by walk, each from its least one on, and the walks' sizes, in order of the least. By pointer doubling."""
    walk, jump = np.arange(len(follow)), follow
    while not np.array_equal(less := np.minimum(walk, walk[jump]), walk):
        walk, jump = less, jump[jump]
    # steps to the walk's least half-edge
    least = walk == np.arange(len(walk))
    jump, steps = np.where(least, walk, follow), np.where(least, 0, 1)
    while (more := steps[jump]).any():
        steps, jump = steps + more, jump[jump]
    size = np.bincount(walk, minlength=len(walk))
    start = np.zeros(len(walk), np.int64)
    start[least] = _starts(size[least])
    path = np.empty(len(walk), np.int64)
    path[start[walk] + (size[walk] - steps) % size[walk]] = np.arange(len(walk))
    return path, size[least]


def _odd_above(at, pieces: _Edges, first: np.ndarray, count: np.ndarray, numbers: np.ndarray | None = None) -> np.ndarray:
    """Is the number of pieces above the judging half-edges odd? Those of each are `count` from `first` on, of `numbers` if given."""
    n, x, y, below = at
    out = np.zeros(len(n), bool)
    for part in _blocks(count + 1, BLOCK):
        item = np.repeat(np.arange(part.start, part.stop), count[part])
        i = _take(first[part], count[part])
        i = i if numbers is None else numbers[i]
        over = (np.minimum(pieces.ax[i], pieces.bx[i]) <= x[item]) & (x[item] < np.maximum(pieces.ax[i], pieces.bx[i]))
        item, i = item[over], i[over]
        ax, ay = pieces.ax[i], pieces.ay[i]
        height = ay + (x[item] - ax) * (pieces.by[i] - ay) / (pieces.bx[i] - ax)
        above = np.where(i == n[item], below[item], height > y[item])
        out[part] = np.bincount(item[above] - part.start, minlength=part.stop - part.start) % 2 == 1
    return out


def _loops(ring: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """The ring cut at places that it passes twice, so that no loop touches itself (`planar.loops`)."""
    path, place, done = [], {}, []
    for p in ring:
        if p in place:
            done.append(path[place[p] :])
            for q in path[place[p] + 1 :]:
                del place[q]
            del path[place[p] + 1 :]
        else:
            place[p] = len(path)
            path.append(p)
    return [*done, path]


def _area(size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Signed area of closed rings."""
    a = _edges(size)
    return np.bincount(np.repeat(np.arange(len(size)), size - 1), weights=x[a] * y[a + 1] - x[a + 1] * y[a], minlength=len(size)) / 2


def _local(size: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = np.repeat(_starts(size), size)
    return size, x - x[start], y - y[start]


def _ordered(group: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, parts: np.ndarray | None = None) -> np.ndarray:
    """Order of items by group, then by their points as Spark orders arrays. An item is a ring, or with `parts` (rings of each) several. Those of a group that begin at the same place are compared as a whole."""
    n = np.ones(len(group), np.int64) if parts is None else parts
    rings, points = _starts(n), _starts(size)
    x0, y0 = x[points[rings]], y[points[rings]]
    order = np.lexsort((y0, x0, group))
    tie = (group[order[1:]] == group[order[:-1]]) & (x0[order[1:]] == x0[order[:-1]]) & (y0[order[1:]] == y0[order[:-1]])
    for k in np.flatnonzero(tie & ~np.r_[False, tie[:-1]]) if len(order) > 1 else ():
        end = k + 1
        while end < len(tie) and tie[end]:
            end += 1
        text = lambda i: [list(zip(x[points[r] : points[r] + size[r]].tolist(), y[points[r] : points[r] + size[r]].tolist(), strict=True)) for r in range(rings[i], rings[i] + n[i])]
        order[k : end + 1] = sorted(order[k : end + 1], key=text)
    return order


def _repaired(p: Polygons, digits: int) -> Polygons:
    """The even-odd area of each row's rings as valid polygons, in order (`planar.repair`). Rows are numbered from 0 and in order."""
    size, x, y = _closed(p.size, p.x, p.y)
    x, y, a = _snapped(x, digits), _snapped(y, digits), _edges(size)
    edges = _directed(np.repeat(p.row[p.ring], np.maximum(size - 1, 0)), x[a], y[a], x[a + 1], y[a + 1])
    pieces = _pieces(edges.at((edges.ax != edges.bx) | (edges.ay != edges.by)), (p.row.max() + 1) if len(p.row) else 0, digits)
    # half-edges: 2 i runs along piece i, 2 i + 1 against it
    both = lambda v, w: np.stack([v, w], 1).ravel()
    shape, ux, uy, vx, vy = np.repeat(pieces.shape, 2), both(pieces.ax, pieces.bx), both(pieces.ay, pieces.by), both(pieces.bx, pieces.ax), both(pieces.by, pieces.ay)
    node = _firsts(shape, ux, uy)
    path, size = _walked(_follow(shape, node, np.arctan2(vy - uy, vx - ux)))
    start, walk = _starts(size), np.repeat(np.arange(len(size)), size)
    owner = shape[path[start]]
    # closed rings of the walks
    at = path[_take(start, size + 1) - np.where(_run(size + 1) == np.repeat(size, size + 1), np.repeat(size, size + 1), 0)]
    area = _area(*_local(size + 1, ux[at], uy[at]))
    # the half-edge that runs farthest in x judges a walk
    wide = np.abs(vx - ux)[path]
    most = np.maximum.reduceat(wide, start) if len(start) else wide
    judge = np.maximum.reduceat(np.where(wide == most[walk], path, -1), start) if len(start) else path
    where = (judge >> 1, (ux[judge] + vx[judge]) / 2, (uy[judge] + vy[judge]) / 2, vx[judge] < ux[judge])
    counts = np.bincount(pieces.shape, minlength=(owner.max() + 1) if len(owner) else 0)
    covered = (area != 0) & _odd_above(where, pieces, _starts(counts)[owner], counts[owner])
    shells, inner = np.flatnonzero(covered & (area > 0)), np.flatnonzero(covered & (area < 0))
    # a hole belongs to the least shell around it
    of = np.bincount(owner[shells], minlength=len(counts))
    hole, shell = np.repeat(inner, of[owner[inner]]), shells[_take(_starts(of)[owner[inner]], of[owner[inner]])]
    around = _odd_above(tuple(v[hole] for v in where), pieces, start[shell], size[shell], path >> 1)
    hole, shell = hole[around], shell[around]
    order = np.lexsort((shell, area[shell], hole))
    hole, shell = hole[order], shell[order]
    least = np.ones(len(hole), bool)
    least[1:] = hole[1:] != hole[:-1]
    hole, shell = hole[least], shell[least]
    return _put_together(np.r_[shells, hole], np.r_[shells, shell], owner, size + 1, ux[at], uy[at], node[at])


def _put_together(walks, shell, owner, size, x, y, node) -> Polygons:
    """Polygons of shells and their holes. walks: the rings to take, each with its shell; size, x, y, node: closed rings of all walks."""
    points = _take(_starts(size)[walks], size[walks])
    hole, size = walks != shell, size[walks]
    x, y, node, ring = x[points], y[points], node[points], np.repeat(np.arange(len(walks)), size)
    last = np.zeros(len(x), bool)
    last[np.cumsum(size) - 1] = True
    passed = np.sort((ring * (node.max() + 1 if len(node) else 1) + node)[~last])
    twice = np.unique(passed[1:][passed[1:] == passed[:-1]] // (node.max() + 1 if len(node) else 1))
    if len(twice):
        plain, first = np.setdiff1d(np.arange(len(walks)), twice), _starts(size)
        loops = [(r, [*loop, loop[0]]) for r in twice for loop in _loops(list(zip(x[first[r] : first[r] + size[r] - 1].tolist(), y[first[r] : first[r] + size[r] - 1].tolist(), strict=True)))]
        keep = np.isin(ring, plain)
        x, y = np.r_[x[keep], [c[0] for _, loop in loops for c in loop]], np.r_[y[keep], [c[1] for _, loop in loops for c in loop]]
        back = np.array([r for r, _ in loops])
        size, shell, was = np.r_[size[plain], [len(loop) for _, loop in loops]], np.r_[shell[plain], shell[back]], np.r_[hole[plain], hole[back]]
        hole = was | ~(_area(*_local(size, x, y)) > 0)
    # rings: outer ones as they come, then holes in order
    inside = np.flatnonzero(hole)
    start = _starts(size)
    ins = _take(start[inside], size[inside])
    order = np.r_[np.flatnonzero(~hole), inside[_ordered(shell[inside], size[inside], x[ins], y[ins])]]
    order = order[np.argsort(shell[order], kind="stable")]
    points, size, shell = _take(start[order], size[order]), size[order], shell[order]
    x, y = x[points], y[points]
    # polygons in order
    first = np.flatnonzero(np.r_[True, shell[1:] != shell[:-1]]) if len(shell) else np.arange(0)
    parts = np.diff(np.r_[first, len(shell)])
    row, start = owner[shell[first]], _starts(size)
    order = _ordered(row, size, x, y, parts)
    rings = _take(first[order], parts[order])
    points = _take(start[rings], size[rings])
    return Polygons(row[order], np.repeat(np.arange(len(order)), parts[order]), size[rings], x[points], y[points])


# Batches of rows


def _chosen(p: Polygons, which: np.ndarray) -> Polygons:
    """The polygons of those numbers (ascending, or a mask)."""
    mask = np.zeros(len(p.row), bool)
    mask[which] = True
    rings = mask[p.ring]
    points = np.repeat(rings, p.size)
    return Polygons(p.row[mask], (np.cumsum(mask) - 1)[p.ring[rings]], p.size[rings], p.x[points], p.y[points])


def _largest(p: Polygons) -> Polygons:
    """Of each row the polygon with the largest area, of equals the first (`geometry.largest`)."""
    if not len(p.row):
        return p
    rings = np.bincount(p.ring, minlength=len(p.row))
    first, part = _starts(rings), np.abs(_area(p.size, p.x, p.y))
    area = np.zeros(len(p.row))
    for k in range(rings.max()):
        some = np.flatnonzero(rings > k)
        area[some] = np.where(area[some] == 0, part[first[some] + k], area[some] - part[first[some] + k])
    order = np.lexsort((-np.arange(len(area)), area, p.row))
    last = np.r_[p.row[order[1:]] != p.row[order[:-1]], True]
    return _chosen(p, order[last])


def _centroid(p: Polygons) -> tuple[np.ndarray, np.ndarray]:
    """Each polygon's area centroid of its outer ring; a flat ring has its vertex mean (`geometry.centroid`)."""
    outer = np.ones(len(p.ring), bool)
    outer[1:] = p.ring[1:] != p.ring[:-1]
    points = np.repeat(outer, p.size)
    size, x, y = p.size[outer], p.x[points], p.y[points]
    _, lx, ly = _local(size, x, y)
    a, start = _edges(size), _starts(size)
    ring = np.repeat(np.arange(len(size)), size - 1)
    cross = lx[a] * ly[a + 1] - lx[a + 1] * ly[a]
    total = lambda of, v: np.bincount(of, weights=v, minlength=len(size))
    six = 3 * total(ring, cross)
    mean = [total(np.repeat(np.arange(len(size)), size), v) / size for v in (x, y)]
    return tuple(np.where(six == 0, m, v[start] + total(ring, (w[a] + w[a + 1]) * cross) / six) for m, v, w in zip(mean, (x, y), (lx, ly), strict=True))


def _read(column: pa.Array) -> tuple[Polygons, np.ndarray, np.ndarray]:
    """The rows' polygons, how many each has, and which rows have a polygon that is missing or a coordinate that isn't finite. Missing rings are as empty ones."""

    def level(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.is_null().to_numpy(zero_copy_only=False), lists.flatten()

    polygons, _, rest = level(column)
    rings, no_polygon, rest = level(rest)
    size, _, rest = level(rest)
    x, y = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in rest.flatten())
    row = np.repeat(np.arange(len(polygons)), polygons)
    ring = np.repeat(np.arange(len(rings)), rings)
    odd = np.zeros(len(polygons), bool)
    odd[row[no_polygon]] = True
    odd[row[ring[np.repeat(np.arange(len(size)), size)[~(np.isfinite(x) & np.isfinite(y))]]]] = True
    return Polygons(row, ring, size, x, y), polygons, odd


def _written(p: Polygons, rows: int, several: bool) -> pa.Array:
    """Arrow's column: a row's polygon, or all its polygons; null for rows without."""
    offsets = lambda sizes: pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    rings = pa.ListArray.from_arrays(offsets(p.size), pa.StructArray.from_arrays([pa.array(p.x), pa.array(p.y)], ["x", "y"]))
    n = np.bincount(p.row, minlength=rows)
    if several:
        inner = pa.ListArray.from_arrays(offsets(np.bincount(p.ring, minlength=len(p.row))), rings)
    else:
        inner, n = rings, np.bincount(p.row[p.ring], minlength=rows)
    return pa.ListArray.from_arrays(offsets(n), inner, mask=pa.array(n == 0))


def _joined(parts: list[tuple[Polygons, np.ndarray]]) -> Polygons:
    """One table of polygons from several, with the rows' true numbers, in order of rows."""
    row = np.concatenate([names[p.row] for p, names in parts])
    before = np.cumsum([0, *(len(p.row) for p, _ in parts)])
    ring = np.concatenate([p.ring + b for (p, _), b in zip(parts, before, strict=False)])
    size, x, y = (np.concatenate([getattr(p, c) for p, _ in parts]) for c in ("size", "x", "y"))
    order = np.argsort(row, kind="stable")
    rings = np.bincount(ring, minlength=len(row))
    take = _take(_starts(rings)[order], rings[order])
    points = _take(_starts(size)[take], size[take])
    return Polygons(row[order], np.repeat(np.arange(len(order)), rings[order]), size[take], x[points], y[points])


def _repaired_rows(p: Polygons, rows: np.ndarray, digits: int) -> list[tuple[Polygons, np.ndarray]]:
    """The repaired polygons of these rows (ascending), block by block."""
    if not len(rows):
        return []
    number = np.full(rows[-1] + 1, -1)
    number[rows] = np.arange(len(rows))
    some = _chosen(p, np.isin(p.row, rows))
    some = some._replace(row=number[some.row])
    corners = np.bincount(np.repeat(some.row[some.ring], some.size), minlength=len(rows))
    out = []
    for part in _blocks((corners + 1) ** 2 // 2, BLOCK):
        block = _chosen(some, (some.row >= part.start) & (some.row < part.stop))
        out.append((_repaired(block._replace(row=block.row - part.start), digits), rows[part]))
    return out


def repaired(column: pa.Array, digits: int) -> pa.Array:
    """All polygons of each row's even-odd area, null if nothing has an area."""
    p, count, odd = _read(column)
    with np.errstate(all="ignore"):
        parts = _repaired_rows(p, np.flatnonzero((count > 0) & ~odd), digits)
    return _written(_joined(parts) if parts else _chosen(p, []), len(column), True)


def largest_valid(column: pa.Array, digits: int) -> pa.Array:
    """struct(polygon, x, y): the largest polygon of each row, of its own, if all are sound, or else of what repair leaves of them; and its centroid."""
    p, count, odd = _read(column)
    with np.errstate(all="ignore"):
        clean, sound = _clean(p)
        broken = np.zeros(len(count), bool)
        broken[p.row[~sound]] = True
        parts = [(_largest(_chosen(clean, ~broken[p.row])), np.arange(len(count)))]
        parts += [(_largest(q), rows) for q, rows in _repaired_rows(p, np.flatnonzero(broken & ~odd), digits)]
        best = _joined(parts)
        place = np.zeros((2, len(count)))
        place[:, best.row] = _centroid(best)
    none = np.ones(len(count), bool)
    none[best.row] = False
    return pa.StructArray.from_arrays([_written(best, len(count), False), *(pa.array(c, mask=none) for c in place)], ["polygon", "x", "y"])
