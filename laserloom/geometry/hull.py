"""Convex hulls and Delaunay triangulations in any dimension, with numpy alone.

Points are inserted one by one; the facets that see a new point are replaced by facets from their horizon
to the point. A Delaunay triangulation is the lower side of the hull of points lifted to a paraboloid.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Hull:
    """facets: corners (indices into the points) of each simplex; normals point outward."""

    facets: np.ndarray
    normals: np.ndarray
    offsets: np.ndarray

    @property
    def vertices(self) -> np.ndarray:
        return np.unique(self.facets)


def _planes(points: np.ndarray, facets: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    corners = points[facets]
    edges = corners[:, 1:] - corners[:, :1]
    d = points.shape[1]
    if d == 2:
        n = np.stack([edges[:, 0, 1], -edges[:, 0, 0]], 1)
    elif d == 3:
        (a, b, c), (e, f, g) = edges[:, 0].T, edges[:, 1].T
        n = np.stack([b * g - c * f, c * e - a * g, a * f - b * e], 1)
    else:
        n = np.linalg.svd(edges)[2][:, -1]
    n = n / np.maximum(np.sqrt((n * n).sum(1, keepdims=True)), 1e-300)
    off = np.einsum("ij,ij->i", n, corners[:, 0])
    flip = n @ inner > off
    n[flip] *= -1
    off[flip] *= -1
    return n, off


def _simplex(points: np.ndarray, eps: float) -> list[int] | None:
    """Corners of a simplex of full dimension, or None for flat points."""
    d = points.shape[1]
    a = int(np.argmin(points[:, 0]))
    chosen, basis = [a], np.zeros((0, d))
    rest = points - points[a]
    for _ in range(d):
        r = rest - (rest @ basis.T) @ basis
        size = np.linalg.norm(r, axis=1)
        k = int(np.argmax(size))
        if size[k] <= eps:
            return None
        chosen.append(k)
        basis = np.vstack([basis, r[k] / size[k]])
    return chosen


def convex_hull(points: np.ndarray) -> Hull | None:
    """Hull of points (n x d); None for fewer than d + 1 or flat points. Repeated points are harmless."""
    n, d = points.shape
    if n < d + 1:
        return None
    centre = points.mean(0)
    p = points - centre
    scale = np.abs(p).max()
    if not scale:
        return None
    p = p / scale
    eps = 1e-10
    first = _simplex(p, 1e-9)
    if first is None:
        return None
    inner = p[first].mean(0)
    facets = np.array([[c for c in first if c != k] for k in first])
    normals, offsets = _planes(p, facets, inner)
    order = np.argsort(-np.linalg.norm(p - inner, axis=1), kind="stable")
    sides = [[c for c in range(d) if c != j] for j in range(d)]
    short = n ** (d - 1) < 2**62  # a ridge's corners fit into one number
    i = 0
    while i < n:
        ahead = order[i : i + 32]
        sees = p[ahead] @ normals.T - offsets > eps
        some = sees.any(1)
        j = int(some.argmax())
        if not some[j]:
            i += len(ahead)
            continue
        i, k, seen = i + j + 1, ahead[j], sees[j]
        vis = facets[seen]
        ridges = np.concatenate([vis[:, c] for c in sides])
        ridges.sort(axis=1)
        if short:
            key = ridges[:, 0]
            for c in range(1, d - 1):
                key = key * n + ridges[:, c]
            o = np.argsort(key)
            key = key[o]
            twin = np.append(key[1:] == key[:-1], False)
            horizon = ridges[o[~(twin | np.append(False, twin[:-1]))]]
        else:
            uniq, count = np.unique(ridges, axis=0, return_counts=True)
            horizon = uniq[count == 1]
        new = np.column_stack([horizon, np.full(len(horizon), k)])
        nn, no = _planes(p, new, inner)
        keep = ~seen
        facets = np.concatenate([facets[keep], new])
        normals, offsets = np.concatenate([normals[keep], nn]), np.concatenate([offsets[keep], no])
    return Hull(facets, normals, offsets * scale + normals @ centre)


def ring_2d(points: np.ndarray) -> np.ndarray | None:
    """Indices of the plane hull's corners in counterclockwise order, not closed (monotone chain). Points on a side are no
    corners, as far as the precision of the coordinates given tells (so give them as they are, not less their mean)."""
    if not len(points):
        return None
    flat = 4 * np.spacing(np.abs(points).max()) * np.ptp(points, axis=0).max()
    o = np.lexsort((points[:, 1], points[:, 0]))
    keep = np.append(True, (points[o][1:] != points[o][:-1]).any(1))
    o = o[keep]
    if len(o) < 3:
        return None

    x, y = points[:, 0].tolist(), points[:, 1].tolist()

    def chain(idx):
        out: list[int] = []
        for k in idx.tolist():
            while len(out) > 1:
                i, j = out[-2], out[-1]
                if (x[j] - x[i]) * (y[k] - y[i]) - (y[j] - y[i]) * (x[k] - x[i]) > flat:
                    break
                out.pop()
            out.append(k)
        return out

    low, high = chain(o), chain(o[::-1])
    ring = low[:-1] + high[:-1]
    return np.array(ring) if len(ring) >= 3 else None


def ring_area(xy: np.ndarray) -> float:
    x, y = xy[:, 0] - xy[0, 0], xy[:, 1] - xy[0, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def area_and_volume(points: np.ndarray, h: Hull) -> tuple[float, float]:
    """Surface and volume of a hull in space."""
    c = points[h.facets]
    cross = np.cross(c[:, 1] - c[:, 0], c[:, 2] - c[:, 0])
    area = np.linalg.norm(cross, axis=1) / 2
    inner = points[h.vertices].mean(0)
    return float(area.sum()), float((area * np.abs(np.einsum("ij,ij->i", h.normals, c[:, 0] - inner))).sum() / 3)


def delaunay(points: np.ndarray) -> np.ndarray | None:
    """Simplices (m x (d + 1)) of the Delaunay triangulation; None for flat or too few points. Positions are
    shaken by 1e-7 of their extent, seeded, so that points on common circles are no trouble."""
    n, d = points.shape
    p = points - points.mean(0)
    scale = np.abs(p).max() if n else 0
    if n < d + 1 or not scale:
        return None
    p = p / scale
    p = p + np.random.RandomState(0).uniform(-1e-7, 1e-7, p.shape)
    if _simplex(p, 1e-6) is None:
        return None
    h = convex_hull(np.column_stack([p, (p**2).sum(1)]))
    if h is None:
        return None
    return h.facets[h.normals[:, -1] < -1e-9]


def circumradius(points: np.ndarray, simplices: np.ndarray) -> np.ndarray:
    c = points[simplices]
    a = 2 * (c[:, 1:] - c[:, :1])
    b = (c[:, 1:] ** 2).sum(2) - (c[:, :1] ** 2).sum(2)
    out = np.full(len(c), np.inf)
    ok = np.abs(np.linalg.det(a)) > 1e-14
    if ok.any():
        centre = np.linalg.solve(a[ok], b[ok][:, :, None])[:, :, 0]
        out[ok] = np.linalg.norm(centre - c[ok][:, 0], axis=1)
    return out


@dataclass
class AlphaShape:
    """boundary: corners of the boundary's edges or facets; measure: area or volume; surface: length or area."""

    alpha: float
    boundary: np.ndarray
    measure: float
    surface: float


def alpha_shape(points: np.ndarray, alpha_min: float = 0.0) -> AlphaShape | None:
    """Alpha shape in the plane or in space with holes filled; alpha is the least that keeps all points in one
    region, or alpha_min if that is larger. None for flat or too few points."""
    once = np.unique(points, axis=0)
    if len(once) < points.shape[1] + 1:
        return None
    pts = once - once.mean(0)
    tri = delaunay(pts)
    if tri is None or not len(tri):
        return None
    d = pts.shape[1]
    r = circumradius(pts, tri)
    sides = np.concatenate([np.delete(tri, j, axis=1) for j in range(d + 1)])
    sides.sort(axis=1)
    owner = np.tile(np.arange(len(tri)), d + 1)
    _, side = np.unique(sides, axis=0, return_inverse=True)
    side = side.ravel()
    by_side: dict[int, list[int]] = {}
    for s, t in zip(side.tolist(), owner.tolist()):
        by_side.setdefault(s, []).append(t)
    of: list[list[int]] = [[] for _ in range(len(tri))]
    for s, t in zip(side.tolist(), owner.tolist()):
        of[t].append(s)
    # the critical alpha: simplices by radius until they hold all points in one region
    parent = list(range(len(tri)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    order = np.argsort(r, kind="stable")
    inside = np.zeros(len(tri), bool)
    covered: set[int] = set()
    used = np.unique(tri)
    regions, critical = 0, float(r[order[-1]])
    for t in order.tolist():
        inside[t] = True
        regions += 1
        covered.update(tri[t].tolist())
        for s in of[t]:
            for u in by_side[s]:
                if u != t and inside[u]:
                    a, b = find(t), find(u)
                    if a != b:
                        parent[a] = b
                        regions -= 1
        if regions == 1 and len(covered) == len(used):
            critical = float(r[t])
            break
    alpha = max(critical, alpha_min)
    inside = r <= alpha
    # holes: what isn't inside and isn't reached from outside
    todo = [t for t in np.flatnonzero(~inside).tolist() if any(len(by_side[s]) == 1 for s in of[t])]
    outside = np.zeros(len(tri), bool)
    outside[todo] = True
    while todo:
        t = todo.pop()
        for s in of[t]:
            for u in by_side[s]:
                if not inside[u] and not outside[u]:
                    outside[u] = True
                    todo.append(u)
    solid = ~outside
    c = pts[tri[solid]]
    measure = float(np.abs(np.linalg.det(c[:, 1:] - c[:, :1])).sum() / (2 if d == 2 else 6))
    edge = [k for k, ts in by_side.items() if sum(solid[t] for t in ts) == 1]
    first = np.zeros(side.max() + 1, int)
    first[side[::-1]] = np.arange(len(side))[::-1]
    b = sides[first[np.array(edge, int)]]
    e = pts[b]
    surface = float(np.linalg.norm(e[:, 1] - e[:, 0], axis=1).sum()) if d == 2 else float(np.linalg.norm(np.cross(e[:, 1] - e[:, 0], e[:, 2] - e[:, 0]), axis=1).sum() / 2)
    # back to rows of the input: the first row at each position
    back = {tuple(p): k for k, p in reversed(list(enumerate(points.tolist())))}
    rows = np.array([back[tuple(p)] for p in once.tolist()])
    return AlphaShape(alpha, rows[b], measure, surface)


def walk(boundary: np.ndarray) -> list[int]:
    """The longest closed ring of a plane boundary's edges, as corners in order, not closed."""
    near: dict[int, list[int]] = {}
    for a, b in boundary.tolist():
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    best: list[int] = []
    used: set[tuple[int, int]] = set()
    for start in near:
        ring, at = [start], start
        while True:
            nxt = next((k for k in near[at] if (min(at, k), max(at, k)) not in used), None)
            if nxt is None:
                break
            used.add((min(at, nxt), max(at, nxt)))
            if nxt == start:
                break
            ring.append(nxt)
            at = nxt
        if len(ring) > len(best):
            best = ring
    return best
