"""Delaunay triangulations and alpha shapes of many point sets at once, with numpy alone.

All sets lie in the same arrays. A triangulation is the lower side of the hull of the points lifted to a paraboloid.
In each round, of every set, points are inserted whose holes in the hull have no facet in common, not even at their rims, so
that their order does not matter; a point not yet inserted knows one facet that sees it. The work grows about as the number of
points, for one large set as for thousands of small ones."""

from __future__ import annotations

import numpy as np

from laserloom.geometry import hull

#: Distance to a facet (sets are scaled to 1) from which a point sees it.
EPS = 1e-14


def _normals(p: np.ndarray, v: np.ndarray, inner: np.ndarray) -> np.ndarray:
    base = p.take(v[:, 0], 0)
    e = [np.ascontiguousarray((p.take(v[:, k], 0) - base).T) for k in range(1, p.shape[1])]
    if p.shape[1] == 3:
        (a, b, c), (f, g, h) = e
        n = np.stack([b * h - c * g, c * f - a * h, a * g - b * f], 1)
    else:
        (a, b, c, d), (f, g, h, i), (q, r, s, t) = e
        gh, gi, hi, fh, fi, fg = g * s - h * r, g * t - i * r, h * t - i * s, f * s - h * q, f * t - i * q, f * r - g * q
        n = np.stack([b * hi - c * gi + d * gh, -(a * hi - c * fi + d * fh), a * gi - b * fi + d * fg, -(a * gh - b * fh + c * fg)], 1)
    n = n / np.maximum(np.sqrt(np.einsum("ij,ij->i", n, n))[:, None], 1e-300)
    n[np.einsum("ij,ij->i", n, inner - base) > 0] *= -1
    return n


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)


class _Hulls:
    """Hulls of the sets of p; first: corners of a simplex of each set. bad: sets whose facets did not fit together."""

    def __init__(self, p: np.ndarray, group: np.ndarray, first: np.ndarray):
        s, k = first.shape
        d = self.d = k - 1
        self.p, self.group, self.inner = p, group, p[first].mean(1)
        keep = np.array([[c for c in range(k) if c != j] for j in range(k)])
        self.v = first[:, keep].reshape(-1, d)
        self.a = (keep[None] + (np.arange(s) * k)[:, None, None]).reshape(-1, d)
        self.n = _normals(p, self.v, np.repeat(self.inner, k, 0))
        self.live = np.ones(len(self.v), bool)
        self.claim = np.full(len(self.v), -1)
        self.seen = np.zeros(len(self.v), bool)
        self.who = np.full(len(self.v), -1)
        self.free = np.zeros(0, np.int64)
        self.others = np.array([[c for c in range(d) if c != j] for j in range(d)])
        self.bad = np.zeros(s, bool)
        self.facet, self.dist = np.full(len(p), -1), np.zeros(len(p))
        rest = np.ones(len(p), bool)
        rest[first] = False
        rest = np.flatnonzero(rest & (group >= 0))
        self.place(rest, group[rest] * k, np.full(len(rest), k), np.arange(len(self.v)))
        self.random = np.random.RandomState(1)
        while self.round():
            pass

    def far(self, q: np.ndarray, f: np.ndarray) -> np.ndarray:
        e = self.p.take(q, 0)
        e -= self.p.take(self.v[:, 0].take(f), 0)
        return np.einsum("ij,ij->i", self.n.take(f, 0), e)

    def place(self, pts: np.ndarray, start: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Give each point the facet that it is farthest from, of ids[start .. start + count - 1], or none."""
        for b in range(0, len(pts), 20_000):
            q, s, n = pts[b : b + 20_000], start[b : b + 20_000], count[b : b + 20_000]
            f = ids.take(_ranges(s, n))
            each = np.repeat(q, n)
            far = self.far(each, f)
            most = np.maximum.reduceat(far, np.cumsum(n) - n)
            hit = np.flatnonzero(far == np.repeat(most, n))
            self.facet[each[hit]] = f[hit]
            self.dist[q] = most
            self.facet[q[~(most > EPS)]] = -1

    def grow(self, n: int) -> None:
        old = len(self.v)
        more = max(n, old)
        wide = lambda x, fill: np.concatenate([x, np.full((more, *x.shape[1:]), fill, x.dtype)])
        self.v, self.a, self.n, self.live = wide(self.v, 0), wide(self.a, 0), wide(self.n, 0.0), wide(self.live, False)
        self.claim, self.seen, self.who = wide(self.claim, -1), wide(self.seen, False), wide(self.who, -1)
        self.free = np.concatenate([self.free, np.arange(old, old + more)])

    def round(self) -> bool:
        act = np.flatnonzero(self.facet >= 0)
        if not len(act):
            return False
        # the farthest point of each facet, and of neighbouring facets' only one
        o = act.take(np.argsort(self.dist.take(act)))
        at = self.facet.take(o)
        self.who[at] = o
        pick = o[self.who.take(at) == o]
        self.who[at] = -1
        pick = self.random.permutation(pick)
        f = self.facet[pick]
        self.who[f] = np.arange(len(f))
        near = self.a.take(f, 0)
        best = np.ones(len(f), bool)
        for j in range(self.d):
            best &= self.who.take(near[:, j]) <= np.arange(len(f))
        k = np.flatnonzero(best)
        for j in range(self.d):
            beyond = self.a.take(near[k, j], 0)
            for i in range(self.d):
                best[k] &= self.who.take(beyond[:, i]) <= k
        self.who[f] = -1
        pick, f = pick[best], f[best]
        # holes: all facets that a point sees, from its own outwards; whoever comes later in the list wins
        alive = np.ones(len(pick), bool)
        c = np.arange(len(pick))
        self.claim[f], self.seen[f] = c, True
        holes, touched = [(c, f)], [f]
        while len(c):
            k, g = np.repeat(c, self.d), self.a.take(f, 0).ravel()
            new = np.flatnonzero(self.claim.take(g) != k)
            k, g = k.take(new), g.take(new)
            np.maximum.at(self.claim, g, k)
            won = self.claim.take(g) == k
            alive[k[~won]] = False
            won = np.flatnonzero(won)
            k, g = k.take(won), g.take(won)
            self.who[g] = np.arange(len(g))
            once = np.flatnonzero((self.who.take(g) == np.arange(len(g))) & alive.take(k))
            self.who[g] = -1
            touched.append(g)
            k, g = k.take(once), g.take(once)
            sees = self.far(pick.take(k), g) > EPS
            self.seen[g] = sees
            c, f = k[sees], g[sees]
            holes.append((c, f))
        c, f = (np.concatenate(x) for x in zip(*holes))
        lost = self.claim.take(f) != c
        for j in range(self.d):
            lost |= self.claim.take(self.a[:, j].take(f)) != c
        alive[c[lost]] = False
        # new facets, from the ridges at the rims to the points
        m = np.flatnonzero(alive.take(c))
        m = m.take(np.argsort(c.take(m), kind="stable"))
        c, f = c.take(m), f.take(m)
        rim = self.a.take(f, 0)
        i, j = np.nonzero(~self.seen.take(rim))
        hc, hf = c.take(i), f.take(i)
        hg = rim.ravel().take(i * self.d + j)
        slots = self.others.take(j, 0)
        nv = self.v.take(hf, 0)
        rest = nv.ravel().take(slots + np.arange(len(nv))[:, None] * self.d)
        if self.d == 3:
            key = rest[:, ::-1].astype(np.int64)
        else:
            x, y, z = rest.T
            key = np.stack([np.minimum(b, c) * len(self.p) + np.maximum(b, c) for b, c in ((y, z), (x, z), (x, y))], 1)
        key = key * len(pick) + hc[:, None]
        width = self.d - 1
        e = np.argsort(key.ravel(), kind="stable")
        s = key.ravel()[e]
        if len(s) % 2 or (s[::2] != s[1::2]).any() or (s[1:-1:2] == s[2::2]).any():
            u, n = np.unique(s, return_counts=True)
            self.fail(np.unique(self.group[pick[np.unique(u[n != 2] % len(pick))]]))
            self.reset(touched)
            return True
        if len(hf) > len(f) + len(self.free):
            self.grow(len(hf))
        pool = np.concatenate([f, self.free])
        ids, self.free = pool[: len(hf)], pool[len(hf) :]
        nv[np.arange(len(hf)), j] = pick[hc]
        na = np.empty_like(nv)
        na[np.arange(len(hf)), j] = hg
        t, slot = e // width, slots.ravel()[e]
        na[t[::2], slot[::2]], na[t[1::2], slot[1::2]] = ids[t[1::2]], ids[t[::2]]
        back = (self.a.take(hg, 0) == hf[:, None]).argmax(1)
        # points that have lost their facet
        gone = np.zeros(len(self.v), bool)
        gone[f] = True
        self.facet[pick[alive]] = -1
        pts = act[self.facet.take(act) >= 0]
        pts = pts[gone.take(self.facet.take(pts))]
        owner = self.claim.take(self.facet.take(pts))
        self.live[f] = False
        self.a[hg, back] = ids
        self.v[ids], self.a[ids], self.n[ids], self.live[ids] = nv, na, _normals(self.p, nv, self.inner[self.group[pick[hc]]]), True
        count = np.bincount(hc, minlength=len(pick))
        self.place(pts, (np.cumsum(count) - count)[owner], count[owner], ids)
        self.reset(touched)
        return True

    def reset(self, touched: list[np.ndarray]) -> None:
        t = np.concatenate(touched)
        self.claim[t], self.seen[t] = -1, False

    def fail(self, groups: np.ndarray) -> None:
        self.bad[groups] = True
        self.facet[np.isin(self.group, groups)] = -1
        self.live &= ~np.isin(self.group[self.v[:, 0]], groups)


def _simplices(tri: np.ndarray) -> np.ndarray:
    """Neighbours of simplices by the corner that lies opposite, -1 for none."""
    k = tri.shape[1]
    sides = np.sort(np.concatenate([np.delete(tri, j, axis=1) for j in range(k)]), axis=1)
    o = np.lexsort(sides.T[::-1])
    same = np.flatnonzero((sides[o][1:] == sides[o][:-1]).all(1))
    out = np.full(k * len(tri), -1)
    out[o[same]], out[o[same + 1]] = o[same + 1] % len(tri), o[same] % len(tri)
    return out.reshape(k, -1).T


def delaunay_many(points: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simplices of the Delaunay triangulations of the groups (0, 1, .., in order) and their neighbours by the opposite corner, -1 for
    none. As hull.delaunay: points are shaken by 1e-7 of their group's extent; flat or small groups have no simplices."""
    n, d = points.shape
    size = np.bincount(group)
    start = np.cumsum(size) - size
    p = points - (np.stack([np.bincount(group, points[:, k]) for k in range(d)], 1) / np.maximum(size, 1)[:, None])[group]
    scale = np.zeros(len(size))
    np.maximum.at(scale, group, np.abs(p).max(1))
    p = p / np.where(scale > 0, scale, 1)[group][:, None]
    p = p + np.random.RandomState(0).uniform(-1e-7, 1e-7, (size.max(initial=0), d))[np.arange(n) - start[group]]
    high = np.column_stack([p, (p**2).sum(1)])
    first, own = [], np.full(n, -1)
    for g in np.flatnonzero((size >= d + 2) & (scale > 0)):
        s = slice(start[g], start[g] + size[g])
        c = hull._simplex(p[s], 1e-6)
        if c is None:
            continue
        e = high[s][c[1:]] - high[s][c[0]]
        normal = np.linalg.svd(e)[2][-1]
        k = np.abs((high[s] - high[s][c[0]]) @ normal)
        k[c] = 0
        own[s] = len(first)
        first.append([*(x + start[g] for x in c), int(k.argmax()) + start[g]])
    if not first:
        return np.zeros((0, d + 1), int), np.zeros((0, d + 1), int)
    h = _Hulls(high, own, np.array(first))
    low = np.flatnonzero(h.live & (h.n[:, -1] < -1e-9))
    at = np.full(len(h.v), -1)
    at[low] = np.arange(len(low))
    tri, near = h.v[low], at[h.a[low]]
    for b in np.flatnonzero(h.bad):  # by inserting one point after the other
        s = np.flatnonzero(own == b)
        more = hull.delaunay(points[s])
        if more is not None and len(more):
            beside = _simplices(more)
            tri, near = np.concatenate([tri, s[more]]), np.concatenate([near, np.where(beside < 0, -1, beside + len(tri))])
    return tri, near


def _spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray, nodes: int) -> np.ndarray:
    """Weights of a least spanning forest's edges."""
    edge = np.argsort(weight, kind="stable")
    a, b, weight, part, out = a[edge], b[edge], weight[edge], np.arange(nodes), []
    while len(a):
        best = np.full(nodes, len(a))
        np.minimum.at(best, a, np.arange(len(a)))
        np.minimum.at(best, b, np.arange(len(a)))
        has = np.flatnonzero(best < len(a))
        k = best[has]
        out.append(weight[np.unique(k)])
        up = np.arange(nodes)
        up[has] = a[k] + b[k] - has
        up = np.where((up[up] == np.arange(nodes)) & (np.arange(nodes) < up), np.arange(nodes), up)
        while (up[up] != up).any():
            up = up[up]
        part = up[part]
        a, b = up[a], up[b]
        m = a != b
        a, b, weight = a[m], b[m], weight[m]
    return np.concatenate(out) if out else weight


def alpha_shapes(points: np.ndarray, group: np.ndarray, alpha_min: float = 0.0) -> list[hull.AlphaShape | None]:
    """The alpha shape of each group (0, 1, .., in order) in the plane or in space, holes filled; alpha is the least that
    keeps all points of a group in one region, or alpha_min if that is larger. None for flat or small groups."""
    groups, d = int(group.max(initial=-1)) + 1, points.shape[1]
    o = np.lexsort((*points.T[::-1], group))
    q, g = points[o], group[o]
    new = np.append(True, (q[1:] != q[:-1]).any(1) | (g[1:] != g[:-1])) if len(q) else np.zeros(0, bool)
    rows, q, g = o[new], q[new], g[new]
    size = np.bincount(g, minlength=groups)
    pts = q - (np.stack([np.bincount(g, q[:, k], minlength=groups) for k in range(d)], 1) / np.maximum(size, 1)[:, None])[g]
    tri, near = delaunay_many(pts, g)
    if not len(tri):
        return [None] * groups
    # by group and radius: a simplex' place is its rank
    r = hull.circumradius(pts, tri)
    o = np.lexsort((r, g[tri[:, 0]]))
    rank = np.empty(len(o), int)
    rank[o] = np.arange(len(o))
    tri, r, near = tri[o], r[o], np.where(near[o] < 0, -1, rank[near[o]])
    own = g[tri[:, 0]]
    count = np.bincount(own, minlength=groups)
    start = np.cumsum(count) - count
    at = np.arange(len(tri))
    # the critical alpha: all points covered by one region
    least = np.full(len(pts), len(tri))
    np.minimum.at(least, tri.ravel(), np.repeat(at, d + 1))
    cover = np.zeros(groups, int)
    used = least < len(tri)
    np.maximum.at(cover, g[used], least[used])
    a, k = np.nonzero((near >= 0) & (near < at[:, None]))
    regions = np.cumsum(1 - np.bincount(_spanning(a, near[a, k], a, len(tri)), minlength=len(tri)))
    regions = regions - np.append(0, regions)[start][own]
    critical = start + count - 1
    np.minimum.at(critical, *(lambda t: (own[t], t))(np.flatnonzero((regions == 1) & (at >= cover[own]))))
    alpha = np.maximum(r[np.minimum(critical, len(r) - 1)], alpha_min)
    # holes: what isn't inside and isn't reached from outside
    inside = r <= alpha[own]
    todo = np.flatnonzero(~inside & (near < 0).any(1))
    outside = np.zeros(len(tri), bool)
    outside[todo] = True
    while len(todo):
        t = near[todo].ravel()
        t = t[t >= 0]
        todo = np.unique(t[~inside[t] & ~outside[t]])
        outside[todo] = True
    c = pts[tri]
    volume = np.where(outside, 0.0, np.abs(np.linalg.det(c[:, 1:] - c[:, :1]))) / (2 if d == 2 else 6)
    measure = np.bincount(own, volume, minlength=groups)
    t, k = np.nonzero(~outside[:, None] & ((near < 0) | outside[near]))
    b = np.sort(np.take_along_axis(tri[t], np.array([[c for c in range(d + 1) if c != j] for j in range(d + 1)])[k], 1), axis=1)
    o = np.lexsort((*b.T[::-1], own[t]))
    b, bg = b[o], own[t][o]
    e = pts[b]
    each = np.linalg.norm(e[:, 1] - e[:, 0], axis=1) if d == 2 else np.linalg.norm(np.cross(e[:, 1] - e[:, 0], e[:, 2] - e[:, 0]), axis=1) / 2
    surface = np.bincount(bg, each, minlength=groups)
    cut = np.searchsorted(bg, np.arange(groups + 1))
    return [hull.AlphaShape(float(alpha[i]), rows[b[cut[i] : cut[i + 1]]], float(measure[i]), float(surface[i])) if count[i] else None for i in range(groups)]
