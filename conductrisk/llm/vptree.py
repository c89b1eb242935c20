"""A vantage-point tree over the rows of a matrix, searched for many queries at once.

An inner node has a vantage point and a radius: rows within the radius lie below its first child, all others below its
second. A query at distance d from the vantage point skips the first child if d - radius > reach, and the second if
radius - d > reach. With the distance of the k-th best row so far as reach this is the triangle inequality, and the search is
exact; dividing it by a factor above one skips more.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

LEAF_ROWS = 128
_TRIES, _SAMPLE = 4, 64


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a and all rows of b, from the differences, in blocks of bounded size."""
    out = np.empty((len(a), len(b)))
    step = max(1, 1_000_000 // max(1, len(b) * a.shape[1]))
    for i in range(0, len(a), step):
        d = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


@dataclass
class VPTree:
    """Rows in the order of the leaves. Node i is a leaf if left[i] < 0; rows first[i] to last[i] lie below it."""

    rows: np.ndarray
    order: np.ndarray
    vantage: np.ndarray
    radius: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = 0) -> "VPTree":
        rng = np.random.default_rng(seed)
        order = np.arange(len(rows))
        nodes, todo = [], [(0, len(rows), -1, 0)]  # [vantage, radius, left, right, first, last]
        while todo:
            first, last, parent, side = todo.pop()
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes)
            node = [0, 0.0, -1, -1, first, last]
            nodes.append(node)
            if last - first <= leaf_rows:
                continue
            own = order[first:last]
            tries = rng.choice(own, _TRIES, replace=False)
            # the vantage point whose distances to some of the rows spread most
            spread = distances(rows[tries], rows[rng.choice(own, min(_SAMPLE, len(own)), replace=False)]).std(axis=1)
            vantage = tries[spread.argmax()]
            d = distances(rows[vantage][None], rows[own])[0]
            radius = float(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
            inside = d <= radius
            if inside.all():  # at least half of the rows are at the largest distance
                radius = float(d[d < radius].max(initial=-1.0))
                inside = d <= radius
            if not inside.any():
                continue  # all rows are equal: a leaf of any size
            order[first:last] = np.concatenate([own[inside], own[~inside]])
            node[0], node[1] = vantage, radius
            middle = first + int(inside.sum())
            todo += [(first, middle, len(nodes) - 1, 0), (middle, last, len(nodes) - 1, 1)]
        v, r, a, b, f, t = (np.array(x) for x in zip(*nodes, strict=True))
        return cls(rows[order], order, rows[v.astype(int)], r.astype(float), a.astype(int), b.astype(int), f.astype(int), t.astype(int))

    def leaf_of(self, queries: np.ndarray) -> np.ndarray:
        """The leaf each query would lie in."""
        at = np.zeros(len(queries), int)
        while True:
            inner = np.flatnonzero(self.left[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            d = queries[inner] - self.vantage[node]
            near = np.sqrt(np.einsum("ij,ij->i", d, d)) <= self.radius[node]
            at[inner] = np.where(near, self.left[node], self.right[node])

    def visit(self, queries: np.ndarray, reach, leaf) -> None:
        """Call leaf(node, numbers of the queries) for every leaf that a query can't skip; reach(numbers) may shrink."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, who = todo.pop()
            if not len(who):
                continue
            if self.left[node] < 0:
                leaf(node, who)
                continue
            beyond = distances(queries[who], self.vantage[node][None])[:, 0] - self.radius[node]
            far = reach(who)
            todo += [(self.right[node], who[-beyond <= far]), (self.left[node], who[beyond <= far])]

    def nearest(self, queries: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, bound: np.ndarray,
                factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest rows of each query within `bound`, nearest first, ties to the smaller id.

        `ids` are the rows' ids in the order the tree was built from, `own` the ids that the queries leave out. Missing
        places have the distance infinity.
        """
        ids = ids[self.order]
        best_d, best_i = np.full((len(queries), k), np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
        home = self.leaf_of(queries) if len(queries) else np.zeros(0, int)

        def scan(node, who):
            rows = slice(self.first[node], self.last[node])
            d = distances(queries[who], self.rows[rows])
            d[(ids[rows][None] == own[who, None]) | (d > bound[who, None])] = np.inf
            every_d = np.hstack([best_d[who], d])
            every_i = np.hstack([best_i[who], np.broadcast_to(ids[rows], d.shape)])
            if every_d.shape[1] > 2 * k:  # what is not further than the k-th
                cut = np.partition(every_d, k - 1, axis=1)[:, k - 1]
                keep = np.arange(int((every_d <= cut[:, None]).sum(axis=1).max()))
                chosen = np.argsort(every_d, axis=1, kind="stable")[:, keep]
                every_d, every_i = np.take_along_axis(every_d, chosen, 1), np.take_along_axis(every_i, chosen, 1)
            top = np.lexsort((every_i, every_d), axis=1)[:, :k]
            best_d[who], best_i[who] = np.take_along_axis(every_d, top, 1), np.take_along_axis(every_i, top, 1)

        for node in np.unique(home):  # first the leaf of each query, for a small reach
            scan(node, np.flatnonzero(home == node))
        slack = 1e-12  # distances are rounded
        self.visit(queries, lambda who: np.minimum(best_d[who, -1], bound[who]) / factor + slack,
                   lambda node, who: scan(node, who[home[who] != node]) if (home[who] != node).any() else None)
        best_i[np.isinf(best_d)] = -1
        return best_i, best_d

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "VPTree":
        return cls(**np.load(io.BytesIO(data)))
