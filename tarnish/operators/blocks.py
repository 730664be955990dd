"""Blocks of weighted texts: pairs of one main and one aux block that can be near, found in bounded memory.

A block holds texts as rows of n-gram numbers and weights, rarest n-gram first. Pairs stay inside
:class:`Block`: what a task gives back is a row per main text, never a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

# Distances and similarities are compared after rounding to this many digits.
DIGITS = 9
SLACK = 1e-8

# Postings, or entries of texts, that are laid out at a time.
BATCH = 1 << 21

# Postings of its rarest n-grams that a text is measured against to find its bound.
SEEDS = 32

# Postings of a text's last n-gram that are visited one by one; of more, the heaviest are.
FEW = 256

# Bits of the mask that tells what a text holds.
BITS = 64


def _flat(ids: pd.Series, ws: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each entry, n-gram number, weight."""
    rows = np.repeat(np.arange(len(ids), dtype="int32"), [len(v) for v in ids])
    if not len(rows):
        return rows, np.zeros(0, "int64"), np.zeros(0)
    return rows, np.concatenate(ids.to_numpy()), np.concatenate(ws.to_numpy())


def _tails(rows: np.ndarray, starts: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Norm of each text's weights from this entry on."""
    so_far = np.concatenate([[0.0], np.cumsum(w * w)])
    return np.sqrt(np.maximum(so_far[starts[rows + 1]] - so_far[:-1], w * w))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start .. start + length - 1`` of every range, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class _Mask:
    """Per text ``held``, the bits of those n-grams that tell texts apart, and ``upto[m]``, the most that
    its squared weights add up to where all but ``m`` of its bits are known not to be shared."""

    def __init__(self, rows: np.ndarray, starts: np.ndarray, grams: np.ndarray, w: np.ndarray, telling: np.ndarray):
        n = len(starts) - 1
        tells = telling[grams]
        plain = np.bincount(rows[~tells], w[~tells] ** 2, n)
        keys = rows[tells].astype("int64") * BITS + grams[tells] * 37 % BITS
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        self.held, self.upto = np.zeros(n, "uint64"), plain[None].astype("float32")
        if not len(keys):
            return
        mass = np.add.reduceat(w[tells][order] ** 2, first)
        rows, starts = keys // BITS, np.searchsorted(keys // BITS, np.arange(n))
        some = np.unique(rows)
        self.held[some] = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (keys % BITS).astype("uint64")), starts[some])
        # the heaviest bit of a text first
        order = np.lexsort((-mass, rows))
        place = np.arange(len(rows)) - starts[rows]
        steps = np.zeros((int(place.max()) + 2, n), "float32")
        steps[0] = plain
        steps[place + 1, rows] = mass[order]
        self.upto = np.cumsum(steps, 0, out=steps)

    def most(self, common: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.upto[np.minimum(common, len(self.upto) - 1), at]


class Aux:
    """Aux texts ``y``, a frame with the columns ``ids``, ``ws`` and, where numbers count, ``z``, filed
    by n-gram. It serves any number of blocks."""

    def __init__(self, y: pd.DataFrame):
        yr, yi, yw = _flat(y["ids"], y["ws"])
        self.grams, yi = np.unique(yi, return_inverse=True)
        yi = yi.astype("int32")
        self.z = np.stack(y["z"].to_numpy()).astype(float) if "z" in y else None
        self.ys = np.searchsorted(yr, np.arange(len(y) + 1))
        self.yg, self.yw = yi, yw
        ty = _tails(yr, self.ys, yw)
        # postings by n-gram, largest remaining norm first
        filed = yi * 2.0 + 1.0 - np.minimum(ty, 1.0)
        order = np.argsort(filed, kind="stable")
        self.filed, self.py, self.pw = filed[order], yr[order], yw[order]
        self.prest = np.sqrt(np.maximum(ty ** 2 - yw ** 2, 0.0))[order]
        self.first = np.searchsorted(yi[order], np.arange(len(self.grams) + 1))
        self.code = np.full(len(self.grams), -1)
        self.order = y["o"].rank(method="first").to_numpy() if "o" in y else np.arange(len(y))
        self.heaviest: dict[int, tuple] = {}
        # an n-gram of many texts tells few apart
        self.telling = np.diff(self.first) * 16 <= len(y)
        self.mask = _Mask(yr, self.ys, yi, yw, self.telling)

    def levels(self, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different weights of an n-gram, largest first, and of each the two texts of lowest order."""
        if g not in self.heaviest:
            rows, w = (v[self.first[g]:self.first[g + 1]] for v in (self.py, self.pw))
            order = np.lexsort((self.order[rows], -w))
            rows, w = rows[order], w[order]
            start = np.concatenate([[0], np.flatnonzero(np.diff(w)) + 1])
            end = np.concatenate([start[1:], [len(w)]])
            self.heaviest[g] = w[start], rows[start], rows[np.minimum(start + 1, end - 1)]
        return self.heaviest[g]


class Block:
    """Main texts ``x``, a frame as that of :class:`Aux`, and aux texts ``y``, such a frame or filed already.
    ``same`` gives per main text the aux row that is no neighbour of it, or -1."""

    def __init__(self, x: pd.DataFrame, y: pd.DataFrame | Aux, same: np.ndarray | None = None):
        aux = y if isinstance(y, Aux) else Aux(y)
        xr, xi, xw = _flat(x["ids"], x["ws"])
        # only n-grams of both sides count
        xr, xi, xw = self._known(aux.grams, xr, xi, xw)
        self.same = same
        self.z = [np.stack(x["z"].to_numpy()).astype(float), aux.z] if "z" in x else None
        self.grams = len(aux.grams)
        self.xs, self.ys = np.searchsorted(xr, np.arange(len(x) + 1)), aux.ys
        self.xg, self.xw, self.xt = xi, xw, _tails(xr, self.xs, xw)
        self.xrest = np.sqrt(np.maximum(self.xt ** 2 - xw ** 2, 0.0))
        self.yg, self.yw = aux.yg, aux.yw
        self.filed, self.py, self.pw, self.prest, self.first = aux.filed, aux.py, aux.pw, aux.prest, aux.first
        # pairs that share a text's last n-gram alone need no visit: its weights tell their cosine
        self.aux, self.last = aux, np.zeros(len(xr), bool)
        if self.z is None and len(xr):
            ends = self.xs[1:][np.diff(self.xs) > 0] - 1
            self.last[ends] = np.diff(self.first)[xi[ends]] > FEW
        self.code = aux.code
        self.masks = _Mask(xr, self.xs, xi, xw, aux.telling), aux.mask

    @staticmethod
    def _known(grams, rows, ids, ws):
        at = np.searchsorted(grams, ids).astype("int32")
        at[at == len(grams)] = 0
        known = grams[at] == ids if len(grams) else np.zeros(len(ids), bool)
        return rows[known], at[known], ws[known]

    def _heaviest(self, a: int, b: int, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of the main rows ``a .. b - 1`` that stand for all pairs with no other n-gram in
        common than the row's last one, where this has many postings: the heaviest, and of equally heavy ones
        the lowest, with one to spare for the row's own. Whoever shares a rarer n-gram too is nearer than them."""
        e = np.flatnonzero(self.last[self.xs[a]:self.xs[b]]) + self.xs[a]
        xi = np.searchsorted(self.xs, e, "right") - 1
        e, xi = (v[self.xw[e] >= need[xi] - SLACK] for v in (e, xi))
        pairs = [np.zeros(0, "int64")]
        for g in np.unique(self.xg[e]):
            w, *rows = self.aux.levels(g)
            at = self.xg[e] == g
            # products that may round to the same
            least = w[0] - 4 * 10.0 ** -DIGITS / self.xw[e[at]]
            if self.same is not None:
                # the heaviest may be the row itself
                own = (rows[0][0] == self.same[xi[at]]) & (rows[1][0] == rows[0][0])
                least = np.where(own, w[min(1, len(w) - 1)] - 4 * 10.0 ** -DIGITS / self.xw[e[at]], least)
            n = np.searchsorted(-w, -least, side="right")
            p, xs = _spread(np.zeros(len(n), "int64"), n), np.repeat(xi[at], n)
            pairs += [xs * len(self.ys) + r[p] for r in rows]
        pairs = np.unique(np.concatenate(pairs))
        xi, yi = pairs // len(self.ys), pairs % len(self.ys)
        if self.same is not None:
            xi, yi = xi[self.same[xi] != yi], yi[self.same[xi] != yi]
        return xi, yi

    def _reach(self, a: int, b: int, need: np.ndarray, all_of: bool = False) -> np.ndarray:
        """Postings that each entry of the main rows ``a .. b - 1`` has to visit, none of the last n-grams that
        :meth:`_heaviest` stands for unless ``all_of`` the pairs count."""
        e = slice(self.xs[a], self.xs[b])
        g, t = self.xg[e], self.xt[e]
        least = np.repeat(need[a:b], np.diff(self.xs[a:b + 1]))
        low = np.clip(least / np.maximum(t, SLACK) - SLACK, 0.0, 1.0)
        n = np.searchsorted(self.filed, g * 2.0 + (1.0 - low) + SLACK, side="right") - self.first[g]
        visited = (t >= least - SLACK) & (all_of | ~self.last[e])
        return np.where(visited, np.clip(n, 0, self.first[g + 1] - self.first[g]), 0)

    def _visit(self, a: int, b: int, n: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs met in the first ``n`` postings of each entry that may reach their need."""
        entries = np.repeat(np.arange(self.xs[a], self.xs[b]), n)
        p = _spread(self.first[self.xg[self.xs[a]:self.xs[b]]], n)
        xi = np.repeat(np.repeat(np.arange(a, b), np.diff(self.xs[a:b + 1])), n)
        yi = self.py[p]
        # the rarest shared n-gram counts as it is, the rest by the Cauchy-Schwarz inequality
        could = self.xw[entries] * self.pw[p] + self.xrest[entries] * self.prest[p] + SLACK
        least = need[xi]
        if self.z:
            least = least + ((self.z[0][xi] - self.z[1][yi]) ** 2).sum(1) / 2
        keep = could >= least
        if self.same is not None:
            keep &= self.same[xi] != yi
        xi, yi, least = xi[keep], yi[keep], least[keep]
        xi, yi = self._sifted(xi, yi, least)
        width = len(self.ys)
        pairs = np.unique(xi * width + yi)
        return pairs // width, pairs % width

    def _sifted(self, xi: np.ndarray, yi: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose cosine may be ``least`` by the number of bits they have in common."""
        x, y = self.masks
        common = np.bitwise_count(x.held[xi] & y.held[yi])
        # in single precision
        keep = x.most(common, xi) * y.most(common, yi) >= np.maximum(least, 0.0) ** 2 - 1e-5
        return xi[keep], yi[keep]

    def _batches(self, need: np.ndarray, rows: int, at_most: int = 0, all_of: bool = False) -> Iterator[tuple[int, int, np.ndarray]]:
        """Main rows in runs whose postings, and whose n-grams as a dense matrix, stay within a batch;
        with the postings to visit of each entry, ``at_most`` so many of a row's rarest n-grams."""
        step = 4096
        for lo in range(0, rows, step):
            hi = min(rows, lo + step)
            n = self._reach(lo, hi, need, all_of)
            starts = self.xs[lo:hi + 1] - self.xs[lo]
            if at_most:
                total = np.concatenate([[0], np.cumsum(n)])
                n = np.clip(at_most - (total[:-1] - np.repeat(total[starts[:-1]], np.diff(starts))), 0, n)
            sums = np.concatenate([[0], np.cumsum(n)])[starts]
            a = lo
            while a < hi:
                b = a + 1
                while (b < hi and sums[b + 1 - lo] - sums[a - lo] <= BATCH
                       and (self.xs[b + 1] - self.xs[a]) * (b + 1 - a) <= BATCH):
                    b += 1
                yield a, b, n[self.xs[a] - self.xs[lo]:self.xs[b] - self.xs[lo]]
                a = b

    def cosines(self, xi: np.ndarray, yi: np.ndarray) -> np.ndarray:
        """Rounded cosines of pairs of the main rows ``xi``, which ascend and lie close together."""
        out = np.zeros(len(xi))
        if not len(xi):
            return out
        a, b = int(xi[0]), int(xi[-1]) + 1
        e = slice(self.xs[a], self.xs[b])
        held, at = np.unique(self.xg[e], return_inverse=True)
        dense = np.zeros((b - a, len(held) + 1))
        dense[np.repeat(np.arange(b - a), np.diff(self.xs[a:b + 1])), at] = self.xw[e]
        self.code[held] = np.arange(len(held))
        lengths = self.ys[yi + 1] - self.ys[yi]
        cuts = np.searchsorted(np.cumsum(lengths) // BATCH, np.arange(1, int(lengths.sum()) // BATCH + 1))
        for part in np.split(np.arange(len(xi)), cuts):
            if not len(part):
                continue
            n = lengths[part]
            p = _spread(self.ys[yi[part]], n)
            product = dense[np.repeat(xi[part] - a, n), self.code[self.yg[p]]] * self.yw[p]
            # whoever is a pair shares an n-gram, so no sum is empty
            out[part] = np.add.reduceat(product, np.cumsum(n) - n)
        self.code[held] = -1
        return np.round(np.minimum(out, 1.0), DIGITS)

    def _squared(self, xi: np.ndarray, yi: np.ndarray) -> np.ndarray:
        gap = ((self.z[0][xi] - self.z[1][yi]) ** 2).sum(1) if self.z else 0.0
        return np.round(np.maximum(2.0 - 2.0 * self.cosines(xi, yi), 0.0) + gap, DIGITS)

    def near(self, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs and their squared distances, the nearest of every main text that is within its
        ``bound`` among them.

        Every text is first measured against some texts that hold its rarest n-grams, which may
        bring its bound down.
        """
        need = np.maximum(1.0 - bound / 2 - SLACK, -1e9)
        # no posting is visited for a need that no cosine meets
        for a, b, _ in self._batches(np.full(len(need), 2.0), len(need)) if self.last.any() else ():
            xi, yi = self._heaviest(a, b, need)
            if len(xi):
                d2 = self._squared(xi, yi)
                np.maximum.at(need, xi, 1.0 - d2 / 2 - SLACK)
                yield xi, yi, d2
        for a, b, n in self._batches(need, len(need), SEEDS):
            xi, yi = self._visit(a, b, n, need)
            np.maximum.at(need, xi, 1.0 - self._squared(xi, yi) / 2 - SLACK)
        for a, b, n in self._batches(need, len(need)):
            xi, yi = self._visit(a, b, n, need)
            yield xi, yi, self._squared(xi, yi)

    def within(self, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs and their distances, all of those within the main text's ``reach`` among them."""
        need = 1.0 - reach ** 2 / 2 - SLACK
        for a, b, n in self._batches(need, len(reach), all_of=True):
            xi, yi = self._visit(a, b, n, need)
            yield xi, yi, np.round(np.sqrt(self._squared(xi, yi)), DIGITS)
