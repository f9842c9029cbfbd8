"""Least integer edge lengths under lower bounds on path lengths: branch and bound over a revised simplex on the dual."""

from __future__ import annotations

import numpy as np

from .network import NetworkError

_EPS = 1e-7
#: Paths that are priced at each pivot: those too short by most when all were priced. Once these are long enough, all are again.
HELD = 256


class _Dual:
    """max b'y, A'y <= c, y >= 0, for min c'x, Ax >= b: the basis of a parent problem stays good when rows are added.

    Rows of A: x >= 0 (unit rows, b = 0), the paths, and the bounds of the branches. prices() is the primal x.
    """

    def __init__(self, paths: np.ndarray, need: np.ndarray, cost: np.ndarray) -> None:
        n = len(cost)
        self.paths, self.need, self.cost = paths, need, cost
        self.inverse, self.level = np.eye(n), cost.astype(float).copy()
        self.value = np.zeros(n)  # b of the basic rows
        self.bounds: list[tuple[int, float, float]] = []  # (edge, sign, b): sign * x >= b

    def copy(self) -> _Dual:
        new = object.__new__(_Dual)
        new.paths, new.need, new.cost = self.paths, self.need, self.cost
        new.inverse, new.level, new.value, new.bounds = self.inverse.copy(), self.level.copy(), self.value.copy(), list(self.bounds)
        return new

    def prices(self) -> np.ndarray:
        return self.value @ self.inverse

    def short(self, x: np.ndarray) -> np.ndarray:
        """By how much all paths are too short."""
        return self.need - self.paths @ x

    def solve(self, limit: float) -> np.ndarray | None:
        """x of the optimum; None if there is none, or only one of at least limit."""
        n, stalled = len(self.cost), 0
        held, paths, need = np.arange(0), self.paths[:0], self.need[:0]
        for _ in range(200_000):
            x = self.prices()
            if self.value @ self.level >= limit:
                return None
            short = need - paths @ x
            if stalled >= 50 or not (short > _EPS).any():
                whole = self.short(x)
                held = np.flatnonzero(whole > _EPS)
                if len(held) > HELD and stalled < 50:
                    held = held[np.sort(np.argsort(-whole[held].round(9), kind="stable")[:HELD])]
                held = held[:HELD]
                paths, need, short = self.paths[held], self.need[held], whole[held]
            best, column, b = _EPS, None, 0.0
            if (short > _EPS).any():
                # Rounded, so that the first of equals is taken whatever order a product's sums run in.
                p = int(short.round(9).argmax()) if stalled < 50 else int(np.flatnonzero(short > _EPS)[0])
                best, column, b = short[p], paths[p], float(need[p])
            if stalled < 50 or column is None:
                e = int(x.argmin())
                if -x[e] > best:
                    best, column, b = -x[e], np.eye(1, n, e)[0], 0.0
                for e, sign, bound in self.bounds:
                    if bound - sign * x[e] > best:
                        best, column, b = bound - sign * x[e], sign * np.eye(1, n, e)[0], bound
            if column is None:
                return x
            way = self.inverse @ column
            pos = np.flatnonzero(way > 1e-9)
            if not len(pos):
                return None
            ratio = self.level[pos] / way[pos]
            least = ratio.min()
            ties = pos[ratio <= least + 1e-12 * max(1.0, abs(least))]
            r = int(ties[way[ties].argmax()])
            stalled = stalled + 1 if least <= 1e-12 else 0
            self.inverse[r] /= way[r]
            self.level[r] /= way[r]
            factor = way.copy()
            factor[r] = 0
            self.inverse -= np.outer(factor, self.inverse[r])
            self.level -= factor * self.level[r]
            np.maximum(self.level, 0, out=self.level)
            self.value[r] = b
        raise NetworkError("The edge lengths' linear program doesn't end.")


def least_lengths(paths: np.ndarray, need: np.ndarray, max_nodes: int = 20_000) -> np.ndarray:
    """Integers x >= 0 with paths @ x >= need, of least sum of (10**6 + index) * x: the fewest steps, early edges first.

    paths: a 0/1 row for each pair of haplotypes, the edges between them. Nodes are visited depth first, the side towards
    the fractional value's ceiling first; a node is left when its bound, rounded up, can't beat the best found.
    """
    m = paths.shape[1]
    cost = 1.0 + np.arange(m) * 1e-6
    best, found, nodes = np.inf, None, 0
    todo = [_Dual(paths.astype(float), need.astype(float), cost)]
    while todo:
        node = todo.pop()
        nodes += 1
        if nodes > max_nodes:
            raise NetworkError("The edge lengths' integer program is too large.")
        x = node.solve(best - 0.5e-6)
        if x is None:
            continue
        off = np.abs(x - np.round(x))
        if off.max(initial=0) < 1e-6:
            whole = np.round(x).astype(np.int64)
            value = float(cost @ whole)
            if value < best - 0.5e-6 and (paths @ whole >= need).all():
                best, found = value, whole
            continue
        e = int(off.argmax())
        down, up = node, node.copy()
        down.bounds.append((e, -1.0, -float(np.floor(x[e]))))
        up.bounds.append((e, 1.0, float(np.ceil(x[e]))))
        todo += [down, up]
    if found is None:
        raise NetworkError("No edge lengths meet the distances.")
    return found
