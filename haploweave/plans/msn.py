"""Minimum spanning networks: links no shorter way round exists for, up to a relaxation."""

from __future__ import annotations

import numpy as np

from .network import Graph, Haplotypes, NetworkError


def bottlenecks(d: np.ndarray) -> np.ndarray:
    """For each pair the least t at which links of at most t connect it: the longest link of its way in a spanning tree.

    The tree grows by its nearest vertex; the new one's ways are those of where it hangs on, or its own link.
    """
    n = len(d)
    out, inside = np.zeros_like(d), np.zeros(n, dtype=bool)
    inside[:1] = True
    near, at = d[0].copy(), np.zeros(n, dtype=int)
    for _ in range(n - 1):
        v = int(np.where(inside, np.inf, near).argmin())
        tree = np.flatnonzero(inside)
        out[v, tree] = out[tree, v] = np.maximum(out[at[v], tree], near[v])
        inside[v] = True
        at, near = np.where(d[v] < near, v, at), np.minimum(near, d[v])
    return out


def spanning_links(d: np.ndarray, epsilon: float = 0) -> list[tuple[int, int, float]]:
    """Links (later, earlier, weight), by weight, of the relaxed minimum spanning network over a distance matrix.

    A pair of distance t is linked if links shorter than t - epsilon don't connect it, and t is at most epsilon above the
    least distance at which all are connected.
    """
    if len(d) < 2:
        return []
    if not np.isfinite(d).all():
        raise NetworkError("The pairs don't connect all haplotypes.")
    b = bottlenecks(d)
    later, earlier = np.nonzero(np.tril((b >= d - epsilon) & (d <= b.max() + epsilon), -1))
    w = d[later, earlier]
    by = np.lexsort((earlier, later, w))
    return list(zip(later[by].tolist(), earlier[by].tolist(), w[by].tolist(), strict=True))


def msn(haps: Haplotypes, epsilon: float = 0) -> Graph:
    g = Graph.sampled(haps)
    for a, b, w in spanning_links(haps.d, epsilon):
        g.link(g.vertices[a], g.vertices[b], w)
    return g
