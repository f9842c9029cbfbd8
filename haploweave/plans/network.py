"""What the algorithms of one network work on: haplotypes as arrays, and a graph with ordered, renumbered edges."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions.states import AMBIGUOUS


class NetworkError(ValueError):
    """A network can't be built from this input."""


@dataclass
class Haplotypes:
    """The haplotypes of one network: names, condensed sequences, pattern weights, frequencies, traits, distances."""

    names: list[str]
    seqs: list[str]
    weights: list[int]
    kind: str = "dna"
    frequencies: list[float] = field(default_factory=list)
    traits: list[list[float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.kind == "aa":
            raise NetworkError("Haplotype networks should not be inferred from protein data.")
        if any(len(s) != len(self.weights) for s in self.seqs):
            raise NetworkError("Sequences are not the same length.")
        self._unknown = {ord(c) for c in AMBIGUOUS[self.kind]} | {ord(c.lower()) for c in AMBIGUOUS[self.kind]}
        self._weights = np.asarray(self.weights, dtype=np.int64)
        self.d = self.matrix(self.seqs)

    def __len__(self) -> int:
        return len(self.names)

    def codes(self, seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points, one row for each sequence, and where they are defined."""
        x = np.array([[ord(c) for c in s] for s in seqs], dtype=np.int32).reshape(len(seqs), len(self.weights))
        return x, ~np.isin(x, list(self._unknown))

    def matrix(self, seqs: list[str]) -> np.ndarray:
        """Symmetric weighted distances: patterns in which both are defined and differ."""
        x, known = self.codes(seqs)
        out = np.zeros((len(seqs), len(seqs)), dtype=np.int64)
        for i in range(len(seqs)):
            out[i] = ((x != x[i]) & known & known[i]) @ self._weights
        return out

    def between(self, one: str, others: list[str]) -> np.ndarray:
        a, ka = self.codes([one])
        b, kb = self.codes(others)
        return ((b != a) & kb & ka) @ self._weights


class Vertex:
    __slots__ = ("index", "label", "links", "origin", "seq")

    def __init__(self, index: int, label: str, origin: int | None, seq: str | None) -> None:
        #: origin: the haplotype it stands for; None if inferred. links: edges at it, in the order they came.
        self.index, self.label, self.origin, self.seq, self.links = index, label, origin, seq, []


class Edge:
    __slots__ = ("index", "a", "b", "weight")

    def __init__(self, index: int, a: Vertex, b: Vertex, weight: float) -> None:
        self.index, self.a, self.b, self.weight = index, a, b, weight

    def other(self, v: Vertex) -> Vertex:
        if v is not self.a and v is not self.b:
            raise NetworkError("The vertex isn't an end of the edge.")
        return self.b if v is self.a else self.a


class Graph:
    """Vertices and edges in order. Removing renumbers; new edges come last."""

    def __init__(self) -> None:
        self.vertices: list[Vertex] = []
        self.edges: list[Edge] = []

    @classmethod
    def sampled(cls, haps: Haplotypes) -> Graph:
        g = cls()
        for i, name in enumerate(haps.names):
            g.add(name, i, haps.seqs[i])
        return g

    def add(self, label: str | None = None, origin: int | None = None, seq: str | None = None) -> Vertex:
        v = Vertex(len(self.vertices), str(len(self.vertices)) if label is None else label, origin, seq)
        self.vertices.append(v)
        return v

    def vertex(self, index: int) -> Vertex:
        if not 0 <= index < len(self.vertices):
            raise NetworkError(f"There is no vertex {index}.")
        return self.vertices[index]

    def edge(self, index: int) -> Edge:
        if not 0 <= index < len(self.edges):
            raise NetworkError(f"There is no edge {index}.")
        return self.edges[index]

    def _own(self, *parts: Vertex | Edge) -> None:
        """Fail if a vertex or edge isn't (or is no longer) one of this graph's."""
        for p in parts:
            have = self.edges if isinstance(p, Edge) else self.vertices
            if not (0 <= p.index < len(have) and have[p.index] is p):
                raise NetworkError(f"The {type(p).__name__.lower()} isn't part of this graph.")

    def link(self, a: Vertex, b: Vertex, weight: float = 1) -> Edge:
        self._own(a, b)
        e = Edge(len(self.edges), a, b, weight)
        self.edges.append(e)
        a.links.append(e)
        if b is not a:
            b.links.append(e)
        return e

    def unlink(self, e: Edge) -> None:
        self._own(e)
        e.a.links.remove(e)
        if e.b is not e.a:
            e.b.links.remove(e)
        del self.edges[e.index]
        for i in range(e.index, len(self.edges)):
            self.edges[i].index = i

    def drop(self, v: Vertex) -> None:
        self._own(v)
        while v.links:
            self.unlink(v.links[0])
        del self.vertices[v.index]
        for i in range(v.index, len(self.vertices)):
            self.vertices[i].index = i

    def relink(self, e: Edge, a: Vertex, b: Vertex) -> None:
        """Move an edge to other ends; it becomes their last."""
        self._own(e, a, b)
        for v in {e.a, e.b}:
            v.links.remove(e)
        e.a, e.b = a, b
        for v in (a, b) if a is not b else (a,):
            v.links.append(e)

    def relabel(self, n: int) -> None:
        """Inferred vertices (from n on) are called by their place."""
        for v in self.vertices[n:]:
            v.label = str(v.index)

    def paths(self) -> np.ndarray:
        """Least sums of weights between all vertices (parallel edges: the lightest); infinite if unreachable."""
        n = len(self.vertices)
        d = np.full((n, n), np.inf)
        np.fill_diagonal(d, 0)
        for e in self.edges:
            i, j = e.a.index, e.b.index
            if e.weight < d[i, j]:
                d[i, j] = d[j, i] = e.weight
        for k in range(n):
            np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
        return d

    def path(self, a: Vertex, b: Vertex) -> list[Vertex]:
        """One shortest path, both ends included; none if there is none. Of equal ways the one that the vertices in order
        gave first."""
        n = len(self.vertices)
        d, via = np.full((n, n), np.inf), np.full((n, n), -1)
        np.fill_diagonal(d, 0)
        for e in self.edges:
            i, j = e.a.index, e.b.index
            d[i, j] = d[j, i] = min(d[i, j], e.weight)
        for k in range(n):
            way = d[:, k, None] + d[None, k, :]
            via[way < d] = k
            np.minimum(d, way, out=d)
        if not np.isfinite(d[a.index, b.index]):
            return []
        inner, todo = [], [(a.index, b.index)]
        while todo:
            i, j = todo.pop()
            k = int(via[i, j]) if j >= 0 else -1
            if j < 0:
                inner.append(self.vertices[i])
            elif k >= 0:
                todo += [(k, j), (k, -1), (i, k)]
        return [a, *inner, b]

    def path_edges(self, a: Vertex, b: Vertex) -> list[Edge]:
        """The edges along path(a, b), in that order; of parallel ones the lightest, then the first."""
        way = self.path(a, b) if a is not b else []
        return [min((e for e in v.links if e.other(v) is w), key=lambda e: (e.weight, e.index)) for v, w in zip(way[:-1], way[1:], strict=True)]

    def edge_list(self) -> list[tuple[str, float, str]]:
        return [(e.a.label, e.weight, e.b.label) for e in self.edges]


class Groups:
    """Disjoint sets with a count."""

    def __init__(self, n: int) -> None:
        self.parent, self.count = list(range(n)), n

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.count -= 1


def ordered_pairs(d: np.ndarray, later_first: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs by (weight, first, second), the later of the two first or second."""
    i, j = np.tril_indices(len(d), -1)
    w = d[i, j]
    a, b = (i, j) if later_first else (j, i)
    order = np.lexsort((j, i, w))
    return a[order], b[order], w[order]
