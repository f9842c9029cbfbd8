"""Median joining: spanning networks over haplotypes and the medians that shorten them."""

from __future__ import annotations

from itertools import product

from .msn import spanning_links
from .network import Graph, Haplotypes, NetworkError

MAX_ROUNDS = 1000


def quasi_medians(a: str, b: str, c: str) -> list[str]:
    """Sequences with the majority state at each site, and any of the three where all differ; in order."""
    choices = []
    for x, y, z in zip(a, b, c, strict=True):
        if x in (y, z):
            choices.append((x,))
        elif y == z:
            choices.append((y,))
        else:
            choices.append((x, y, z))
    return sorted({"".join(p) for p in product(*choices)})


def triplets(links: list[tuple[int, int, float]]) -> list[tuple[int, int, int]]:
    """Ends of each link with the far end of every earlier link that touches it, in order."""
    at: dict[int, list[int]] = {}
    found = []
    for k, (u, v, _) in enumerate(links):
        for p in sorted({*at.get(u, ()), *at.get(v, ())}):
            a, b, _ = links[p]
            found.append((u, v, b if a in (u, v) else a))
        at.setdefault(u, []).append(k)
        at.setdefault(v, []).append(k)
    return found


def pruned(seqs: list[str], links: list[tuple[int, int, float]], n: int) -> tuple[list[str], list[tuple[int, int, float]], bool]:
    """Without inferred sequences of fewer than two links, again and again; the rest renumbered."""
    alive, any_ = [True] * len(seqs), False
    while True:
        degree = [0] * len(seqs)
        for u, v, _ in links:
            degree[u] += 1
            degree[v] += 1
        gone = {i for i in range(n, len(seqs)) if alive[i] and degree[i] < 2}
        if not gone:
            break
        any_ = True
        for i in gone:
            alive[i] = False
        links = [x for x in links if x[0] not in gone and x[1] not in gone]
    place = {i: k for k, i in enumerate(i for i in range(len(seqs)) if alive[i])}
    return [s for s, ok in zip(seqs, alive, strict=True) if ok], [(place[u], place[v], w) for u, v, w in links], any_


def _new_medians(haps: Haplotypes, seqs: list[str], links: list[tuple[int, int, float]], epsilon: float) -> list[str]:
    """Medians of the network's triplets that aren't there yet, at most epsilon dearer than the cheapest such."""
    known, candidates, cache = set(seqs), [], {}
    for u, v, w in triplets(links):
        key = tuple(sorted((u, v, w)))
        if key not in cache:
            fresh = [m for m in quasi_medians(seqs[u], seqs[v], seqs[w]) if m not in known]
            cache[key] = [(m, int(haps.between(m, [seqs[u], seqs[v], seqs[w]]).sum())) for m in fresh]
        candidates += cache[key]
    if not candidates:
        return []
    least = min(c for _, c in candidates)
    return list(dict.fromkeys(m for m, c in candidates if c <= least + epsilon))


def mjn(haps: Haplotypes, epsilon: float = 0) -> Graph:
    n, seqs = len(haps), list(haps.seqs)
    for _ in range(MAX_ROUNDS):
        seqs, links, removed = pruned(seqs, spanning_links(haps.matrix(seqs), epsilon), n)
        more = _new_medians(haps, seqs, links, epsilon)
        seqs += more
        if not removed and not more:
            break
    else:
        raise NetworkError("Median joining doesn't come to an end.")
    removed = True
    while removed:
        seqs, links, removed = pruned(seqs, spanning_links(haps.matrix(seqs)), n)
    g = Graph.sampled(haps)
    for s in seqs[n:]:
        g.add(seq=s)
    for u, v, w in links:
        g.link(g.vertices[u], g.vertices[v], w)
    return g
