"""From a parsed document to the haplotypes of one network, without Spark: what a single file needs."""

from __future__ import annotations

from ..functions.states import AMBIGUOUS
from ..sources.nexus import Document
from .network import Haplotypes, NetworkError


def kind_of(datatype: str | None) -> str:
    low = (datatype or "dna").lower()
    return "binary" if low in ("standard", "binary") else "aa" if low in ("protein", "aa", "aminoacid") else "dna"


def keep_sites(seqs: list[str], percent: float = 5.0) -> list[bool]:
    """All sites, unless over `percent` of them have undefined states: then those go."""
    if len(set(map(len, seqs))) > 1:
        raise NetworkError("Sequences are not the same length.")
    bad = [any(c.upper() in AMBIGUOUS["dna"] for c in column) for column in zip(*seqs, strict=True)]
    return [True] * len(bad) if not bad or 100 * sum(bad) / len(bad) <= percent else [not x for x in bad]


def haplotypes_of(doc: Document, mask: bool = True) -> Haplotypes:
    names, kind = doc.ordered_taxa(), kind_of(doc.characters.datatype)
    lost = [x for x in names if x not in doc.characters.matrix]
    if lost:
        raise NetworkError(f'Taxon "{lost[0]}" has no character sequence.')
    seqs = [doc.characters.matrix[x].upper() for x in names]
    keep = keep_sites(seqs)
    if mask:
        seqs = ["".join(c for c, k in zip(s, keep, strict=True) if k) for s in seqs]
    groups: dict[str, list[int]] = {}
    for i, s in enumerate(seqs):
        groups.setdefault(s, []).append(i)
    unique = list(groups)
    patterns: dict[tuple, list[int]] = {}
    for site, column in enumerate(zip(*unique, strict=True)):
        if not all(c in AMBIGUOUS.get(kind, ()) for c in column):
            patterns.setdefault(tuple(c if c in AMBIGUOUS.get(kind, ()) else column.index(c) for c in column), []).append(site)
    first = [sites[0] for sites in patterns.values()]
    traits, frequencies = [[] for _ in unique], [float(len(g)) for g in groups.values()]
    if doc.traits is not None:
        width = len(doc.traits.labels) or int(doc.traits.ntraits)
        traits = [[sum(v[k] for i in g if k < len(v := doc.traits.matrix.get(names[i], []))) for k in range(width)] for g in groups.values()]
        frequencies = [float(sum(t)) for t in traits]
    return Haplotypes([names[g[0]] for g in groups.values()], ["".join(s[k] for k in first) for s in unique], [len(x) for x in patterns.values()], kind, frequencies, traits)
