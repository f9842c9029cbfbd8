"""Near pairs of sequences without all pairs: states in bit planes, an index of segments that grows with the radius.

Spanning networks need pairs at any distance, where segments tell nothing apart: they are found by blocks.

Sequences that differ at r sites agree on all but r of any segments into which their sites are cut. So those within r meet
where they agree on a choice of segments, and only those are compared: by XOR and a count of bits.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.states import AMBIGUOUS, ambiguous, characters
from ..shared import save
from . import blocks
from .graph import components, numbered

#: States with a code of their own, from 1 on: three planes of bits. Unknown states have none.
STATES = "ACGTU01"
#: Sites of a word, so that it is a positive number; radii up to which two segments are asked for, not one.
WORD, PAIRED = 60, 4


def packed(seq: Column, kind: str = "dna") -> Column:
    """A sequence as an array of words of 60 sites, each a struct of three planes of bits; another state fails the job."""
    unknown = "".join(s for s in AMBIGUOUS[kind] if s not in STATES)
    known = "".join(s for s in STATES if s not in AMBIGUOUS[kind])
    up = F.upper(seq)
    valid = F.when(F.length(F.translate(up, known + unknown, "")) > 0, F.raise_error(F.concat(F.lit("A state has no code: "), F.translate(up, known + unknown, "")))).otherwise(up)
    bits = [F.translate(valid, known + unknown, "".join(str((STATES.index(s) + 1) >> k & 1) for s in known) + "0" * len(unknown)) for k in range(3)]
    starts = F.when(F.length(seq) > 0, F.sequence(F.lit(1), F.length(seq), F.lit(WORD))).otherwise(F.array().cast("array<int>"))
    plane = lambda text, i: F.conv(F.substring(text, i, F.lit(WORD)), 2, 10).cast("long")
    return F.transform(starts, lambda i: F.struct(*(plane(b, i).alias(n) for b, n in zip(bits, "abc", strict=True))))


def _apart(p: Column, q: Column) -> Column:
    planes = [p[n].bitwiseXOR(q[n]) for n in "abc"]
    both = (p["a"].bitwiseOR(p["b"]).bitwiseOR(p["c"])).bitwiseAND(q["a"].bitwiseOR(q["b"]).bitwiseOR(q["c"]))
    return F.bit_count(planes[0].bitwiseOR(planes[1]).bitwiseOR(planes[2]).bitwiseAND(both))


def difference(x: Column, y: Column) -> Column:
    """Sites at which both packed sequences are known and differ."""
    return F.aggregate(F.zip_with(x, y, _apart), F.lit(0), lambda a, b: a + b)


def prepared(haplotypes: DataFrame, kind: str = "dna") -> DataFrame:
    """haplotypes(network_id, index, seq) -> (network_id, index, words, clean).

    clean: the states at the sites where no haplotype of the network is unknown and not all are alike. Unknown states
    differ from nothing, so that only these sites can tell sequences apart for certain; leaving others out brings pairs
    nearer, hence none is missed. What a network's sites hold meets as partial aggregates, by site.
    """
    states = haplotypes.select("network_id", F.posexplode(characters(F.upper("seq"))).alias("site", "state"))
    told = states.groupBy("network_id", "site").agg((~F.max(ambiguous(F.col("state"), kind)) & (F.min("state") != F.max("state"))).alias("tells"))
    flags = told.groupBy("network_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("site", "tells"))), lambda x: x["tells"]).alias("flags"))
    joined = haplotypes.join(flags, "network_id", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<boolean>")))
    chosen = F.filter(F.zip_with(characters(F.upper("seq")), "flags", lambda c, t: F.when(t, c)), lambda c: c.isNotNull())
    return joined.select("network_id", "index", packed(F.col("seq"), kind).alias("words"), F.array_join(chosen, "").alias("clean"))


def keys(clean: Column, radius: int) -> Column:
    """Hashes of choices of segments: of sequences within the radius, at least one agrees.

    Up to PAIRED, radius + 2 segments, two at a time, which few others share; beyond, radius + 1, one at a time.
    """
    n, at_once = (radius + 2, 2) if radius <= PAIRED else (radius + 1, 1)
    edge = [F.floor(F.lit(k) * F.length(clean) / n).cast("int") for k in range(n + 1)]
    parts = [F.substring(clean, edge[k] + 1, edge[k + 1] - edge[k]) for k in range(n)]
    return F.array(*(F.xxhash64(*(parts[k] for k in c)) for c in combinations(range(n), at_once)))


def near_pairs(sides: DataFrame, low: int, high: int) -> DataFrame:
    """sides(network_id, index, component, outer, words, clean) -> (network_id, i, j, d), i > j: pairs with low < d <= high
    of different components, of which one is outer at least.

    outer marks all but one component of a network, its largest: pairs within that one, most of all where a network is
    nearly connected, never meet.
    """
    met = sides.select("network_id", "index", "component", "outer", "words", F.posexplode(keys(F.col("clean"), high)).alias("choice", "key"))
    a = met.where("outer").select("network_id", "choice", "key", F.col("index").alias("p"), F.col("component").alias("cp"), F.col("words").alias("x"))
    b = met.select("network_id", "choice", "key", F.col("index").alias("q"), F.col("component").alias("cq"), F.col("outer").alias("oq"), F.col("words").alias("y"))
    pairs = a.join(b, ["network_id", "choice", "key"]).where("cp != cq and (not oq or p > q)")
    pairs = pairs.select("network_id", F.greatest("p", "q").alias("i"), F.least("p", "q").alias("j"), difference(F.col("x"), F.col("y")).alias("d"))
    return pairs.where((F.col("d") > low) & (F.col("d") <= high)).distinct()


def spanning_network(haplotypes: DataFrame, epsilon: float = 0, kind: str = "dna") -> DataFrame:
    """haplotypes(network_id, index, seq) -> (network_id, edge_idx, later, earlier, weight): the relaxed minimum spanning
    network of every network, of any size: no pair but the links is a row, and no task holds a network's pairs.

    A pair at distance t is linked if links shorter than t - epsilon don't connect it, and t is at most epsilon above the
    distance at which all are connected. Trees in rounds over pairs of blocks give what links of each length connect.
    """
    found = blocks.links(haplotypes.select("network_id", "index", blocks.known(F.col("seq"), kind, STATES).alias("seq")), epsilon, kind)
    return numbered(found, ["d", "i", "j"], "edge_idx").select("network_id", "edge_idx", F.col("i").alias("later"), F.col("j").alias("earlier"), F.col("d").alias("weight"))


def components_within(haplotypes: DataFrame, threshold: float, kind: str = "dna") -> DataFrame:
    """haplotypes(network_id, index, seq) -> (network_id, index, component): the least index reached by pairs nearer than the
    threshold. Only pairs that the index brings together are looked at; beyond its radii, trees by blocks."""
    within = ceil(threshold) - 1
    if within > PAIRED:
        named = blocks.tree(haplotypes.withColumn("seq", blocks.known(F.col("seq"), kind, STATES)), kind, threshold)[0]
        return named.withColumns({c: F.col(c).cast(haplotypes.schema["index"].dataType) for c in ("index", "component")})
    sides = save(prepared(haplotypes, kind).withColumns({"component": F.col("index"), "outer": F.lit(True)}), "sides")
    pairs = near_pairs(sides, -1, within)
    return components(haplotypes, pairs.select("network_id", F.lit(0).alias("index"), F.col("i").alias("from"), F.col("j").alias("to"), F.col("d").alias("weight")))
