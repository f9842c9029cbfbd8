"""Median joining as a fixpoint over all networks at once: spanning links, triplets that are new, their quasi-medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.states import characters
from ..shared import save
from .graph import endpoints, numbered, peel
from .near import difference, packed, spanning_network


def stretched(pattern: Column, weights: Column) -> Column:
    """Each state of a condensed sequence as often as its pattern weighs: plain differences are then weighted distances."""
    return F.array_join(F.zip_with(characters(pattern), weights, lambda c, w: F.repeat(c, w.cast("int"))), "")


def quasi_medians(a: Column, b: Column, c: Column) -> Column:
    """All sequences that have, at each site, the state of two or more of three sequences, or any of three different ones."""
    pairs = F.zip_with(characters(a), characters(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    choices = F.zip_with(pairs, characters(c), lambda p, z: F.when((p["x"] == p["y"]) | (p["x"] == z), F.array(p["x"])).when(p["y"] == z, F.array(z)).otherwise(F.array(p["x"], p["y"], z)))
    return F.aggregate(choices, F.array(F.lit("")), lambda made, some: F.flatten(F.transform(made, lambda m: F.transform(some, lambda s: F.concat(m, s)))))


def triplets(links: DataFrame) -> DataFrame:
    """(network_id, u, v, w), ascending: three vertices of which two pairs are linked; once each."""
    ends = endpoints(links).select("network_id", "vertex", "other")
    met = ends.join(ends.withColumnRenamed("other", "third"), ["network_id", "vertex"]).where("other < third")
    three = F.sort_array(F.array("vertex", "other", "third"))
    return met.select("network_id", three[0].alias("u"), three[1].alias("v"), three[2].alias("w")).distinct()


def median_joining(condensed: DataFrame, epsilon: float = 0, kind: str = "dna", max_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """condensed(network_id, hap_idx, pattern_seq, weights) -> vertices(network_id, index, pattern_seq, inferred), edges(network_id,
    index, from, to, weight) of the median-joining networks.

    A round: the relaxed spanning network; inferred vertices of fewer than two links go, again and again; of the medians of
    linked triplets that aren't there yet, those at most epsilon dearer than the network's cheapest come in. Medians and
    costs are worked out for triplets with a new link only: those of earlier rounds are kept, and count as long as their
    triplet is linked. A network that neither loses nor gains a vertex leaves the loop. Last, spanning networks without
    relaxation, from which idle medians go. No network is ever in one task; vertices are numbered as they come in, the
    sampled ones first.
    """
    weights = condensed.groupBy("network_id").agg(F.first("weights").alias("weights"))
    types = save(condensed.select("network_id", F.col("hap_idx").cast("int").alias("index"), F.col("pattern_seq").alias("pattern"), F.lit(False).alias("inferred")), "types")
    known: DataFrame | None = None
    done, active = [], types.select("network_id").distinct()
    for _ in range(max_rounds):
        links = _links(types, weights, epsilon, kind)
        kept, links = peel(types.withColumn("keep", ~F.col("inferred")), links)
        linked = save(triplets(links), "triplets")
        fresh = linked if known is None else linked.join(known.select("network_id", "u", "v", "w").distinct(), ["network_id", "u", "v", "w"], "left_anti")
        costs = save(_costs(fresh, types, weights, kind), "medians")
        known = costs if known is None else known.unionByName(costs)
        offers = known.join(linked, ["network_id", "u", "v", "w"], "left_semi").join(kept.select("network_id", F.col("pattern").alias("median")), ["network_id", "median"], "left_anti")
        least = offers.groupBy("network_id").agg(F.min("cost").alias("least"))
        new = offers.join(least, "network_id").where(F.col("cost") <= F.col("least") + epsilon).select("network_id", "median").distinct()
        top = types.groupBy("network_id").agg(F.max("index").alias("top"))
        new = numbered(new.join(top, "network_id"), ["median"], "nth").select("network_id", (F.col("top") + 1 + F.col("nth")).cast("int").alias("index"), F.col("median").alias("pattern"), F.lit(True).alias("inferred"))
        grown = save(kept.select(*types.columns).unionByName(new), "types")
        before = types.select("network_id", "index", F.lit(True).alias("was"))
        after = grown.select("network_id", "index", F.lit(True).alias("is"))
        active = save(before.join(after, ["network_id", "index"], "full").where("was is null or is is null").select("network_id").distinct(), "active")
        done.append(grown.join(active, "network_id", "left_anti"))
        types = save(grown.join(active, "network_id", "left_semi"), "types")
        if active.isEmpty():
            break
    else:
        raise RuntimeError("Median joining doesn't come to an end.")
    types = done[0]
    for part in done[1:]:
        types = types.unionByName(part)
    while True:
        links = _links(types, weights, 0, kind)
        kept, links = peel(types.withColumn("keep", ~F.col("inferred")), links)
        fewer = save(kept.select(*types.columns), "types")
        if fewer.count() == types.count():
            break
        types = fewer
    places = numbered(fewer, ["inferred", "index"], "place").withColumn("place", F.col("place").cast("int"))
    names = save(places, "places")
    edges = links
    for end in ("from", "to"):
        edges = edges.join(names.select("network_id", F.col("index").alias(end), F.col("place").alias(f"new_{end}")), ["network_id", end])
    edges = edges.select("network_id", "index", F.col("new_from").alias("from"), F.col("new_to").alias("to"), "weight")
    return names.select("network_id", F.col("place").alias("index"), F.col("pattern").alias("pattern_seq"), "inferred"), edges


def _links(types: DataFrame, weights: DataFrame, epsilon: float, kind: str) -> DataFrame:
    seqs = types.join(weights, "network_id").select("network_id", "index", stretched(F.col("pattern"), F.col("weights")).alias("seq"))
    found = spanning_network(seqs, epsilon, kind)
    return save(found.select("network_id", F.col("edge_idx").cast("int").alias("index"), F.col("later").cast("int").alias("from"), F.col("earlier").cast("int").alias("to"), "weight"), "links")


def _costs(triplets_: DataFrame, types: DataFrame, weights: DataFrame, kind: str) -> DataFrame:
    """(network_id, u, v, w, median, cost): the medians of triplets, and how far their three are from each altogether."""
    out = triplets_
    for end in ("u", "v", "w"):
        out = out.join(types.select("network_id", F.col("index").alias(end), F.col("pattern").alias(f"p{end}")), ["network_id", end])
    out = out.withColumn("median", F.explode(F.array_distinct(quasi_medians(F.col("pu"), F.col("pv"), F.col("pw"))))).join(weights, "network_id")
    words = lambda c: packed(stretched(F.col(c), F.col("weights")), kind)
    out = out.withColumn("words", words("median"))
    cost = sum((difference(F.col("words"), words(c)) for c in ("pv", "pw")), difference(F.col("words"), words("pu")))
    return out.select("network_id", "u", "v", "w", "median", cost.alias("cost"))
