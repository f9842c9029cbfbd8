"""Neighbour-joining trees of all networks at once: each round joins one pair in every network that has three nodes or more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import discard, save

#: Criteria this close, relative to the greatest sum of a row, are worked out anew in the order of the places.
NEAR = 1e-9
_ROW = ("network_id", "n", "m", "pos", "node", "d", "parent", "length", "edge")


def joining_trees(vertices: DataFrame, distances: DataFrame) -> DataFrame:
    """vertices(network_id, index 0, 1, ...), distances(network_id, i, j, d) for i > j -> branches(network_id, index, from, to, weight).

    A node is a row with its distances to the nodes still apart, in their order; a join's new node takes the place of its
    second one. A round: sums of rows; each row's least criterion; the pairs close to the network's least, whose criteria
    are summed again term by term, so that ties fall to the first row, then the first column, however the rows are
    spread; rows take over the new distance on their own. What comes together is a row of a node, and one array of sums for
    a network: never the pairs of a network. Joined nodes keep their branch and lose their distances. New nodes have the
    numbers n, n + 1, ...; a network's branches number as its tree grows, the new node first. Negative lengths are zero.

    A network of one vertex has no branch. Pairs that are missing or there twice fail the job. As many rounds as the
    largest network has nodes, less two, each written to the shared folder in place of the last.
    """
    state = save(_start(vertices, distances), "joining")
    largest = state.agg(F.max("m")).first()[0] or 0
    for _ in range(largest - 2):
        grown = save(_joined(state), "joining")
        discard(state)
        state = grown
    top = state.where("m = 2 and pos = 0 and parent is null").select("network_id", F.col("node").alias("top"))
    last = F.col("parent").isNull() & (F.col("pos") == 1)
    ended = state.join(top, "network_id", "left").where(F.col("parent").isNotNull() | last)
    return ended.select(
        "network_id",
        F.when(last, 2 * F.col("n") - 4).otherwise(F.col("edge")).alias("index"),
        F.when(last, F.col("top")).otherwise(F.col("parent")).alias("from"),
        F.col("node").alias("to"),
        F.when(last, F.col("d")[0]).otherwise(F.col("length")).alias("weight"),
    )


def _start(vertices: DataFrame, distances: DataFrame) -> DataFrame:
    one = distances.select("network_id", "i", "j", F.col("d").cast("double").alias("d"))
    other = one.select("network_id", F.col("j").alias("i"), F.col("i").alias("j"), "d")
    own = vertices.select("network_id", F.col("index").cast("int").alias("i"), F.col("index").cast("int").alias("j"), F.lit(0.0).alias("d"))
    lists = one.unionByName(other).unionByName(own).groupBy("network_id", "i").agg(F.sort_array(F.collect_list(F.struct("j", "d"))).alias("x"))
    sizes = vertices.groupBy("network_id").agg(F.count("*").cast("int").alias("n"))
    rows = lists.join(sizes, "network_id")
    whole = F.transform("x", lambda x: x["j"]) == F.sequence(F.lit(0), F.col("n") - 1)
    d = F.when(whole, F.transform("x", lambda x: x["d"])).otherwise(F.raise_error(F.lit("A network's distances aren't those of all its pairs.")))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("parent", "int"), ("length", "double"), ("edge", "int"))]
    return rows.select("network_id", "n", F.col("n").alias("m"), F.col("i").cast("int").alias("pos"), F.col("i").cast("int").alias("node"), d.alias("d"), *none)


def _side_by_side(one: str, two: str) -> Column:
    return F.zip_with(one, two, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _pairs(alive: DataFrame) -> DataFrame:
    """(network_id, one, two, from_one, from_two): places, lengths and distances of the pair that each network joins."""
    own = F.aggregate("d", F.lit(0.0), lambda s, x: s + x)
    sums = alive.groupBy("network_id").agg(F.sort_array(F.collect_list(F.struct("pos", own.alias("r")))).alias("x"))
    sums = sums.select("network_id", F.transform("x", lambda x: x["r"]).alias("rs")).withColumn("near", NEAR * (1 + F.array_max("rs")))
    scores = F.transform(F.slice("d", 1, F.col("pos")), lambda x, k: (F.col("m") - 2) * x - F.get("rs", F.col("pos")) - F.get("rs", k))
    scored = alive.join(sums, "network_id").where("pos > 0").withColumn("qs", scores).withColumn("least", F.array_min("qs"))
    bound = scored.groupBy("network_id").agg(F.min(F.col("least") + F.col("near")).alias("bound"))
    close = scored.join(bound, "network_id").where("least <= bound")
    close = close.select("network_id", "m", F.col("pos").alias("one"), F.col("d").alias("from_one"), F.posexplode("qs").alias("two", "q"), "bound").where("q <= bound")
    met = close.join(alive.select("network_id", F.col("pos").alias("two"), F.col("d").alias("from_two")), ["network_id", "two"])
    exact = F.aggregate(_side_by_side("from_one", "from_two"), (F.col("m") - 2) * F.get("from_one", F.col("two")), lambda q, x: q - x["a"] - x["b"])
    first = met.groupBy("network_id").agg(F.min(F.struct(exact.alias("q"), "one", "two", "m", "from_one", "from_two")).alias("p"))
    pairs = first.select("network_id", "p.one", "p.two", "p.from_one", "p.from_two", F.col("p.m").alias("left"))
    half = 0.5 * F.get("from_one", F.col("two"))

    def length(own: str, other: str) -> Column:
        skew = F.aggregate(_side_by_side(own, other), F.lit(0.0), lambda s, x: s + x["a"] - x["b"])
        return F.greatest(F.lit(0.0), half + skew / (2 * (F.col("left") - 2)))

    return pairs.select("network_id", "one", "two", "from_one", "from_two", length("from_one", "from_two").alias("l1"), length("from_two", "from_one").alias("l2"))


def _joined(state: DataFrame) -> DataFrame:
    """The state after one more join in each network of three nodes or more."""
    going = F.col("parent").isNull() & (F.col("m") > 2)
    alive = state.where(going)
    rows = alive.join(_pairs(alive), "network_id")
    one, two = F.col("one"), F.col("two")
    kept = lambda c: F.filter(c, lambda _, k: k != one)
    at_two = lambda c, value: F.transform(c, lambda x, k: F.when(k == two, value).otherwise(x))
    merged = lambda a, b: 0.5 * (a - F.col("l1") + b - F.col("l2"))
    step = F.col("n") - F.col("m")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("parent", "int"), ("length", "double"), ("edge", "int"))]

    def as_row(pos: Column, node: Column, d: Column, parent: Column, length: Column, edge: Column) -> Column:
        return F.struct("n", (F.col("m") - 1).alias("m"), pos.cast("int").alias("pos"), node.cast("int").alias("node"), d.alias("d"), parent.cast("int").alias("parent"), length.alias("length"), edge.cast("int").alias("edge"))

    no_d, new = F.lit(None).cast("array<double>"), F.col("n") + step
    place = F.col("pos") - (F.col("pos") > one).cast("int")
    stays = as_row(place, F.col("node"), kept(at_two(F.col("d"), merged(F.get("d", one), F.get("d", two)))), *none)
    gone = lambda length, edge: as_row(F.lit(None), F.col("node"), no_d, new, F.col(length), edge)
    fresh = as_row(two, new, kept(at_two(F.zip_with("from_one", "from_two", merged), F.lit(0.0))), *none)
    after = F.when(F.col("pos") == one, F.array(gone("l1", 2 * step + 1))).when(F.col("pos") == two, F.array(gone("l2", 2 * step), fresh)).otherwise(F.array(stays))
    grown = rows.select("network_id", F.explode(after).alias("r")).select("network_id", "r.*").select(*_ROW)
    return state.where(~going).select(*_ROW).unionByName(grown)
