"""Graphs as vertices(network_id, index, ...) and edges(network_id, index, from, to, weight): steps on all networks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import discard, save


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place, from 0, within their network in the given order."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy("network_id").orderBy(*order)) - 1).cast("long"))


def endpoints(edges: DataFrame) -> DataFrame:
    """(network_id, vertex, edge, other, weight): both ends of every edge (a self-loop twice)."""
    one = edges.select("network_id", F.col("from").alias("vertex"), F.col("index").alias("edge"), F.col("to").alias("other"), "weight")
    two = edges.select("network_id", F.col("to").alias("vertex"), F.col("index").alias("edge"), F.col("from").alias("other"), "weight")
    return one.unionByName(two)


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(network_id, index, degree): incident edges, 0 for vertices without any; a self-loop counts once."""
    counts = endpoints(edges).groupBy("network_id", "vertex").agg(F.countDistinct("edge").alias("degree"))
    joined = vertices.select("network_id", "index").join(counts.withColumnRenamed("vertex", "index"), ["network_id", "index"], "left")
    return joined.select("network_id", "index", F.coalesce("degree", F.lit(0)).alias("degree"))


def with_edge_ends(edges: DataFrame, vertices: DataFrame, *columns: str) -> DataFrame:
    """edges with the given vertex columns of both ends, as from_<c> and to_<c>."""
    out = edges
    for end in ("from", "to"):
        side = vertices.select("network_id", F.col("index").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns))
        out = out.join(side, ["network_id", end])
    return out


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with new(network_id, from, to[, weight]) after them; missing weights are 1."""
    weight = F.coalesce(F.col("weight"), F.lit(1)) if "weight" in new.columns else F.lit(1)
    more = new.select("network_id", F.lit(None).cast("int").alias("index"), "from", "to", weight.cast(edges.schema["weight"].dataType).alias("weight"))
    return renumber(edges.select("network_id", "index", "from", "to", "weight").unionByName(more), ["index", "from", "to"])


def renumber(rows: DataFrame, order: list[str]) -> DataFrame:
    """index made dense from 0 within each network, in the given order (nulls last)."""
    place = F.row_number().over(Window.partitionBy("network_id").orderBy(*(F.col(c).asc_nulls_last() for c in order))) - 1
    return rows.withColumn("index", place.cast("int"))


def remove_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without gone(network_id, index) and the edges at them; both lists renumbered densely, order kept."""
    kept = vertices.join(gone.select("network_id", "index"), ["network_id", "index"], "left_anti")
    numbered = kept.withColumn("new", (F.row_number().over(Window.partitionBy("network_id").orderBy("index")) - 1).cast("int"))
    names = numbered.select("network_id", "index", "new")
    out = edges
    for end in ("from", "to"):
        out = out.join(names.select("network_id", F.col("index").alias(end), F.col("new").alias(f"new_{end}")), ["network_id", end])
    out = out.select("network_id", "index", F.col("new_from").alias("from"), F.col("new_to").alias("to"), "weight")
    return numbered.drop("index").withColumnRenamed("new", "index").select(*vertices.columns), renumber(out, ["index"])


def peel(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the vertices that have not keep and fewer than two edges, and the edges at them, again and again.

    vertices(network_id, index, keep, ...). Indices stay as they are.
    """
    while True:
        few = degrees(vertices, edges).where("degree < 2").select("network_id", "index")
        gone = save(vertices.where("not keep").join(few, ["network_id", "index"], "left_semi").select("network_id", "index"), "leaves")
        if gone.isEmpty():
            return vertices, edges
        vertices = save(vertices.join(gone, ["network_id", "index"], "left_anti"), "vertices")
        for end in ("from", "to"):
            edges = edges.join(gone.withColumnRenamed("index", end), ["network_id", end], "left_anti")
        edges = save(edges.select("network_id", "index", "from", "to", "weight"), "edges")


def contract(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(network_id, from, to, weight, first, last, n_edges): edges after vertices that have not keep and exactly two edges are
    taken out and their edges joined, weights summed.

    vertices(network_id, index, keep). Each edge is taken in both directions; one that leads to such a vertex goes on by the
    other edge there, and what it reaches doubles in each round. first, last: the edges at from and to; first <= last. A
    ring of such vertices alone has no end and is left out; one that leads back to where it began is an edge from a vertex
    to itself.
    """
    one = edges.select("network_id", F.col("index").alias("first"), F.lit(0).alias("way"), F.col("from").alias("a"), F.col("to").alias("b"), "weight")
    two = edges.select("network_id", F.col("index").alias("first"), F.lit(1).alias("way"), F.col("to").alias("a"), F.col("from").alias("b"), "weight")
    half = one.unionByName(two)
    inner = half.groupBy("network_id", "a").agg(F.count("*").alias("n")).where("n = 2").select("network_id", F.col("a").alias("index"))
    inner = save(inner.join(vertices.where("not keep").select("network_id", "index"), ["network_id", "index"], "left_semi"), "inner")
    mark = lambda df, c, name: df.join(inner.select("network_id", F.col("index").alias(c), F.lit(True).alias(name)), ["network_id", c], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    half = mark(mark(half, "a", "from_inner"), "b", "open")
    reach = half.select("network_id", "first", "way", "a", "from_inner", F.col("first").alias("last"), F.col("way").alias("last_way"), F.col("b").alias("end"), F.col("weight").cast("double").alias("weight"), F.lit(1).cast("long").alias("n_edges"), "open")
    # The half-edge that goes on from the end of another: it begins there and isn't the same edge turned round.
    ahead = half.where("open").select("network_id", F.col("b").alias("at"), F.col("first").alias("last"), F.col("way").alias("last_way"))
    onward = ahead.join(half.select("network_id", F.col("a").alias("at"), F.col("first").alias("next"), F.col("way").alias("next_way")), ["network_id", "at"])
    onward = onward.where("not (last = next and last_way != next_way)").select("network_id", "last", "last_way", "next", "next_way")
    reach = save(reach.join(onward, ["network_id", "last", "last_way"], "left"), "reach")
    while not reach.where("open and not from_inner").isEmpty():
        more = reach.select("network_id", F.col("first").alias("next"), F.col("way").alias("next_way"), F.col("last").alias("l2"), F.col("last_way").alias("lw2"), F.col("end").alias("e2"), F.col("weight").alias("w2"), F.col("n_edges").alias("n2"), F.col("open").alias("o2"), F.col("next").alias("nn"), F.col("next_way").alias("nw"))
        moved_ = reach.where("open").join(more, ["network_id", "next", "next_way"])
        moved_ = moved_.select("network_id", "first", "way", "a", "from_inner", F.col("l2").alias("last"), F.col("lw2").alias("last_way"), F.col("e2").alias("end"), (F.col("weight") + F.col("w2")).alias("weight"), (F.col("n_edges") + F.col("n2")).alias("n_edges"), F.col("o2").alias("open"), F.col("nn").alias("next"), F.col("nw").alias("next_way"))
        new = save(reach.where("not open").select(*moved_.columns).unionByName(moved_), "reach")
        discard(reach)
        reach = new
    whole = reach.where("not open and not from_inner and (first < last or first = last and way = 0)")
    return whole.select("network_id", F.col("a").alias("from"), F.col("end").alias("to"), "weight", "first", "last", "n_edges")


def components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(network_id, index, component): the least vertex index reachable.

    Labels take the least label next to them and then, twice, their label's label, so that rounds grow with the
    logarithm of a path's length.
    """
    links = save(endpoints(edges).select("network_id", F.col("vertex").alias("index"), "other").where(F.col("index") != F.col("other")).distinct())
    labels = save(vertices.select("network_id", "index", F.col("index").alias("component")))
    for _ in range(max_rounds):
        near = links.join(labels.select("network_id", F.col("index").alias("other"), F.col("component").alias("c")), ["network_id", "other"]).groupBy("network_id", "index").agg(F.min("c").alias("c"))
        new = labels.join(near, ["network_id", "index"], "left").select("network_id", "index", F.least("component", F.coalesce("c", "component")).alias("component"))
        for _ in range(2):
            up = new.select("network_id", F.col("index").alias("component"), F.col("component").alias("c"))
            new = new.join(up, ["network_id", "component"]).select("network_id", "index", F.col("c").alias("component"))
        new = save(new)
        same = new.join(labels.withColumnRenamed("component", "old"), ["network_id", "index"]).where("component != old").isEmpty()
        discard(labels)
        labels = new
        if same:
            discard(links)
            return labels
    raise RuntimeError("components: no end")


def components_at(distances: DataFrame, vertices: DataFrame, threshold: float) -> DataFrame:
    """Components of the graph of pairs nearer than the threshold."""
    edges = distances.where(F.col("d") < threshold).select("network_id", F.lit(0).alias("index"), F.col("i").alias("from"), F.col("j").alias("to"), F.col("d").alias("weight"))
    return components(vertices, edges)


def connected(paths: DataFrame, a: int, b: int) -> DataFrame:
    """(network_id, connected) for two vertices, from paths.shortest_paths()."""
    return paths.groupBy("network_id").agg(F.max((F.col("i") == a) & (F.col("j") == b)).alias("connected"))


def total_excess(paths: DataFrame, distances: DataFrame) -> DataFrame:
    """(network_id, excess): sum over the pairs of distances(i, j, d) of path length less distance; a shorter path fails."""
    joined = distances.join(paths, ["network_id", "i", "j"])
    over = F.col("length") - F.col("d")
    over = F.when(over < 0, F.raise_error(F.lit("Path length is shorter than allowed."))).otherwise(over)
    return joined.groupBy("network_id").agg(F.sum(over).alias("excess"))


def excess_pairs(paths: DataFrame, distances: DataFrame) -> DataFrame:
    """(network_id, i, j, excess, place): pairs with a path too long, numbered by (excess, i, j)."""
    over = distances.join(paths, ["network_id", "i", "j"]).withColumn("excess", F.col("length") - F.col("d")).where("excess > 0")
    place = F.row_number().over(Window.partitionBy("network_id").orderBy("excess", "i", "j")) - 1
    return over.select("network_id", "i", "j", "excess", place.alias("place"))


def shared_edges(edges: DataFrame) -> DataFrame:
    """(network_id, a, b, edge): for vertices next to each other, a < b, the first edge between them."""
    pairs = edges.select("network_id", F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b"), "index")
    return pairs.where("a < b").groupBy("network_id", "a", "b").agg(F.min("index").alias("edge"))


def feasible_triplets(edges: DataFrame) -> DataFrame:
    """(network_id, edge, previous, u, v, w): each edge with every earlier one that touches it; w is the other's far end."""
    ends = edges.select("network_id", "index", F.explode(F.array_distinct(F.array("from", "to"))).alias("vertex"))
    later, earlier = ends.withColumnRenamed("index", "edge"), ends.withColumnRenamed("index", "previous")
    # Edges meet at a shared vertex: the join grows with the degrees, not with all pairs of a network's edges.
    met = later.join(earlier, ["network_id", "vertex"]).where("edge > previous").select("network_id", "edge", "previous").distinct()
    met = met.join(edges.select("network_id", F.col("index").alias("edge"), F.col("from").alias("u"), F.col("to").alias("v")), ["network_id", "edge"])
    met = met.join(edges.select("network_id", F.col("index").alias("previous"), F.col("from").alias("a"), F.col("to").alias("b")), ["network_id", "previous"])
    return met.select("network_id", "edge", "previous", "u", "v", F.when(F.col("a").isin(F.col("u"), F.col("v")), F.col("b")).otherwise(F.col("a")).alias("w"))


def nj_scores(distances: DataFrame) -> DataFrame:
    """(network_id, i, j, q) for i > j: the neighbour-joining criterion (n - 2) d - sum of row i - sum of row j."""
    full = distances.select("network_id", F.col("i").alias("a"), "d").unionByName(distances.select("network_id", F.col("j").alias("a"), "d"))
    sums = full.groupBy("network_id", "a").agg(F.sum("d").alias("s"))
    n = sums.groupBy("network_id").agg(F.count("*").alias("n"))
    out = distances.join(sums.withColumnRenamed("a", "i").withColumnRenamed("s", "si"), ["network_id", "i"]).join(sums.withColumnRenamed("a", "j").withColumnRenamed("s", "sj"), ["network_id", "j"]).join(n, "network_id")
    return out.select("network_id", "i", "j", ((F.col("n") - 2) * F.col("d") - F.col("si") - F.col("sj")).alias("q"))


def pair_buckets(distances: DataFrame) -> DataFrame:
    """(network_id, from, to, weight, bucket): pairs, earlier vertex first, bucketed by weight in ascending order."""
    return distances.select("network_id", F.col("j").alias("from"), F.col("i").alias("to"), F.col("d").alias("weight"), (F.dense_rank().over(Window.partitionBy("network_id").orderBy("d")) - 1).alias("bucket"))


def radii(vertices: DataFrame) -> DataFrame:
    """vertices(..., frequency, inferred) with radius: 7.5 * sqrt(size), size the frequency and at least 4/9."""
    fallback = F.when(F.col("inferred"), 0.0).otherwise(1.0)
    frequency = F.coalesce(F.when(~F.isnan("frequency") & (F.col("frequency") >= 0), F.col("frequency")), fallback)
    return vertices.withColumn("radius", 7.5 * F.sqrt(F.greatest(F.lit(4 / 9), frequency)))


def bounds(vertices: DataFrame) -> DataFrame:
    """(network_id, min_x, min_y, max_x, max_y) of the circles."""
    return vertices.groupBy("network_id").agg(F.min(F.col("x") - F.col("radius")).alias("min_x"), F.min(F.col("y") - F.col("radius")).alias("min_y"), F.max(F.col("x") + F.col("radius")).alias("max_x"), F.max(F.col("y") + F.col("radius")).alias("max_y"))


def within(vertices: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Vertices whose centre lies in the rectangle, borders included, corners in any order."""
    return vertices.where(F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1)))


def moved(vertices: DataFrame, chosen: DataFrame, dx: float, dy: float) -> DataFrame:
    """vertices with those of chosen(network_id, index) moved by (dx, dy)."""
    hit = vertices.join(chosen.select("network_id", "index", F.lit(True).alias("hit")), ["network_id", "index"], "left")
    step = lambda c, by: F.when(F.col("hit"), F.col(c) + by).otherwise(F.col(c))
    return hit.withColumns({"x": step("x", dx), "y": step("y", dy)}).select(*vertices.columns)


def pie_slices(counts: DataFrame) -> DataFrame:
    """(network_id, hap_idx, trait_idx, start, stop): slices of positive traits around the circle, from -pi/2 on."""
    by = Window.partitionBy("network_id", "hap_idx")
    running = by.orderBy("trait_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = counts.where("count > 0")
    turn = lambda part: 2 * F.pi() * part / F.sum("count").over(by) - F.pi() / 2
    upto = F.sum("count").over(running)
    return some.select("network_id", "hap_idx", "trait_idx", turn(upto - F.col("count")).alias("start"), turn(upto).alias("stop"))
