"""Charges between the vertices of drawings, without all pairs: cells of a grid that halves, met two at a time.

Two cells of one size meet. Where they lie apart and all distances between them fall under one law of the force, the one's
moments stand for its vertices; where they hold few vertices, these meet; else their quarters meet in the next round. Every
vertex so meets every other one exactly once, be it alone or in a cell. All networks go through the rounds together.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.layout import CAP, EDGE_LENGTH, LEAST_SIZE, VERTEX_RADIUS, VERY_SMALL
from ..shared import discard, save

#: Halvings of a drawing's side at most: cells of a drawing 1000 wide are then narrower than what counts as one spot.
DEEPEST = 24
#: Laws of the force, by the distance: beyond the reach, within it, and so near that it is capped. For each the power of
#: (edge length + both radii) and half the power of the distance by which the way between the vertices is divided.
FAR, WITHIN, CAPPED = 3, 2, 1
_REACH_POWER, _WAY_POWER = {FAR: 3, WITHIN: 2, CAPPED: 0}, {FAR: 2.0, WITHIN: 1.5, CAPPED: 0.5}
_PARTS = ("", "x", "y", "xx", "xy", "yy")
_MOMENTS = [f"m{k}{p}" for k in range(4) for p in _PARTS]
_CELL = ["network_id", "level", "cx", "cy"]


def radius(frequency: Column, inferred: Column) -> Column:
    """A vertex's radius in the layout; without a usable frequency inferred vertices count 0, others 1."""
    usable = frequency.isNotNull() & ~F.isnan(frequency) & (frequency >= 0)
    size = F.when(usable, frequency).when(inferred, 0.0).otherwise(1.0)
    return 0.5 * VERTEX_RADIUS * F.sqrt(F.greatest(F.lit(LEAST_SIZE), size))


def _gridded(vertices: DataFrame, leaf: int) -> DataFrame:
    """Vertices with the bounds of their network, its depth, and their place in its finest grid.

    The depth is the first one at which no cell holds more than `leaf` vertices; counts of all depths come from one pass."""
    n = 1 << DEEPEST
    bounds = vertices.groupBy("network_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"))
    place = lambda c: F.when(F.col("side") > 0, F.least(F.floor((F.col(c) - F.col(f"{c}0")) / F.col("side") * n), F.lit(n - 1))).otherwise(0).cast("long")
    placed = vertices.join(bounds, "network_id").withColumns({"gx": place("x"), "gy": place("y")})
    full = _levels(placed.select("network_id", "gx", "gy", F.lit(DEEPEST).alias("depth"))).groupBy(*_CELL).count()
    depths = full.groupBy("network_id", "level").agg(F.max("count").alias("most")).groupBy("network_id")
    return placed.join(depths.agg(F.coalesce(F.min(F.when(F.col("most") <= leaf, F.col("level"))), F.lit(DEEPEST)).alias("depth")), "network_id")


def _levels(placed: DataFrame) -> DataFrame:
    """A row for each level of a vertex's network, with its cell there."""
    rows = placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    return rows.withColumns({c: F.expr(f"shiftright(g{c[1]}, {DEEPEST} - level)") for c in ("cx", "cy")})


def _cells(placed: DataFrame) -> DataFrame:
    """Cells of all levels: how many vertices, their radii's range, and sums of radius^k times offsets from the cell's middle."""
    width = F.col("side") / F.pow(F.lit(2.0), F.col("level"))
    rows = _levels(placed).withColumn("width", width).withColumns({f"o{c}": F.col(f"{c}0") + (F.col(f"c{c}") + 0.5) * F.col("width") for c in "xy"})
    off = {"x": F.col("x") - F.col("ox"), "y": F.col("y") - F.col("oy")}

    def moment(k: int, part: str) -> Column:
        out = F.lit(1.0)
        for factor in [F.col("radius")] * k + [off[c] for c in part]:
            out = out * factor
        return F.sum(out).alias(f"m{k}{part}")

    sums = [moment(k, p) for k in range(4) for p in _PARTS]
    return rows.groupBy(*_CELL).agg(F.count("*").alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most"), *(F.first(c).alias(c) for c in ("width", "ox", "oy", "depth")), *sums)


def _meetings(cells: DataFrame, apart: int, leaf: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Pairs of cells (network_id, level, ax, ay, bx, by, kind), a table for each round: with a law as kind, or 0 where
    vertices are to meet."""
    slim = cells.select(*_CELL, "n", "least", "most", "width", "depth")
    named = lambda df, p: df.select("network_id", "level", *(F.col(c).alias(p + c[-1:]) for c in ("cx", "cy")), *(F.col(c).alias(f"{p}_{c}") for c in ("n", "least", "most", "width", "depth")))
    young = lambda p: slim.select("network_id", F.col("level").alias("next"), F.expr("level - 1").alias("level"), F.expr("shiftright(cx, 1)").alias(f"{p}x"), F.expr("shiftright(cy, 1)").alias(f"{p}y"), F.col("cx").alias(f"{p}x2"), F.col("cy").alias(f"{p}y2"))
    root = slim.where("level = 0").select("network_id", "level")
    frontier = root.select("network_id", "level", *(F.lit(0).cast("long").alias(c) for c in ("ax", "ay", "bx", "by")))
    sx, sy = (F.abs(F.col(f"a{c}") - F.col(f"b{c}")) for c in "xy")
    gap, far = (F.col("a_width") * F.sqrt(x * x + y * y) for x, y in ((F.greatest(sx - 1, F.lit(0)), F.greatest(sy - 1, F.lit(0))), (sx + 1, sy + 1)))
    low, high = (EDGE_LENGTH + F.col(f"a_{c}") + F.col(f"b_{c}") for c in ("least", "most"))
    separate, root_cap = F.greatest(sx, sy) > apart, CAP**0.5
    law = F.when(separate & (gap >= high), FAR).when(separate & (far < low) & (gap >= high / root_cap), WITHIN).when(separate & (far < low / root_cap), CAPPED)
    kind = F.coalesce(law, F.when((F.col("a_n") * F.col("b_n") <= leaf * leaf) | (F.col("level") == F.col("a_depth")), 0).otherwise(-1))
    columns, rounds, kept = ["network_id", "level", "ax", "ay", "bx", "by"], [], []
    for level in range(DEEPEST + 1):
        here = slim.where(F.col("level") == level)
        met = frontier.join(named(here, "a"), ["network_id", "level", "ax", "ay"]).join(named(here, "b"), ["network_id", "level", "bx", "by"])
        met = save(met.select(*columns, kind.alias("kind")), "cells")
        kept.append(met)
        rounds.append(met.where("kind >= 0"))
        split = met.where("kind < 0").drop("kind")
        if split.isEmpty():
            break
        next_cells = lambda p: young(p).where(F.col("next") == level + 1).drop("next")  # noqa: B023, E731
        both = split.join(next_cells("a"), ["network_id", "level", "ax", "ay"]).join(next_cells("b"), ["network_id", "level", "bx", "by"])
        frontier = both.select("network_id", (F.col("level") + 1).alias("level"), *(F.col(f"{c}2").alias(c) for c in ("ax", "ay", "bx", "by")))
    return rounds, kept


def _by_moments(rows: DataFrame) -> DataFrame:
    """Forces on vertices (x, y, radius) by cells' moments: the force from where the cell's charge has its middle, and the
    term of second order for how it spreads about there."""
    s = EDGE_LENGTH + F.col("radius")
    law = lambda of: F.when(F.col("kind") == FAR, of(FAR)).when(F.col("kind") == WITHIN, of(WITHIN)).otherwise(of(CAPPED))

    def factor(kind: int, k: int) -> Column:
        power = _REACH_POWER[kind]
        scale = CAP if kind == CAPPED else 1.0
        return F.lit(0.0) if k > power else scale * comb(power, k) * F.pow(s, F.lit(power - k))

    rows = rows.withColumns({f"f{k}": law(lambda kind, k=k: factor(kind, k)) for k in range(4)} | {"p": law(lambda kind: F.lit(_WAY_POWER[kind]))})
    total = {p: sum((F.col(f"f{k}") * F.col(f"m{k}{p}") for k in range(1, 4)), F.col("f0") * F.col(f"m0{p}")) for p in _PARTS}
    rows = rows.withColumns({f"t{p}": total[p] for p in _PARTS})
    rows = rows.withColumns({"ex": F.col("tx") / F.col("t"), "ey": F.col("ty") / F.col("t")})
    rows = rows.withColumns({f"s{a}{b}": F.col(f"t{a}{b}") / F.col("t") - F.col(f"e{a}") * F.col(f"e{b}") for a, b in ("xx", "xy", "yy")})
    rows = rows.withColumns({f"v{c}": F.col(c) - F.col(f"o{c}") - F.col(f"e{c}") for c in "xy"}).withColumn("u", F.expr("vx * vx + vy * vy"))
    rows = rows.withColumns({"sx": F.expr("sxx * vx + sxy * vy"), "sy": F.expr("sxy * vx + syy * vy")})
    along = F.expr("1 - p * (sxx + syy) / u + 2 * p * (p + 1) * (sx * vx + sy * vy) / (u * u)")
    force = [(F.col("t") * F.pow("u", -F.col("p")) * (F.col(f"v{c}") * along - 2 * F.col("p") * F.col(f"s{c}") / F.col("u"))).alias(f"f{c}") for c in "xy"]
    return rows.select("network_id", "index", *force, F.col("n").alias("n_met"), F.col("m1").alias("radii_met"))


def _one_by_one(pairs: DataFrame) -> DataFrame:
    """Forces on vertices (x, y, radius) by others (bx, by, b_radius)."""
    reach = EDGE_LENGTH + F.col("radius") + F.col("b_radius")
    rows = pairs.withColumns({"wx": F.col("x") - F.col("b_x"), "wy": F.col("y") - F.col("b_y"), "reach": reach})
    rows = rows.withColumn("u", F.greatest(F.expr("wx * wx + wy * wy"), F.lit(VERY_SMALL))).withColumn("d", F.sqrt("u"))
    push = F.least(F.expr("CASE WHEN u < reach * reach THEN reach * reach / u ELSE reach * reach * reach / (u * d) END"), F.lit(CAP))
    return rows.select("network_id", "index", *((push / F.col("d") * F.col(f"w{c}")).alias(f"f{c}") for c in "xy"), F.lit(1).cast("long").alias("n_met"), F.col("b_radius").alias("radii_met"))


def charges(vertices: DataFrame, apart: int = 2, leaf: int = 32) -> DataFrame:
    """vertices(network_id, index, x, y, radius) -> (network_id, index, fx, fy, n_met, radii_met): the force of all others'
    charges on each, how many these are, and their radii's sum.

    Cells count as apart if more than `apart` rows or columns of cells off each other; a wider value costs more and errs
    less. Vertices without a finite place or a radius push none and aren't in the result. Those on one spot don't push each
    other. A lone vertex has no force. Only cells of up to `leaf` vertices, or finer than a spot, are met vertex by vertex.
    """
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    kept = vertices.where(finite("x") & finite("y") & finite("radius")).select("network_id", "index", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "radius")))
    placed = save(_gridded(kept, leaf), "placed")
    cells = save(_cells(placed), "cells")
    rounds, tables = _meetings(cells, apart, leaf)
    met = rounds[0]
    for r in rounds[1:]:
        met = met.unionByName(r)
    own = _levels(placed.select("network_id", "index", "x", "y", "radius", "gx", "gy", "depth")).select("network_id", "level", F.col("cx").alias("ax"), F.col("cy").alias("ay"), "index", "x", "y", "radius")
    other = own.select("network_id", "level", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("index").alias("b_index"), F.col("x").alias("b_x"), F.col("y").alias("b_y"), F.col("radius").alias("b_radius"))
    sums = cells.select("network_id", "level", F.col("cx").alias("bx"), F.col("cy").alias("by"), "ox", "oy", "n", *_MOMENTS)
    far = met.where("kind > 0").join(sums, ["network_id", "level", "bx", "by"]).join(own, ["network_id", "level", "ax", "ay"])
    near = met.where("kind = 0").join(other, ["network_id", "level", "bx", "by"]).join(own, ["network_id", "level", "ax", "ay"]).where("index != b_index")
    alone = kept.select("network_id", "index", *(F.lit(0.0).alias(c) for c in ("fx", "fy")), F.lit(0).cast("long").alias("n_met"), F.lit(0.0).alias("radii_met"))
    parts = _by_moments(far).unionByName(_one_by_one(near)).unionByName(alone)
    out = save(parts.groupBy("network_id", "index").agg(*(F.sum(c).alias(c) for c in ("fx", "fy", "n_met", "radii_met"))), "charges")
    for table in (placed, cells, *tables):
        discard(table)
    return out


def springs(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices(network_id, index, x, y, radius), edges(network_id, from, to, weight) -> (network_id, index, fx, fy): the pull
    of its edges on each vertex that has some. Weights that are none or not positive count 1; loops pull nothing."""
    end = lambda p, c: vertices.select("network_id", F.col("index").alias(c), *(F.col(n).alias(f"{p}_{n}") for n in ("x", "y", "radius")))
    usable = F.col("weight").isNotNull() & ~F.isnan(F.col("weight").cast("double")) & (F.col("weight") > 0)
    rows = edges.where("`from` != `to`").select("network_id", "from", "to", F.when(usable, F.col("weight").cast("double")).otherwise(1.0).alias("weight"))
    rows = rows.join(end("a", "from"), ["network_id", "from"]).join(end("b", "to"), ["network_id", "to"])
    rows = rows.withColumns({"wx": F.expr("b_x - a_x"), "wy": F.expr("b_y - a_y"), "sums": F.expr("a_radius + b_radius")})
    rows = rows.withColumn("d", F.greatest(F.sqrt(F.expr("wx * wx + wy * wy")), F.lit(VERY_SMALL)))
    pull = F.least((F.col("d") - F.col("sums")) / F.greatest(EDGE_LENGTH * F.col("weight"), F.col("sums")), CAP / F.col("d")) / F.col("d")
    rows = rows.withColumns({f"f{c}": pull * F.col(f"w{c}") for c in "xy"})
    both = rows.select("network_id", F.explode(F.array(F.struct(F.col("from").alias("index"), "fx", "fy"), F.struct(F.col("to").alias("index"), (-F.col("fx")).alias("fx"), (-F.col("fy")).alias("fy")))).alias("e"))
    return both.select("network_id", "e.*").groupBy("network_id", "index").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def relax(vertices: DataFrame, edges: DataFrame, rounds: int = 20, width: float = 1000.0, height: float = 1000.0, apart: int = 2) -> DataFrame:
    """vertices(network_id, index, radius) and their edges -> (network_id, index, x, y, radius): a layout in rounds over all
    networks at once, for networks that no task could hold.

    Places start spread by a hash of network and index over the canvas, widened so that every vertex has its room, hence
    reruns agree. In each round a vertex moves along its force, at most as far as the round allows: this shrinks from a
    tenth of the canvas. The drawing ends centred on the canvas.
    """
    share = lambda salt: F.pmod(F.xxhash64(F.col("network_id").cast("string"), F.col("index"), F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)
    room = vertices.groupBy("network_id").agg(F.greatest(F.lit(1.0), F.sqrt(F.count("*")) * EDGE_LENGTH / max(width, height)).alias("wide"))
    v = save(vertices.select("network_id", "index", "radius").join(room, "network_id").withColumns({"x": share(1) * width * F.col("wide"), "y": share(2) * height * F.col("wide")}), "layout")
    for k in range(rounds):
        pushed = charges(v, apart)
        force = pushed.select("network_id", "index", "fx", "fy").unionByName(springs(v, edges)).groupBy("network_id", "index").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        most = F.col("wide") * max(width, height) * 0.1 * (1 - k / rounds)
        length = F.greatest(F.sqrt(F.expr("fx * fx + fy * fy")), F.lit(VERY_SMALL))
        by = F.least(F.lit(EDGE_LENGTH * 0.5), most / length)
        moved = v.join(force, ["network_id", "index"]).withColumns({c: F.col(c) + F.col(f"f{c}") * by for c in "xy"}).drop("fx", "fy")
        last, v = v, save(moved, "layout")
        discard(last)
        discard(pushed)
    middle = v.groupBy("network_id").agg(*(((F.min(c) + F.max(c)) / 2).alias(f"m{c}") for c in "xy"))
    out = v.join(middle, "network_id")
    return out.select("network_id", "index", (F.col("x") + width / 2 - F.col("mx")).alias("x"), (F.col("y") + height / 2 - F.col("my")).alias("y"), "radius")
