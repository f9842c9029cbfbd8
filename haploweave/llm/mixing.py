"""Mixing sources to target weights by cube-method balanced sampling (public: Deville and Tillé, 2004; Chauvet and Tillé, 2006)."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, join_checked, prepare, save

#: By code point of the source, repeating; the share of all words that the mix takes; how often a document may be taken.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Units of a block of the flight phase; the share of its words, as 1 / HEAVY, beyond which a unit is decided first.
BLOCK, HEAVY = 4096, 256
#: Units that are landed at once, besides what the flight leaves; how near to their expectation, as a share of it.
LANDING, NEAR = 10, 0.001


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources(source, source_size) -> with target: shares by weight that stop at most times the source's size.

    The excess is dealt by weight until no source is above: the level at which it ends is found from running sums over
    the sources in the order in which they stop. One row per source, so the windows are as small as the list of sources.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((order - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("stops", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("stops", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(1))
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - (F.sum("cap").over(upto) - F.col("cap"))
    level = left / (F.sum("weight").over(everything) - (F.sum("weight").over(upto) - F.col("weight")))
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("stops"), F.struct("stops", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def _weighty(pi: np.ndarray, size: np.ndarray, rng: random.Random) -> None:
    """Decide, in place and from the largest on, units of more than 1 / HEAVY of the open units' words, all others that are
    open giving way: a unit that outweighs the others would outlive a flight in threes and be left to the landing.

    A move is 1 for the unit and the same for all others, by which they take back its words: it keeps the sum of
    pi * size and gives up that of pi, which the flight of the others keeps again. It ends where a unit is decided. It is
    fair wherever the others can give way to both decisions.
    """
    heavy = np.flatnonzero((pi > 0) & (pi < 1) & (size > size[(pi > 0) & (pi < 1)].sum() / HEAVY))
    for k in heavy[np.argsort(-size[heavy], kind="stable")]:
        while 0 < pi[k] < 1:
            rest = np.flatnonzero((pi > 0) & (pi < 1) & (size > 0) & (np.arange(len(pi)) != k))
            s = size[rest]
            if len(rest) < 2:
                return
            u = np.full(len(s), -size[k] / s.sum())
            idx, way = np.append(rest, k), np.append(u, 1.0)
            x = pi[idx]
            up, down = (np.where(way * sign > 0, 1 - x, x) / np.abs(way) for sign in (1, -1))
            up, down = float(up.min()), float(down.min())
            # Where the others can give way in one direction only, that one is taken.
            can = up >= 1 - pi[k] - 1e-12, down >= pi[k] - 1e-12
            rises = can[0] if can[0] != can[1] else rng.random() * (up + down) < down
            x = x + (up if rises else -down) * way
            pi[idx] = np.where(x < 1e-9, 0.0, np.where(x > 1 - 1e-9, 1.0, x))


def flight(pi: list[float], size: list[float], rng: random.Random, land: bool) -> list[float]:
    """Flight phase of the cube method on (1, size): moves in the constraints' null space until at most two units stay
    between 0 and 1. With land, the last LANDING units (the smallest, as units come by falling size) don't fly: they and
    what the flight leaves are landed.

    With land, units that outweigh the others are decided first. Every move keeps the sum of pi * size and is fair: the
    expectation of each unit stays its probability, but for units that the others can't make up for and for the few that
    are landed: see _weighty(), _landed().
    """
    whole, sizes = np.array(pi, dtype=np.float64), np.array(size, dtype=np.float64)
    flying = np.ones(len(whole), dtype=bool)
    if land:
        flying[np.flatnonzero((whole > 0) & (whole < 1) & (sizes > 0))[-LANDING:]] = False
        part = whole[flying]
        _weighty(part, sizes[flying], rng)
        whole[flying] = part
    out, open_ = whole.tolist(), []

    def move(idx: list[int], u: list[float]) -> None:
        up = down = float("inf")
        for i, d in zip(idx, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - out[i]) / d), min(down, out[i] / d)
            elif d < 0:
                up, down = min(up, out[i] / -d), min(down, (1 - out[i]) / -d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(idx, u, strict=True):
            x = out[i] + step * d
            out[i] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x

    for k in range(len(out)):
        if flying[k] and 0.0 < out[k] < 1.0:
            open_.append(k)
        if len(open_) == 3:
            a, b, c = (size[i] for i in open_)
            move(open_, [b - c, c - a, a - b] if not a == b == c else [1.0, -1.0, 0.0])
            open_ = [i for i in open_ if 0.0 < out[i] < 1.0]
    if land:
        last = [k for k in range(len(out)) if 0.0 < out[k] < 1.0]
        for k, x in zip(last, _landed([out[k] for k in last], [size[k] for k in last], rng), strict=True):
            out[k] = x
    return out


def _landed(pi: list[float], size: list[float], rng: random.Random) -> list[float]:
    """The landing problem of a few units: of all ways to decide them, one drawn from those whose words are nearest to their
    expectation (within NEAR of it), and of these whose number is."""
    if not pi:
        return []
    ways = (np.arange(1 << len(pi))[:, None] >> np.arange(len(pi)) & 1).astype(np.float64)
    words = np.abs(ways @ np.array(size) - np.dot(pi, size))
    near = np.flatnonzero(words <= max(words.min(), NEAR * np.dot(pi, size)))
    number = np.abs(ways[near].sum(1) - sum(pi))
    near = near[number <= number.min() + 1e-9]
    return ways[near[rng.randrange(len(near))]].tolist()


def _fly(seed: int, level: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("hash", "ascending"), ("nth", "ascending")])
        source, block, land = table.column("source")[0].as_py(), table.column("block")[0].as_py(), table.column("blocks")[0].as_py() == 1
        pi, size = table.column("pi").to_pylist(), [float(x) for x in table.column("size").to_pylist()]
        done = flight(pi, size, random.Random(f"{seed}/{level}/{source!r}/{block}"), land)
        return table.set_column(table.schema.get_field_index("pi"), "pi", pa.array(done, pa.float64()))

    return run


def with_row_key(docs: DataFrame, *others: str) -> DataFrame:
    """doc_key (doc_id, null as the least long), size, hash, and nth: 0, 1, ... among rows of one doc_id."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumns({"doc_key": F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")), "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "hash": F.xxhash64(text)})
    nth = F.row_number().over(Window.partitionBy("doc_key").orderBy(F.col("source").asc_nulls_last(), "size", "hash", *others)) - 1
    return out.withColumn("nth", nth)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7) -> DataFrame:
    """docs(doc_id, text, source, ...) -> (doc_id, source, nth, size, source_size, target, copies, taken): one row per row.

    size: words of the whole text (null: 0). A source takes target / source_size of each document: the whole part for
    all, the rest by balanced sampling, so that words and documents of the sample meet their expectations up to a landing
    problem of about LANDING of its smallest units per source. In the last flight, units that outweigh the others are
    decided first, all others giving way, and every unit that flies keeps its probability; the landing takes the way nearest to the words
    that are left, so that a source of LANDING documents or fewer is landed alone. taken = copies * size. Reruns agree: the draws hang on the rows, not on their places.
    Null sources are one source, the last. Sources without words take nothing. Repeated rows are units of their own (nth).
    An empty table gives an empty table. Blocks of about BLOCK units fly apart, a hot source in many; what they leave
    open (two units each) flies again, in as many rounds as the logarithm of the size to the base BLOCK / 2 asks for.
    """
    prepare(docs.sparkSession)
    thin = docs.select("doc_id", "source", "text")
    sizes = save(with_row_key(thin).select("doc_id", "source", "size", "hash", "nth"), "sizes")
    found = save(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "sources")
    n_sources, largest = found.agg(F.count("*"), F.max("n_docs")).first()
    aims = save(targets(found, weights, share, most).join(found.select(F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets").withColumnRenamed("source", "s")
    units = join_checked(sizes, aims, F.col("source").eqNullSafe(F.col("s")), n_sources).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("rate", F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate))
    units = units.withColumns({"whole": F.floor("rate").cast("long"), "pi": F.col("rate") - F.floor("rate"), "blocks": F.ceil(F.col("n_docs") / BLOCK).cast("long")})
    units = units.drop("rate", "n_docs")
    done = [units.where("pi = 0")]
    open_, level, most_blocks = units.where("pi > 0"), 0, -(-(largest or 0) // BLOCK)
    while True:
        flown = open_.withColumn("block", F.pmod(F.xxhash64("doc_id", "hash", "nth", F.lit(level)), F.col("blocks")))
        flown = save(flown.groupBy("source", "block").applyInArrow(_fly(seed, level), flown.schema), f"flight-{level}").drop("block")
        if most_blocks <= 1:
            done.append(flown)
            break
        done.append(flown.where("pi = 0 or pi = 1"))
        open_ = flown.where("pi > 0 and pi < 1").withColumn("blocks", F.ceil(2 * F.col("blocks") / BLOCK).cast("long"))
        level, most_blocks = level + 1, -(-2 * most_blocks // BLOCK)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = out.withColumn("copies", F.col("whole") + F.col("pi").cast("long"))
    discard(found)
    return out.select("doc_id", "source", "nth", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, **options: object) -> DataFrame:
    """The mixed documents: each row of docs as often as mix() takes it (not at all, once or twice), columns as they were.

    Texts cross the network once, by doc_id, and meet there the thin table of copies.
    """
    copies = mix(docs, **options).where("copies > 0").select(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("key"), F.col("nth").alias("own"), "copies")
    # The row travels as one struct, so that no column of it can clash with those that the join needs.
    full = with_row_key(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source", "text"))
    # nth is compared in an expression, so that the join keeps the window's partitioning by doc_key alone.
    picked = full.join(copies, (F.col("doc_key") == F.col("key")) & (F.abs(F.col("nth") - F.col("own")) == 0))
    return picked.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
