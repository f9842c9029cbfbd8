"""SimHash near-dedup: fingerprints, a join on blocks of bits by the pigeonhole principle, Hamming check, groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, discard, prepare, save
from .components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LANES = np.uint64(0x0101010101010101)


def fingerprint_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of texts whose hashes lie one after another; a bit is set if it is in over half of a text's hashes."""
    out = np.zeros(len(counts), dtype=np.uint64)
    has = np.flatnonzero(counts)
    if not len(has):
        return out
    n = counts[has]
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    pieces = -(-n // 255)  # sums of 255 ones fit a byte
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    piece = np.arange(pieces.sum()) - np.repeat(first, pieces)
    starts = np.repeat(begin, pieces) + piece * 255
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        for lane in range(8):
            out[has] |= (2 * ones[:, lane] > n).astype(np.uint64) << np.uint64(8 * lane + k)
    return out


def shingles(text: bytes, size: int = 3) -> list[bytes]:
    """Word n-grams, space-joined, of text with A-Z lower-cased; of fewer words the whole sequence, of none nothing."""
    words = text.translate(_LOWER).split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, hashed: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fingerprint as signed long), one row per row; null text counts as empty (0).

    hashed: with a column hash, xxhash64 of the text.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            texts, found, hashes, counts = batch.column(1), [], [], []
            held = 0
            for t in texts:
                own = shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", size)
                hashes.extend([digest(s, seed) for s in own])
                counts.append(len(own))
                held += len(own)
                if held > BATCH_BYTES // 16:
                    found.append(fingerprint_of(np.array(hashes, dtype=np.uint64), np.array(counts, dtype=np.int64)))
                    hashes, counts, held = [], [], 0
            found.append(fingerprint_of(np.array(hashes, dtype=np.uint64), np.array(counts, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found).view(np.int64)), *batch.columns[2:]], names=["doc_id", "fingerprint", "hash"][: batch.num_columns])

    hashes = [F.xxhash64("text").alias("hash")] if hashed else []
    return docs.select("doc_id", "text", *hashes).mapInArrow(run, "doc_id long, fingerprint long" + ", hash long" * hashed)


def block_masks(blocks: int, distance: int, bits: int = 64) -> list[int]:
    """Masks of all unions of blocks - distance blocks: fingerprints at most `distance` apart agree under one of them."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    single = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(single[i] for i in some) for some in combinations(range(blocks), blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(distinct: DataFrame, distance: int = 2, blocks: int = 4, crowded: int = 64) -> DataFrame:
    """distinct(fingerprint) -> links(a, b) that connect exactly the fingerprints that links of <= distance bits connect.

    Join on blocks: pairs that agree on blocks - distance blocks, checked by Hamming distance. A bucket with over
    `crowded` fingerprints isn't paired up: there, fingerprints (distance 2 or less) that agree on a value one flipped
    bit away from each lie within 2 bits of each other, and all that share such a value are linked to the least of them.
    The rows are 1 + (bits outside the mask) for each fingerprint of a crowded bucket, whatever its size.
    """
    if distance != 2:
        crowded = 1 << 62
    masks = block_masks(blocks, distance)
    keyed = distinct.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("block", "bits"))
    sizes = keyed.groupBy("block", "bits").agg(F.count("*").alias("n")).where("n > 1")
    shared = save(keyed.join(sizes, ["block", "bits"]), "blocks")
    few = shared.where(F.col("n") <= crowded)
    left, right = few.select("block", "bits", F.col("fingerprint").alias("a")), few.select("block", "bits", F.col("fingerprint").alias("b"))
    pairs = left.join(right, ["block", "bits"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    if distance != 2:
        return pairs
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64) if not m >> b & 1]) for m in masks])
    many = shared.where(F.col("n") > crowded)
    ways = many.select("block", "fingerprint", F.explode(F.element_at(flips, F.col("block") + 1)).alias("flip")).select("block", "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("middle"))
    least = ways.groupBy("block", "middle").agg(F.min("fingerprint").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = ways.join(least, ["block", "middle"]).select("a", F.col("fingerprint").alias("b")).where("a != b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, distance: int = 2, blocks: int = 4, size: int = 3) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fingerprint long, component_id): the smallest doc_id reachable by close fingerprints.

    Null text counts as empty; empty texts share fingerprint 0 and link with each other and with what is near 0.
    Repeated rows give repeated rows. A null doc_id takes part, but names a component only if it has no other id.
    An empty table gives an empty table. Other columns are not read. Copies meet as one fingerprint before any join.
    """
    own, named = _groups(docs, distance, blocks, size)
    names = named.select("fingerprint", F.col("lead.doc_id").alias("component_id"))
    return own.join(names, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _groups(docs: DataFrame, distance: int = 2, blocks: int = 4, size: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fingerprint, hash) of every row, and (fingerprint, root, lead) of every fingerprint.

    hash: of the text; root: one for each group; lead: (no_id, doc_id, hash) of the group's first row, null ids last.
    """
    own = save(fingerprints(docs, size, hashed=True), "fingerprints")
    distinct = own.groupBy("fingerprint").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("lead"))
    distinct = save(distinct, "distinct-fingerprints")
    groups = components(near_links(distinct.select("fingerprint"), distance, blocks))
    named = distinct.join(groups, distinct.fingerprint == groups.vertex, "left").select("fingerprint", "lead", F.coalesce("component", "fingerprint").alias("root"))
    named = save(named, "roots")
    least = named.groupBy("root").agg(F.min("lead").alias("lead"))
    discard(distinct)
    return own, named.drop("lead").join(least, "root")


def keep_first(docs: DataFrame, **options: int) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, null ids last; of rows that have that id
    and are in the group, one stays. So different texts under a null or repeated id each count for their own group.

    Columns as they were. Rows are told apart by id and a 64-bit hash of the text. Only (doc_id, fingerprint, hash) and
    the texts of rows that lead a group cross the network.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))
    leads = _groups(docs, **options)[1].select("root", "lead.*").distinct().select(key.alias("key"), "no_id", "hash")
    # One exchange of the rows, by id and hash: the join and the choice among repeated rows both go by them.
    rows = docs.select(key.alias("key"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(leads, ["key", "no_id", "hash"], "left_semi").dropDuplicates(["key", "no_id", "hash"]).select("row.*")
