"""From aligned sequences to haplotypes, site patterns and distances. All networks at once, by network_id.

alignment: (network_id, taxon_idx, taxon, seq), and datatype (dna, binary or aa) if the networks differ in it: the steps
carry that column along, and it goes before their argument `kind`. Everything here but distances is DataFrame built-ins; sequences are condensed,
rows and columns, before any pair is formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.states import ambiguous, characters
from . import blocks


def ordered_sequences(taxa: DataFrame, sequences: DataFrame) -> DataFrame:
    """taxa(network_id, taxon_idx, taxon) with their upper-cased sequences; a taxon without one fails the job."""
    joined = taxa.join(sequences.select("network_id", "taxon", "seq"), ["network_id", "taxon"], "left")
    missing = F.concat(F.lit("Taxon has no character sequence: "), F.col("taxon"))
    seq = F.when(F.col("seq").isNull(), F.raise_error(missing)).otherwise(F.upper("seq"))
    return joined.select("network_id", "taxon_idx", "taxon", seq.alias("seq"))


def _datatype(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "datatype"]


def checked(alignment: DataFrame) -> DataFrame:
    """The alignment; it fails if a network's sequences differ in length, or if its datatype is aa."""
    lengths = alignment.groupBy(F.col("network_id").alias("net")).agg(F.min(F.length("seq")).alias("least"), F.max(F.length("seq")).alias("most"))
    joined = alignment.join(lengths, F.col("network_id").eqNullSafe(F.col("net")))
    seq = F.when(F.col("least") == F.col("most"), F.col("seq")).otherwise(F.raise_error(F.lit("Sequences are not the same length.")))
    if _datatype(alignment):
        seq = F.when(F.col("datatype") == "aa", F.raise_error(F.lit("Haplotype networks should not be inferred from protein data."))).otherwise(seq)
    return joined.withColumn("seq", seq).select(*alignment.columns)


def known_taxa(rows: DataFrame, taxa: DataFrame) -> DataFrame:
    """rows(network_id, taxon, ...); one whose taxon isn't in taxa(network_id, taxon) fails the job."""
    names = taxa.select("network_id", "taxon", F.lit(True).alias("known")).distinct()
    joined = rows.join(names, ["network_id", "taxon"], "left")
    taxon = F.when(F.col("known"), F.col("taxon")).otherwise(F.raise_error(F.concat(F.lit("Taxon is not defined: "), F.col("taxon"))))
    return joined.withColumn("taxon", taxon).select(*rows.columns)


def sites(alignment: DataFrame) -> DataFrame:
    """Long form: (network_id, taxon_idx, site, state)."""
    return alignment.select("network_id", "taxon_idx", F.posexplode(characters(F.upper("seq"))).alias("site", "state"))


def ambiguity_flags(alignment: DataFrame) -> DataFrame:
    """(network_id, site, undefined): whether any sequence is undefined there. The nucleotide set serves all datatypes."""
    return sites(alignment).groupBy("network_id", "site").agg(F.max(ambiguous(F.col("state"))).alias("undefined"))


def site_mask(alignment: DataFrame, percent: float = 5.0) -> DataFrame:
    """(network_id, site, keep): all sites, unless over `percent` of a network's sites have undefined states: then those go."""
    flags = ambiguity_flags(alignment)
    by = Window.partitionBy("network_id")
    share = 100.0 * F.sum(F.col("undefined").cast("int")).over(by) / F.count("*").over(by)
    return flags.select("network_id", "site", (~F.col("undefined") | (share <= percent)).alias("keep"))


def masked_sites(mask: DataFrame) -> DataFrame:
    """(network_id, masked array<int>): the sites that go, ascending; networks without any have an empty array."""
    gone = F.collect_list(F.when(~F.col("keep"), F.col("site")))
    return mask.groupBy("network_id").agg(F.sort_array(gone).alias("masked"))


def apply_mask(alignment: DataFrame, mask: DataFrame) -> DataFrame:
    """The alignment with kept sites only. A mask of another length than the sequences fails the job."""
    kept = mask.groupBy("network_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("site", "keep"))), lambda x: x["keep"]).alias("flags"))
    joined = alignment.join(kept, "network_id", "left")
    flags = F.coalesce("flags", F.array().cast("array<boolean>"))
    flags = F.when(F.size(flags) == F.length("seq"), flags).otherwise(F.raise_error(F.lit("Mask and alignment differ in length.")))
    chosen = F.filter(F.zip_with(characters(F.col("seq")), flags, lambda c, k: F.when(k, c)), lambda c: c.isNotNull())
    return joined.select("network_id", "taxon_idx", "taxon", F.array_join(chosen, "").alias("seq"), *_datatype(alignment))


def condense(alignment: DataFrame) -> DataFrame:
    """Haplotypes: (network_id, hap_idx, name, seq, originals, frequency), one per distinct sequence.

    Name and order are those of the first taxon with the sequence. Rows meet as partial aggregates on the sequence.
    """
    groups = alignment.groupBy("network_id", *_datatype(alignment), "seq").agg(F.min(F.struct("taxon_idx", "taxon")).alias("lead"), F.sort_array(F.collect_list("taxon_idx")).alias("originals"), F.count("*").cast("double").alias("frequency"))
    place = F.row_number().over(Window.partitionBy("network_id").orderBy("lead.taxon_idx")) - 1
    return groups.select("network_id", place.alias("hap_idx"), F.col("lead.taxon").alias("name"), "seq", "originals", "frequency", *_datatype(alignment))


def site_patterns(haplotypes: DataFrame, kind: str = "dna") -> DataFrame:
    """(network_id, site, pattern_idx): sites that split the haplotypes alike share a pattern; numbered by first site.

    Sites are alike if they divide the haplotypes into the same sets, of unknown states those of the same state. A set is
    told by the exclusive or of two hashes of its members and its size, a site by that of its sets': partial aggregates
    that merge in any order, so that no row holds a column of a network. Sites that are unknown throughout have none.
    """
    own = _datatype(haplotypes)
    unknown = ambiguous(F.col("state"), F.col("datatype") if own else kind)
    states = haplotypes.select("network_id", *own, "hap_idx", F.posexplode(characters("seq")).alias("site", "state"))
    print_ = lambda *of: [F.bit_xor(F.xxhash64(F.lit(salt), *of)).alias(f"p{salt}") for salt in (1, 2)]
    sets = states.groupBy("network_id", *own, "site", "state").agg(F.count("*").alias("n"), *print_("hap_idx"))
    sets = sets.withColumn("unknown", F.when(unknown, F.col("state")))
    alike = sets.groupBy("network_id", "site").agg(F.bool_or(F.col("unknown").isNull()).alias("tells"), *print_("p1", "p2", "n", F.coalesce("unknown", F.lit("")))).where("tells")
    first = alike.withColumn("first", F.min("site").over(Window.partitionBy("network_id", "p1", "p2")))
    return first.select("network_id", "site", (F.dense_rank().over(Window.partitionBy("network_id").orderBy("first")) - 1).alias("pattern_idx"))


def pattern_weights(patterns: DataFrame) -> DataFrame:
    """(network_id, pattern_idx, site, weight): the first site of each pattern and how many sites have it."""
    return patterns.groupBy("network_id", "pattern_idx").agg(F.min("site").alias("site"), F.count("*").alias("weight"))


def condensed(haplotypes: DataFrame, patterns: DataFrame) -> DataFrame:
    """haplotypes with pattern_seq (a state for each pattern) and weights (array, of the network's patterns)."""
    by = pattern_weights(patterns).groupBy("network_id").agg(F.sort_array(F.collect_list(F.struct("pattern_idx", "site", "weight"))).alias("p"))
    out = haplotypes.join(by, "network_id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<struct<pattern_idx:int,site:int,weight:bigint>>")))
    picked = F.array_join(F.transform("p", lambda x: F.substring(F.col("seq"), x["site"] + 1, F.lit(1))), "")
    return out.select("network_id", "hap_idx", "name", picked.alias("pattern_seq"), F.transform("p", lambda x: x["weight"]).alias("weights"), "seq", "originals", "frequency", *_datatype(haplotypes))


def distances(condensed_: DataFrame, kind: str = "dna", block: int = blocks.BLOCK) -> DataFrame:
    """(network_id, i, j, d) for i > j: weights of the patterns in which both states are defined and differ.

    Haplotypes meet in blocks, and a task holds two blocks at a time and the pairs between them.
    """
    rows = condensed_.select("network_id", F.col("hap_idx").alias("index"), F.col("pattern_seq").alias("seq"), "weights", *_datatype(condensed_))
    return blocks.distances(blocks.stacked(rows, kind, block))


def haplotype_traits(alignment: DataFrame, haplotypes: DataFrame, traits: DataFrame, labels: DataFrame) -> DataFrame:
    """(network_id, hap_idx, trait_idx, count): traits(network_id, taxon, trait_idx, count) summed for each haplotype.

    Every haplotype has every label of labels(network_id, trait_idx, label), 0 where no taxon counts; traits beyond the
    labels are ignored.
    """
    taxa = haplotypes.select("network_id", "hap_idx", F.explode("originals").alias("taxon_idx"))
    named = taxa.join(alignment.select("network_id", "taxon_idx", "taxon"), ["network_id", "taxon_idx"])
    sums = named.join(traits, ["network_id", "taxon"]).groupBy("network_id", "hap_idx", "trait_idx").agg(F.sum("count").alias("count"))
    grid = haplotypes.select("network_id", "hap_idx").join(labels.select("network_id", "trait_idx"), "network_id")
    return grid.join(sums, ["network_id", "hap_idx", "trait_idx"], "left").select("network_id", "hap_idx", "trait_idx", F.coalesce("count", F.lit(0.0)).alias("count"))


def with_traits(haplotypes: DataFrame, counts: DataFrame) -> DataFrame:
    """haplotypes with traits (array in label order); the frequency becomes the traits' sum, 0 without any."""
    by = counts.groupBy("network_id", "hap_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("trait_idx", "count"))), lambda x: x["count"]).alias("traits"), F.sum("count").alias("total"))
    out = haplotypes.join(by, ["network_id", "hap_idx"], "left")
    return out.withColumn("frequency", F.coalesce("total", "frequency")).drop("total")


def trait_summary(traits: DataFrame) -> DataFrame:
    """(network_id, trait_idx, n_sequences, n_samples): taxa with a positive count, and the sum of those counts."""
    positive = F.when(~F.isnan("count") & (F.col("count") > 0), F.col("count"))
    return traits.groupBy("network_id", "trait_idx").agg(F.count(positive).alias("n_sequences"), F.coalesce(F.sum(positive), F.lit(0.0)).alias("n_samples"))
