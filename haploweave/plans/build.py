"""Networks of all alignments at once: relational steps up to condensed haplotypes, then one kernel run per network."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import blocks
from ..session import ship
from .intnj import intnj
from .mjn import mjn
from .msn import msn, spanning_links
from .network import Graph, Haplotypes, NetworkError
from .tcs import tcs

ALGORITHMS: dict[str, Callable[..., Graph]] = {"MSN": msn, "MJN": mjn, "TCS": tcs, "IntNJ": intnj}
#: An element of a network: a vertex (kind v) or an edge (kind e).
ELEMENTS = "network_id string, kind string, index int, label string, hap_idx int, sequence string, inferred boolean, `from` int, `to` int, weight double, from_label string, to_label string"


def haplotypes(alignment: DataFrame, mask: bool = True, kind: str = "dna") -> DataFrame:
    """condensed() haplotypes of checked, masked and condensed alignments. A column datatype, if there, goes before kind."""
    sequences = A.checked(alignment)
    if mask:
        sequences = A.apply_mask(sequences, A.site_mask(sequences))
    haps = A.condense(sequences)
    return A.condensed(haps, A.site_patterns(haps, kind))


def _options(algorithm: str, epsilon: float, alpha: float) -> dict[str, float]:
    if algorithm not in ALGORITHMS:
        raise NetworkError(f'Unknown algorithm "{algorithm}".')
    return {"MSN": {"epsilon": epsilon}, "MJN": {"epsilon": epsilon}, "TCS": {}, "IntNJ": {"alpha": alpha}}[algorithm]


def elements(condensed: DataFrame, algorithm: str = "MJN", epsilon: float = 0, alpha: float = 0.5, kind: str = "dna") -> DataFrame:
    """Vertices and edges of every network (ELEMENTS), each built in one task from its haplotypes.

    The algorithms are sequential and a network's haplotypes are few (its sequences were condensed before), so that
    networks, not pairs, are what runs in parallel: they are dealt out however few bytes they have. Sampled vertices come first. A column datatype, if there, goes before kind.
    """
    options, build = _options(algorithm, epsilon, alpha), ALGORITHMS[algorithm]
    ship(condensed.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hap_idx")
        own = pdf["datatype"].iloc[0] if "datatype" in pdf else kind
        haps = Haplotypes(pdf["name"].tolist(), pdf["pattern_seq"].tolist(), list(pdf["weights"].iloc[0]), own)
        g = build(haps, **options)
        net = pdf["network_id"].iloc[0]
        rows = [(net, "v", v.index, v.label, v.origin, v.seq, v.origin is None, None, None, None, None, None) for v in g.vertices]
        rows += [(net, "e", e.index, None, None, None, None, e.a.index, e.b.index, float(e.weight), e.a.label, e.b.label) for e in g.edges]
        return pd.DataFrame(rows, columns=["network_id", "kind", "index", "label", "hap_idx", "sequence", "inferred", "from", "to", "weight", "from_label", "to_label"]).astype(object)

    slim = condensed.select(F.col("network_id").cast("string").alias("network_id"), "hap_idx", "name", "pattern_seq", "weights", *(c for c in condensed.columns if c == "datatype"))
    return blocks.spread(slim, "network_id").groupBy("network_id").applyInPandas(run, ELEMENTS)


def vertices(elements_: DataFrame) -> DataFrame:
    return elements_.where("kind = 'v'").select("network_id", "index", "label", "hap_idx", "sequence", "inferred")


def edges(elements_: DataFrame) -> DataFrame:
    return elements_.where("kind = 'e'").select("network_id", "index", "from", "to", F.col("weight").cast("int").alias("weight"))


def labelled_edges(elements_: DataFrame) -> DataFrame:
    """(network_id, edge_idx, from_label, weight, to_label): the edge list, in edge order by edge_idx."""
    return elements_.where("kind = 'e'").select("network_id", F.col("index").alias("edge_idx"), "from_label", F.col("weight").cast("int").alias("weight"), "to_label")


def with_frequencies(vertices_: DataFrame, haps: DataFrame) -> DataFrame:
    """vertices with frequency (and traits, where haps has them) of their haplotypes; inferred ones have 0 and none."""
    extra = [c for c in ("frequency", "traits") if c in haps.columns]
    joined = vertices_.join(haps.select(F.col("network_id").cast("string").alias("network_id"), "hap_idx", *extra), ["network_id", "hap_idx"], "left")
    return joined.withColumn("frequency", F.when(F.col("inferred"), 0.0).otherwise(F.col("frequency")))


def minimum_spanning_edges(distances: DataFrame, epsilon: float = 0) -> DataFrame:
    """(network_id, edge_idx, later, earlier, weight) from distances(network_id, i, j, d): the relaxed spanning network.

    One task per network over its pairs; no haplotypes needed.
    """
    ship(distances.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["i"].max()) + 1
        d = np.zeros((n, n), dtype=np.int64)
        d[pdf["i"], pdf["j"]] = pdf["d"]
        d = d + d.T
        net = pdf["network_id"].iloc[0]
        rows = [(net, k, a, b, w) for k, (a, b, w) in enumerate(spanning_links(d, epsilon))]
        return pd.DataFrame(rows, columns=["network_id", "edge_idx", "later", "earlier", "weight"])

    kind = distances.schema["network_id"].dataType.simpleString()
    return distances.groupBy("network_id").applyInPandas(run, f"network_id {kind}, edge_idx long, later long, earlier long, weight long")
