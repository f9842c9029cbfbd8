import math

import pytest

from haploweave.operators import alignment as A
from haploweave.plans import build
from haploweave.sources import nexus as N

TEXT = """#NEXUS [a comment; with a stop]
BEGIN TAXA; DIMENSIONS NTAX=3; TAXLABELS s1 's 2' s3 s1; END;
Begin Characters;
 Dimensions NChar = 6;
 Format Datatype = DNA Missing=? Gap=- MatchChar=.;
 Matrix
  s1 ACG [inside
  a comment] TAC
  's 2' ..T
  TTT
  s3 AC-...
 ;
End;
BEGIN TRAITS; DIMENSIONS NTRAITS=2; FORMAT labels=yes missing=? separator=comma; TRAITLATITUDE 1 2; TRAITLONGITUDE -3 4; TRAITLABELS North South;
MATRIX
s1 1,2
's 2' ?,3
s3 1,,2
s1 5,6
;
END;
BEGIN GEOTAGS; FORMAT labels=yes separator=spaces; MATRIX
s1 10.5S 20E 3
s1 1 2
; END;
BEGIN TREES; TRANSLATE 1 s1; TREE t = (s1,(s2,s3)); END;
BEGIN NETWORK; VERTICES
1 0 0,
2 1.5 2
; EDGES
1 1 2,
2 2 1 4
; VLABELS
1 3 4
; END;
BEGIN UNKNOWN; MATRIX x; END;
"""


def test_all_blocks():
    d = N.parse(TEXT)
    assert d.taxa == ["s1", "s 2", "s3"]
    assert d.characters.matrix == {"s1": "ACGTAC", "s 2": "ACTTTT", "s3": "AC-TAC"}
    assert (d.characters.nchar, d.characters.datatype, d.characters.missing, d.characters.gap) == (6, "dna", "?", "-")
    assert d.traits.labels == ["North", "South"]
    assert d.traits.latitude == [1, 2]
    assert d.traits.matrix == {"s1": [5, 6], "s 2": [0, 3], "s3": [1, 2]}  # last row wins; empty cells fall out
    assert d.geotags.rows == [("s1", -10.5, 20, 3), ("s1", 1, 2, 1)]
    assert d.trees == ["(s1,(s2,s3))"]
    assert d.network.edges == [(1, 1, 2, 1), (2, 2, 1, 4)]
    assert d.network.vertices[1] == (2, 1.5, 2)


def test_data_only_and_case():
    d = N.parse("#nexus\nbegin DATA; matrix\na ACGT\nb ACGA\n; endblock;")
    assert d.taxa == ["a", "b"]
    assert d.traits is None and d.geotags is None and d.trees is None and d.network is None


@pytest.mark.parametrize("text", ["", "BEGIN DATA;", "#NEXUS\nBEGIN TRAITS; END;", "#NEXUS\nBEGIN TAXA; TAXLABELS a; END;", "#NEXUS\nBEGIN DATA; MATRIX\na\n; END;", None, "#NEXUS BEGIN DATA; MATRIX\n'a ACGT\n; END;"])
def test_errors(text):
    with pytest.raises(N.NexusError):
        N.parse(text)


def test_traits_in_taxa_order_and_unknown_taxon():
    base = "#NEXUS\nBEGIN DATA; MATRIX\na AC\nb AC\n; END; BEGIN TRAITS; FORMAT SEPARATOR=TAB {0}; TRAITLABELS X; MATRIX\n{1}\n; END;"
    assert N.parse(base.format("", "1\n2")).traits.matrix == {"a": [1], "b": [2]}
    with pytest.raises(N.NexusError):
        N.parse(base.format("LABELS=YES", "c 1"))


def test_numbers():
    assert math.isnan(N.number("x")) and N.number(" ") == 0
    assert N.coordinate("12.5w") == -12.5
    with pytest.raises(N.NexusError):
        N.coordinate("1e5")


def test_data_source(spark, tmp_path):
    (tmp_path / "one.nex").write_text(TEXT)
    (tmp_path / "two.NEX").write_text("#NEXUS\nBEGIN DATA; MATRIX\na AC\n; END;")
    (tmp_path / "other.txt").write_text("x")
    t = N.read_nexus(spark, str(tmp_path))
    assert sorted((r.dataset_id, r.taxon_idx, r.seq) for r in t["characters"].collect()) == [("one", 0, "ACGTAC"), ("one", 1, "ACTTTT"), ("one", 2, "AC-TAC"), ("two", 0, "AC")]
    assert t["traits"].count() == 6 and t["net_edges"].count() == 2 and t["geotags"].count() == 2
    assert N.alignment(t).count() == 4


def test_parse_texts(spark):
    df = spark.createDataFrame([("d", TEXT)], "dataset_id string, text string")
    assert [r.label for r in N.parse_texts(df, "trait_labels").orderBy("trait_idx").collect()] == ["North", "South"]


def test_datatype_goes_along(spark):
    """A binary and a DNA file, with the letters N and B, which only DNA reads as unknown; proteins have no network."""
    made = "#NEXUS\nBEGIN DATA; FORMAT DATATYPE={}; MATRIX\na NAB\nb BAN\nc NCB\n; END;"
    read = lambda *kinds: {t: N.parse_texts(spark.createDataFrame([(k, made.format(k)) for k in kinds], "dataset_id string, text string"), t) for t in ("characters", "characters_meta")}
    a = N.alignment(read("DNA", "Standard"))
    assert {(r.network_id, r.datatype) for r in a.collect()} == {("DNA", "dna"), ("Standard", "binary")}
    haps = build.haplotypes(a, mask=False)
    d = {(r.network_id, r.i, r.j): r.d for r in A.distances(haps).collect()}
    assert d == {("DNA", 1, 0): 0, ("DNA", 2, 0): 1, ("DNA", 2, 1): 1, ("Standard", 1, 0): 2, ("Standard", 2, 0): 1, ("Standard", 2, 1): 3}
    edges = {(r.network_id, r.from_label, r.weight, r.to_label) for r in build.labelled_edges(build.elements(haps, "MSN")).collect()}
    assert {e for e in edges if e[0] == "Standard"} == {("Standard", "c", 1, "a"), ("Standard", "b", 2, "a")}
    with pytest.raises(Exception, match="protein"):
        build.haplotypes(N.alignment(read("protein"))).collect()


def test_text_round_trip():
    text = N.nexus_text([{"taxon": "a b", "seq": "AC"}, {"taxon": "c", "seq": "GT"}])
    assert N.parse(text).characters.matrix == {"a b": "AC", "c": "GT"}
