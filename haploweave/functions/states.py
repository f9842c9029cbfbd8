"""Character states of alignments as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States that stand for unknown, by datatype.
AMBIGUOUS = {"dna": ("-", "?", "N", "Y", "R", "M", "S", "V", "W", "K", "D", "H", "B"), "binary": ("-", "?"), "aa": ("-", "X", "?")}


def datatype(name: Column) -> Column:
    """binary for standard and binary, aa for protein names, dna for anything else and null."""
    low = F.lower(F.coalesce(name, F.lit("dna")))
    return F.when(low.isin("standard", "binary"), "binary").when(low.isin("protein", "aa", "aminoacid"), "aa").otherwise("dna")


def ambiguous(state: Column, kind: str | Column = "dna") -> Column:
    """Whether a state stands for unknown; kind: a datatype, or a column of them."""
    up = F.upper(state)
    if isinstance(kind, str):
        return up.isin(*AMBIGUOUS[kind])
    return F.when(kind == "binary", up.isin(*AMBIGUOUS["binary"])).when(kind == "aa", up.isin(*AMBIGUOUS["aa"])).otherwise(up.isin(*AMBIGUOUS["dna"]))


def characters(text: Column) -> Column:
    """The characters of a string as an array; of an empty one none."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def expand_match(text: Column, top: Column, match: str = ".") -> Column:
    """text with each match character replaced by top's character at the same place (kept where top is shorter)."""
    pairs = F.zip_with(characters(text), characters(top), lambda c, t: F.when(c == match, F.coalesce(t, c)).otherwise(c))
    return F.array_join(F.filter(pairs, lambda c: c.isNotNull()), "")


def nucleotide_class(state: Column, masked: Column | None = None) -> Column:
    """Colour class of an alignment cell: a, t (also U), g, c, or gap for all else and for masked sites."""
    up = F.upper(state)
    found = F.when(up == "A", "a").when(up.isin("T", "U"), "t").when(up == "G", "g").when(up == "C", "c").otherwise("gap")
    return found if masked is None else F.when(masked, "gap").otherwise(found)


def coordinate(text: Column) -> Column:
    """Decimal degrees with an optional hemisphere letter; south and west negative; null if it isn't one."""
    shape = r"^(-?\d+(?:\.\d+)?)([NSEWnsew])?$"
    t = F.trim(text)
    number = F.regexp_extract(t, shape, 1).try_cast("double")
    return F.when(F.lower(F.regexp_extract(t, shape, 2)).isin("s", "w"), -F.abs(number)).otherwise(number)
