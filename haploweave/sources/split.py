"""Alignments of Nexus files of any size: a file is read in byte ranges by many tasks, each range once for each step.

Whether a range begins inside a quote or a comment hangs on all that lies before it. So each range first tells what it makes
of every state it may begin in; put together in order, these give the state at each range. Then ranges find the ends of
statements, one task a file reads the short statements (taxa, format), and ranges cut their share of the matrix into lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.states import expand_match
from ..session import ship
from ..shared import save
from .nexus import _HEADER, NexusError, _labelled, _NexusReader, _Reader, _statements

#: Bytes of a range, and of a statement's start that is read to see what it is.
RANGE, HEAD = 64 << 20, 1 << 16
#: What may last over the border of ranges: nothing, or what is open, by the byte that ends it.
STATES = (b"", b"'", b'"', b"]")
_OPENS = re.compile(rb"""['"\[;]""")
_CLOSED_BY = {b"'": 1, b'"': 2, b"[": 3}
_MATRIX = re.compile(rb"(?:\s|\[[^\]]*\])*matrix", re.I)


def spans(data: bytes, state: int) -> Iterator[tuple[int, int, int]]:
    """(state, start, stop) of quotes and comments, (0, at, at) of statement ends, then (state, size, size) at the end."""
    at, size = 0, len(data)
    while True:
        if state:
            stop = data.find(STATES[state], at)
            if stop < 0:
                yield state, at, size
                yield state, size, size
                return
            yield state, at, stop + 1
            at, state = stop + 1, 0
        found = _OPENS.search(data, at)
        if not found:
            yield 0, size, size
            return
        at = found.start()
        if found[0] == b";":
            yield 0, at, at
            at += 1
        else:
            # The opening byte belongs to the span: blank it here, and look for the end after it.
            state = _CLOSED_BY[found[0]]
            if state == 3:
                yield 3, at, at + 1
            at += 1


def final_state(data: bytes, state: int) -> int:
    for state, _, _ in spans(data, state):  # noqa: B007
        pass
    return state


def without_comments(data: bytes, state: int) -> bytes:
    """The same number of bytes: those of comments are zero, but for line breaks."""
    out = bytearray(data)
    for kind, a, b in spans(data, state):
        if kind == 3 and b > a:
            out[a:b] = re.sub(rb"[^\r\n]", b"\0", data[a:b])
    return bytes(out)


def _fs(path: str) -> Any:
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")[0]


def _bytes(f: Any, start: int, size: int) -> bytes:
    f.seek(start)
    return f.read(size)


def lines_of(f: Any, start: int, size: int, state: int, first: int, stop: int) -> Iterator[tuple[int, str | None, str]]:
    """(offset, name, states) of the matrix lines that begin in a range; a line that goes on with the taxon before the
    range has no name. The matrix runs from `first` to `stop`."""
    skip = max(first - start, 0)
    data = _bytes(f, start, min(size, stop - start))
    while start + len(data) < stop and not data.endswith(b"\n"):
        more = _bytes(f, start + len(data), min(HEAD, stop - start - len(data)))
        cut = more.find(b"\n") + 1
        data += more[:cut] if cut else more
    held = without_comments(data, state)
    at, last = skip, None
    if start > first and _bytes(f, start - 1, 1) != b"\n":
        at = (held.find(b"\n") + 1) or len(held)
    while at < len(held) and at < size:
        end = held.find(b"\n", at)
        end = len(held) if end < 0 else end
        row = held[at:end].replace(b"\0", b"").decode().strip()
        if row:
            name, states = _labelled(row)
            states = "".join(states.split())
            if name and states:
                last = name
            elif name:
                name, states = last, "".join(row.split())
            if states:
                yield start + at, name, states
        at = end + 1


def head_of(f: Any, ends: list[int]) -> tuple[list[str], str, int, int]:
    """Taxa, match character, and where the matrix begins and stops (-1: none)."""
    reader, start, where = _Reader(), 0, (-1, -1)
    for k, end in enumerate(ends):
        head = _bytes(f, start, min(HEAD, end - start))
        if reader.block == "characters" and (m := _MATRIX.match(head)):
            if where[0] >= 0:
                raise NexusError("More than one matrix of characters: read such a file whole.")
            where = (start + m.end(), end)
        else:
            words = next(_statements(head.decode("utf-8", "ignore")), "")
            if k == 0:
                if not (m := _HEADER.match(words + "\n")):
                    raise NexusError("No Nexus header found.")
                words = words[m.end() :].strip()
            word = (words.split(None, 1) or [""])[0].lower()
            if word in ("begin", "end", "endblock", "taxlabels") or reader.block in ("taxa", "characters"):
                whole = next(_statements(_bytes(f, start, end - start).decode()), "") if end - start > HEAD else words
                reader.take(_HEADER.sub("", whole, count=1).strip() if k == 0 else whole)
        start = end + 1
    if reader.doc.characters is None:
        raise NexusError("A Nexus file must include a CHARACTERS or DATA block.")
    return list(reader.doc.taxa or ()), reader.match, *where


def read_characters(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(dataset_id, taxon_idx, taxon, seq) of a Nexus file or a folder of such, as the table characters of read_nexus().

    Lines of a taxon may stand together, follow it, or be interleaved. A line, and a taxon's whole sequence, are held by one
    task. Files without a header or characters, with a line without states at the start, or with two matrices fail the job.
    """
    ship(spark)
    names = [p.path for p in _NexusReader({"path": path}, "characters").partitions()]
    files = [(n, re.sub(r"\.(nex|nexus)$", "", n.rsplit("/", 1)[-1], flags=re.I), _fs(path).get_file_info(n).size) for n in names]
    listed = spark.createDataFrame(files, "path string, dataset_id string, bytes long")
    last = F.greatest(F.floor((F.col("bytes") - 1) / size), F.lit(0)).cast("long")
    ranges = listed.select("path", "dataset_id", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("range"))
    ranges = ranges.select("*", (F.col("range") * size).alias("start"), F.least(F.lit(size), F.col("bytes") - F.col("range") * size).alias("size")).repartition("path", "range")

    def each(run: Any, out: list[str]) -> Any:
        """A function of (row, file) that gives rows, over ranges."""

        def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    with _fs(path).open_input_file(row.path) as f:
                        yield pd.DataFrame(list(run(row, f)), columns=out).astype(object)

        return over

    def exits(row: Any, f: Any) -> Iterator[tuple]:
        data = _bytes(f, row.start, row.size)
        yield row.path, row.range, [final_state(data, s) for s in range(len(STATES))]

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = 0, []
        for row in pdf.sort_values("range").itertuples(index=False):
            out.append((row.path, row.range, state))
            state = int(row.exits[state])
        return pd.DataFrame(out, columns=["path", "range", "state"])

    def ends(row: Any, f: Any) -> Iterator[tuple]:
        for kind, a, b in list(spans(_bytes(f, row.start, row.size), int(row.state)))[:-1]:
            if kind == 0 and a == b:
                yield row.path, row.start + a
        if row.start + row.size == row.bytes:
            yield row.path, row.bytes

    def heads(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["path"].iloc[0]
        with _fs(path).open_input_file(name) as f:
            taxa, match, first, stop = head_of(f, sorted(pdf["at"].tolist()))
        return pd.DataFrame({"path": [name], "taxa": [taxa], "match": [match], "first": [first], "stop": [stop]})

    def lines(row: Any, f: Any) -> Iterator[tuple]:
        for at, name, states in lines_of(f, row.start, row.size, int(row.state), row.first, row.stop):
            yield row.dataset_id, row.range, at, name, states

    told = ranges.mapInPandas(each(exits, ["path", "range", "exits"]), "path string, range long, exits array<int>")
    states = told.groupBy("path").applyInPandas(ordered, "path string, range long, state int")
    known = save(ranges.join(states, ["path", "range"]), "ranges")
    found = known.mapInPandas(each(ends, ["path", "at"]), "path string, at long")
    head = save(listed.select("path", "dataset_id").join(found.groupBy("path").applyInPandas(heads, "path string, taxa array<string>, match string, first long, stop long"), "path"), "heads")
    inside = known.join(head.drop("dataset_id", "taxa"), "path").where("start < stop AND start + size > first").repartition("path", "range")
    cut = save(inside.mapInPandas(each(lines, ["dataset_id", "range", "at", "taxon", "states"]), "dataset_id string, range long, at long, taxon string, states string"), "lines")
    # Lines without a name go on with the last one of the ranges before theirs.
    ranked = cut.groupBy("dataset_id", "range").agg(F.max_by("taxon", F.when(F.col("taxon").isNotNull(), F.col("at"))).alias("own"))
    before = Window.partitionBy("dataset_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranked.select("dataset_id", "range", F.last("own", ignorenulls=True).over(before).alias("carried"))
    named = cut.join(carried, ["dataset_id", "range"]).withColumn("taxon", F.coalesce("taxon", "carried"))
    named = named.withColumn("taxon", F.when(F.col("taxon").isNull(), F.raise_error(F.concat(F.lit("No sequence found for taxon "), "states"))).otherwise(F.col("taxon")))
    rows = named.groupBy("dataset_id", "taxon").agg(F.min("at").alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "states"))), lambda x: x["states"]), "").alias("seq"))
    tops = rows.groupBy("dataset_id").agg(F.min("at").alias("top_at"), F.min_by("seq", "at").alias("top"))
    rows = rows.join(tops, "dataset_id").join(head.select("dataset_id", "match"), "dataset_id")
    # Match characters as the engine knows them are dots; another one stands for a dot that isn't one.
    plain = F.when(F.col("match") == ".", F.col("seq")).otherwise(F.translate("seq", ".", "\u0001"))
    dotted = F.when(F.col("match") == ".", plain).when(F.length("match") == 1, F.replace(plain, F.col("match"), F.lit("."))).otherwise(plain)
    # Only sequences with a match character are taken apart.
    expanded = F.when(F.contains(dotted, F.lit(".")), F.translate(expand_match(dotted, F.col("top")), "\u0001", ".")).otherwise(F.col("seq"))
    rows = rows.select("dataset_id", "taxon", "at", F.when(F.col("at") == F.col("top_at"), F.col("seq")).otherwise(expanded).alias("seq"))
    given = head.select("dataset_id", F.posexplode("taxa").alias("pos", "taxon"))
    both = rows.join(given, ["dataset_id", "taxon"], "full").join(head.select("dataset_id", F.size("taxa").alias("n")), "dataset_id")
    late = F.row_number().over(Window.partitionBy("dataset_id", F.col("pos").isNull()).orderBy("at")) - 1
    return both.select("dataset_id", F.coalesce("pos", F.col("n") + late).cast("int").alias("taxon_idx"), "taxon", "seq")
