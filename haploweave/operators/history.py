"""Undo and redo over logs of actions: a fold that runs in parallel within one log, too.

A log's states form a line of at most `most` + 1 versions with a cursor on it: an edit cuts off what lies after the cursor
and appends, undo and redo move the cursor as far as there is room. What a stretch of a log does to that line hangs only on
how much lies before and after the cursor when it begins, that is on few cases. So each stretch is first run for all cases
at once, then the stretches of a log are put together in order, and last each is run again from the line it really meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..shared import discard, save

#: Actions of one stretch, and how many versions can be undone.
STRETCH, MOST = 1 << 20, 20
EDIT, UNDO, REDO, NOTHING = 0, 1, 2, 3


def kinds(action: Column) -> Column:
    """Codes of the actions edit, undo and redo; all others do nothing."""
    return F.when(action == "edit", EDIT).when(action == "undo", UNDO).when(action == "redo", REDO).otherwise(NOTHING)


def replayed(line: list, cursor: int, codes: np.ndarray, ids: list, most: int) -> Iterator[tuple]:
    """(version, n_undo, n_redo) after each action, from a line of versions and its cursor."""
    line = list(line)
    for code, now in zip(codes.tolist(), ids, strict=True):
        if code == EDIT:
            line[cursor + 1 :] = [now]
            cursor += 1
            if cursor > most:
                del line[0]
                cursor = most
        elif code == UNDO:
            cursor = max(cursor - 1, 0)
        elif code == REDO:
            cursor = min(cursor + 1, len(line) - 1)
        yield line[cursor], cursor, len(line) - 1 - cursor


def cases(most: int) -> np.ndarray:
    """All (length, cursor) that a line may have, in a fixed order: case(length, cursor) is the row of one."""
    return np.array([(length, cursor) for length in range(1, most + 2) for cursor in range(length)])


def case(length: int, cursor: int) -> int:
    return length * (length - 1) // 2 + cursor


def summary(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What actions make of a line in each case: (entries, length, cursor, which).

    which: for each of cases(most) the row of the other three. An entry is the place of an action, or -1 - k for the k-th
    version of the line at the start. Cases that have become equal go on as one.
    """
    start = cases(most)
    length, cursor, which = start[:, 0].copy(), start[:, 1].copy(), np.arange(len(start))
    entries = np.where(np.arange(most + 1) < length[:, None], -1 - np.arange(most + 1), 0)
    for i, code in enumerate(codes.tolist()):
        if code == EDIT:
            full = cursor == most
            if full.any():
                entries[full, :-1] = entries[full, 1:]
                cursor[full] -= 1
            cursor += 1
            length = cursor + 1
            entries[np.arange(len(cursor)), cursor] = i
        elif code == UNDO:
            cursor = np.maximum(cursor - 1, 0)
        elif code == REDO:
            cursor = np.minimum(cursor + 1, length - 1)
        if len(cursor) > 1 and i % 16 == 15:
            entries = np.where(np.arange(most + 1) < length[:, None], entries, 0)
            rows, back = np.unique(np.column_stack([entries, length, cursor]), axis=0, return_inverse=True)
            entries, length, cursor, which = rows[:, :-2].copy(), rows[:, -2].copy(), rows[:, -1].copy(), back.ravel()[which]
    return entries, length, cursor, which


def versions(log: DataFrame, order: tuple[str, ...], stretch: int = STRETCH, most: int = MOST) -> DataFrame:
    """log(key, id long, code, order columns) -> (key, id, version long, n_undo int, n_redo int): after each action the id of
    the edit whose state is shown (null: the state at the start), and how many versions can be undone and redone.

    The order columns, then the id, order the actions of a key (nulls first). Keys may be null; so may ids, which then can't
    be told from the start. Unknown and null codes do nothing. Actions are cut by key and order into stretches of about
    `stretch`; one task holds one stretch, or the summaries of one key: at most a few hundred short lists a stretch.
    """
    spark = ship(log.sparkSession)
    by = list(dict.fromkeys([*order, "id"]))
    picked = log.select("key", "id", F.coalesce(F.col("code").cast("int"), F.lit(NOTHING)).alias("code"), *(c for c in order if c not in ("key", "id", "code")))
    n = max(picked.count() // stretch + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = save(picked.repartitionByRange(n, "key", *by).withColumn("stretch", F.spark_partition_id()), "log")
    key_type, shapes = cut.schema["key"].dataType.simpleString(), ["key", "stretch"]
    groups = cut.select(*shapes).distinct().groupBy("key").agg(F.min("stretch").alias("first"), F.max("stretch").alias("last"))
    # At most one key a border between stretches goes on into the next one.
    long = groups.where("first < last").withColumnRenamed("key", "long_key")
    several = cut.join(long, F.col("key").eqNullSafe(F.col("long_key"))).where("stretch < last").drop("long_key", "first", "last")

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by, na_position="first", kind="stable")
        ids = [None if pd.isna(x) else int(x) for x in pdf["id"]]
        entries, length, cursor, which = summary(pdf["code"].to_numpy(), most)
        lines = [[int(e) if e < 0 else 0 for e in row[:k]] for row, k in zip(entries.tolist(), length.tolist(), strict=True)]
        made = [[None if e < 0 else ids[e] for e in row[:k]] for row, k in zip(entries.tolist(), length.tolist(), strict=True)]
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "stretch": [pdf["stretch"].iloc[0]], "old": [lines], "made": [made], "cursor": [cursor.tolist()], "which": [which.tolist()]})

    def put_together(pdf: pd.DataFrame) -> pd.DataFrame:
        line, cursor, out = [None], 0, []
        for row in pdf.sort_values("stretch").itertuples(index=False):
            k = int(row.which[case(len(line), cursor)])
            line = [line[-1 - int(o)] if o < 0 else (None if pd.isna(m) else int(m)) for o, m in zip(row.old[k], row.made[k], strict=True)]
            cursor = int(row.cursor[k])
            out.append((row.key, row.stretch + 1, line, cursor))
        return pd.DataFrame(out, columns=["key", "stretch", "line", "cursor"]).astype({"line": object})

    def replay(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "id", "version", "n_undo", "n_redo"]
        if left.empty:
            return pd.DataFrame([], columns=names)
        left = left.sort_values(by, na_position="first", kind="stable")
        ids = [None if pd.isna(x) else int(x) for x in left["id"]]
        line = [None if x is None or pd.isna(x) else int(x) for x in right["line"].iloc[0]] if len(right) else [None]
        rows = list(replayed(line, int(right["cursor"].iloc[0]) if len(right) else 0, left["code"].to_numpy(), ids, most))
        out = pd.DataFrame({"key": left["key"].to_numpy(), "id": pd.array(ids, dtype="Int64"), "version": pd.array([r[0] for r in rows], dtype="Int64")})
        return out.assign(n_undo=[r[1] for r in rows], n_redo=[r[2] for r in rows])[names]

    summaries = several.groupBy(*shapes).applyInPandas(summarise, f"key {key_type}, stretch int, old array<array<int>>, made array<array<bigint>>, cursor array<int>, which array<int>")
    starts = save(summaries.groupBy("key").applyInPandas(put_together, f"key {key_type}, stretch int, line array<bigint>, cursor int"), "starts")
    out = save(cut.groupBy(*shapes).cogroup(starts.groupBy(*shapes)).applyInPandas(replay, f"key {key_type}, id bigint, version bigint, n_undo int, n_redo int"), "versions")
    discard(cut)
    discard(starts)
    return out
