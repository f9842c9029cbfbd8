"""Undo and redo of logs against the plain stacks."""

import random

import numpy as np
from pyspark.sql import functions as F

from haploweave.operators import history as H
from haploweave.sources.project import History

LOG = "key string, at int, id long, action string"


def stacks(actions, most=20):
    """(version, n_undo, n_redo) after each action, by two stacks."""
    h, now, out = History(most), None, []
    for i, action in actions:
        if action == "edit":
            h.record(now)
            now = i
        elif action == "undo":
            now = h.undo(now)
        elif action == "redo":
            now = h.redo(now)
        out.append((now, len(h.undo_stack), len(h.redo_stack)))
    return out


def test_summary_of_every_case():
    rng = random.Random(3)
    for most in (1, 3, 20):
        codes = np.array(rng.choices([H.EDIT, H.UNDO, H.REDO, H.NOTHING], [2, 3, 2, 1], k=90))
        for size in (0, 1, 7, 15, 16, 17, 90):
            entries, length, cursor, which = H.summary(codes[:size], most)
            for k, (n, c) in enumerate(H.cases(most).tolist()):
                assert H.case(n, c) == k
                line, at = [-1 - x for x in range(n)], c
                for code, i in zip(codes[:size].tolist(), range(size), strict=True):
                    if code == H.EDIT:
                        line, at = ([*line[: at + 1], i])[-(most + 1) :], min(at + 1, most)
                    elif code == H.UNDO:
                        at = max(at - 1, 0)
                    elif code == H.REDO:
                        at = min(at + 1, len(line) - 1)
                row = which[k]
                assert (entries[row, : length[row]].tolist(), cursor[row]) == (line, at)


def test_versions_in_many_stretches(spark):
    rng, rows, wanted = random.Random(4), [], {}
    for key, n in (("hot", 900), (None, 120), ("few", 5), ("edits", 60), ("undone", 40)):
        weights = {"edits": [1, 0, 0, 0], "undone": [0, 1, 0, 0]}.get(key, [4, 4, 3, 1])
        actions = [(len(rows) + i, rng.choices(["edit", "undo", "redo", None], weights)[0]) for i in range(n)]
        wanted |= {(key, i): x for (i, _), x in zip(actions, stacks(actions), strict=True)}
        rows += [(key, i // 3, i, a) for i, a in actions]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, LOG).withColumn("code", H.kinds(F.col("action"))).withColumn("version", F.lit("clash"))
    for stretch in (50, 100_000):
        out = H.versions(log, ("at",), stretch=stretch).collect()
        assert {(r.key, r.id): (r.version, r.n_undo, r.n_redo) for r in out} == wanted and len(out) == len(rows)
    assert max(u for _, u, _ in wanted.values()) == 20


def test_empty_log(spark):
    log = spark.createDataFrame([], LOG).withColumn("code", H.kinds(F.col("action")))
    assert H.versions(log, ("at",)).count() == 0
