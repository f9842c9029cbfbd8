"""URL rules and vocabulary, vector codes, periodic runs: against brute force, on nulls, ties, repeats, empty tables, odd columns."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from haploweave.llm import quantize, queries, runs, urls
from haploweave.llm import common

CLASHING = ("host", "path", "rule", "verdict", "terms", "length", "nth", "x", "code", "codes", "runs", "collapsed", "best", "_best", "row", "h", "own")


# ---- 11


def brute_terms(url, strict, soft, limit):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")

    def within(term):
        left = "(?<![a-z0-9])" if term[0].isascii() and term[0].isalnum() else ""
        right = "(?![a-z0-9])" if term[-1].isascii() and term[-1].isalnum() else ""
        return re.search(left + re.escape(term) + right, low) is not None

    n_strict, n_soft = sum(map(within, strict)), sum(map(within, set(soft) - set(strict)))
    return n_strict + n_soft, "block" if n_strict or n_soft >= limit else "allow"


def test_vocabulary():
    """Terms within terms, at the ends, overlapping, repeated and of several bytes, against looking for each alone."""
    rng = random.Random(1)
    strict, soft = ("abc", "bc", "c-a", "é"), ("a", "ab", "ba", "b.a", "aaa")
    v = urls.Vocabulary({t: 1 for t in soft} | {t: 2 for t in strict})
    texts = ["".join(rng.choice("aabbc.-/é") for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["", "abc", "xabc", "a" * 50_000, "a/" * 9]
    n, weight = v.count([t.encode() for t in texts])
    for t, k, w in zip(texts, n.tolist(), weight.tolist(), strict=True):
        assert (k, "block" if w >= 2 else "allow") == brute_terms(t, strict, soft, 2), t
    n, weight = v.count([])
    assert len(n) == 0 and urls.Vocabulary({}).count([b"abc"])[0].tolist() == [0]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "http://", "no scheme/com/", "https://Example.COM/en/x?q=1", "https://www.example.com/en/x", "https://www.example.com/EN/x", "http://a.www.example.com/en/#x", "http://example.com", "http://example.com?/en/",
    "http://notexample.com/en/", "http://x.net/es/casino-win", "http://x.net/fr", "http://x.org/free/casino", "http://x.org/casino/casino", "http://x.org/Porn", "http://x.org/pornography", "http://essex.org/sex", "http://x.org/#sex&nude",
    "ftp://user@example.com:80/en/", "http://x.com/a://y.net/es/", "http://com/", "http://.com/", "http://x.com./", "http://İ.org/sex-cheap", "http://x.org/\nsex\ncheap", "http://x.org/" + "sex-" * 20_000 + "win",
]


def test_urls(spark):
    rows = [(k, u, "h") for k, u in enumerate(URLS)] + [(None, "http://x.org/free-casino", "h"), (5, URLS[5], "h"), (5, URLS[5], "h")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in CLASHING})
    got = urls.judge(table).collect()
    assert len(got) == len(rows)
    for r in got:
        after = (r.url or "").split("://", 1)[1] if "://" in (r.url or "") else ""
        host = re.match(r"[^/?#]*", after).group()
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", after[len(host) :]).group()
        rule, verdict = brute_rule(host, path)
        n, by_terms = (0, verdict) if rule else brute_terms(r.url, urls.STRICT, urls.SOFT, urls.SOFT_LIMIT)
        assert (r.host, r.path, r.rule, r.n_terms, r.verdict) == (host, path, rule, n, by_terms), r.url
    assert urls.judge(table.limit(0)).count() == 0


def test_rules_of_ones_own(spark, monkeypatch):
    """Rules as a table: the same rule twice, nulls, no rules, and hosts joined without broadcast."""
    table = spark.createDataFrame([(1, "http://a.b/x/y"), (2, "http://b/x"), (3, "http://q.a.b/x"), (4, None)], "page_id long, url string")
    rules = spark.createDataFrame([("b", "/x", "block"), ("B", "/x", "allow"), ("a.b", "/x/y", "block"), (None, None, "block"), (None, None, None)], "host string, path string, verdict string")
    expected = {1: ("a.b/x/y", "block"), 2: ("b/x", "allow"), 3: ("b/x", "allow"), 4: ("", "block")}
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(table, rules).collect()} == expected
    plain = common.join_checked
    monkeypatch.setattr(urls, "join_checked", lambda *a, **k: plain(*a, **k, most=-1))
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(table, rules).collect()} == expected
    assert {r.verdict for r in urls.judge(table, rules.limit(0)).collect()} == {"allow"}


# ---- 12


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error) of rows (vec_id, vector), whose lengths parts divide, in whole numbers of any size."""
    kept = [(i, [math.floor(4096 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            chosen = [nearest(p, c[p])[1] for c in cut]
            for k in range(len(books[p])):
                own = [c[p] for c, x in zip(cut, chosen, strict=True) if x == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    final = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(y) for b in books for e in b for y in e).encode()).hexdigest()
    return [(i, bytes(k for _, k in f).hex(), sum(d for d, _ in f)) for (i, _), f in zip(kept, final, strict=True)], digest


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, v, lab) for i, v, lab in rows], "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("block", [8192, 7])
def test_codes(spark, block, monkeypatch, tmp_path):
    """Ties, repeated rows and ids, nulls, components that aren't numbers, unused entries, many small blocks."""
    monkeypatch.setattr(quantize, "BLOCK", block)
    rng = random.Random(3)
    rows = [(k, [rng.choice([-0.5, -0.25, 0.0, 0.3, rng.random()]) for _ in range(16)], rng.choice([None, 1, 2])) for k in range(150)]
    rows += [(k, [0.0] * 16, 7) for k in range(20)] + [(None, [1.0] * 16, None), (None, [1.0] * 16, None), (3, None, 1), (4, [None] + [0.0] * 15, 1), (5, [float("nan")] * 16, 1), (6, [float("-inf")] + [0.0] * 15, None)]
    rows += [rows[8]] * 3
    rng.shuffle(rows)
    (tmp_path / "t").mkdir()
    vectors_table(spark, rows).withColumns({c: F.lit("x") for c in CLASHING}).repartition(3).write.parquet(f"{tmp_path}/t/embeddings.parquet")
    got = queries.op12_codes(spark, f"{tmp_path}/t").collect()
    expected, digest = brute_codes([(i, None if v is None else [float(np.float32(x)) if x is not None else None for x in v]) for i, v, _ in rows])
    assert sorted((str(r.vec_id), r.code, r.error) for r in got) == sorted((str(i), c, e) for i, c, e in expected)
    assert {r.codebooks_sha256 for r in got} == {digest}
    # Labels' sums: over all rows 0 to 170 of this table.
    sums, labels = {}, {}
    for i, v, lab in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            labels.setdefault(str(i), []).append(lab)
    for r in quantize.fit(vectors_table(spark, rows))[0].collect():
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert {r.label_error for r in got} == set(sums.values())


def test_codes_of_odd_lengths(spark):
    """Codebooks of their own for each length, lengths that parts don't divide, vectors without components, few vectors, none."""
    rows = [(k, [float(k % 3), 0.5, -0.1 * k], 1) for k in range(9)] + [(k, [], 1) for k in range(3)] + [(77, [1.0] * 8, None)]
    coded, books = quantize.fit(vectors_table(spark, rows))
    got = coded.collect()
    assert len(got) == 13 and sorted(books) == [0, 3, 8]
    padded = [(k, v + [0.0] * 5) for k, v, _ in rows if len(v) == 3]
    expected, digest = brute_codes([(k, [float(np.float32(x)) for x in v]) for k, v in padded])
    assert sorted((r.vec_id, bytes(r.code).hex(), r.error) for r in got if r.length == 3) == sorted(expected) and books[3].digest() == digest
    assert {(bytes(r.code).hex(), r.error) for r in got if r.length != 3} == {("00" * 8, 0)}
    coded, books = quantize.fit(vectors_table(spark, rows).where("vec_id < 0"))
    assert coded.count() == 0 and books == {}
    with pytest.raises(Exception, match="too large"):
        quantize.fit(vectors_table(spark, [(1, [1e30] * 8, 1)]))


def test_heaps_spare_scans():
    """Only violated parts are looked at: codes equal a full search in every round, with far fewer parts scanned."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3000, (16, 4))
    x = np.floor(centres[rng.integers(0, 16, 4000)] + rng.normal(0, 150, (4000, 4))).astype(np.int64).reshape(4000, 1, 4)
    book, block = quantize.Codebook(x[:16]), quantize.Block(x, 16)
    scans = []
    for _ in range(12):
        before = block.scanned
        gain = block.assign(book.entries, book.used).reshape(-1)
        block = quantize.Block(x, 16).load(block.dump())
        scans.append(4000 if not scans else block.scanned)
        full = quantize.distances(x[:, 0], book.entries[0]).argmin(1)
        assert np.array_equal(block.codes[:, 0], full)
        assert before >= 0
        book.update({int(k): int(gain[k]) for k in np.flatnonzero(gain)})
    probe = quantize.Block(x, 16).load(block.dump())
    probe.assign(book.entries, book.used)
    assert probe.scanned < 1000


# ---- 13


def brute_runs(w, min_words=6, min_periods=4):
    """Maximal runs by comparing each word with that one period on; a period that a shorter one divides isn't the smallest."""
    out, n = set(), len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                start, length = i, j - i + q
                smallest = next(p for p in range(1, q + 1) if all(w[k] == w[k + p] for k in range(start, start + length - p)))
                if smallest == q and length >= max(min_words, min_periods * q):
                    out.add((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("min_words", "min_periods"), [(6, 4), (2, 2), (4, 3), (1, 2)])
def test_runs_brute_force(min_words, min_periods):
    rng = random.Random(2)
    for k in range(600):
        if k % 3:
            w = [rng.randint(0, 1 + k % 3) for _ in range(rng.randint(0, 60))]
        else:
            w = []
            while len(w) < 50:
                unit = [rng.randint(0, 2) for _ in range(rng.randint(1, 6))]
                w += (unit * 8)[: rng.randint(1, 8 * len(unit))] + [rng.randint(0, 2) for _ in range(rng.randint(0, 3))]
        assert runs.runs_of(w, min_words, min_periods) == brute_runs(w, min_words, min_periods), w
        ids, text = np.array(w, dtype=np.int64), np.zeros(len(w), dtype=np.int64)
        parts = runs.stretches(ids, text, min_words, min_periods)
        by_part = [(a + s, n, q) for a, b in parts for s, n, q in runs.runs_of(w[a:b], min_words, min_periods)]
        assert sorted(by_part, key=lambda r: (r[0], r[2])) == brute_runs(w, min_words, min_periods), w


def test_ordered_ends():
    rng = random.Random(4)
    values = rng.sample(range(10_000), 3000)
    ends, plain = runs.Ends(values[0]), {values[0]}
    for x in values[1:]:
        below, above = ends.add(x)
        assert below == max((y for y in plain if y < x), default=None) and above == min((y for y in plain if y > x), default=None)
        plain.add(x)
    assert list(ends) == sorted(plain) and ends.n == 3000


def test_long_runs():
    """One word 40 000 times; a long period; both in one text beside prose."""
    assert runs.runs_of([1] * 40_000) == [(0, 40_000, 1)]
    unit = list(range(2000))
    assert runs.runs_of([*unit * 5, 7, 7]) == [(0, 10_000, 2000)]


def test_find_runs(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b " * 4 + "c"), (3, "x " * 6), (3, "x " * 5), (4, "é\u00a0ü " * 7), (5, "no run at all here"), (6, "a b a b a b a b\nb b b b b b"), (7, " \t\n")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})
    got = [(str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find(table.repartition(2)).collect()]
    expected = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        found = brute_runs(w)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        expected.append((str(i), len(w), found, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted(got) == sorted(expected)
    assert runs.find(table.limit(0)).count() == 0
