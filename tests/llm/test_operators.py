"""Each operator against a brute-force version, a round trip or SQL, and on nulls, ties, repeats, empty tables, odd columns."""

import hashlib
import io
import itertools
import math
import os
import random
import re
import zipfile
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from haploweave.llm import archive, chat, components, density, mixing, ngram, packs, passages, pieces, repetition, simhash, vectors
from haploweave.llm.common import Words

SPACES = " \t\n\r\x0b\x0c"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (2, ""), (None, "x y z"), (3, "é ü 日本"), (3, None), (4, "Same words here again"), (5, "Same words here again"), (6, "a▁b  c\n\nd "), (7, "w " * 3000)]


def docs(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in rows], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def passage(rng, n=60):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n))


def odd_tables(spark):
    yield docs(spark, ODD)
    yield docs(spark, [])
    yield docs(spark, ODD).withColumns({c: F.lit("x") for c in ("fingerprint", "row", "key", "pack", "size", "kept", "n", "ids", "sig", "nth", "hash")})


@pytest.mark.parametrize("run", [repetition.judge, mixing.mix, passages.passages, ngram.score, simhash.near_duplicates, pieces.encode, repetition.select_kept, simhash.keep_first, passages.remove_passages, mixing.apply_mix], ids=lambda f: f.__name__)
def test_odd_tables(spark, run):
    for table in odd_tables(spark):
        out = run(table)
        n, whole = out.count(), table.count()
        if run in (repetition.judge, mixing.mix, ngram.score, simhash.near_duplicates, pieces.encode, passages.remove_passages):
            assert n == whole
        if run in (repetition.select_kept, simhash.keep_first, passages.remove_passages, mixing.apply_mix):
            assert out.columns == table.columns


# ---- words and helpers


def test_words():
    texts = ["a bb a", None, "", " x\ty\n", "é z", "A"]
    import pyarrow as pa

    w = Words(pa.array(texts))
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    assert [w.distinct[i].as_py().decode() for i in w.ids.tolist()] == [x for t in texts for x in words(t)]
    h = packs.word_hashes(w)
    assert len(set(h.tolist())) == len({x for t in texts for x in words(t)}) and h[0] == h[2]
    long = Words(pa.array(["z" * 600000 + " q", "z" * 600000]))
    a, b, c = packs.word_hashes(long).tolist()
    assert a == c != b
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 999).astype(np.uint64))
    assert (packs.expand_sorted(packs.squeeze_sorted(keys)) == keys).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_folder_needs_a_setting():
    """Without spark.checkpoint.dir, a folder of our own is only taken where driver and executors are one machine."""
    from types import SimpleNamespace

    from haploweave.llm import common

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(away)


# ---- 1


def test_repeats_brute_force():
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(100)] + ["a " * 20]
    w = Words(pa.array(texts))
    got = repetition.longest_repeats(w.ids, w.first)
    want = []
    for t in texts:
        ws = t.split()
        for i in range(len(ws)):
            best = 0
            for j in range(len(ws)):
                k = 0
                while i != j and max(i, j) + k < len(ws) and ws[i + k] == ws[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
    assert got.tolist() == want


def test_repetition_rules(spark):
    rng = random.Random(3)
    clean, junk = passage(rng, 200), " ".join([passage(rng, 12)] * 15)
    part = passage(rng, 110)
    rows = {r.doc_id: r for r in repetition.judge(docs(spark, [(1, clean), (2, junk), (3, "too short"), (4, f"{part} {passage(rng, 900)} {part}"), (5, "l one\nl one\n#*$%&|<>\n\n")])).collect()}
    assert [rows[i].kept for i in range(1, 6)] == [True, False, False, False, False]
    assert rows[3].base_failed and rows[2].base_failed and not rows[4].base_failed and rows[4].longest_repeat == 110
    assert (rows[5].n_dup_lines, rows[5].n_symbols, rows[5].n_words, rows[5].word_chars) == (1, 8, 5, 16)


# ---- 2


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, passage(rng, rng.randint(1, 60)), "en", rng.choice(["a", "b", "c", "Z", "é", None] + ["b"] * 10), 0) for i in range(900)] + [(7, "twice", "en", "a", 0)] * 2
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(60, 0.02 * want[s]) for s in want)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.apply_mix(df).count() == sum(r.copies for r in out)


def test_flight_of_a_dominant_unit():
    """One document of a quarter of the words, among many and few others: sums stay near, it keeps its chance."""
    rng = random.Random(21)
    for heavy, n, most in ((0.25, 300, 0.004), (0.25, 40, 0.004), (0.25, 14, 0.01)):
        small = [float(rng.randint(1, 400)) for _ in range(n)]
        size = [heavy / (1 - heavy) * sum(small), *sorted(small, reverse=True)]
        pi, errors, taken = [0.37] * len(size), [], 0
        for seed in range(300):
            out = mixing.flight(pi, size, random.Random(seed), True)
            assert set(out) <= {0.0, 1.0}
            errors.append(abs(sum(x * s for x, s in zip(out, size, strict=True)) / (0.37 * sum(size)) - 1))
            taken += out[0]
        assert sum(errors[:60]) / 60 < most, (heavy, n, sum(errors[:60]) / 60)
        assert n < 40 or abs(taken / 300 - 0.37) < 0.1


def test_flight_balances():
    rng = random.Random(0)
    size = [float(rng.randint(1, 100)) for _ in range(2000)]
    done = mixing.flight([0.37] * 2000, size, rng, True)
    assert set(done) <= {0.0, 1.0} and abs(sum(done) - 740) < 2.5
    assert abs(sum(d * s for d, s in zip(done, size, strict=True)) - 0.37 * sum(size)) < 200
    half = mixing.flight([0.5] * 100, size[:100], rng, False)
    assert sum(0 < x < 1 for x in half) <= 2 and math.isclose(sum(half), 50)


# ---- 3


def test_windows_brute_force():
    rng = np.random.default_rng(5)
    for n in (0, 3, 40, 200):
        first = np.array([0, n // 3, n])
        order = rng.permutation(n).astype(np.uint64) << np.uint64(40)
        want = set()
        for a, b in zip(first, first[1:], strict=False):
            for c in range(a, b):
                lo, hi = c, c
                while lo > a and order[lo - 1] > order[c]:
                    lo -= 1
                while hi < b - 1 and order[hi + 1] > order[c]:
                    hi += 1
                if hi - lo + 1 >= 10:
                    want.add((lo, c, hi))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(order, first, 10)), strict=True)) == want


def brute_links(texts, least=50):
    """Rows that share `least` words in a row."""
    grams = {}
    for i, t in texts.items():
        ws = words(lower(t))
        for k in range(len(ws) - least + 1):
            grams.setdefault(tuple(ws[k : k + least]), set()).add(i)
    return [g for g in grams.values() if len(g) > 1]


def test_passages(spark):
    rng = random.Random(6)
    p, q = passage(rng, 55), passage(rng, 80)
    ws = p.split()
    ws[27] = "changed"
    texts = {1: f"{passage(rng, 100)} {p} {passage(rng, 100)}", 2: f"{passage(rng, 30)}\n{p.upper()}\n{passage(rng, 40)}", 3: p, 4: " ".join(ws), 5: passage(rng, 300), 6: f"{q} {passage(rng, 50)}", 7: f"{passage(rng, 20)} {q}", 8: passage(rng, 49), 9: passage(rng, 49), 10: "the same nine words stand in many texts here. " + passage(rng, 80)}
    texts |= {20 + i: "the same nine words stand in many texts here. " + passage(rng, 80) for i in range(8)}
    found = passages.passages(docs(spark, sorted(texts.items()))).collect()
    rows = {r.doc_id for r in found}
    assert rows == {2, 3, 4, 7}
    for r in found:
        assert r.source_doc_id < r.doc_id and r.end - r.start >= 50 and r.similarity >= 0.8
    (seven,) = (r for r in found if r.doc_id == 7)
    assert (seven.start, seven.end, seven.source_start, seven.source_end) == (20, 100, 0, 80)
    for group in brute_links(texts):
        assert len(group - rows) <= 1
    left = {r.doc_id: r for r in passages.remove_passages(docs(spark, sorted(texts.items()))).collect()}
    assert not brute_links({i: r.text for i, r in left.items()})
    assert all(left[i].text == texts[i] for i in texts if i not in rows) and left[7].n_chars == len(left[7].text) and words(left[7].text) == words(texts[7])[:20]


def test_crowded_passages(spark):
    """One passage in many texts, beside a line that all share: found in all but one, and the line alone in none."""
    rng = random.Random(7)
    p, line = passage(rng, 60), "a line of nine words that all of them"
    old = passages.CROWDED
    passages.CROWDED = 5
    try:
        texts = {i: f"{passage(rng, 60)}\n{line}\n" + (f"{passage(rng, 30)} {p}" if i % 2 else passage(rng, 80)) for i in range(40)}
        found = passages.passages(docs(spark, sorted(texts.items()))).collect()
    finally:
        passages.CROWDED = old
    assert {r.doc_id for r in found} == {i for i in texts if i % 2} - {1}


def test_verify_edit_near_end():
    """A near-equal passage is whole, too, where an edit leaves less than the shortest passage after it."""
    a = np.arange(1, 97, dtype=np.uint32)
    b = np.concatenate([np.arange(500, 530), a, np.arange(600, 630)]).astype(np.uint32)
    b[30 + 55 : 30 + 60] = np.arange(900, 905)
    ((i, j, p, q, similar),) = passages.verify(a, b, 30)
    assert (i, j, p, q) == (0, 96, 30, 126) and abs(similar - 91 / 101) < 1e-9
    assert passages.verify(a[:55], b, 30) == [(0, 55, 30, 85, 1.0)]


def test_verify_repeats():
    """An exact run is found though all its shingles stand at more than eight places before."""
    run, rng = np.arange(1, 47, dtype=np.uint32), np.random.default_rng(22)
    parts = [run[x : x + 23] for x in (0, 12, 23)] * 12
    b = np.concatenate([y for x in parts for y in (x, rng.integers(1000, 1 << 30, 9))] + [run, rng.integers(1000, 1 << 30, 40)]).astype(np.uint32)
    at = len(b) - 86
    assert (0, 46, at, at + 46, 1.0) in passages.verify(run, b, at - 300)


def test_partial_first_text(spark):
    """Texts that share 50 words meet, though earlier ones hold most of these words, or stand beside a near copy."""
    rng, texts = random.Random(23), {}
    for g in range(12):
        whole = passage(rng, 50 + 4 * (g % 3)).split()
        part = whole[:45] if g % 2 else whole[-45:]
        texts[10 * g] = " ".join([passage(rng, 60), *part, passage(rng, 60)])
        for k in range(1, 4):
            texts[10 * g + k] = " ".join([passage(rng, 60), *whole, passage(rng, 60)])
    table = docs(spark, sorted(texts.items()))
    rows = {r.doc_id for r in passages.passages(table).collect()}
    assert rows == {10 * g + k for g in range(12) for k in (2, 3)}
    left = {r.doc_id: r.text for r in passages.remove_passages(table).collect()}
    assert brute_links(texts) and not brute_links(left)


def test_near_passages_recall(spark):
    """Near-equal passages against brute force, behind earlier texts that hold only the phrase at their middle."""
    rng, texts, pairs = random.Random(24), {}, []
    stock = passage(rng, 9)
    for g in range(80):
        n = rng.randint(60, 110)
        first = f"{passage(rng, n // 2 - 4)} {stock if g % 2 else passage(rng, 9)} {passage(rng, n // 2 - 4)}".split()
        second = list(first)
        for at in rng.sample(range(len(first)), max(1, n // 55)):
            second[at] = "edited%d" % at
        one, two = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (first, second))
        texts[10 * g] = f"{passage(rng, 60)} {stock} {passage(rng, 60)}"
        texts[10 * g + 1] = " ".join([passage(rng, 40), *first, passage(rng, 40)])
        texts[10 * g + 2] = " ".join([passage(rng, 40), *second, passage(rng, 40)])
        if len(one & two) / len(one | two) >= 0.8:
            pairs.append(10 * g + 2)
    found = {r.doc_id for r in passages.passages(docs(spark, sorted(texts.items()))).where("end - start >= 50").collect()}
    assert len(pairs) > 50 and found <= {i for i in texts if i % 10 == 2}
    assert len(found & set(pairs)) >= 0.97 * len(pairs), len(found & set(pairs)) / len(pairs)


def test_columns_travel(spark):
    """Types and names of other columns survive the removal of passages."""
    import datetime
    from decimal import Decimal

    rng = random.Random(25)
    p, when = passage(rng, 60), datetime.datetime(2024, 1, 2, 3, 4, 5, 123456)
    rows = [(i, t, when, Decimal("1.23"), [1, None], {"k": "v"}, "x") for i, t in enumerate([p + " " + passage(rng, 30), p, None, ""])]
    table = spark.createDataFrame(rows, "doc_id long, text string, `a.b` timestamp, __null decimal(9,2), row array<int>, empty map<string,string>, pack string")
    out = sorted(passages.remove_passages(table).collect())
    assert [tuple(r)[2:] for r in out] == [r[2:] for r in rows] and [r.text for r in out] == [rows[0][1], "", None, ""]


def test_cut():
    assert passages.cut("a b  c\nd e", [(1, 3)]) == "a\nd e" and passages.cut("a b", [(0, 2)]) == "" and passages.cut(" a ", []) == " a "


# ---- 4


def brute_scores(rows, order):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base, score) from plain counts of tuples."""
    tokens = {k: [*words(lower(t)), "</>"] for k, (_, t) in enumerate(rows)}
    train = {k for k, (i, _) in enumerate(rows) if zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2}
    counts, arcs = Counter(), {}
    for k in train:
        padded = ["<s>", *tokens[k]]
        for n in range(1, order + 1):
            for a in range(len(padded) - n + 1):
                gram = tuple(padded[a : a + n])
                counts[gram] += 1
                arcs.setdefault(gram[:-1], set()).add(gram[-1])
    n_all, v = sum(c for g, c in counts.items() if len(g) == 1 and g != ("<s>",)), sum(len(g) == 1 and g != ("<s>",) for g in counts)

    def p(h, w):
        if not h:
            return (counts[(w,)] + 1) / (n_all + v + 1)
        if not counts[h]:
            return p(h[1:], w)
        back = ngram.DISCOUNT * len(arcs[h]) / counts[h] * p(h[1:], w)
        return (counts[(*h, w)] - ngram.DISCOUNT) / counts[h] + back if counts[(*h, w)] else back

    for h in [(), *list(arcs)[1:20]] if order > 1 else [()]:  # each state's probabilities sum to one
        if h and len(h) < order and h[0] != "<s>":
            assert math.isclose(sum(p(h, w) for (w,) in [g for g in counts if len(g) == 1 and g != ("<s>",)]) + p(h, "never seen"), 1, rel_tol=1e-9)
    out = []
    for k, (i, _) in enumerate(rows):
        padded = ["<s>", *tokens[k]]
        score = sum(math.log10(p(tuple(padded[max(0, a - order + 1) : a]), padded[a])) for a in range(1, len(padded)))
        base = sum(math.log10(p((), w)) for w in tokens[k])
        out.append((str(i), k not in train, len(tokens[k]), sum(counts[(x,)] > 0 for x in tokens[k]), n_all, round(base, 6), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_of_unseen_words(spark, order):
    """Held-out texts with words that training lacks at their start, middle and end, alone, in a row and after known words."""
    rng = random.Random(9)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, " ".join(rng.choice(["the", "of", "tea", "x", "yy"]) for _ in range(rng.randint(1, 25)))) for i in range(60) if i not in held]
    odd = ["new the of", "the of new", "the new of tea", "new", "new newer newest", "the of new newer tea x yy the of", "new the new of new", "tea tea tea", ""]
    rows += list(zip(held, odd, strict=False))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ngram.score(docs(spark, rows), order=order).collect()]
    assert sorted(got) == brute_scores(rows, order)


def test_scores_beat_the_base(spark):
    """Over prose with unseen words, held-out documents get more on average than the base of single words gives them."""
    rng = random.Random(10)
    rows = []
    for i in range(300):
        out, word = [], 0
        for _ in range(80):
            word = (word * 3 + rng.randint(0, 2)) % 50 if rng.random() < 0.95 else 1000 + rng.randint(0, 10**6)
            out.append(f"w{word}")
        rows.append((i, " ".join(out)))
    found = [r for r in ngram.score(docs(spark, rows)).collect() if r.held_out]
    assert any(r.n_known < r.n_tokens for r in found)
    assert sum(r.score for r in found) > sum(r.base_score for r in found) and all(r.score > r.base_score - 0.5 * r.n_tokens for r in found)


@pytest.mark.parametrize(("order", "fan"), [(1, 256), (2, 256), (2, 2), (3, 2), (4, 256)])
def test_scores(spark, order, fan, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the", "of", "Tea", "x", "yy", "zz"]) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(61, None), (62, "New words"), (None, "the of"), (62, "New words")]
    plain = ngram.pack
    monkeypatch.setattr(ngram, "pack", lambda d: plain(d, 200))  # many packs, so that counts meet in levels
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ngram.score(docs(spark, rows), order=order, fan=fan).collect()]
    assert sorted(got) == brute_scores(rows, order)


def test_failure_arcs_are_taken():
    """The traversal gives the sum of arc and failure weights; a text whose words never stood together takes failures."""
    import zstandard

    texts = [b"a b c", b"a b d", b"c a", b"d c b a"]
    t = ngram.Tokens([len(x) for x in texts], zstandard.ZstdCompressor().compress(b"".join(texts)), [False, False, False, True], 3)
    counts = [x.astype(np.int64) for x in t.own]
    kinds = [np.bincount(t.history[k + 1][counts[k + 1] > 0], minlength=len(t.keys[k])) for k in (0, 1)]
    a = ngram.Automaton(t, counts, kinds, 11, 5, 0.75)
    whole = a.run()
    assert math.isfinite(whole[3])
    a.fail = [x - 1 for x in a.fail]
    taken = np.round(whole - a.run()).astype(int).tolist()
    assert taken[:3] == [0, 0, 0] and taken[3] >= 4
    a.fail = [x + 1 for x in a.fail]
    assert np.allclose(whole[:3], [math.fsum(a.arc[min(2, i + 1)][b + i] for i in range(e - b)) for b, e in zip(t.first[:3], t.first[1:4])])


# ---- 5


def test_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[100:160] = x[0] + 0.2 * rng.normal(size=(60, 24))
    x[160:170] = x[5]
    x[170:200] = x[6] + 0.35 * rng.normal(size=(30, 24))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] + [1.0] * 23, 0), (903, [], 0), (904, [1.0], 0), (None, x[5].tolist(), 0), (905, [None] + [1.0] * 23, 0)]
    got = vectors.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), tile=16).collect()
    assert len(got) == len(rows)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    truth = near.sum(1)
    truth[5] += 1
    truth[160:170] += 1
    found = {r.vec_id: r for r in got if r.vec_id is not None}
    links = np.array([found[i].n_links for i in range(400)])
    assert (links <= truth).all() and links.sum() >= 0.9 * truth.sum()
    assert (links[160:170] == truth[160:170]).all() and {found[i].component_id for i in range(160, 170)} == {5}
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in range(900, 906))
    for r in found.values():
        assert r.kept == (r.vec_id == r.component_id)
    assert vectors.links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("tile", [16, 512])
def test_vector_lengths(spark, tile):
    """Neighbours of every length are found; a cluster of one description is counted once; the SQL agrees where all are found."""
    import duckdb

    from haploweave.llm import queries

    rng = np.random.default_rng(31)
    rows = []
    for width, groups, each, noise in ((16, 30, 12, 0.15), (8, 1, 2, 0.02), (24, 12, 8, 0.2), (3, 1, 150, 0.05), (1, 1, 3, 0)):
        for _ in range(groups):
            centre = rng.normal(size=width)
            rows += [(len(rows) + k, (centre * rng.uniform(0.5, 2) + noise * rng.normal(size=width)).tolist(), width) for k in range(each)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("node", "width", "key", "class", "own", "n", "payload")})
    got = {r.vec_id: r for r in vectors.links(table, tile=tile).collect()}
    embeddings = table.select("vec_id", "embedding", "label").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    want = {r[0]: r for r in con.execute(queries.SQL["op5_pivots"]).fetchall()}
    for width in (16, 8, 24, 3, 1):
        ids = [i for i, _, w in rows if w == width]
        true, found = sum(want[i][1] for i in ids), sum(got[i].n_links for i in ids)
        assert all(got[i].n_links <= want[i][1] for i in ids) and true > 0 and found >= 0.9 * true, (width, found, true)
    assert [(got[i].n_links, got[i].component_id) for i, _, w in rows if w in (8, 3, 1)] == [want[i][1:3] for i, _, w in rows if w in (8, 3, 1)]


@pytest.mark.parametrize("width", [16, 64, 128, 768])
def test_recall_at_the_threshold(width):
    """Of pairs of cosine 0.90 exactly, in vectors that spread out evenly, nine in ten share as many pivots as a list asks for."""
    rng = np.random.default_rng(width)
    a, o = rng.normal(size=(2, 4000, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(1, keepdims=True) * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * o / np.linalg.norm(o, axis=1, keepdims=True)
    refs = vectors.choose_pivots(a)
    x, y = vectors.describe(a[2000:], refs), vectors.describe(b[2000:], refs)
    shared = (x[:, :, None] == y[:, None, :]).any(2).sum(1)
    assert (shared >= vectors.SHARED).mean() >= 0.9


def test_descriptions():
    refs = np.eye(6)
    lists = vectors.describe(np.array([[0.1, 0.9, 0.2, 0.3, 0, 0], [0.5, 0.5, 0.4, 0.3, 0, 0]]), refs, 4)
    assert lists.tolist() == [[1, 3, 2, 0], [0, 1, 2, 3]]  # nearest first, ties by id
    keys, extra = vectors.postings_of(lists, 3, 10)
    assert keys[0].tolist() == [12, 13, 23, 123] and extra[0].tolist() == [-1, 2, 1, 0] and (keys[0] == keys[1]).all()


# ---- 6


def brute_fingerprint(t):
    ws = words(lower(t))
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) > 2 else [" ".join(ws)] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("crowded", [64, 3])
def test_simhash(spark, crowded, monkeypatch):
    rng = random.Random(10)
    base = passage(rng, 400).split()
    rows = list(ODD)
    for i in range(60):
        ws = list(base)
        for _ in range(rng.randint(0, 2)):
            ws[rng.randrange(400)] = "x%d" % rng.randint(0, 9)
        rows.append((100 + i, " ".join(ws)))
    rows += [(300 + i, passage(rng, 5)) for i in range(40)]
    plain = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda d, distance, blocks: plain(d, distance, blocks, crowded))
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    assert sorted((str(r.doc_id), r.fingerprint % (1 << 64)) for r in got) == sorted((str(i), p) for (i, _), p in zip(rows, prints, strict=True))
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] != group[b]:
            lo, hi = sorted((group[a], group[b]))
            group = [lo if g == hi else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(i), str(least.get(g))) for (i, _), g in zip(rows, group, strict=True))


def test_keep_first_ids(spark):
    """One row of each group stays, also where ids are null or repeated with different texts."""
    rng = random.Random(21)
    a, b, c, d, e, f = (passage(rng, 200) for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (None, c), (3, d), (3, e), (3, e), (5, d), (2, a), (None, None), (4, ""), (-(1 << 63), f), (None, f + " end"), (None, passage(rng, 200))]
    prints = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for x, y in itertools.combinations(range(len(rows)), 2):
        if (prints[x] ^ prints[y]).bit_count() <= 2 and group[x] != group[y]:
            group = [group[x] if g == group[y] else g for g in group]
    want = []
    for g in set(group):
        want.append(min((i is None, i or 0, t or "") for (i, t), h in zip(rows, group, strict=True) if h == g))
    got = [(r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.keep_first(docs(spark, rows)).collect()]
    assert sorted(got) == sorted(want)


def test_links_random(spark):
    rng = random.Random(11)
    center = rng.getrandbits(64)
    prints = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    groups = {}
    for crowded in (10**6, 4):
        c = {r.vertex: r.component for r in components.components(simhash.near_links(df, crowded=crowded)).collect()}
        groups[crowded] = c
    assert groups[4] == groups[10**6]


# ---- 7


def test_layouts():
    turns = [("user", "q"), ("assistant", "a")]
    same = [{"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a", "id": 3}, {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"data": {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}}]
    assert all(chat.canonical(x) == turns for x in same)
    assert chat.canonical({"system": "s", "instruction": "q", "input": "i", "output": None}) == [("system", "s"), ("user", "q\n\ni"), ("assistant", "")]
    assert chat.canonical({"other": 1}) is None and chat.canonical({"messages": []}) == []
    assert len({chat.fingerprint(chat.field_paths(x)) for x in same}) == len(same)


def test_template_is_reversible():
    rng = random.Random(12)
    bits = ["\\", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "<|role|>", "<|end|>", " ", "x", "\n", "[", "<", "|"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "<s>x\\"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))) for _ in range(3)]
        formatted = "".join(chat.format_turn(*t) for t in turns)
        assert [(r, t) for r, t, _ in chat.parse_turns(formatted)] == turns
    with pytest.raises(ValueError, match="unescaped"):
        chat.parse_turns("[INST] a </s> [/INST]")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, None, None, "x"), (2, 0, "assistant", "</s>"), (None, 0, "user", "n"), (1, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}))
    got = {r.conv_id: r for r in chat.digest_formatted(chat.format_turns(chat.to_turns(df))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\nx\nassistant\n</s>\n").hexdigest() and got[None].n_turns == 1
    bad = chat.to_turns(spark.createDataFrame([(1, 0, "{"), (2, 0, None), (3, 0, '{"zz": 1}')], "conv_id long, turn long, record string"))
    assert [r.role for r in bad.collect()] == [None] * 3
    assert chat.digest_formatted(chat.format_turns(chat.to_turns(df.limit(0)))).count() == 0


# ---- 8

needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer files here")


@needs_model
def test_pieces_equal_the_models_own():
    import sentencepiece

    with open(pieces.MODEL, "rb") as f:
        raw = f.read()
    own, codec, rng = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Codec(raw), random.Random(13)
    texts = ["".join(rng.choice("aabetnis  \n\t.1é日,$%") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [x * n for x in ("a", "=", " ", "ab ", ".$", "日") for n in (1, 7, 64, 500)] + [passage(rng, 50)]
    for t in texts:
        ids = array("i")
        codec.encode(t, ids)
        assert list(ids) == own.encode(t) and codec.decode(ids) == t
    for t in ("a▁b", "▁", "x\u0000y"):
        ids = array("i")
        codec.encode(t, ids)
        assert codec.decode(ids) == t


@needs_model
def test_search_makes_all_ids(spark):
    """The ids of a whole table are the search's own: each stretch is searched once, one stream over a whole text without
    stretches or memory gives the same ids, commits where the stretches end, and its window stays small."""
    import sentencepiece

    with open(pieces.MODEL, "rb") as f:
        raw = f.read()
    own, codec = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Codec(raw)
    seen, n, longest = set(), 0, 0
    for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if os.path.exists("/root/testdata/sf0.01") else [("a b c " * 50,)]):
        text, ids = r[0] or "", array("i")
        codec.encode(text, ids)
        assert list(ids) == own.encode(text)
        if text:
            seen.update(codec.stretches(" " + text))
        if i % 10 == 0 and text:
            stream, got = pieces.StreamingViterbi(codec.pieces), []
            for lo in range(0, len(text) + 1, 100):
                got += stream.feed((" " + text)[lo : lo + 100].replace(pieces.SPACE, pieces._LITERAL).replace(" ", pieces.SPACE))
                longest = max(longest, len(stream.window))
            assert got + stream.finish() == list(ids) and stream.committed == len(ids)
        n += len(ids)
    assert n and codec.searched == sum(map(len, seen)) and longest < 250


@needs_model
def test_stream_is_bounded():
    with open(pieces.MODEL, "rb") as f:
        p = pieces.Pieces(f.read())
    text, whole = "internationalization" * 3000, pieces.StreamingViterbi(p)
    want = whole.feed(text) + whole.finish()
    s, got = pieces.StreamingViterbi(p), []
    for i in range(0, len(text), 7):
        got += s.feed(text[i : i + 7])
        assert len(s.window) < 200
    assert got + s.finish() == want and s.peak < 200


@needs_model
def test_encode_and_decode(spark):
    df = docs(spark, ODD)
    out = pieces.encode(df)
    assert all(r.decoded and r.n_ids == len(r.ids) for r in out.collect())
    assert sorted(str(r.text) for r in pieces.decode(out).collect()) == sorted(t or "" for _, t in ODD)


# ---- 9


def test_density():
    para = "Words of an article that go on for a while, so that there is something to find in it. "
    around = "<nav><ul><li><a href=/>Home</a><li><a href=/>About</a></ul></nav><div class='sidebar'><p>" + para * 3 + "</div>"
    page = f"<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>{around}<div id=post><h2>Head &amp; more</h2><p>{para}<b>bold</b>  text\n<p>Second&nbsp;one &lt;x&gt;<br>line<ul><li>one<li>two</ul></div><div class='comments'><p>{para * 5}</p></div><form><p>{para * 9}</form><footer><p>{para * 4}</footer><!-- <p>{para}</p>"
    assert density.extract(page) == f"Head & more\n{para}bold text\nSecond one <x> line\none\ntwo"
    assert density.extract("<article><h1>A</h1></article>") == "A"
    assert [density.extract(x) for x in (None, "", "<p>", "plain  text", "<", "<a <b>", "<!-- ")] == ["", "", "", "plain text", "<", "", ""]
    assert density.extract(f"<div class='page no-sidebar'><p>{para}</p></div>") == para.strip()
    assert density.extract(f"<div class='widget'><p>{para}</p></div>") == para.strip()
    assert density.extract(f"<article><p>{para}</p></article><article class='comment'><p>{para * 3}</p></article>") == para.strip()
    deep = "<div>" * 3000 + "x"
    assert density.extract(deep) == "x"


def test_density_names_mislead():
    """Class names that take the main text lose against density, whatever else stands on the page."""
    rng = random.Random(20)
    paras = [passage(rng, 60) for _ in range(6)]
    ps = lambda some: "".join(f"<p>{x}</p>" for x in some)
    skip, foot = "<a class='skip-link'>Skip to content</a>", "<div><p>Copyright of the site</p></div>"
    share = "<div class='share'><a href=/f>Like</a> <a href=/t>Post</a></div>"
    for name in ("elementor-widget elementor-widget-text-editor", "layout-sidebar-right", "post social"):
        for some in (paras, paras[:1]):
            got = density.extract(f"<body>{skip}<div class='{name}'>{ps(some)}{share}</div>{foot}</body>").split("\n")
            assert [x for x in got if x in paras] == some and (len(some) == 1 or "Skip to content" not in got)
        assert density.extract(f"<body>{skip}<div class='{name}'>{paras[0]}</div></body>").endswith(paras[0])
    widgets = "".join(f"<div class='widget'>{ps(paras[k : k + 2])}</div>" for k in (0, 2, 4))
    assert density.extract(f"<body>{skip}<div>{widgets}</div></body>") == "\n".join(paras)
    assert density.extract(f"<body><div>{ps(paras)}</div><div class='comments'>{ps(paras[:2])}</div></body>") == "\n".join(paras)


def test_density_formula():
    """Densities and totals of random trees against the formula taken literally, from the tree and not from the parser."""
    rng = random.Random(32)

    def grow(depth):
        kids = []
        for _ in range(rng.randint(0, 4)):
            kids.append(grow(depth - 1) if depth and rng.random() < 0.6 else "x" * rng.randint(1, 60))
        return rng.choice(["div", "section", "a", "span"]), kids

    def html_of(t):
        return t if isinstance(t, str) else f"<{t[0]}>{''.join(map(html_of, t[1]))}</{t[0]}>"

    def subtree(t):
        return [t] + [y for x in t[1] if not isinstance(x, str) for y in subtree(x)]

    def chars(t):
        return sum(len(x) if isinstance(x, str) else chars(x) for x in t[1])

    def links(t):
        """Outermost links of a subtree, itself included."""
        return [t] if t[0] == "a" else [y for x in t[1] if not isinstance(x, str) for y in links(x)]

    def density_of(t, body):
        c, tags = chars(t), len(subtree(t)) - 1
        lc, lt = sum(map(chars, links(t))), sum(x[0] == "a" for x in subtree(t))
        if not c:
            return 0.0
        lcb, cb = sum(map(chars, links(body))), chars(body)
        base = math.log(c / max(1, c - lc) * lc + lcb / cb * c + math.e)
        value = math.log(max(1.0, c / max(1, lc) * max(1, tags) / max(1, lt)))
        return c / max(1, tags) * (value / math.log(base) if base > 1 else value)

    for _ in range(200):
        body = ("body", [grow(3) for _ in range(rng.randint(1, 4))])
        # Adjacent texts are one in a page; links within links close nothing in this parser.
        nodes = density.measure(density.parse(html_of(body)))[1:]
        want = subtree(body)
        assert len(nodes) == len(want)
        for n, t in zip(nodes, want, strict=True):
            assert n.name == t[0] and math.isclose(n.density, density_of(t, body), rel_tol=1e-9)
            assert math.isclose(n.total, sum(density_of(x, body) for x in t[1] if not isinstance(x, str)), rel_tol=1e-9, abs_tol=1e-12)
        assert density.select(density.parse(html_of(body))).name


def test_density_keeps_article_parts():
    """Names alone drop no part of an article; what they name goes where it is a text of its own, or thin, or links."""
    rng = random.Random(33)
    a, b, c, d = (passage(rng, 40) for _ in range(4))
    page = f"<body><article><p>{a}</p><p class='share'>{b}</p><p class='stock share price'>{c}</p><section id='related-work'><p>{d}</p></section><div class='share'><a href=/>Like</a></div><div class='comments'><p>{passage(rng, 20)}</p></div></article></body>"
    assert density.extract(page).split("\n") == [a, b, c, d]


def test_density_forms_headers_comments():
    """A form around the whole page; an article's own header; reader comments that outweigh the article; a plain form."""
    para = "Some words of an article that go on for a while, with a comma and a full stop. " * 4
    line = para.strip()
    assert density.extract(f"<body><form action=x><input><div><h1>Head</h1><p>{para}</p></div><button>Send</button></form></body>") == f"Head\n{line}"
    assert density.extract(f"<body><form><div><p>{para}</p><p>{para}</p></div><select><option>a</select></form>") == f"{line}\n{line}"
    assert density.extract(f"<body><article><header><h1>Head</h1></header><p>{para}</p></article><header><h1>Site</h1></header>") == f"Head\n{line}"
    assert density.extract(f"<body><article><header><a href=x>menu</a></header><h1>Head</h1><p>{para}</p></article>") == f"Head\n{line}"
    said = "".join(f"<div><p>{para * 3}</p></div>" for _ in range(9))
    assert density.extract(f"<body><article><h1>Head</h1><p>{para}</p></article><div id='discussion'>{said}</div>") == f"Head\n{line}"
    assert density.extract(f"<body><article><h1>Head</h1><p>{para}</p></article><div id='x7'>{said}</div>") == f"Head\n{line}"
    assert density.extract(f"<body><div><h1>Head</h1><p>{para}</p></div><form><p>{para * 9}</p></form>") == f"Head\n{line}"
    assert density.extract(f"<body><main><div><p>{para}</p></div></main><div>{said}</div>") == line


def test_density_of_a_long_page():
    """A page of some MB: whole, and in time that grows with its length."""
    para = "Words of a long page, one after the other. "
    page = f"<body><nav>{'<a href=x>menu</a>' * 500}</nav><article><h1>Head</h1>{f'<p>{para}</p>' * 60_000}</article>"
    assert density.extract(page).count("\n") == 60_000


def test_density_is_linear():
    import time

    def seconds(n):
        began = time.perf_counter()
        for page in ("<div>" * n + "</x>" * n, "<p><section>" + "<b>" * n + "<div></div>" * n + "<ul>" + "<li>" * n + "<table>" + "<td>" * n):
            density.extract(page)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(32000) < 16 * seconds(4000)


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>é x</p>"), (2, None, None), (2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = density.main_text(df).collect()
    assert len(got) == 4 and {(r.page_id, r.text, r.n_chars) for r in got} == {(1, "é x", 3), (2, "", 0), (None, "", 0)}
    assert density.main_text(df.limit(0)).count() == 0


# ---- 10


@pytest.mark.parametrize("zip64", [False, True])
def test_package(zip64):
    out = io.BytesIO()
    p = archive.Package(out, zip64)
    for name, parts in (("archive/records.warc.gz", [b"abc", b"defg"]), ("indexes/index.cdx", [b""])):
        p.begin(name)
        offsets = [p.write(x) for x in parts]
        p.end()
    p.close()
    data = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.read("archive/records.warc.gz") == b"abcdefg"
    found = archive.directory(io.BytesIO(data), len(data))
    assert archive.read_range(io.BytesIO(data), found["archive/records.warc.gz"], 3, 4) == b"defg" and offsets == [0]
    with pytest.raises(ValueError, match="end of central"):
        archive.directory(io.BytesIO(b"x" * 50), 50)
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 99)
        z.comment = b"PK\5\6 in a comment"
    packed = archive.directory(other, len(other.getvalue()))
    with pytest.raises(ValueError, match="compressed"):
        archive.read_range(other, packed["a"], 0, 1)


def test_archive_round_trip(spark):
    rows = [(1, "u", "x"), (2, "v", "x"), (2, "w", "x"), (3, "q", None), (4, None, ""), (None, "z", "x"), (5, "a\nb", "yé\r\n\r\n"), (None, None, "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(0))
    got = archive.round_trip(df, records_each=2).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(i), len((h or "").encode()), archive.digest_of((h or "").encode())) for i, _, h in rows)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("1", "revisit", 2), ("2", "response", None), ("2", "revisit", 2), ("3", "revisit", 4), ("4", "response", None), ("None", "revisit", 2), ("5", "response", None), ("None", "response", None)], key=lambda x: (x[0], x[1], str(x[2]))) or Counter(kinds) == Counter([("1", "revisit", 2), ("2", "response", None), ("2", "revisit", 2), ("3", "revisit", 4), ("4", "response", None), ("None", "revisit", 2), ("5", "response", None), ("None", "response", None)])
    assert next(bytes(r.payload) for r in got if r.page_id == 5) == "yé\r\n\r\n".encode()
    assert {r.record_type for r in archive.round_trip(df, least_bytes=2).collect()} == {"response"}
    assert archive.round_trip(df.limit(0)).count() == 0


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    """Stages in turn against plain Python: rejects go, one row of each group of copies stays, a passage stays once, the mix
    takes what mix() says, ids are those of the public encoder; nulls, repeats, an empty table and odd columns included."""
    pipe = pytest.importorskip("corpus_pipeline")
    rng = random.Random(41)
    p = passage(rng, 70)
    rows = [(i, passage(rng, 120), "ab"[i % 2]) for i in range(40)]
    rows += [(100, rows[3][1], "a"), (101, rows[3][1], "b"), (200, f"{passage(rng, 60)} {p} {passage(rng, 60)}", "a"), (201, f"{passage(rng, 60)} {p} {passage(rng, 60)}", None)]
    rows += [(300, "too short", "a"), (301, None, "b"), (None, passage(rng, 90), "a"), (302, " ".join([passage(rng, 10)] * 30), "b"), (5, rows[5][1], "b")]
    table = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    made, docs_ = {}, table
    for name, stage in pipe.STAGES:
        docs_ = stage(spark, docs_, "")
        docs_.write.parquet(str(tmp_path / name))
        docs_ = spark.read.parquet(str(tmp_path / name))
        made[name] = docs_.collect()
        if name != "encoded":
            assert docs_.columns == table.columns
    kept = sorted((str(i), t) for i, t, _ in rows if t and i not in (300, 302))
    assert sorted((str(r.doc_id), r.text) for r in made["quality"]) == kept
    one = sorted({(str(i), t) for i, t, _ in rows if t and i not in (300, 302, 100, 101)})
    assert sorted((str(r.doc_id), r.text) for r in made["near_duplicates"]) == one
    assert [p in r.text for r in sorted(made["repeated_passages"], key=str) if r.doc_id in (200, 201)].count(True) == 1 and len(made["repeated_passages"]) == len(one)
    want = {(str(r.doc_id), r.nth): r.copies for r in mixing.mix(spark.read.parquet(str(tmp_path / "repeated_passages"))).collect()}
    taken = Counter(str(r.doc_id) for r in made["mixture"])
    assert all(taken[i] == n for (i, _), n in want.items())
    texts = Counter(r.text for r in made["mixture"])
    if os.path.exists(pieces.MODEL):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
        assert Counter(tuple(r.ids) for r in made["encoded"]) == Counter({tuple(own.encode(t)): n for t, n in texts.items()})
    assert len(made["encoded"]) == len(made["mixture"]) and all(r.decoded for r in made["encoded"])
    empty = table.limit(0)
    for _, stage in pipe.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0
