"""URL filters: rules of hosts and paths, and a weighted vocabulary counted by an Aho-Corasick automaton.

The automaton (public: Aho and Corasick, 1975) is one table of next states over the bytes that its terms use. A batch's
URLs run through it side by side, one byte of each at a step, so that a step is a few operations on whole arrays.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, prepare

#: Terms that reject alone, and terms of which SOFT_LIMIT different ones reject. A parameter: these are a start, not a list of the web.
STRICT = ("porn", "porno", "xxx", "xvideos", "hentai", "milf", "escorts", "camgirls", "viagra", "cialis", "cheap-pills", "casino-win", "adult-x", "phishing", "warez")
SOFT = ("adult", "sex", "nude", "casino", "poker", "betting", "slots", "jackpot", "pills", "pharmacy", "cheap", "loan", "payday", "win", "free", "bonus", "torrent", "crack", "keygen", "spam")
SOFT_LIMIT = 2
#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """With A-Z in lower case, and no other letter changed."""
    return F.translate(text, _UPPER, _LOWER)


class Vocabulary:
    """An Aho-Corasick automaton over the UTF-8 bytes of weighted terms: term -> weight.

    step[state * width + byte class] is the next state, failures followed in advance; ends[state] lists the terms that
    end there, by the failure links, so none is missed inside another. A term counts where neither neighbour is an ASCII
    letter or digit, for a term's end that is one itself ("cheap-pills" within "/cheap-pills/", "sex" not within "essex").
    """

    def __init__(self, weights: dict[str, int]) -> None:
        self.terms = [t.encode() for t in sorted(weights) if t]
        self.weights = np.array([weights[t.decode()] for t in self.terms], dtype=np.int64)
        used = sorted({b for t in self.terms for b in t})
        self.kind = np.zeros(256, dtype=np.int64)
        self.kind[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        rows, self.ends = [[0] * self.width], [[]]
        for k, term in enumerate(self.terms):
            at = 0
            for b in term:
                c = int(self.kind[b])
                if not rows[at][c]:
                    rows[at][c] = len(rows)
                    rows.append([0] * self.width)
                    self.ends.append([])
                at = rows[at][c]
            self.ends[at].append(k)
        fail, queue = [0] * len(rows), deque(s for s in rows[0] if s)
        while queue:
            at = queue.popleft()
            self.ends[at] = self.ends[at] + self.ends[fail[at]]
            for c in range(self.width):
                to, other = rows[at][c], rows[fail[at]][c]
                if to:
                    fail[to] = other
                    queue.append(to)
                else:
                    rows[at][c] = other
        self.step = np.array(rows, dtype=np.int64).reshape(-1)
        self.final = np.array([bool(e) for e in self.ends])

    def hits(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text, place after the last byte, state) of each place where terms end, boundaries not yet looked at."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        length = np.array([len(texts[k]) for k in order], dtype=np.int64)
        begin = np.zeros(len(texts), dtype=np.int64)
        np.cumsum(length[:-1], out=begin[1:])
        data = self.kind[np.frombuffer(b"".join(texts[k] for k in order), dtype=np.uint8)]
        state, live = np.zeros(len(texts), dtype=np.int64), len(texts)
        for i in range(int(length[0]) if len(texts) else 0):
            while length[live - 1] <= i:
                live -= 1
            state[:live] = self.step[state[:live] * self.width + data[begin[:live] + i]]
            for k in np.flatnonzero(self.final[state[:live]]).tolist():
                yield int(order[k]), i + 1, int(state[k])

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of different terms it holds within boundaries, and the sum of their weights."""
        found: set[tuple[int, int]] = set()
        for k, end, state in self.hits(texts):
            text = texts[k]
            for term in self.ends[state]:
                begin = end - len(self.terms[term])
                if not (begin and _joined(text[begin - 1], text[begin]) or end < len(text) and _joined(text[end - 1], text[end])):
                    found.add((k, term))
        rows = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        return np.bincount(rows[:, 0], minlength=len(texts)), np.bincount(rows[:, 0], self.weights[rows[:, 1]], len(texts)).astype(np.int64)


def _joined(a: int, b: int) -> bool:
    """Whether two neighbouring bytes are both ASCII letters or digits."""
    return bytes((a,)).isalnum() and bytes((b,)).isalnum()


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to /, ? or #, A-Z in lower case; then up to ? or #. Both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _fits(rule: Column) -> Column:
    return F.col("path").startswith(rule["path"])


def _named(host: str) -> Callable[[Column], Column]:
    def out(rule: Column) -> Column:
        name = F.concat(F.col(host), rule["path"])
        return F.struct(F.length(name).alias("length"), (rule["verdict"] == "allow").alias("allows"), name.alias("rule"), rule["verdict"].alias("verdict"))

    return out


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(host, path, ...) and rules(host, path, verdict) -> with rule (host and path of the longest that fits) and ruled.

    A rule fits its host and its subdomains where the path starts with the rule's. Rules are grouped by host, so that one
    join for each number of labels that rules' hosts have finds all that fit: no URL's row is repeated or moved to meet its
    other rows, and a host that has a third of them is split by the join as any other. Of the same rule twice, one that
    allows counts. Nulls in a rule count as empty; a rule of an empty host fits only an empty host.
    """
    rules = rules.select(F.coalesce(lowered(F.col("host")), F.lit("")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.coalesce("verdict", F.lit("")).alias("v"))
    hosts = rules.groupBy("h").agg(F.collect_set(F.struct(F.col("p").alias("path"), F.col("v").alias("verdict"))).alias("own")).withColumn("labels", F.size(F.split("h", r"\.")))
    depths = [tuple(r) for r in hosts.groupBy("labels").count().orderBy("labels").collect()]
    out, found = urls, [F.lit(None).cast("struct<length:int,allows:boolean,rule:string,verdict:string>")] * 2
    for labels, n_hosts in depths:
        host, own = f"_host{labels}", f"_own{labels}"
        here = hosts.where(F.col("labels") == labels).select(F.col("h").alias(host), F.col("own").alias(own))
        out = join_checked(out, here, F.substring_index("host", ".", -labels) == F.col(host), n_hosts, how="left")
        found.append(F.array_max(F.transform(F.filter(own, _fits), _named(host))))
    best = F.greatest(*found)
    out = out.withColumn("_best", best)
    return out.withColumns({"rule": F.col("_best.rule"), "ruled": F.col("_best.verdict")}).drop("_best", *(f"_{k}{labels}" for labels, _ in depths for k in ("host", "own")))


def judge(pages: DataFrame, rules: DataFrame | None = None, strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """pages(page_id, url, ...) -> (page_id, url, host, path, rule, n_terms, weight, verdict), one row per row.

    verdict: that of the longest rule that fits, else the vocabulary's: block where the URL (A-Z in lower case, null: empty)
    holds a strict term or soft_limit different soft ones within boundaries. A strict term weighs soft_limit, a soft one
    1, and a URL of at least soft_limit is blocked; a term in both lists is strict. n_terms and weight are 0 where a rule
    decides: those URLs don't go through the automaton. Other columns aren't read; repeated rows stay; an empty table
    gives an empty table. URLs of any length are read whole; only the URL leaves the JVM, and nothing is shuffled.
    """
    spark = prepare(pages.sparkSession)
    if rules is None:
        rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    weights = {lower_ascii(t): 1 for t in soft} | {lower_ascii(t): soft_limit for t in strict}

    @F.pandas_udf("n long, weight long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(weights)
        for urls in parts:
            n, weight = vocabulary.count([b"" if u is None else lower_ascii(u).encode() for u in urls])
            yield pd.DataFrame({"n": n, "weight": weight})

    host, path = split_url(F.col("url"))
    found = with_rules(pages.select("page_id", "url").withColumns({"host": host, "path": path}), rules)
    found = found.withColumn("terms", counted(F.when(F.col("ruled").isNull(), F.col("url"))))
    by_terms = F.when(F.col("terms.weight") >= soft_limit, "block").otherwise("allow")
    return found.select("page_id", "url", "host", "path", "rule", F.col("terms.n").alias("n_terms"), F.col("terms.weight").alias("weight"), F.coalesce("ruled", by_terms).alias("verdict"))


_TO_LOWER = str.maketrans(_UPPER, _LOWER)


def lower_ascii(text: str) -> str:
    return text.translate(_TO_LOWER)
