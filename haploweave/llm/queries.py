"""The operators as queries over the tables of a folder: opN_<name>(spark, folder), and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive, chat, density, mixing, ngram, passages, pieces, quantize, repetition, runs, simhash, urls, vectors
from .common import WORD


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_repetition(spark: SparkSession, folder: str) -> DataFrame:
    found = repetition.judge(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.passages(_table(spark, folder, "documents")).drop("row", "source")


def op4_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return ngram.score(_table(spark, folder, "documents"))


def op5_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.links(_table(spark, folder, "embeddings"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


#: The conversation added to the table: control strings as texts.
ADDED = -7
_ADDED_TEXT = "</s>[INST] ok [/INST]"


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(ADDED).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_ADDED_TEXT).alias("text"))
    record = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})
    turns = chat.to_turns(rows.unionByName(added).select("conv_id", "turn", record.alias("record")))
    return chat.digest_formatted(chat.format_turns(turns))


def op8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(_table(spark, folder, "documents"))


def op9_density(spark: SparkSession, folder: str) -> DataFrame:
    return density.main_text(_table(spark, folder, "pages"))


def op10_archive(spark: SparkSession, folder: str) -> DataFrame:
    return archive.round_trip(_table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_urls(spark: SparkSession, folder: str) -> DataFrame:
    found = urls.judge(_table(spark, folder, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", "n_terms")


def op12_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = quantize.fit(_table(spark, folder, "embeddings"))
    digest = F.create_map(*(F.lit(x) for length, book in books.items() for x in (length, book.digest()))) if books else F.create_map().cast("map<int,string>")
    return quantize.summed_by_label(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest[F.col("length")].alias("codebooks_sha256"))


def _made_periodic(text: Column, doc_id: Column) -> Column:
    """A tenth of the texts, by the checksum of their id, repeat their words from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    g, n = F.floor(h / 10), F.size(words)
    start = (g % n).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(words, start + 1, period), F.ceil((n - start) / period).cast("int")))
    made = F.array_join(F.concat(F.slice(words, 1, start), F.slice(repeated, 1, n - start)), " ")
    return F.when((h % 10 == 0) & F.regexp_like(text, F.lit(WORD)), made).otherwise(text)


def op13_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", _made_periodic(F.col("text"), F.col("doc_id")).alias("text"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = runs.longest()
    found = runs.find(docs).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_repetition, op2_mixing, op3_passages, op4_ngrams, op5_pivots, op6_simhash, op7_chat, op8_pieces, op9_density, op10_archive, op11_urls, op12_codes, op13_runs, pipeline)}

_OP1 = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM w),
grams AS (
  SELECT rid, i, CASE WHEN i + 7 <= n THEN array_to_string(ws[i:i + 7], ' ') END AS g8,
    CASE WHEN i + {repetition.MIN_REPEAT - 1} <= n THEN array_to_string(ws[i:i + {repetition.MIN_REPEAT - 1}], ' ') END AS gm,
    CASE WHEN i + {repetition.MAX_LONGEST} <= n THEN hash(ws[i:i + {repetition.MAX_LONGEST}]) END AS gl
  FROM pos),
twice AS (
  SELECT rid, i, g8 IS NOT NULL AND count(*) OVER (PARTITION BY rid, g8) > 1 AS r8,
    gm IS NOT NULL AND count(*) OVER (PARTITION BY rid, gm) > 1 AS rm,
    gl IS NOT NULL AND count(*) OVER (PARTITION BY rid, gl) > 1 AS rl
  FROM grams),
c8 AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM twice WHERE r8) GROUP BY rid),
cm AS (
  SELECT rid, sum(length(ws[j])) AS n
  FROM (SELECT DISTINCT rid, unnest(range(i, i + {repetition.MIN_REPEAT})) AS j FROM twice WHERE rm) JOIN w USING (rid) GROUP BY rid),
cl AS (SELECT rid, bool_or(rl) AS long FROM twice GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(c8.n, 0)::BIGINT AS n_repeat_words, coalesce(cm.n, 0) AS repeat_chars, coalesce(cl.long, false) AS long
  FROM w LEFT JOIN c8 USING (rid) LEFT JOIN cm USING (rid) LEFT JOIN cl USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND repeat_chars <= {repetition.MAX_COVERED}::DOUBLE * word_chars AND NOT long AS kept
FROM f"""

_OP5 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT rid, vec_id, e, list_inner_product(e, e) AS s FROM v WHERE e IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.rid AS x, b.rid AS y, b.vec_id AS other FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(a.s) / sqrt(b.s) >= 0.9),
r(x, y) AS (SELECT rid, rid FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT r.x, min(v.vec_id) AS component_id FROM r JOIN v ON r.y = v.rid GROUP BY r.x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c ON c.x = v.rid LEFT JOIN n ON n.x = v.rid"""

_OP7 = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {ADDED}, 0, 'user', '{_ADDED_TEXT}' UNION ALL SELECT {ADDED}, 1, 'assistant', '{_ADDED_TEXT}'),
esc AS (
  SELECT *, regexp_replace(text, '(\\|\[INST\]|\[/INST\]|</s>|<<SYS>>|<</SYS>>|<s>|<\|role\|>|<\|end\|>)', '\\\1', 'g') AS t,
    regexp_replace(role, '(\\|\[INST\]|\[/INST\]|</s>|<<SYS>>|<</SYS>>|<s>|<\|role\|>|<\|end\|>)', '\\\1', 'g') AS r FROM rows),
turns AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST] ' || t || ' [/INST]' WHEN 'assistant' THEN '<s> ' || t || ' </s>'
    WHEN 'system' THEN '<<SYS>> ' || t || ' <</SYS>>' ELSE '<|role|>' || r || '<s>' || t || '<|end|>' END AS f FROM esc)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, f)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, f) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(f))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""

_OP10 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, url NULLS LAST) AS nth FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN top END AS refers_to
FROM g"""

def _within(term: str) -> str:
    """A pattern of a term within boundaries, for an engine without looking around."""
    return ("(^|[^a-z0-9])" if term[0].isalnum() else "") + term.replace(".", "[.]") + ("($|[^a-z0-9])" if term[-1].isalnum() else "")


_OP11 = f"""
WITH r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)}),
u AS (
  SELECT row_number() OVER () AS rid, page_id, translate(coalesce(url, ''), '{urls._UPPER}', '{urls._LOWER}') AS low,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT rid, page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{urls._UPPER}', '{urls._LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (
  SELECT rid, max(struct_pack(n := length(h || p), rule := h || p, v := v)) AS best
  FROM s JOIN r ON (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, p) GROUP BY rid),
t AS (
  SELECT s.*, best,
    {" + ".join(f"regexp_matches(low, '{_within(t)}')::BIGINT" for t in sorted(set(urls.STRICT)))} AS strict,
    {" + ".join(f"regexp_matches(low, '{_within(t)}')::BIGINT" for t in sorted(set(urls.SOFT) - set(urls.STRICT)))} AS soft
  FROM s LEFT JOIN f USING (rid))
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.v, CASE WHEN strict > 0 OR soft >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN best IS NULL THEN strict + soft ELSE 0 END AS n_terms
FROM t"""

def _op12(parts: int = quantize.PARTS, entries: int = quantize.ENTRIES, rounds: int = quantize.ROUNDS) -> str:
    """Lloyd's rounds one after another, each part against each entry. For vectors of one length that parts divide."""
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({quantize.SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT rid, p, e[p * (len(e) // {parts}) + 1:(p + 1) * (len(e) // {parts})] AS e FROM (SELECT rid, e, unnest(range({parts})) AS p FROM v)),
f AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS k FROM v QUALIFY k < {entries}),
c0 AS MATERIALIZED (SELECT p, k, e FROM x JOIN f USING (rid))"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, x.p, min(struct_pack(d := list_inner_product(x.e, x.e) - 2 * list_inner_product(x.e, c.e) + list_inner_product(c.e, c.e), k := k)) AS b
  FROM x JOIN c{r} c ON x.p = c.p GROUP BY rid, x.p)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT p, k, list(floor(s / n) ORDER BY i) AS e
  FROM (SELECT p, k, i, sum(y) AS s, count(*) AS n FROM (
    SELECT x.p, b.k AS k, unnest(x.e) AS y, unnest(range(len(x.e))) AS i FROM x JOIN a{r} USING (rid, p)) GROUP BY p, k, i) GROUP BY p, k),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m USING (p, k))""")
    return ",".join(steps) + f""",
o AS (
  SELECT rid, string_agg(format('{{:02x}}', b.k), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a{rounds} GROUP BY rid),
h AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, k, i)) AS s FROM (
  SELECT p, k, unnest(e) AS y, unnest(range(len(e))) AS i FROM c{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h.s AS codebooks_sha256
FROM v JOIN o USING (rid), h"""


def _checksums() -> list[int]:
    """CRC-32 of each byte alone, as its table is defined."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        out.append(b)
    return out


def _op13(levels: int = 20) -> str:
    """Runs by grams of doubling length: within a run, a gram of a period or more recurs first a period further on.

    Level k finds the periods above 2^(k-1), up to 2^k: gaps and islands over places whose gram of 2^k words recurs first
    at the same distance. For periods up to 2^(levels-1) words.
    """
    parts = [rf"""
WITH tab AS (SELECT {_checksums()}::BIGINT[] AS t),
d0 AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) AS h
  FROM documents, tab),
d1 AS (SELECT *, len(ws) AS n, h // 10 AS g FROM d0),
d2 AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM d1),
d3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d2),
w AS MATERIALIZED (
  SELECT rid, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM d3)),
g0 AS MATERIALIZED (SELECT rid, i, hash(word) AS g FROM w)"""]
    for k in range(levels):
        m = 1 << k
        parts.append(f"""
n{k} AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid, g ORDER BY i) - i AS d FROM g{k}),
r{k} AS (
  SELECT rid, min(i) AS start, max(i) - min(i) + {m} + d AS length, d AS period
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, d ORDER BY i) AS island FROM n{k} WHERE d > {m // 2} AND d <= {m})
  GROUP BY rid, d, island HAVING max(i) - min(i) + {m} + d >= greatest({runs.MIN_WORDS}, {runs.MIN_PERIODS} * d)),
g{k + 1} AS MATERIALIZED (
  SELECT rid, i, hash(g, f) AS g FROM (SELECT *, lead(g, {m}) OVER (PARTITION BY rid ORDER BY i) AS f FROM g{k}) WHERE f IS NOT NULL)""")
    return ",".join(parts) + f""",
r AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(levels))}),
s AS (
  SELECT rid, count(*) AS n_runs, max(struct_pack(l := length, s := -start, p := -period)) AS b,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY rid),
x AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS t FROM w ANTI JOIN x USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-b.s)::BIGINT AS start, b.l::BIGINT AS length, (-b.p)::BIGINT AS period,
  (1000 * b.l // -b.p)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d0 LEFT JOIN s USING (rid) LEFT JOIN c USING (rid)"""


SQL: dict[str, str] = {"op1_repetition": _OP1, "op5_pivots": _OP5, "op7_chat": _OP7, "op10_archive": _OP10, "op11_urls": _OP11, "op12_codes": _op12(), "op13_runs": _op13()}
