"""Queries of this subpackage and their SQL, for registration."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, fim, line_dedup, near_dups, packing, quality, secrets, site_bayes, suffix_dedup, token_rollup, whitening
from .storage import settle, shared_dir

#: Folder with the vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources, and a source's languages its paths."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return site_bayes.classified(_docs(spark, sf_dir), labels, F.col("source"), F.col("lang"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four commits: all documents; counts revised where marks at word ends are stripped; exact copies deleted; and the last batch again.

    Of rows with one text the first by (doc_id, source, lang) stays, whether ids repeat or not; rows without an id come last.
    """
    docs = _docs(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", "lang", F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("i"), "text", F.regexp_replace("text", r"[#*$%&]{3}|!!", "").alias("stripped"))
    counted = token_rollup.with_counts(rows, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "text", "stripped")
    names = ["h", "i", "doc_id", "source", "lang", "n_bpe", "n_plain", "m_bpe", "m_plain", "revised"]
    both = settle(counted.groupBy(*names).agg(F.count("*").alias("times")), "counts")

    def events(rows: DataFrame, op: str, count: str, before: str) -> DataFrame:
        of = F.explode(F.array(*(F.struct(F.lit(name).alias("tokenizer"), F.col(f"{count}_{k}").alias("n_tokens"), F.col(f"{before}_{k}").alias("old_tokens")) for name, k in (("byte_bpe_50k/1", "bpe"), ("plain_words/1", "plain")))))
        return rows.select("source", "lang", F.lit(op).alias("op"), "times", of.alias("x")).select("source", "lang", "op", "times", "x.*")

    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "source", "lang")
    first = both.groupBy("h", "i").agg(F.min(place).alias("first"), F.sum("times").alias("rows")).where("rows > 1")
    copies = both.join(first, ["h", "i"]).withColumn("times", F.col("times") - F.when(place.eqNullSafe(F.col("first")), 1).otherwise(0)).where("times > 0")
    ledger = token_rollup.Ledger(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    ledger.commit("load", events(both, "insert", "n", "n"))
    ledger.commit("strip", events(both.where("revised"), "revise", "m", "n"))
    for _ in range(2):
        ledger.commit("copies", events(copies, "delete", "m", "m"))
    return ledger.totals()


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_table(_docs(spark, sf_dir))


def op9_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_docs(spark, sf_dir))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(_docs(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and lines cut of every document, and the digest of what is left of its text."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    before = docs.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long"))
    out = line_dedup.deduplicated(before)
    return out.select("doc_id", "n_lines", F.coalesce(F.size("_cut"), F.lit(0)).cast("long").alias("n_cut"), F.sha2(text, 256).alias("kept_sha256"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_docs(spark, sf_dir))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_docs(spark, sf_dir), _benchmark(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_docs(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the transformed texts and of the texts rebuilt from them."""
    out = fim.transformed(_docs(spark, sf_dir))
    back = fim.restored(F.col("output"), F.col("form"))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.groups(_docs(spark, sf_dir), every_digest=True)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component; deviation is null where it does not fit in 64 bits."""
    rows, fit = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    shares = F.array(*(F.lit(float(v)) for v in fit.explained)).cast("array<double>")
    out = rows.select(F.col("id").alias("vec_id"), F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(fit.identity_error).alias("identity_error"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_line_dedup,
        op3_secret_scans,
        op4_benchmark_decontamination,
        op5_chat_formatting,
        op6_quality_classifier,
        op7_token_counts,
        op8_suffix_array_dedup,
        op9_minhash_near_dups,
        op10_packing,
        op11_fill_in_middle,
        op12_exact_dedup,
        op13_embedding_whitening,
    )
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op9_minhash_near_dups"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
      ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS sh FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT i.a, i.b FROM i JOIN n na ON na.doc_id = i.a JOIN n nb ON nb.doc_id = i.b WHERE 100 * k >= 75 * (na.n + nb.n - k)
), e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), r AS (
  SELECT doc_id AS id, doc_id AS low FROM documents
  UNION SELECT e2.b, r.low FROM r JOIN e2 ON e2.a = r.id WHERE r.low < e2.b
), c AS (SELECT id, min(low) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

ORACLE_SQL["op1_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (SELECT doc_id, host, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM d
), g AS (SELECT doc_id, i, l[i:i + 2] AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM w)
), r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), h AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM r, (VALUES (0), (1), (2)) t(k)) GROUP BY 1
), ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d
), lc AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM ln WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1
), m AS (
  SELECT w.doc_id, host, len(l) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words
  FROM w LEFT JOIN h ON h.doc_id = w.doc_id LEFT JOIN lc ON lc.doc_id = w.doc_id
), f AS (
  SELECT *, (n_words < 50)::INT AS few, (100 * n_repeat_words > 50 * n_words)::INT AS rep, (100 * n_symbols > 10 * word_chars)::INT AS sym, (100 * n_dup_lines > 30 * n_lines)::INT AS dup FROM m
), hs AS (SELECT host, count(*) AS n, sum(few) AS few, sum(rep) AS rep, sum(sym) AS sym, sum(dup) AS dup FROM f GROUP BY 1
), u AS (UNPIVOT hs ON few, rep, sym, dup INTO NAME rule VALUE k
), p AS (SELECT rule, sum(k) / sum(n) AS m, count(*) - 1 AS df, sum(k * k / n) - sum(k) * (sum(k) / sum(n)) AS ss, sum(n) - sum(n::DOUBLE * n) / sum(n) - (count(*) - 1) AS room FROM u GROUP BY 1
), cw AS (SELECT rule, m, CASE WHEN m * (1 - m) > 0 AND room > 0 THEN (ss / (m * (1 - m)) - df) / room ELSE 0 END AS c FROM p
), s AS (SELECT rule, m, CASE WHEN c <= 1 / 1001.0 THEN 1000.0 ELSE greatest(1 / c - 1, 1.0) END AS s FROM cw
), v AS (SELECT host, rule, (k + m * s) / (n + s) >= 0.08 AS bad FROM u JOIN s USING (rule)
), b AS (SELECT host, bool_or(bad AND rule = 'few') AS few, bool_or(bad AND rule = 'rep') AS rep, bool_or(bad AND rule = 'sym') AS sym, bool_or(bad AND rule = 'dup') AS dup FROM v GROUP BY 1)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  f.few + f.rep > 0 AS base_failed,
  (f.few = 1 AND b.few) OR (f.rep = 1 AND b.rep) OR (f.sym = 1 AND b.sym) OR (f.dup = 1 AND b.dup) AS host_failed,
  NOT (f.few + f.rep > 0) AND NOT ((f.few = 1 AND b.few) OR (f.rep = 1 AND b.rep) OR (f.sym = 1 AND b.sym) OR (f.dup = 1 AND b.dup)) AS kept
FROM f JOIN b USING (host)
"""

ORACLE_SQL["op4_benchmark_decontamination"] = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), l AS (
  SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS l FROM t
), iw AS (
  SELECT DISTINCT id, least(len(l), 13) AS k, array_to_string(l[i:i + 12], ' ') AS g
  FROM (SELECT id, l, unnest(range(1, greatest(len(l) - 12, 1) + 1)) AS i FROM l WHERE kind = 'i' AND len(l) > 0)
), ks AS (SELECT DISTINCT k FROM iw
), dw AS (
  SELECT id, k, i, array_to_string(l[i:i + k - 1], ' ') AS g
  FROM (SELECT id, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM l, ks WHERE kind = 'd')
), o AS (SELECT dw.id, dw.k, dw.i, iw.id AS item FROM dw JOIN iw ON iw.g = dw.g AND iw.k = dw.k
), h AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + k)) AS p FROM o) GROUP BY 1
), n AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM o) GROUP BY 1)
SELECT l.id AS doc_id, len(l.l)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l.l) AS contaminated
FROM l LEFT JOIN h ON h.id = l.id LEFT JOIN n ON n.id = l.id WHERE l.kind = 'd'
"""


def _duck_spans(kind: str, pattern: str, least: str = "true") -> str:
    """Matches of the pattern with their places; least is a condition on m (whole match) and v (second group)."""
    group = 2 if "v" in least.split() else 0
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS k, s, s + length(m) AS e FROM (
      SELECT doc_id, ms[i] AS m, vs[i] AS v, list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
      FROM (SELECT doc_id, ms, vs, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {group}) AS vs, string_split_regex(text, '{p}') AS gs FROM d))) WHERE {least}"""


ORACLE_SQL["op3_secret_scans"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), p AS (SELECT doc_id, k, s::BIGINT AS s, e::BIGINT AS e FROM (
  {_duck_spans("assign", secrets.ASSIGN, "length( v ) >= 6")}
  UNION ALL {_duck_spans("access", secrets.ACCESS, "length( m ) >= 20")}
  UNION ALL {_duck_spans("hex", secrets.HEX, "length( m ) >= 24")}
  UNION ALL {_duck_spans("ident", secrets.IDENT, "length( v ) >= 3")}
  UNION ALL {_duck_spans("value", secrets.VALUE)}
  UNION ALL {_duck_spans("endpoint", secrets.ENDPOINT)})
), n AS (SELECT * FROM p WHERE k IN ('access', 'ident')
), v AS (SELECT * FROM p WHERE k IN ('assign', 'hex', 'value')
), w AS (
  SELECT i.doc_id, i.k, i.s, i.e FROM n i JOIN v ON v.doc_id = i.doc_id AND i.s - 400 <= v.e AND v.s - 400 <= i.e AND (v.e <= i.s OR i.e <= v.s) WHERE i.k = 'ident'
  UNION SELECT v.doc_id, v.k, v.s, v.e FROM v JOIN n ON n.doc_id = v.doc_id AND n.s - 400 <= v.e AND v.s - 400 <= n.e AND (v.e <= n.s OR n.e <= v.s) WHERE v.k = 'value'
  UNION SELECT u.doc_id, u.k, u.s, u.e FROM p u JOIN n ON n.doc_id = u.doc_id AND n.s - 400 <= u.e AND u.s - 400 <= n.e AND (u.e <= n.s OR n.e <= u.s)
    JOIN v ON v.doc_id = u.doc_id AND v.s - 400 <= u.e AND u.s - 400 <= v.e AND (u.e <= v.s OR v.e <= u.s) AND n.s - 400 <= v.e AND v.s - 400 <= n.e AND (v.e <= n.s OR n.e <= v.s) WHERE u.k = 'endpoint'
), r AS (
  SELECT doc_id, k, s, e FROM p WHERE k IN ('assign', 'access', 'hex') UNION ALL SELECT doc_id, k, s, e FROM w
), o AS (
  SELECT *, list_position(['assign', 'access', 'hex', 'ident', 'value', 'endpoint'], k) AS o, k || ':' || s || ':' || e AS x FROM r
), a AS (
  SELECT doc_id, count(*) FILTER (k = 'assign') AS n_assign, count(*) FILTER (k = 'access') AS n_access, count(*) FILTER (k = 'hex') AS n_hex, count(*) FILTER (o > 3) AS n_linked,
    string_agg(x, ',' ORDER BY s, o) FILTER (o <= 3) AS base, string_agg(x, ',' ORDER BY s, o) AS spans FROM o GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0)::BIGINT AS n_linked
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

ORACLE_SQL["op8_suffix_array_dedup"] = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), h AS (SELECT doc_id, octet_length(b) AS n, hex(b) AS x FROM d
), s AS (SELECT doc_id, i, md5_number(substring(x, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS i FROM h WHERE n >= 400)
), r AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY k) > 1
), g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS f FROM r
), u AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g
), v AS (SELECT doc_id, run, min(i) AS lo, max(i) + 400 AS hi FROM u GROUP BY 1, 2
), p AS (SELECT v.doc_id, run, lo, hi, coalesce(lag(hi) OVER (PARTITION BY v.doc_id ORDER BY run), 0) AS since FROM v
), k AS (
  SELECT p.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substring(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY run) || substring(any_value(x), 2 * max(hi) + 1) AS kept
  FROM p JOIN h ON h.doc_id = p.doc_id GROUP BY 1)
SELECT h.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM h LEFT JOIN k ON k.doc_id = h.doc_id
"""

ORACLE_SQL["op5_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, role, replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' AS body, coalesce(turn, 0) // 256 AS part FROM conversations
), p AS (SELECT DISTINCT conv_id, role AS me FROM t WHERE role IS NOT NULL AND role <> 'system'
), r AS (
  SELECT t.conv_id, part, me, turn, role, body, role IS NOT DISTINCT FROM me AS mine,
    '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = me THEN 'assistant' ELSE 'user name=' || regexp_replace(coalesce(role, 'unknown'), '[\s<>|]', '_', 'g') END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, row_number() OVER w AS k, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS s FROM r
  WINDOW w AS (PARTITION BY conv_id, part, me ORDER BY turn NULLS FIRST, role NULLS FIRST, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, part::BIGINT AS part, me AS perspective, count(*)::BIGINT AS n_turns, string_agg(head || body || chr(10), '' ORDER BY k) AS rendered,
  coalesce(string_agg(s::BIGINT || ':' || (s + length(body))::BIGINT, ',' ORDER BY k) FILTER (mine), '') AS mask, coalesce(sum(length(body)) FILTER (mine), 0)::BIGINT AS n_masked
FROM o GROUP BY 1, 2, 3
"""

#: Parts are cut by code points here, from the lengths of the units before a cut.
ORACLE_SQL["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (SELECT *, list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]'), lambda x: length(x)) AS ls FROM d
), c AS (
  SELECT *, len(ls) AS n, ('0x' || h[1:8])::BIGINT % (len(ls) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(ls) + 1) AS b,
    ('0x' || h[17:24])::BIGINT % 100 >= 90 OR text = '' OR regexp_matches(text, '<[PSM]>') AS plain, ('0x' || h[25:32])::BIGINT % 100 < 20 AS spm FROM u
), p AS (SELECT *, coalesce(list_sum(ls[1:least(a, b)]), 0)::BIGINT AS i, coalesce(list_sum(ls[1:greatest(a, b)]), 0)::BIGINT AS j FROM c
), q AS (SELECT *, substr(text, 1, i) AS x, substr(text, i + 1, j - i) AS y, substr(text, j + 1) AS z FROM p)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN i END AS prefix_chars, CASE WHEN NOT plain THEN j - i END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN spm THEN concat('<S>', z, '<P>', x, '<M>', y) ELSE concat('<P>', x, '<S>', z, '<M>', y) END) AS output_sha256, sha256(text) AS restored_sha256
FROM q
"""

ORACLE_SQL["op12_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents
), r AS (
  SELECT doc_id, bare, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS size, row_number() OVER w AS k FROM d
  WINDOW w AS (PARTITION BY bare ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, size::BIGINT AS group_size, k = 1 AS kept, sha256(bare) AS text_sha256 FROM r
"""
