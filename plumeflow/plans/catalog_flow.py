"""Registered queries, fourth part: sequential operators, each held against a recursion of one row at a time in SQL."""

from __future__ import annotations

import contextlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators import digest as dg
from ..operators import schedules as sch
from ..operators import sequential as seq
from ..sources import shared, versions
from ..streaming import flows
from . import fixtures as fx
from .catalog import query
from .fixtures import AS_OF, Tables

# --- digests ----------------------------------------------------------------------------------------------------------


def _digest_rows(t: Tables) -> DataFrame:
    return t.conversations.select(
        F.col("conv_id").alias("group_id"),
        F.col("turn").alias("ord"),
        F.lit("Weekly").alias("name"),
        F.lit(AS_OF).cast("date").alias("published"),
        F.col("role").alias("title"),
        F.col("text").alias("content"),
        F.concat(F.lit("https://x.example.com/"), F.col("turn").cast("string")).alias("url"),
    )


def _digest_sql(most: int) -> str:
    part = r"""|| '. ' || t || chr(10) || CASE WHEN c = '' THEN '' ELSE c || chr(10) END || 'Link: ' || u"""
    head = f"length('2024년 1월 31일 Weekly 모음{dg.INTRO}')"
    return rf"""
WITH RECURSIVE i AS (
  SELECT conv_id AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, coalesce(role, '') AS t,
    trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS c, 'https://x.example.com/' || turn AS u, length(coalesce(text, '')) < {dg.SHORT} AS short FROM conversations
), ok AS (SELECT g FROM i GROUP BY 1 HAVING count(*) FILTER (short) >= {dg.MIN_SHORT}
), f AS (
  SELECT g, k, 1::BIGINT AS no, 1::BIGINT AS m, {head} + length('1' {part}) + 2 AS len FROM i SEMI JOIN ok USING (g) WHERE k = 1
  UNION ALL
  SELECT g, i.k, CASE WHEN more THEN no ELSE no + 1 END, CASE WHEN more THEN m + 1 ELSE 1 END, CASE WHEN more THEN len + longer ELSE {head} + length('1' {part}) + 2 END
  FROM (SELECT f.*, i.k AS next, length((m + 1) {part}) + 2 AS longer, len + longer <= {most} AS more FROM f JOIN i ON i.g = f.g AND i.k = f.k + 1) x JOIN i USING (g) WHERE i.k = x.next
), c AS (
  SELECT g, no, count(*) AS n_items, string_agg(m {part}, chr(10) || chr(10) ORDER BY k) AS body, max(no) OVER (PARTITION BY g) AS of_all FROM f JOIN i USING (g, k) GROUP BY 1, 2
), d AS (
  SELECT *, '{dg.INTRO}' || chr(10) || chr(10) || body AS rest, '2024년 1월 31일 Weekly 모음' || CASE WHEN of_all > 1 THEN ' (' || no || '/' || of_all || ')' ELSE '' END AS draft FROM c
), e AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY no) AS chunk, count(*) OVER (PARTITION BY g) AS n FROM d
  WHERE n_items >= {dg.MIN_SHORT} AND length(draft) + length(rest) BETWEEN {dg.LEAST} AND {most}
), r AS (SELECT *, '2024년 1월 31일 Weekly 모음' || CASE WHEN n > 1 THEN ' (' || chunk || '/' || n || ')' ELSE '' END AS title FROM e)
SELECT g AS group_id, chunk::BIGINT AS chunk, n_items::BIGINT AS n_items, title, title || rest AS content FROM r"""


@query("dig01_digests", _digest_sql(dg.MOST))
def dig01(t: Tables) -> DataFrame:
    return dg.digests(_digest_rows(t))


@query("dig04_greedy_chunks", _digest_sql(2000))
def dig04(t):
    return dg.digests(_digest_rows(t), most=2000)


@query(
    "win05_greedy_fill",
    r"""
WITH RECURSIVE i AS (SELECT o_custkey AS g, o_orderkey AS id, round(o_totalprice)::BIGINT AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders
), f AS (
  SELECT g, k, id, 1::BIGINT AS bin, w AS load FROM i WHERE k = 1
  UNION ALL SELECT g, i.k, i.id, CASE WHEN load + w <= 400000 THEN bin ELSE bin + 1 END, CASE WHEN load + w <= 400000 THEN load + w ELSE w END FROM f JOIN i USING (g) WHERE i.k = f.k + 1)
SELECT g AS o_custkey, id AS o_orderkey, bin, load FROM f""",
)
def win05(t):
    return seq.filled(t.orders.select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("w")), "o_custkey", "o_orderkey", "w", 400_000).select("o_custkey", "o_orderkey", "bin", "load")


# --- suppression and spacing ------------------------------------------------------------------------------------------

BAN_SQL = r"""
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), r AS (
  SELECT user_id, 0::BIGINT AS k, []::BIGINT[] AS recent, 0::BIGINT AS until, NULL::BIGINT AS ban FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT r.user_id, e.k, CASE WHEN t < until THEN recent WHEN hit THEN [] ELSE near END, CASE WHEN t >= until AND hit THEN t + {ban} * 1000000::BIGINT ELSE until END, CASE WHEN t >= until AND hit THEN t END
  FROM (SELECT r.*, e.k AS next, e.t AS at, list_append(list_filter(recent, lambda x: x > e.t - {find} * 1000000::BIGINT), e.t) AS near, len(near) >= {most} AS hit FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) r
  JOIN e ON e.user_id = r.user_id AND e.k = r.next)
SELECT user_id, ban AS from_us, ban + {ban} * 1000000::BIGINT AS until_us FROM r WHERE ban IS NOT NULL"""
MOST, FIND, BAN = 3, 8 * 3600, 36 * 3600


@query("stm06_exact_ban", BAN_SQL.format(most=MOST, find=FIND, ban=BAN))
def stm06(t):
    found = seq.bans(t.events, "user_id", MOST, FIND, BAN)
    return found.select("user_id", F.unix_micros("from_ts").alias("from_us"), F.unix_micros("until_ts").alias("until_us"))


@query(
    "stm09_host_spacing",
    r"""
WITH RECURSIVE p AS (SELECT page_id, regexp_extract(url, 'https?://([^/?#]+)', 1) AS host, page_id // 3 * 2 AS arrival FROM pages
), i AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY arrival, page_id) AS k FROM p WHERE host <> ''
), r AS (
  SELECT page_id, host, arrival, k, arrival AS start FROM i WHERE k = 1
  UNION ALL SELECT i.page_id, i.host, i.arrival, i.k, greatest(i.arrival, r.start + 15) FROM r JOIN i ON i.host = r.host AND i.k = r.k + 1)
SELECT page_id, host, arrival::BIGINT AS arrival, start::BIGINT AS start, (start - arrival)::BIGINT AS wait FROM r""",
)
def stm09(t):
    calls = t.pages.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.floor(F.col("page_id") / 3).cast("long").alias("arrival")).where("host is not null")
    return seq.spaced(calls.withColumn("arrival", F.col("arrival") * 2), "host", "arrival", "page_id", 15)


@query(
    "stm12_single_flight",
    r"""
WITH RECURSIVE c AS (SELECT event_id, event_type || user_id % 10 AS key, epoch_us(ts) // 1000000 AS came, greatest(round(value * 60)::BIGINT, 1) AS took FROM events
), i AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY came, event_id) AS k FROM c
), r AS (
  SELECT event_id, key, came, k, k - 1 AS leader, came + took AS ends, false AS shared FROM i WHERE k = 1
  UNION ALL SELECT i.event_id, i.key, i.came, i.k, CASE WHEN i.came < ends THEN leader ELSE i.k - 1 END, CASE WHEN i.came < ends THEN ends ELSE i.came + took END, i.came < ends FROM r JOIN i ON i.key = r.key AND i.k = r.k + 1)
SELECT key, leader::BIGINT AS leader, ends::BIGINT AS ends, count(*) FILTER (shared)::BIGINT AS followers, min(came)::BIGINT AS began FROM r GROUP BY 1, 2, 3""",
)
def stm12(t):
    calls = t.events.select("event_id", F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.round(F.col("value") * 60).cast("long").alias("took"))
    return seq.flights(calls, "key", "at", "took", "event_id").groupBy("key", "leader", "ends").agg(F.count_if("shared").alias("followers"), F.min("at").alias("began"))


# --- triggers ---------------------------------------------------------------------------------------------------------


@query(
    "stm03_triggers",
    r"""
WITH e AS (SELECT event_id, epoch_us(ts) AS t FROM events
), b AS (SELECT epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS s
), f AS (
  SELECT 'rate' AS kind, s + i * 300000000 AS fire FROM b, (SELECT unnest(range(0, 31 * 288)) AS i)
  UNION ALL SELECT 'daily', epoch_us(TIMESTAMP '2024-01-01 00:05:00') + (i * 86400 - 9 * 3600) * 1000000 FROM (SELECT unnest(range(0, 31)) AS i)
  UNION ALL SELECT 'weekly', epoch_us(TIMESTAMP '2024-01-01 08:00:00') + (i * 86400 - 9 * 3600) * 1000000 FROM (SELECT unnest(range(0, 31)) AS i) WHERE isodow(DATE '2024-01-01' + i::INT) = 1
  UNION ALL SELECT 'delay', s + (sum(p_size * 60 + 600) OVER (ORDER BY p_partkey) - (p_size * 60 + 600))::BIGINT * 1000000 FROM b, part
), k AS (SELECT event_id, t, kind FROM e, (SELECT DISTINCT kind FROM f)
), j AS (SELECT k.kind, event_id, fire FROM k ASOF LEFT JOIN f ON k.kind = f.kind AND k.t <= f.fire)
SELECT kind, fire::BIGINT AS fire, count(*) AS n, min(event_id) AS first_event FROM j GROUP BY 1, 2""",
)
def stm03(t):
    begin = 1_704_067_200 * sch.SECOND  # 2024-01-01 in UTC
    part = t.part.select("p_partkey", "p_size")
    fires = {
        "rate": sch.fixed_rate(t.spark, begin, begin + 31 * 86_400 * sch.SECOND - 1, 300),
        "daily": sch.calendar(t.spark, "2024-01-01", 31, "00:05", "Asia/Seoul"),
        "weekly": sch.calendar(t.spark, "2024-01-01", 31, "08:00", "Asia/Seoul", (1,)),
        "delay": sch.fixed_delay(part, "p_partkey", F.col("p_size").cast("long") * (60 * sch.SECOND), begin, 600).select("fire"),
    }
    all_fires = reduce(DataFrame.unionByName, (rows.select(F.lit(kind).alias("kind"), "fire") for kind, rows in fires.items()))
    events = t.events.select("event_id", sch.micros(F.col("ts")).alias("t"), F.explode(F.array(*map(F.lit, fires))).alias("kind"))
    taken = sch.taken_by(events, all_fires, F.col("t"), ["kind"])
    return taken.groupBy("kind", "fire").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


# --- flows that stop and go on ----------------------------------------------------------------------------------------


def _thirds(rows: DataFrame, ts: str) -> list[DataFrame]:
    """rows in three parts by time."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    a, b = rows.select(F.percentile_approx(at, F.array(F.lit(0.33), F.lit(0.67))).alias("q")).first().q
    return [rows.where(at < a), rows.where((at >= a) & (at < b)), rows.where(at >= b)]


@query("stm06_ban_flow", "SELECT user_id::VARCHAR AS key, from_us, until_us FROM (" + BAN_SQL.format(most=MOST, find=FIND, ban=BAN) + ")")
def stm06_flow(t):
    """The same bans from files that arrive in three parts, the flow being ended and started again after each."""
    root = shared.new_folder(t.spark, "bans")
    schema = t.events.select("user_id", "ts").schema
    for part in _thirds(t.events.select("user_id", "ts"), "ts"):
        flows.land(part, f"{root}/in")
        flows.ban_flow(t.spark, f"{root}/in", schema, f"{root}/checkpoint", f"{root}/out", "user_id", MOST, FIND, BAN)
    return flows.read_sink(t.spark, f"{root}/out", flows.BANNED).drop("batch")


@query(
    "src11_followed_log",
    r"""
WITH x AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN '/wp-login.php' WHEN event_id % 13 = 0 THEN '/favicon.ico' WHEN event_id % 17 = 0 THEN '/' ELSE '/api' END AS p,
  CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 500 ELSE 404 END WHEN 'signup' THEN 429 ELSE 200 END AS status, round(value * 10)::BIGINT + 0.5 AS rt FROM events WHERE event_id % 97 <> 0)
SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s,
  CASE WHEN status = 429 THEN 'rate_limited' WHEN p = '/wp-login.php' OR event_id % 19 = 0 THEN 'bot_scan' WHEN p = '/favicon.ico' THEN 'favicon' WHEN p = '/' AND event_id % 17 = 0 THEN 'root_probe'
    WHEN status >= 500 THEN 'server_error' WHEN status >= 400 THEN 'client_error' ELSE 'normal' END AS category,
  CASE WHEN rt >= 3 THEN 'critical' WHEN rt >= 1 THEN 'slow' WHEN rt >= 0.5 THEN 'warn' ELSE 'ok' END AS band, count(*) AS n
FROM x GROUP BY 1, 2, 3""",
)
def src11(t):
    """A log that is written in three parts and followed by a flow that is ended and started again after each."""
    root = shared.new_folder(t.spark, "log")
    lines = fx.access_lines(t).join(t.events.select(F.col("event_id").alias("line_no"), "ts"), "line_no")
    for part in _thirds(lines, "ts"):
        flows.land(part.select("line"), f"{root}/in", as_text=True)
        flows.follow_log(t.spark, f"{root}/in", f"{root}/checkpoint", f"{root}/out")
    return flows.band_counts(t.spark, f"{root}/out").select(F.unix_seconds("start").alias("start_s"), "category", "band", "n")


@query(
    "stm01_mail_flow",
    r"""
WITH m AS (SELECT doc_id, source AS sender, split_part(text, chr(10), 1) AS subject, doc_id % 50 AS received, text FROM documents
), r AS (SELECT *, CASE WHEN trim(coalesce(subject, '')) = '' THEN 'no subject' WHEN length(text) < 60 THEN 'too short' WHEN sender = 'src3' THEN 'unknown sender' END AS reason FROM m)
SELECT 'bad' AS route, reason, sender, sha256(coalesce(subject, '')) AS subject, received, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT DISTINCT 'good', NULL, sender, sha256(subject), received, 1 FROM r WHERE reason IS NULL""",
)
def stm01(t):
    """Mails that arrive in three parts, in several batches each: dead letters with their reason, and each good mail once."""
    root = shared.new_folder(t.spark, "mail")
    mails = t.documents.select("doc_id", F.col("source").alias("sender"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("subject"), (F.col("doc_id") % 50).alias("received"), F.length("text").alias("length"))
    reason = F.when(F.trim(F.coalesce("subject", F.lit(""))) == "", "no subject").when(F.col("length") < 60, "too short").when(F.col("sender") == "src3", "unknown sender")
    for k in range(3):
        flows.land(mails.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == k).repartition(4), f"{root}/in")
        flows.mail_flow(t.spark, f"{root}/in", mails.schema, f"{root}/checkpoint", root, ["sender", "subject", "received"], reason, files_per_batch=2)
    columns = ["sender", F.sha2(F.coalesce("subject", F.lit("")), 256).alias("subject"), "received"]
    bad = flows.read_sink(t.spark, f"{root}/bad", T.StructType([*mails.schema.fields, T.StructField("reason", T.StringType())]))
    good = flows.read_sink(t.spark, f"{root}/good", mails.schema)
    routes = good.select(F.lit("good").alias("route"), F.lit(None).cast("string").alias("reason"), *columns).unionByName(bad.select(F.lit("bad").alias("route"), "reason", *columns))
    return routes.groupBy("route", "reason", "sender", "subject", "received").agg(F.count("*").alias("n"))


# --- tables with versions ---------------------------------------------------------------------------------------------


@query(
    "snk09_ranking_snapshots",
    r"""
WITH c AS (SELECT ts::DATE AS d, user_id AS object_id, count(*) AS clicks FROM events WHERE event_type = 'click' AND ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY clicks DESC, object_id) AS rank FROM c QUALIFY rank <= 10
), h AS (SELECT d, CASE WHEN d = DATE '2024-01-11' THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM (VALUES (DATE '2024-01-10'), (DATE '2024-01-11'), (DATE '2024-01-12')) v(d))
SELECT h.d::VARCHAR AS day, status, CASE WHEN status = 'SUCCESS' THEN count(rank) OVER (PARTITION BY h.d) ELSE 0 END AS n_items, rank, object_id, clicks
FROM h LEFT JOIN r ON r.d = h.d AND status = 'SUCCESS'""",
)
def snk09(t):
    """Snapshots of three days, saved twice each; on the second day the computation fails both times."""
    store = versions.Snapshots(t.spark, shared.new_folder(t.spark, "ranking"), "rank int, object_id long, clicks long")
    clicks = t.events.where("event_type = 'click'").select(F.to_date("ts").alias("d"), F.col("user_id").alias("object_id"))

    def ranking(day: str) -> DataFrame:
        if day == "2024-01-11":
            raise OSError("the report is not available")
        top = clicks.where(F.col("d") == day).groupBy("object_id").agg(F.count("*").alias("clicks")).orderBy(F.desc("clicks"), "object_id").limit(10)
        return top.select(F.row_number().over(Window.orderBy(F.desc("clicks"), "object_id")).alias("rank"), "object_id", "clicks")  # ten rows at most

    for day in ("2024-01-10", "2024-01-11", "2024-01-12"):
        for _ in range(2):
            with contextlib.suppress(OSError):
                store.save(day, lambda day=day: ranking(day))
    return store.headers().select("day", "status", "n_items").join(store.items(), "day", "left")


@query(
    "snk10_daily_archive",
    r"""
WITH n AS (SELECT count(*) AS n FROM documents
), v AS (
  SELECT c_custkey AS user_id, d, 1 AS version, d || ' 00:05' AS valid_from, CASE WHEN c_custkey % 5 = 0 AND d = '2024-01-30' THEN d || ' 09:00' END AS valid_to FROM customer, (VALUES ('2024-01-30'), ('2024-01-31')) x(d)
  UNION ALL SELECT c_custkey, '2024-01-30', 2, '2024-01-30 09:00', NULL FROM customer WHERE c_custkey % 5 = 0
), i AS (SELECT v.*, n, k, (user_id * 7 + version * 3 + k + right(d, 2)::INT) % n AS content_id FROM v, n, (VALUES (0), (1), (2)) y(k)
), a AS (SELECT unnest(['2024-01-30 08:00', '2024-01-30 20:00', '2024-01-31 08:00']) AS as_at)
SELECT as_at, user_id, d AS day, valid_from, valid_to, count(*) AS n, sum(content_id)::BIGINT AS total FROM a JOIN i ON valid_from <= as_at AND (valid_to IS NULL OR valid_to > as_at) GROUP BY ALL""",
)
def snk10(t):
    """Two days: an archive for all each morning, a refresh for some, and a second one that comes too often; read as of three times."""
    store = versions.Archive(t.spark, shared.new_folder(t.spark, "archive"))
    n = t.documents.agg(F.count("*").alias("n"))

    def picks(users: DataFrame, day: str, version: int) -> DataFrame:
        k = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")
        rows = users.select(F.col("c_custkey").alias("user_id"), k).join(F.broadcast(n))  # one row
        return rows.select("user_id", "k", ((F.col("user_id") * 7 + version * 3 + F.col("k") + int(day[-2:])) % F.col("n")).alias("content_id"))

    some = t.customer.where("c_custkey % 5 = 0")
    store.save(picks(t.customer, "2024-01-30", 1), "2024-01-30", "2024-01-30 00:05")
    store.save(picks(some, "2024-01-30", 2), "2024-01-30", "2024-01-30 09:00")
    store.save(picks(some, "2024-01-30", 3), "2024-01-30", "2024-01-30 10:00")
    store.save(picks(t.customer, "2024-01-31", 1), "2024-01-31", "2024-01-31 00:05")
    reads = (store.as_of(at).withColumn("as_at", F.lit(at)) for at in ("2024-01-30 08:00", "2024-01-30 20:00", "2024-01-31 08:00"))
    return reduce(DataFrame.unionByName, reads).groupBy("as_at", "user_id", "day", "valid_from", "valid_to").agg(F.count("*").alias("n"), F.sum("content_id").alias("total"))
