"""Registered queries over the stand-in views, each with its SQL for the oracle where SQL can express it.

Query names begin with the operator ids of the blueprint that they cover.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import web
from ..operators import analytics as an
from ..operators import digest as dg
from ..operators import recommend as rec
from ..operators import tables as tb
from ..sources import logs
from . import fixtures as fx
from .fixtures import AS_OF, Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
END = "2024-01-30"
EVENTS = ["click", "view", "share", "purchase"]


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), dates: tuple[str, ...] = ()):
    """Registers f(tables) under the name, with its SQL. Days are given as text, which all engines print alike; dates names them for the SQL."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _dates_as_text(f(Tables(spark, sf_dir)))
        if sql is not None:
            whole = with_views(sql, *views) if views else sql
            ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(f'{d}::VARCHAR AS {d}' for d in dates)}) FROM ({whole})" if dates else whole
        return f

    return register


# --- rankings and reports -------------------------------------------------------------------------------------------


def _titles(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    return t.documents.select(k.cast("string").alias("object_id"), F.when(k % 10 == 7, F.concat(F.lit("Preview Title "), k.cast("string"))).otherwise(F.concat(F.lit("Title "), k.cast("string"))).alias("title"))


def _resolution(t: Tables) -> DataFrame:
    return t.documents.where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("object_id"), F.col("doc_id").alias("resolved_id"))


RANKED = """top AS (
  SELECT object_id, count(*) AS clicks FROM ga WHERE event_name = 'click' AND event_date BETWEEN DATE '2024-01-30' - 364 AND DATE '2024-01-30' GROUP BY 1 ORDER BY clicks DESC, object_id LIMIT 20
), ranking AS (
  SELECT row_number() OVER (ORDER BY clicks DESC, top.object_id) AS rank, top.object_id, title, clicks, CASE WHEN doc_id % 3 <> 0 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status,
    CASE WHEN doc_id % 3 <> 0 THEN doc_id END AS resolved_id
  FROM top LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN 'Preview Title ' ELSE 'Title ' END || doc_id AS title FROM documents) d ON d.doc_id::VARCHAR = top.object_id
  WHERE NOT coalesce(starts_with(title, 'Preview Title'), false))"""


@query("rnk01_click_ranking", RANKED + " SELECT * FROM ranking", ("ga",))
def rnk01(t):
    return an.click_ranking(fx.ga_events(t), _titles(t), _resolution(t), END)


@query("rnk01_resolved_count", RANKED + " SELECT count(*) AS n_items, count(*) FILTER (status = 'RESOLVED') AS n_resolved FROM ranking", ("ga",))
def rnk01_count(t):
    return rnk01(t).agg(F.count("*").alias("n_items"), F.count_if(F.col("status") == "RESOLVED").alias("n_resolved"))


@query("rpt03_ranking_text", RANKED + """ SELECT count(*) AS n, CASE WHEN count(*) = 0 THEN 'no data' ELSE string_agg(rank || '. ' || object_id || ' (' ||
  CASE WHEN clicks >= 1000 THEN printf('%.1fK', clicks / 1000) ELSE clicks::VARCHAR END || ')', chr(10) ORDER BY rank) END AS report FROM ranking""", ("ga",))
def rpt03(t):
    return an.report_lines(rnk01(t))


@query("agg01_event_counts", "SELECT event_name, event_date, count(*) AS event_count FROM ga GROUP BY 1, 2", ("ga",), dates=("event_date",))
def agg01(t):
    return an.count_by(fx.ga_events(t), "event_name", "event_date")


@query("top01_topk_clicks", "SELECT object_id, count(*) AS event_count FROM ga WHERE event_name = 'click' GROUP BY 1 ORDER BY event_count DESC, object_id LIMIT 10", ("ga",))
def top01(t):
    return an.top_k(an.count_by(fx.ga_events(t).where("event_name = 'click'"), "object_id"), 10, F.desc("event_count"), F.asc("object_id"))


@query("agg06_fixed_event_list", "SELECT ord, e.event_name, count(ga.event_id) AS event_count FROM (VALUES (0::BIGINT, 'click'), (1, 'view'), (2, 'share'), (3, 'purchase')) e(ord, event_name) LEFT JOIN ga ON ga.event_name = e.event_name GROUP BY 1, 2", ("ga",))
def agg06(t):
    return an.fixed_list(an.count_by(fx.ga_events(t), "event_name"), EVENTS)


STATS = """s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_type, user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_type, user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS st FROM ga
), stats AS (SELECT user_type, count(DISTINCT user_id) AS total_users, sum(st)::BIGINT AS sessions, count(*) FILTER (event_name = 'view') AS page_views FROM s GROUP BY 1)"""


@query("agg02_user_stats", STATS + " SELECT * FROM stats", ("ga",))
def agg02(t):
    return an.user_stats(fx.ga_events(t))


@query("agg03_user_totals", STATS + """ SELECT max(total_users) FILTER (user_type = 'new') AS new_users, max(total_users) FILTER (user_type = 'returning') AS returning_users,
  (max(total_users) FILTER (user_type = 'new')) + (max(total_users) FILTER (user_type = 'returning')) AS total_users, sum(sessions)::BIGINT AS sessions, sum(page_views)::BIGINT AS page_views FROM stats""", ("ga",))
def agg03(t):
    return an.user_totals(agg02(t))


REPORT = """SELECT count(*) FILTER (event_name = 'click' AND now) AS clicks, count(*) FILTER (event_name = 'view' AND now) AS views, count(*) FILTER (event_name = 'signup' AND now) AS signups,
  count(*) FILTER (event_name = 'purchase' AND now) AS purchases, count(*) FILTER (event_name = 'error' AND now) AS errors, count(*) FILTER (now) AS events, count(*) FILTER (before) AS events_before,
  count(DISTINCT user_id) FILTER (now) AS users, count(DISTINCT user_id) FILTER (before) AS users_before, count(DISTINCT user_id) FILTER (now AND user_type = 'returning') AS returning_users,
  count(*) FILTER (now) / {days}.0::DOUBLE AS per_day,
  CASE WHEN count(DISTINCT user_id) FILTER (before) > 0 THEN count(DISTINCT user_id) FILTER (now AND user_type = 'returning') / count(DISTINCT user_id) FILTER (before) * 100 ELSE 0.0 END AS returning_rate
FROM (SELECT *, event_date BETWEEN DATE '2024-01-30' - {less} AND DATE '2024-01-30' AS now, event_date BETWEEN DATE '2024-01-30' - {last} AND DATE '2024-01-30' - {days} AS before FROM ga) WHERE now OR before"""


@query("rpt01_daily", REPORT.format(days=1, less=0, last=1), ("ga",))
def rpt01(t):
    return an.period_report(fx.ga_events(t), END, 1)


@query("rpt02_weekly", REPORT.format(days=7, less=6, last=13), ("ga",))
def rpt02(t):
    return an.period_report(fx.ga_events(t), END, 7)


@query("agg05_returning_rate", "SELECT event_date, count(DISTINCT user_id) FILTER (user_type = 'returning') / count(DISTINCT user_id) * 100 AS rate FROM ga GROUP BY 1", ("ga",), dates=("event_date",))
def agg05(t):
    return fx.ga_events(t).groupBy("event_date").agg(F.count_distinct(F.when(F.col("user_type") == "returning", F.col("user_id"))).alias("r"), F.count_distinct("user_id").alias("u")).select("event_date", an.percentage(F.col("r"), F.col("u")).alias("rate"))


@query("agg07_nested_report", """c AS (SELECT event_name, object_id, count(*) AS n FROM ga WHERE event_name IN ('click', 'view') GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY event_name ORDER BY n DESC, object_id) AS k FROM c)
SELECT event_name, sum(n)::BIGINT AS total, string_agg(object_id || '=' || n, ',' ORDER BY k) FILTER (k <= 5) AS top FROM r GROUP BY 1""", ("ga",))
def agg07(t):
    return an.nested_report(fx.ga_events(t), ["click", "view"], 5)


@query("agg08_source_stats", "SELECT newsletter_name, count(*) AS n, max(published_at) AS latest FROM contents GROUP BY 1", ("contents",), dates=("latest",))
def agg08(t):
    return an.source_stats(fx.contents(t))


@query("agg09_feed_stats", """SELECT source, count(*) AS total, count(*) FILTER (ai_processed) AS processed, count(*) FILTER (NOT ai_processed AND processed) AS pending, count(*) FILTER (has_error) AS errors,
  trunc(count(*) FILTER (ai_processed) * 100 / count(*))::BIGINT AS percent FROM statuses GROUP BY 1""", ("statuses",))
def agg09(t):
    return an.feed_stats(fx.statuses(t))


@query("agg10_totals", "SELECT sum(n)::BIGINT AS n, count(*) AS groups FROM (SELECT source, count(*) AS n FROM statuses WHERE ai_processed GROUP BY 1)", ("statuses",))
def agg10(t):
    return an.feed_stats(fx.statuses(t)).agg(F.sum("processed").alias("n"), F.count_if(F.col("processed") > 0).alias("groups"))


@query("agg13_weight_products", """SELECT user_id, product(1 + value / 100) AS up, sum(value) AS total FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def agg13(t):
    rows = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.coalesce(F.product(1 + F.col("value") / 100), F.lit(1.0)).alias("up"), F.sum("value").alias("total"))
    return rows


@query("agg22_distinct_keep_first", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def agg22(t):
    return tb.first_by(t.events, ["user_id", "event_type"], F.asc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("agg24_counts_by_category", "SELECT category_id, count(*) AS n, count(DISTINCT content_id) FILTER (total_score > 0) AS scored FROM category_score GROUP BY 1", ("category_score",))
def agg24(t):
    return fx.category_score(t).groupBy("category_id").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("total_score") > 0, F.col("content_id"))).alias("scored"))


@query("flt03_not_set", "SELECT event_id, object_id FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '(not set)' WHEN event_id % 7 = 0 THEN NULL ELSE object_id END AS object_id FROM ga) WHERE object_id IS DISTINCT FROM '(not set)'", ("ga",))
def flt03(t):
    rows = fx.ga_events(t).select("event_id", F.when(F.col("event_id") % 5 == 0, "(not set)").when(F.col("event_id") % 7 == 0, None).otherwise(F.col("object_id")).alias("object_id"))
    return rows.where(an.not_set(F.col("object_id")))


@query("flt05_rolling_window", "SELECT event_id, event_name, event_date FROM ga WHERE event_date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30' AND event_name IN ('click', 'view')", ("ga",), dates=("event_date",))
def flt05(t):
    return fx.ga_events(t).where(an.rolling_window(F.col("event_date"), END, 7) & F.col("event_name").isin("click", "view")).select("event_id", "event_name", "event_date")


@query("flt07_length_range", "SELECT content_id, length(content) AS n FROM contents WHERE length(content) BETWEEN 500 AND 10000", ("contents",))
def flt07(t):
    return fx.contents(t).where(F.length("content").between(500, 10_000)).select("content_id", F.length("content").cast("long").alias("n"))


@query("flt08_budget_cut", "SELECT newsletter_name, content_id, running FROM (SELECT newsletter_name, content_id, (sum(length(content)) OVER (PARTITION BY newsletter_name ORDER BY content_id ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM contents) WHERE running <= 30000", ("contents",))
def flt08(t):
    return an.budget_cut(fx.contents(t), F.length("content"), 30_000, F.asc("content_id"), by="newsletter_name").select("newsletter_name", "content_id", "running")


@query("flt09_skip_oversize_budget", "SELECT newsletter_name, content_id, running FROM (SELECT newsletter_name, content_id, (sum(length(content)) OVER (PARTITION BY newsletter_name ORDER BY content_id ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM contents WHERE length(content) <= 4000) WHERE running <= 30000", ("contents",))
def flt09(t):
    return an.budget_cut(fx.contents(t).where(F.length("content") <= 4000), F.length("content"), 30_000, F.asc("content_id"), by="newsletter_name").select("newsletter_name", "content_id", "running")


@query("flt20_optional_conjuncts", "SELECT content_id, newsletter_name FROM contents WHERE newsletter_name IN ('src1', 'src2', 'src3') AND content NOT LIKE '%Apache%' AND title IS NOT NULL AND published_at >= DATE '2023-06-01'", ("contents",))
def flt20(t):
    return fx.contents(t).where(F.col("newsletter_name").isin("src1", "src2", "src3") & ~F.col("content").like("%Apache%") & F.col("title").isNotNull() & (F.col("published_at") >= F.lit("2023-06-01").cast("date"))).select("content_id", "newsletter_name")


@query("flt21_like_any", "SELECT content_id FROM contents WHERE content LIKE '%token =%' OR content LIKE '%Licensed under%'", ("contents",))
def flt21(t):
    return fx.contents(t).where("content LIKE ANY ('%token =%', '%Licensed under%')").select("content_id")


@query("flt24_recent", "SELECT content_id, published_at FROM contents WHERE published_at >= DATE '2024-01-31' - 30", ("contents",), dates=("published_at",))
def flt24(t):
    return fx.contents(t).where(F.col("published_at") >= F.date_sub(F.lit(AS_OF).cast("date"), 30)).select("content_id", "published_at")


@query("prj01_cards", "SELECT content_id, title, coalesce(language, 'en') AS language, coalesce(provider_type, 'UNKNOWN') AS provider_type FROM contents", ("contents",))
def prj01(t):
    return fx.contents(t).select("content_id", "title", F.coalesce("language", F.lit("en")).alias("language"), F.coalesce("provider_type", F.lit("UNKNOWN")).alias("provider_type"))


@query("prj02_language", "SELECT content_id, CASE WHEN lower(coalesce(language, '')) IN ('ko', 'korean', '한국어') OR content_id % 9 = 0 THEN 'KOREAN' ELSE 'ENGLISH' END AS language FROM contents", ("contents",))
def prj02(t):
    return fx.contents(t).select("content_id", tx.language(F.when(F.col("content_id") % 9 == 0, "Korean").otherwise(F.col("language"))).alias("language"))


@query("top05_keyset_page", "p AS (SELECT content_id, title FROM contents WHERE content_id < 700 ORDER BY content_id DESC LIMIT 21), q AS (SELECT * FROM p ORDER BY content_id DESC LIMIT 20) SELECT content_id, title, (SELECT count(*) FROM p) > 20 AS has_more, CASE WHEN (SELECT count(*) FROM p) > 20 THEN (SELECT min(content_id) FROM q) END AS next_offset FROM q", ("contents",))
def top05(t):
    return an.keyset_page(fx.contents(t).select("content_id", "title"), 20, 700)


@query("top06_published_page", "SELECT content_id, published_at FROM contents WHERE (published_at, content_id) < (DATE '2024-01-10', 500) ORDER BY published_at DESC, content_id DESC LIMIT 25", ("contents",), dates=("published_at",))
def top06(t):
    return an.published_page(fx.contents(t).select("content_id", "published_at"), 25, ("2024-01-10", 500))


@query("win07_section_bounds", "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS until FROM conversations WHERE role = 'user'")
def win07(t):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("until"))


@query("win08_look_ahead", "SELECT conv_id, turn, min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS answer FROM conversations")
def win08(t):
    ahead = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, 5)
    return t.conversations.select("conv_id", "turn", F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(ahead).alias("answer"))


@query("win10_previous_day", "d AS (SELECT event_date, count(*) AS n FROM ga GROUP BY 1) SELECT event_date, n, lag(n) OVER (ORDER BY event_date) AS before FROM d", ("ga",), dates=("event_date",))
def win10(t):
    days = an.count_by(fx.ga_events(t), "event_date").withColumnRenamed("event_count", "n")
    return days.withColumn("before", F.lag("n").over(Window.orderBy("event_date")))  # one row a day


# --- logs -----------------------------------------------------------------------------------------------------------

RE = logs.ACCESS.replace("'", "''")
PARSED = f"""p AS (SELECT line_no, line, regexp_matches(line, '{RE}') AS ok, regexp_extract(line, '{RE}', ['ip', 'user', 'ts', 'method', 'target', 'protocol', 'status', 'bytes', 'referer', 'ua', 'xff', 'rt', 'uct', 'uht', 'urt']) AS f FROM access
), a AS (SELECT line_no, ok AS parsed, CASE WHEN ok THEN f.ip END AS ip, CASE WHEN ok THEN f.method END AS method, CASE WHEN ok THEN f.target END AS target, CASE WHEN ok THEN try_cast(f.status AS INT) END AS status, CASE WHEN ok THEN try_cast(f.bytes AS BIGINT) END AS bytes,
  CASE WHEN ok THEN f.ua END AS user_agent, CASE WHEN ok THEN try_strptime(replace(f.ts, ' +0000', ''), '%d/%b/%Y:%H:%M:%S') END AS ts, CASE WHEN ok THEN split_part(f.target, '?', 1) END AS path, CASE WHEN ok THEN try_cast(f.rt AS DOUBLE) END AS request_time,
  CASE WHEN ok THEN try_cast(trim(split_part(f.urt, ',', 1)) AS DOUBLE) END AS response_time FROM p
), n AS (SELECT *, regexp_replace(regexp_replace(path, '/[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', '/{{uuid}}', 'gi'), '/[0-9]+(/|$)', '/{{id}}\\1', 'g') AS norm_path,
  CASE WHEN status = 429 THEN 'rate_limited' WHEN regexp_matches(target, '(^|/)wp-') OR regexp_matches(user_agent, 'sqlmap') THEN 'bot_scan' WHEN path = '/favicon.ico' THEN 'favicon' WHEN path = '/' AND method = 'POST' THEN 'root_probe'
    WHEN status >= 500 THEN 'server_error' WHEN status >= 400 THEN 'client_error' ELSE 'normal' END AS category FROM a)"""


def _parsed(t: Tables) -> DataFrame:
    return logs.parse_access(fx.access_lines(t))


@query("log01_parse", PARSED + " SELECT line_no, parsed, ip, method, target, status, bytes, request_time, response_time, ts::VARCHAR AS ts FROM n", ("access",))
def log01(t):
    return _parsed(t).select("line_no", "parsed", "ip", "method", "target", "status", "bytes", "request_time", "response_time", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("log03_classify", PARSED + " SELECT category, count(*) AS n FROM n WHERE parsed GROUP BY 1", ("access",))
def log03(t):
    return _parsed(t).where("parsed").groupBy(logs.access_class().alias("category")).agg(F.count("*").alias("n"))


@query("log05_scanners", PARSED + " SELECT ip, n, first FROM (SELECT ip, count(*) AS n, min(line_no) AS first FROM n WHERE parsed AND category IN ('bot_scan', 'root_probe', 'rate_limited') GROUP BY 1) ORDER BY n DESC, first LIMIT 10", ("access",))
def log05(t):
    rows = _parsed(t).where("parsed").withColumn("category", logs.access_class()).where(F.col("category").isin("bot_scan", "root_probe", "rate_limited"))
    return an.counter_top(rows, "ip", 10)


@query("log06_path_norm", PARSED + " SELECT norm_path, count(*) AS n FROM n WHERE parsed GROUP BY 1", ("access",))
def log06(t):
    return _parsed(t).where("parsed").groupBy("norm_path").agg(F.count("*").alias("n"))


@query("agg11_counter_topn", PARSED + " SELECT norm_path, count(*) AS n, min(line_no) AS first FROM n WHERE parsed GROUP BY 1 ORDER BY n DESC, first LIMIT 5", ("access",))
def agg11(t):
    return an.counter_top(_parsed(t).where("parsed"), "norm_path", 5)


@query("agg12_percentiles", PARSED + " SELECT status, count(request_time) AS n, avg(request_time) AS mean, min(request_time) AS least, quantile_disc(request_time, 0.5) AS p50, quantile_disc(request_time, 0.95) AS p95, quantile_disc(request_time, 0.99) AS p99, max(request_time) AS most FROM n WHERE parsed GROUP BY 1", ("access",))
def agg12(t):
    return an.latency_stats(_parsed(t).where("parsed"), "request_time", "status")


@query("flt22_cutoff_keep_null", PARSED + " SELECT line_no FROM n WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-20 00:00:00'", ("access",))
def flt22(t):
    return _parsed(t).where(logs.since(F.col("ts"), "2024-01-20 00:00:00")).select("line_no")


@query("flt23_slow_errors", PARSED + " SELECT line_no, status, request_time FROM n WHERE status >= 400 AND starts_with(norm_path, '/api/') AND request_time >= 100", ("access",))
def flt23(t):
    return _parsed(t).where((F.col("status") >= 400) & F.startswith("norm_path", F.lit("/api/")) & (F.col("request_time") >= 100)).select("line_no", "status", "request_time")


@query("top11_slowest", PARSED + " SELECT line_no, request_time FROM n WHERE request_time IS NOT NULL ORDER BY request_time DESC, line_no LIMIT 20", ("access",))
def top11(t):
    return an.top_k(_parsed(t).where("request_time is not null").select("line_no", "request_time"), 20, F.desc("request_time"), F.asc("line_no"))


@query("win09_last_lines", "SELECT line_no, line FROM access ORDER BY line_no DESC LIMIT 50", ("access",))
def win09(t):
    return logs.last_lines(fx.access_lines(t), 50)


@query("stm05_realtime_bands", PARSED + " SELECT CASE WHEN request_time >= 3 THEN 'critical' WHEN request_time >= 1 THEN 'slow' WHEN request_time >= 0.5 THEN 'warn' ELSE 'ok' END AS band, status // 100 AS class, count(*) AS n FROM n WHERE parsed GROUP BY 1, 2", ("access",))
def stm05(t):
    return _parsed(t).where("parsed").groupBy(logs.realtime_band(F.col("request_time")).alias("band"), F.floor(F.col("status") / 100).cast("int").alias("class")).agg(F.count("*").alias("n"))


# --- recommendations ------------------------------------------------------------------------------------------------


def _weights(sign: int):
    """Keyword weights of a content: three numbers from its id, of one sign."""
    w = F.array(*(((F.col("content_id") * k) % 11 - 4) / 2.0 for k in (1, 3, 7)))
    return F.filter(w, lambda x: x > 0 if sign > 0 else x < 0)


WEIGHTS = "[((content_id * 1) % 11 - 4) / 2.0::DOUBLE, ((content_id * 3) % 11 - 4) / 2.0::DOUBLE, ((content_id * 7) % 11 - 4) / 2.0::DOUBLE]"
AFFINITY = f"greatest(coalesce(list_product(list_filter({WEIGHTS}, lambda x: x > 0)), 1.0) - coalesce(list_product(list_transform(list_filter({WEIGHTS}, lambda x: x < 0), lambda x: -x)), 1.0) + bonus, 0.0)"
BONUS = "CASE WHEN provider_id % 3 = 0 THEN 5.0 ELSE 0.0 END::DOUBLE AS bonus"
SIGNAL = "CASE content_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 * 0.85 * 20 WHEN 2 THEN 1.0 * 0.85 * 20 + 0.7 * 0.55 * 20 + 15 ELSE 1.0 * 0.85 * 20 + 1.0 * 0.75 * 20 + 0.7 * 0.55 * 20 + 30 END::DOUBLE"


def _signals():
    s = [F.struct(F.lit(a).alias("source"), F.lit(b).alias("score"), F.lit(c).alias("confidence")) for a, _, _, b, c in rec.SOURCES]
    k = F.col("content_id") % 4
    return F.when(k == 0, F.array().cast("array<struct<source:string,score:double,confidence:double>>")).when(k == 1, F.array(s[0])).when(k == 2, F.array(s[0], s[2])).otherwise(F.array(*s))


def _affinity():
    return rec.keyword_affinity(_weights(1), _weights(-1), F.when(F.col("provider_id") % 3 == 0, 5.0).otherwise(0.0))


def _rerank_text():
    return F.concat_ws(" ", "title", "newsletter_name", F.when(F.col("content_id") % 6 == 0, "Launch of an AI agent").when(F.col("content_id") % 6 == 1, "Postgresql and maintain").when(F.col("content_id") % 6 == 2, "새로운 프롬프트 API"))


TEXT = "concat_ws(' ', title, newsletter_name, CASE content_id % 6 WHEN 0 THEN 'Launch of an AI agent' WHEN 1 THEN 'Postgresql and maintain' WHEN 2 THEN '새로운 프롬프트 API' END)"


def _mention_sql(words: str, korean: str) -> str:
    return f"(regexp_matches(x, '(?i)\\b({words})\\b') OR regexp_matches(x, '{korean}'))"


RERANK = f"""m AS (SELECT *, {_mention_sql(rec.NEW_WORDS, rec.NEW_KOREAN)} AS n, {_mention_sql(rec.AI_WORDS, rec.AI_KOREAN)} AS a, {_mention_sql(rec.PLATFORM_WORDS, rec.PLATFORM_KOREAN)} AS p, greatest(DATE '2024-01-31' - published_at, 0) AS age FROM (SELECT *, {TEXT} AS x, {BONUS} FROM contents)
), parts AS (SELECT content_id, published_at, newsletter_name, {AFFINITY} AS affinity, {SIGNAL} AS signal, CASE WHEN n THEN 40.0 ELSE 0.0 END AS new_technology, CASE WHEN a THEN 35.0 ELSE 0.0 END AS ai_llm, CASE WHEN p THEN 25.0 ELSE 0.0 END AS platform,
  CASE WHEN n AND a AND p THEN 30.0 WHEN n AND (a OR p) THEN 20.0 WHEN a AND p THEN 10.0 ELSE 0.0 END AS synergy, CASE WHEN age <= 1 THEN 60.0 WHEN age <= 3 THEN 45.0 WHEN age <= 7 THEN 30.0 WHEN age <= 14 THEN 15.0 WHEN age <= 30 THEN 5.0 ELSE 0.0 END AS recency,
  -least(age, 10)::DOUBLE AS fresh FROM m)"""


@query("rec06_keyword_affinity", f"SELECT content_id, {AFFINITY} AS score FROM (SELECT *, {BONUS} FROM contents)", ("contents",))
def rec06(t):
    return fx.contents(t).select("content_id", _affinity().alias("score"))


@query("rec07_signal_bonus", f"SELECT content_id, {SIGNAL} AS score FROM contents", ("contents",))
def rec07(t):
    return fx.contents(t).select("content_id", rec.signal_bonus(_signals()).alias("score"))


def _parts(rows: DataFrame) -> dict:
    parts = rec.rerank_parts(_rerank_text(), F.col("published_at"), F.lit(AS_OF).cast("date"))
    return {"keyword_affinity": _affinity(), "candidate_source_signal": rec.signal_bonus(_signals()), **parts, "freshness": rec.freshness(F.col("published_at"), F.lit(AS_OF).cast("date"))}


@query("rec08_rerank", RERANK + " SELECT content_id, new_technology::DOUBLE AS new_technology, ai_llm::DOUBLE AS ai_llm, platform::DOUBLE AS platform, synergy::DOUBLE AS synergy, recency::DOUBLE AS recency FROM parts", ("contents",))
def rec08(t):
    p = _parts(fx.contents(t))
    names = {"new_technology": "new_technology_signal", "ai_llm": "ai_llm_signal", "platform": "platform_signal", "synergy": "signal_synergy", "recency": "reranking_recency"}
    return fx.contents(t).select("content_id", *(p[v].cast("double").alias(k) for k, v in names.items()))


@query("rec09_freshness", RERANK + " SELECT content_id, fresh FROM parts", ("contents",))
def rec09(t):
    return fx.contents(t).select("content_id", rec.freshness(F.col("published_at"), F.lit(AS_OF).cast("date")).alias("fresh"))


TOTAL = "affinity + signal + new_technology + ai_llm + platform + synergy + recency + fresh"


@query("rec11_total_score", RERANK + f" SELECT content_id, greatest({TOTAL}, 0.0)::DOUBLE AS score FROM parts", ("contents",))
def rec11(t):
    return fx.contents(t).select("content_id", F.greatest(sum(_parts(fx.contents(t)).values(), F.lit(0.0)), F.lit(0.0)).alias("score"))


@query("rec12_explain", RERANK + f""", u AS (
  SELECT content_id, 'keyword_affinity' AS rule, affinity AS score FROM parts UNION ALL SELECT content_id, 'freshness', fresh FROM parts
  UNION ALL SELECT content_id, r, s FROM (SELECT content_id, unnest(['candidate_source_signal', 'new_technology_signal', 'ai_llm_signal', 'platform_signal', 'signal_synergy', 'reranking_recency']) AS r, unnest([signal, new_technology, ai_llm, platform, synergy, recency]) AS s FROM parts) WHERE s <> 0
  UNION ALL SELECT content_id, 'final_score_floor', -({TOTAL}) FROM parts WHERE {TOTAL} < 0)
SELECT content_id, rule, score::DOUBLE AS score, CASE WHEN rule = 'final_score_floor' THEN 'ADJUSTMENT' WHEN score < 0 THEN 'PENALTY' WHEN rule = 'keyword_affinity' THEN 'SCORE' ELSE 'BONUS' END AS type FROM u""", ("contents",))
def rec12(t):
    rows = fx.contents(t)
    return rows.select("content_id", F.explode(rec.explained(_parts(rows))).alias("x")).select("content_id", "x.rule", "x.score", "x.type")


FIT = """g AS (SELECT content_id, count(*) FILTER (total_score > 0) AS n, count(*) FILTER (total_score > 0 AND provider_score > 0) AS np, count(*) FILTER (total_score > 0 AND provider_score > 0 AND {asked}) AS npr,
  coalesce(sum(total_score) FILTER (total_score > 0 AND {asked}), 0.0) AS requested, coalesce(max(total_score) FILTER (total_score > 0 AND NOT {asked}), 0.0) AS competing FROM category_score GROUP BY 1)
SELECT content_id, requested, competing, CASE WHEN n = 0 THEN true WHEN np > 0 AND npr = 0 THEN false WHEN requested <= 0 THEN false ELSE {rule} END AS fit FROM g"""
ONE = "competing <= 0 OR requested >= competing + 2.0"
MANY = "competing < requested * 1.5 OR competing - requested < 8.0"


@query("rec04_category_fit", FIT.format(asked="category_id IN (1)", rule=ONE), ("category_score",))
def rec04(t):
    return rec.category_fit(fx.category_score(t), [1])


@query("rec04_category_fit_many", FIT.format(asked="category_id IN (1, 3)", rule=MANY), ("category_score",))
def rec04_many(t):
    return rec.category_fit(fx.category_score(t), [1, 3])


FITS = """fits AS (SELECT s.content_id, q.category_id, CASE WHEN count(*) FILTER (total_score > 0) = 0 THEN true
    WHEN count(*) FILTER (total_score > 0 AND provider_score > 0) > 0 AND count(*) FILTER (total_score > 0 AND provider_score > 0 AND s.category_id = q.category_id) = 0 THEN false
    WHEN coalesce(sum(total_score) FILTER (total_score > 0 AND s.category_id = q.category_id), 0) <= 0 THEN false
    ELSE coalesce(max(total_score) FILTER (total_score > 0 AND s.category_id <> q.category_id), 0) <= 0 OR sum(total_score) FILTER (s.category_id = q.category_id) >= max(total_score) FILTER (s.category_id <> q.category_id) + 2.0 END AS fit
  FROM category_score s, (SELECT unnest(range(1, 6)) AS category_id) q GROUP BY 1, 2)"""


@query("rec05_fit_by_category", FITS + " SELECT * FROM fits", ("category_score",))
def rec05(t):
    return rec.fit_by_category(fx.category_score(t))


CAND = """c0 AS (SELECT u.user_id, u.category_id, s.content_id, c.published_at, k.source_ord, k.lim, row_number() OVER (PARTITION BY u.user_id, k.source_ord ORDER BY c.published_at DESC, s.content_id DESC) AS rank
  FROM users u JOIN category_score s ON s.category_id = u.category_id JOIN contents c ON c.content_id = s.content_id
  JOIN (VALUES (1, 560), (2, 400), (3, 240)) k(source_ord, lim) ON (k.source_ord = 1 AND total_score > 0) OR (k.source_ord = 2 AND keyword_score > 0) OR (k.source_ord = 3 AND provider_score > 0)
  WHERE NOT EXISTS (SELECT 1 FROM exposed e WHERE e.user_id = u.user_id AND e.content_id = s.content_id)
), cand AS (SELECT user_id, category_id, content_id, source_ord, rank, published_at FROM c0 WHERE rank <= lim)"""
CAND_VIEWS = ("users", "category_score", "contents", "exposed")


@query("rec01_candidates", CAND + " SELECT user_id, content_id, source_ord, rank FROM cand WHERE rank <= CASE source_ord WHEN 1 THEN 140 WHEN 2 THEN 100 ELSE 60 END", CAND_VIEWS)
def rec01(t):
    return rec.first_candidates(fx.category_score(t), fx.contents(t), fx.users(t), fx.exposed(t))


POOL = CAND + ", " + FITS + """, st AS (SELECT *, CASE WHEN rank <= l AND DATE '2024-01-31' - published_at <= 30 THEN 1 WHEN rank <= 2 * l AND DATE '2024-01-31' - published_at <= 90 THEN 2 WHEN rank <= 3 * l AND DATE '2024-01-31' - published_at <= 365 THEN 3 WHEN rank <= 4 * l THEN 4 END AS w
  FROM (SELECT *, CASE source_ord WHEN 1 THEN 140 WHEN 2 THEN 100 ELSE 60 END AS l FROM cand)
), mg AS (SELECT user_id, category_id, content_id, any_value(published_at) AS published_at, min((w - 1) * 3 + source_ord) AS fs, min(w) FILTER (source_ord = 1) AS w1, min(w) FILTER (source_ord = 2) AS w2, min(w) FILTER (source_ord = 3) AS w3 FROM st WHERE w IS NOT NULL GROUP BY 1, 2, 3
), mf AS (SELECT mg.*, coalesce(fit, true) AS fit FROM mg LEFT JOIN fits ON fits.content_id = mg.content_id AND fits.category_id = mg.category_id
), rw AS (SELECT user_id, s, count(*) FILTER (fs <= s) AS raw FROM mf, (SELECT unnest(range(1, 13)) AS s) GROUP BY 1, 2
), sr AS (SELECT user_id, coalesce(min(s) FILTER (raw >= 120), 12) AS star FROM rw GROUP BY 1
), ms AS (SELECT mf.*, star, (star + 2) // 3 AS ws FROM mf JOIN sr USING (user_id)
), fw AS (SELECT user_id, any_value(ws) AS ws, v, count(*) FILTER (fit AND (fs <= star OR w1 <= v)) AS n FROM ms, (SELECT unnest(range(1, 5)) AS v) GROUP BY user_id, v
), sp AS (SELECT user_id, coalesce(min(v) FILTER (v >= ws AND n >= 120), 4) AS stop FROM fw GROUP BY 1
), ch AS (SELECT ms.*, stop, coalesce(w1 <= stop, false) AS u1, coalesce((w2 - 1) * 3 + 2 <= star, false) AS u2, coalesce((w3 - 1) * 3 + 3 <= star, false) AS u3 FROM ms JOIN sp USING (user_id) WHERE fit AND (fs <= star OR w1 <= stop)
), po AS (SELECT user_id, content_id, published_at, round(CASE WHEN u1 THEN 0.85 ELSE 0 END + CASE WHEN u2 THEN 0.75 ELSE 0 END + CASE WHEN u3 THEN 0.55 ELSE 0 END, 4)::DOUBLE AS confidence, round(CASE WHEN u1 THEN 1.0 ELSE 0 END + CASE WHEN u2 THEN 1.0 ELSE 0 END + CASE WHEN u3 THEN 0.7 ELSE 0 END, 4)::DOUBLE AS score, u1::BIGINT + u2::BIGINT + u3::BIGINT AS sources FROM ch
), pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY published_at DESC, confidence DESC, score DESC, content_id DESC) AS place FROM po) WHERE place <= 200)"""


def _pool(t: Tables) -> DataFrame:
    return rec.category_pools(fx.category_score(t), fx.contents(t), fx.users(t), fx.exposed(t), rec.fit_by_category(fx.category_score(t)), AS_OF)


@query("rec03_pool", POOL + " SELECT * FROM pool", CAND_VIEWS, dates=("published_at",))
def rec03(t):
    return _pool(t)


DIVERSE = """f1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, published_at DESC, content_id DESC) AS r FROM sc
), f2 AS (SELECT *, greatest(score - 50.0 * (row_number() OVER (PARTITION BY user_id, publisher ORDER BY r) - 1), 0.0) AS final_score FROM f1 WHERE r <= 36
), f3 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY final_score DESC, published_at DESC, content_id DESC) AS q FROM f2
), f4 AS (SELECT *, row_number() OVER (PARTITION BY user_id, publisher ORDER BY q) AS k FROM f3
), fin AS (SELECT user_id, content_id, publisher, score::DOUBLE AS score, published_at, final_score::DOUBLE AS final_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY q) AS rank FROM f4 WHERE k <= 5) WHERE rank <= 6)"""
SCORED = RERANK + f""", sc AS (SELECT pool.user_id, pool.content_id, newsletter_name AS publisher, greatest({TOTAL}, 0.0) AS score, pool.published_at FROM pool JOIN parts ON parts.content_id = pool.content_id WHERE {TOTAL} > 0)"""


def _scored(t: Tables) -> DataFrame:
    score = F.greatest(sum(_parts(fx.contents(t)).values(), F.lit(0.0)), F.lit(0.0))
    scores = fx.contents(t).select("content_id", F.col("newsletter_name").alias("publisher"), score.alias("score"))
    return _pool(t).select("user_id", "content_id", "published_at").join(scores, "content_id").where("score > 0").select("user_id", "content_id", "publisher", "score", "published_at")


@query("rec16_diversity", POOL + ", " + SCORED + ", " + DIVERSE + " SELECT * FROM fin", CAND_VIEWS, dates=("published_at",))
def rec16(t):
    return rec.diverse(_scored(t), 6)


@query("rec18_daily_archive", POOL + ", " + SCORED + ", " + DIVERSE + " SELECT user_id, count(*) AS n, string_agg(content_id, ',' ORDER BY rank) AS contents FROM fin GROUP BY 1", CAND_VIEWS)
def rec18(t):
    return rec16(t).groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "content_id"))), lambda x: x["content_id"].cast("string")), ",").alias("contents"))


@query("rec15_fallback", """s AS (SELECT provider_id AS user_id, content_id, published_at, (content_id % 13 - 9)::DOUBLE AS base FROM contents
), r AS (SELECT *, CASE WHEN base > 0 THEN 1 WHEN base + 3 > 0 THEN 2 WHEN base + 6 > 0 THEN 3 WHEN base + 8 > 0 THEN 4 END AS round FROM s
), q AS (SELECT user_id, content_id, round, CASE round WHEN 1 THEN base WHEN 2 THEN base + 3 WHEN 3 THEN base + 6 ELSE base + 8 END AS score, published_at FROM r WHERE round IS NOT NULL)
SELECT user_id, content_id, round, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round, score DESC, published_at DESC, content_id DESC) AS rank FROM q) WHERE rank <= 30""", ("contents",))
def rec15(t):
    base = (F.col("content_id") % 13 - 9).cast("double")
    rows = fx.contents(t).select(F.col("provider_id").alias("user_id"), "content_id", "published_at", *((base + k).alias(f"score{i + 1}") for i, k in enumerate((0, 3, 6, 8))))
    return rec.fallback(rows, 30).select("user_id", "content_id", "round", "score", "rank")


@query("rec17_user_categories", "SELECT u.user_id, c.category_id FROM users u, (SELECT unnest(range(1, 6)) AS category_id) c WHERE u.category_id = c.category_id OR u.user_id % 10 = 0", ("users",))
def rec17(t):
    chosen = F.when(F.col("user_id") % 10 == 0, None).otherwise(F.array("category_id"))
    return fx.users(t).select("user_id", F.explode(F.coalesce(chosen, F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long")))).alias("category_id"))


@query("rec19_preload", "SELECT user_id FROM (SELECT user_id FROM users ORDER BY user_id LIMIT 200) WHERE user_id % 7 <> 0", ("users",))
def rec19(t):
    return tb.preload(fx.users(t).select("user_id"), fx.users(t).where("user_id % 7 = 0"), 200)


@query("rec20_trending", """f AS (SELECT user_id, content_id, row_number() OVER (PARTITION BY user_id ORDER BY content_id) AS ord FROM exposed WHERE content_id % 3 = 0
), c AS (SELECT user_id, content_id, row_number() OVER (PARTITION BY user_id ORDER BY content_id) AS ord FROM exposed WHERE content_id % 3 <> 0
), b AS (SELECT user_id, content_id, CASE WHEN content_id % 2 = 0 THEN 1 ELSE 0 END AS tier, ord FROM f UNION ALL SELECT user_id, content_id, 2, ord FROM c)
SELECT user_id, content_id, tier::BIGINT AS tier FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, ord, content_id) AS k FROM b) WHERE k = 1""", ("exposed",))
def rec20(t):
    ord_ = F.row_number().over(Window.partitionBy("user_id").orderBy("content_id"))
    shown = fx.exposed(t)
    featured, cards = (shown.where(w).withColumn("ord", ord_) for w in ("content_id % 3 = 0", "content_id % 3 <> 0"))
    return tb.trending(featured, cards, shown.where("content_id % 2 = 0").select("user_id", "content_id"))


@query("rec21_seen_filter", "SELECT e.user_id, e.content_id FROM exposed e WHERE EXISTS (SELECT 1 FROM contents c WHERE c.content_id = e.content_id AND c.published_at >= DATE '2024-01-01')", ("exposed", "contents"))
def rec21(t):
    recent = fx.contents(t).where("published_at >= DATE '2024-01-01'").select("content_id")
    return fx.exposed(t).join(recent, "content_id", "left_semi").select("user_id", "content_id")


@query("ext05_keyword_weights", "SELECT content_id % 20 AS keyword_id, sum(keyword_score) AS weight FROM category_score WHERE category_id IN (1, 3) GROUP BY 1", ("category_score",))
def ext05(t):
    return fx.category_score(t).where("category_id in (1, 3)").groupBy((F.col("content_id") % 20).alias("keyword_id")).agg(F.sum("keyword_score").alias("weight"))


@query("ext07_category_balance", "SELECT content_id, category_id, turn FROM (SELECT content_id, category_id, row_number() OVER (PARTITION BY category_id ORDER BY content_id) AS turn FROM category_score WHERE keyword_score > 0) WHERE turn <= 10", ("category_score",))
def ext07(t):
    turn = F.row_number().over(Window.partitionBy("category_id").orderBy("content_id")).cast("long")
    return fx.category_score(t).where("keyword_score > 0").withColumn("turn", turn).where("turn <= 10").select("content_id", "category_id", "turn")


@query("ext08_count_without_summary", "SELECT count(*) AS n FROM contents c WHERE length(content) BETWEEN 500 AND 10000 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.content_id)", ("contents",))
def ext08(t):
    rows = fx.contents(t).where(F.length("content").between(500, 10_000))
    return rows.join(t.labels.select(F.col("doc_id").alias("content_id")), "content_id", "left_anti").agg(F.count("*").alias("n"))


# --- joins, inserts, merges -----------------------------------------------------------------------------------------


@query("jon01_left_join", "SELECT c.content_id, p.provider_name FROM contents c LEFT JOIN (SELECT DISTINCT regexp_extract(source, 'src([0-9]+)', 1)::BIGINT AS provider_id, upper(source) AS provider_name FROM documents WHERE length(source) = 4) p ON p.provider_id = c.provider_id", ("contents",))
def jon01(t):
    provider = t.documents.where(F.length("source") == 4).select(F.regexp_extract("source", "src([0-9]+)", 1).cast("long").alias("provider_id"), F.upper("source").alias("provider_name")).distinct()
    return fx.contents(t).join(provider, "provider_id", "left").select("content_id", "provider_name")


@query("jon02_exists_or", "SELECT content_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.content_id AND toxic = 1) OR EXISTS (SELECT 1 FROM exposed e WHERE e.content_id = c.content_id AND e.user_id % 50 = 0) OR EXISTS (SELECT 1 FROM pages p WHERE p.page_id = c.content_id) AS has_references FROM contents c", ("contents", "exposed"))
def jon02(t):
    others = (t.labels.where("toxic = 1").select(F.col("doc_id").alias("content_id")), fx.exposed(t).where("user_id % 50 = 0").select("content_id"), t.pages.select(F.col("page_id").alias("content_id")))
    return tb.referenced(fx.contents(t).select("content_id"), "content_id", *others)


@query("jon03_scalar_count", "SELECT content_id, (SELECT count(*) FROM contents g WHERE g.newsletter_name = c.newsletter_name AND g.content LIKE '%Apache%') AS existing_grouped FROM contents c", ("contents",))
def jon03(t):
    return tb.grouped_count(fx.contents(t), "newsletter_name", "%Apache%").select("content_id", "existing_grouped")


@query("jon04_status_lookup", "SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END, 'x') AS q, CASE WHEN l.doc_id IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def jon04(t):
    found = t.labels.select("doc_id", "quality", F.lit("RESOLVED").alias("status"))
    return tb.resolve(t.documents.select("doc_id"), found, "doc_id").select("doc_id", F.when(F.col("quality") == 1, "GOOD").otherwise("BAD").alias("q"), "status")


@query("jon05_order_preserving", "SELECT user_id, u.pos::INT AS pos, u.content_id FROM (SELECT user_id, unnest(range(0, 3)) AS pos, unnest([user_id % 100, user_id % 37, 999999]) AS content_id FROM users) u JOIN contents c ON c.content_id = u.content_id", ("users", "contents"))
def jon05(t):
    ids = fx.users(t).select("user_id", F.array(F.col("user_id") % 100, F.col("user_id") % 37, F.lit(999_999).cast("long")).alias("ids"))
    return tb.in_list_order(ids, "ids", fx.contents(t).select("content_id"), "content_id").select("user_id", "pos", "content_id")


@query("jon06_features", "SELECT content_id, string_agg(category_id, ',' ORDER BY category_id) FILTER (keyword_score > 0) AS cats FROM category_score GROUP BY 1", ("category_score",))
def jon06(t):
    lists = fx.category_score(t).where("keyword_score > 0").groupBy("content_id").agg(F.array_join(F.sort_array(F.collect_list("category_id")).cast("array<string>"), ",").alias("cats"))
    return fx.category_score(t).select("content_id").distinct().join(lists, "content_id", "left")


@query("jon07_weighted_lookup", "w AS (SELECT DISTINCT provider_id, c AS category_id, (provider_id * c % 7)::DOUBLE AS weight FROM contents, (SELECT unnest(range(1, 6)) AS c)) SELECT content_id, coalesce((SELECT sum(weight) FROM w WHERE w.provider_id = c.provider_id AND category_id IN (1, 3)), 0.0) AS bonus FROM contents c", ("contents",))
def jon07(t):
    p = fx.contents(t).select("provider_id").distinct().select("provider_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("category_id"))
    weights = p.select("provider_id", "category_id", (F.col("provider_id") * F.col("category_id") % 7).cast("double").alias("weight"))
    return tb.weighted_lookup(fx.contents(t), weights, [1, 3]).select("content_id", "bonus")


@query("jon11_carry_section", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def jon11(t):
    return tb.carry_forward(t.conversations, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn"))).select("conv_id", "turn", "section")


@query("jon12_priority_lookup", """r AS (SELECT content_id, content_id % 30 AS a, content_id % 17 AS b FROM contents), x AS (SELECT content_id AS k, title AS value, content_id AS ord FROM contents)
SELECT r.content_id, coalesce(p.value, q.value) AS value, CASE WHEN p.value IS NOT NULL THEN 1 WHEN q.value IS NOT NULL THEN 2 END::BIGINT AS level
FROM r LEFT JOIN (SELECT * FROM x WHERE k % 2 = 0) p ON p.k = r.a LEFT JOIN (SELECT * FROM x WHERE k % 3 = 0) q ON q.k = r.b""", ("contents",))
def jon12(t):
    rows = fx.contents(t).select("content_id", (F.col("content_id") % 30).alias("a"), (F.col("content_id") % 17).alias("b"))
    x = fx.contents(t).select(F.col("content_id").alias("k"), F.col("title").alias("value"), F.col("content_id").alias("ord"))
    return tb.by_priority(rows, [("a", x.where("k % 2 = 0")), ("b", x.where("k % 3 = 0"))], "content_id").select("content_id", "value", "level")


HINTS = [("token", "Secrets"), ("apache", "Licence"), ("the", "English"), ("der", "German"), ("de", "Romance")]


@query("jon15_first_hint", "SELECT content_id, CASE WHEN contains(lower(content), 'token') THEN 'Secrets' WHEN contains(lower(content), 'apache') THEN 'Licence' WHEN contains(lower(content), 'the') THEN 'English' WHEN contains(lower(content), 'der') THEN 'German' WHEN contains(lower(content), 'de') THEN 'Romance' END AS name FROM contents", ("contents",))
def jon15(t):
    return fx.contents(t).select("content_id", tb.first_hint(F.col("content"), HINTS).alias("name"))


@query("snk01_insert_new", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events e WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.ts < TIMESTAMP '2024-01-03' AND o.user_id = e.user_id AND o.event_type = e.event_type)) WHERE k = 1")
def snk01(t):
    old = t.events.where("ts < TIMESTAMP_NTZ '2024-01-03 00:00:00'")
    return tb.insert_new(old, t.events, ["user_id", "event_type"], F.asc("event_id")).select("user_id", "event_type", "event_id")


@query("snk04_insert_not_exists", "SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages o WHERE o.page_id % 2 = 0 AND o.page_id = p.page_id) AND NOT EXISTS (SELECT 1 FROM pages o WHERE o.page_id % 2 = 0 AND o.url = p.url)")
def snk04(t):
    return tb.insert_not_exists(t.pages.where("page_id % 2 = 0"), t.pages.select("page_id", "url"), ["page_id", "url"])


@query("snk05_fill_missing", "SELECT content_id, coalesce(CASE WHEN content_id % 3 = 0 THEN NULL ELSE provider_id END, content_id % 5) AS provider_id FROM contents", ("contents",))
def snk05(t):
    rows = fx.contents(t).select("content_id", F.when(F.col("content_id") % 3 == 0, None).otherwise(F.col("provider_id")).alias("provider_id"))
    return tb.fill_missing(rows, fx.contents(t).select("content_id", (F.col("content_id") % 5).alias("value")), "content_id", "provider_id").select("content_id", "provider_id")


@query("snk06_get_or_create", """k AS (SELECT source AS name, min(doc_id) AS id FROM documents WHERE length(source) = 4 GROUP BY 1), a AS (SELECT DISTINCT source AS name FROM documents)
SELECT name, id, false AS created FROM k UNION ALL SELECT name, (SELECT max(doc_id) FROM documents WHERE length(source) = 4) + row_number() OVER (ORDER BY name), true FROM a WHERE name NOT IN (SELECT name FROM k)""".replace("k AS", "WITH k AS", 1))
def snk06(t):
    table = t.documents.where(F.length("source") == 4).select(F.col("source").alias("name"), F.col("doc_id").alias("id"))
    return tb.get_or_create(t.documents.select(F.col("source").alias("name")), table)


UPD_ROWS = "r AS (SELECT content_id, newsletter_name || ' ' || language AS content, CASE WHEN content_id % 4 = 0 THEN '' WHEN content_id % 4 = 1 THEN 'img' END AS image FROM contents), n AS (SELECT content_id, content, 'new' AS image FROM contents WHERE content_id % 2 = 0)"


@query("upd01_merge", UPD_ROWS + """, j AS (SELECT r.content_id, r.content, r.image, n.content AS nc, n.image AS ni, coalesce(n.content_id IS NOT NULL AND ((length(r.content) <= 50 AND length(r.content) < length(n.content)) OR contains(r.content, 'stupid')), false) AS take FROM r LEFT JOIN n ON n.content_id = r.content_id)
SELECT content_id, CASE WHEN take THEN nc ELSE content END AS content, CASE WHEN take THEN coalesce(nullif(image, ''), ni) ELSE image END AS image, take AS updated FROM j""", ("contents",))
def upd01(t):
    rows = fx.contents(t).select("content_id", F.concat_ws(" ", "newsletter_name", "language").alias("content"), F.when(F.col("content_id") % 4 == 0, "").when(F.col("content_id") % 4 == 1, "img").alias("image"))
    new = fx.contents(t).where("content_id % 2 = 0").select("content_id", "content", F.lit("new").alias("image"))
    return tb.merge_longer(rows, new, "content_id", 50, "stupid")


@query("snk08_keep_delete", """m AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1)
SELECT turn, c.conv_id, coalesce(m.content, text) AS content FROM conversations c LEFT JOIN m ON m.conv_id = c.conv_id WHERE m.content IS NULL OR turn = (SELECT min(turn) FROM conversations o WHERE o.conv_id = c.conv_id)""".replace("m AS", "WITH m AS", 1))
def snk08(t):
    merged = t.conversations.where("conv_id % 2 = 0").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return tb.keep_first(t.conversations.withColumnRenamed("text", "content"), "conv_id", "turn", merged)


@query("bkf01_backfill_status", """r AS (SELECT page_id AS row_id, CASE WHEN page_id % 20 = 0 THEN ' ' ELSE 't' END AS title, CASE WHEN page_id % 5 = 0 THEN 'https://home.example.com/' ELSE split_part(url, '#', 1) END AS url, page_id FROM pages
), s AS (SELECT row_id, CASE WHEN trim(title) = '' THEN 'INVALID' WHEN url <> 'https://home.example.com/' AND url IN (SELECT url FROM r WHERE page_id % 7 = 0) THEN 'EXISTS'
  WHEN url <> 'https://home.example.com/' AND row_number() OVER (PARTITION BY trim(title) = '', url ORDER BY row_id) > 1 THEN 'DUPLICATE' ELSE 'CREATED' END AS status FROM r)
SELECT row_id, status FROM s""".replace("r AS", "WITH r AS", 1))
def bkf01(t):
    i = F.col("page_id")
    rows = t.pages.select(i.alias("row_id"), F.when(i % 20 == 0, " ").otherwise("t").alias("title"), F.lit("c").alias("content"), F.when(i % 5 == 0, "https://home.example.com/").otherwise(F.split("url", "#")[0]).alias("url"))
    return tb.backfill_status(rows, rows.where("row_id % 7 = 0"), fallback=("https://home.example.com",)).select("row_id", "status")


@query("agg20_counters", """s AS (SELECT doc_id, CASE WHEN quality IS NULL THEN 'SKIPPED' WHEN toxic = 1 THEN 'FAILED' ELSE 'CREATED' END AS status FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT count(*) AS scanned, count(*) FILTER (status = 'CREATED') AS created, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'SKIPPED') AS skipped FROM s""".replace("s AS", "WITH s AS", 1))
def agg20(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select(F.when(F.col("quality").isNull(), "SKIPPED").when(F.col("toxic") == 1, "FAILED").otherwise("CREATED").alias("status"))
    return rows.agg(F.count("*").alias("scanned"), *(F.count_if(F.col("status") == k).alias(k.lower()) for k in ("CREATED", "FAILED", "SKIPPED")))


@query("agg21_status_roll_up", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND value > 30) THEN 'SUCCESS' WHEN bool_or(event_type = 'error' AND value > 40) THEN 'FAILED' ELSE 'SKIPPED' END AS outcome FROM events GROUP BY 1")
def agg21(t):
    rows = t.events.select("user_id", F.when((F.col("event_type") == "purchase") & (F.col("value") > 30), "SUCCESS").when((F.col("event_type") == "error") & (F.col("value") > 40), "FAILED").otherwise("SKIPPED").alias("outcome"))
    return tb.roll_up(rows, "user_id")


@query("set01_union_distinct_by", "SELECT content_id, side FROM (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY o) AS k FROM (SELECT content_id, 'left' AS side, 0 AS o FROM contents WHERE content_id % 2 = 0 UNION ALL SELECT content_id, 'right', 1 FROM contents WHERE content_id % 3 = 0)) WHERE k = 1", ("contents",))
def set01(t):
    ids = fx.contents(t).select("content_id")
    return tb.union_first(ids.where("content_id % 2 = 0").withColumn("side", F.lit("left")), ids.where("content_id % 3 = 0").withColumn("side", F.lit("right")), ["content_id"], F.asc("content_id"))


@query("set02_keyed_merge", "SELECT content_id, any_value(published_at) AS published_at, count(*) AS n, string_agg(src, ',' ORDER BY o) AS sources FROM (SELECT content_id, published_at, 'a' AS src, 0 AS o FROM contents WHERE content_id % 2 = 0 UNION ALL SELECT content_id, published_at, 'b', 1 FROM contents WHERE content_id % 3 = 0) GROUP BY 1", ("contents",), dates=("published_at",))
def set02(t):
    def part(name, where):
        return fx.contents(t).where(where).select("content_id", "published_at", F.lit(name).alias("source"), F.lit(1.0).alias("score"), F.lit(0.5).alias("confidence"))

    merged = tb.keyed_merge([part("a", "content_id % 2 = 0"), part("b", "content_id % 3 = 0")], "content_id")
    return merged.select("content_id", "published_at", F.size("signals").cast("long").alias("n"), F.array_join(F.transform("signals", lambda s: s["source"]), ",").alias("sources"))


@query("set03_difference", "SELECT content_id FROM contents c WHERE NOT EXISTS (SELECT 1 FROM exposed e WHERE e.content_id = c.content_id AND e.user_id < 20)", ("contents", "exposed"))
def set03(t):
    return fx.contents(t).select("content_id").join(fx.exposed(t).where("user_id < 20"), "content_id", "left_anti")


# --- digests --------------------------------------------------------------------------------------------------------


@query("dig03_groupable", "SELECT conv_id, count(*) AS n, count(*) FILTER (length(text) < 500) AS n_short, count(*) FILTER (length(text) < 500) >= 3 AND NOT bool_or(role = 'system') AS groupable FROM conversations GROUP BY 1")
def dig03(t):
    return dg.groupable(t.conversations.select("conv_id", F.col("text").alias("content"), (F.col("role") == "system").alias("has_references")), "conv_id")


@query("agg18_numbered_concat", "SELECT conv_id, count(*) AS n, string_agg(k || '. ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY k) AS merged FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY 1")
def agg18(t):
    return dg.numbered(t.conversations, "conv_id", "turn", "role", "text")


@query("agg19_first_not_null", "SELECT conv_id, arg_min(text, turn) FILTER (role = 'assistant') AS first FROM conversations GROUP BY 1")
def agg19(t):
    return t.conversations.groupBy("conv_id").agg(F.min_by(F.col("text"), F.when(F.col("role") == "assistant", F.col("turn"))).alias("first"))


@query("dig06_titles", """SELECT content_id, CASE WHEN n > 1 AND e > 0 THEN b || ' (추가 1/' || n || ')' WHEN n > 1 THEN b || ' (1/' || n || ')' WHEN e > 0 THEN b || ' (추가)' ELSE b END AS title FROM (
  SELECT content_id, 1 + content_id % 3 AS n, content_id % 2 AS e, CASE WHEN content_id % 4 = 0 THEN newsletter_name || ' Issue #' || content_id || ' 모음' ELSE year(published_at) || '년 ' || month(published_at) || '월 ' || day(published_at) || '일 ' || newsletter_name || ' 모음' END AS b FROM contents)""", ("contents",))
def dig06(t):
    i = F.col("content_id")
    return fx.contents(t).select("content_id", dg.group_title(F.col("newsletter_name"), F.when(i % 4 == 0, i), F.col("published_at"), i % 2, F.lit(1), 1 + i % 3).alias("title"))


@query("dig07_issue_number", "SELECT content_id, CASE WHEN newsletter_name <> 'React Status' AND try_cast(regexp_extract(x, '(?i)issue\\s*:?\\s*#?([0-9]{1,9})', 1) AS BIGINT) <= 10000 THEN try_cast(regexp_extract(x, '(?i)issue\\s*:?\\s*#?([0-9]{1,9})', 1) AS BIGINT) END AS issue FROM (SELECT content_id, newsletter_name, CASE content_id % 3 WHEN 0 THEN 'Issue #' || content_id || ': news' WHEN 1 THEN 'issue: 99999' ELSE 'none' END AS x FROM contents)", ("contents",))
def dig07(t):
    i = F.col("content_id")
    x = F.when(i % 3 == 0, F.concat(F.lit("Issue #"), i.cast("string"), F.lit(": news"))).when(i % 3 == 1, "issue: 99999").otherwise("none")
    return fx.contents(t).select("content_id", dg.issue_number(F.col("newsletter_name"), x).alias("issue"))


@query("dig09_library_grouping", """i AS (SELECT conv_id AS doc, turn AS pos, role = 'assistant' AS lib, text AS title, 'l' || turn AS link FROM conversations)
SELECT doc, pos, 1::BIGINT AS n_items, title, link FROM i WHERE NOT lib UNION ALL SELECT doc, min(pos), count(*), string_agg(title, ', ' ORDER BY pos), 'l' || min(pos) FROM i WHERE lib GROUP BY 1""".replace("i AS", "WITH i AS", 1))
def dig09(t):
    rows = t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), (F.col("role") == "assistant").alias("is_library"), F.col("text").alias("title"), F.concat(F.lit("l"), F.col("turn").cast("string")).alias("link"), F.lit(None).cast("string").alias("issue_link"))
    return dg.library_rows(rows)


# --- text and pages -------------------------------------------------------------------------------------------------


@query("str01_collapse", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def str01(t):
    return t.documents.select("doc_id", tx.collapse(F.col("text")).alias("text"))


@query("str03_clean_lines", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM documents")
def str03(t):
    return t.documents.select("doc_id", tx.clean_lines(F.col("text")).alias("text"))


@query("str05_truncate", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS text FROM documents")
def str05(t):
    return t.documents.select("doc_id", tx.truncate(F.col("text"), 100).alias("text"))


@query("str16_sha256", "SELECT doc_id, sha256(text) AS hash FROM documents")
def str16(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))


@query("str17_terms", r"SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(lower(text), '[^0-9a-z가-힣]+', ' ', 'g'), ' '), lambda w: length(w) >= 4 AND w NOT IN ('about', 'after', 'into', 'that', 'this', 'what', 'when', 'where', 'which', 'with', 'your')), ' ') AS terms FROM documents".replace("array_to_string(list_filter(", "len(list_distinct(list_filter(").replace(", ' ') AS terms", "))::BIGINT AS n_terms"))
def str17(t):
    return t.documents.select("doc_id", F.size(tx.significant_terms(F.col("text"))).cast("long").alias("n_terms"))


@query("ing05_exposure_text", "SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'summary' END, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END) AS text FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def ing05(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", tx.exposure_text(F.when(F.col("quality") == 1, "summary"), F.col("text")).alias("text"))


@query("ing08_rss_sender", r"SELECT page_id, 'rss@' || regexp_replace(lower(regexp_extract(url, 'https?://([^/?#]+)', 1)), '^www\.', '') AS sender FROM pages")
def ing08(t):
    return t.pages.select("page_id", web.rss_sender(F.col("url"), F.lit(None).cast("string")).alias("sender"))


@query("flt16_no_article", r"SELECT page_id, regexp_matches(lower(regexp_extract(u, 'https?://([^/?#]+)', 1)), '(^|\.)(github\.com|x\.com)$') OR regexp_matches(lower(regexp_extract(u, 'https?://[^/?#]+([^?#]*)', 1)), '(^|/)(privacy|unsubscribe)(/|$)|\.(pdf|png)$') AS skip FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://gist.github.com/a' WHEN 1 THEN 'https://a.example.com/privacy' WHEN 2 THEN 'https://a.example.com/f.PDF?x=1' ELSE url END AS u FROM pages)")
def flt16(t):
    i = F.col("page_id") % 5
    return t.pages.select("page_id", web.is_no_article(F.when(i == 0, "https://gist.github.com/a").when(i == 1, "https://a.example.com/privacy").when(i == 2, "https://a.example.com/f.PDF?x=1").otherwise(F.col("url"))).alias("skip"))


@query("url01_normalise")
def url01(t):
    return t.pages.select("page_id", web.normal_url_udf("url").alias("url"))


@query("htm01_links")
def htm01(t):
    return t.pages.select("page_id", F.explode(web.links_udf("html", "url")).alias("x")).select("page_id", "x.url", "x.text")


@query("enr03_pages")
def enr03(t):
    return web.enriched(t.pages)


@query("mth02_truncation", "SELECT event_id, trunc(value)::INT AS whole, greatest(least(value, 50.0), 10.0) AS clamped FROM events")
def mth02(t):
    return t.events.select("event_id", F.col("value").cast("int").alias("whole"), F.greatest(F.least(F.col("value"), F.lit(50.0)), F.lit(10.0)).alias("clamped"))


@query("dat01_ages", "SELECT content_id, greatest(DATE '2024-01-31' - published_at, 0)::INT AS age, week(published_at)::INT AS week, isoyear(published_at)::INT AS week_year FROM contents", ("contents",))
def dat01(t):
    d = F.col("published_at")
    return fx.contents(t).select("content_id", F.greatest(F.datediff(F.lit(AS_OF).cast("date"), d), F.lit(0)).alias("age"), F.extract(F.lit("WEEK"), d).cast("int").alias("week"), F.extract(F.lit("YEAROFWEEK"), d).cast("int").alias("week_year"))


@query("jsn01_props", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def jsn01(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- batch twins of streams -----------------------------------------------------------------------------------------


@query("stm04_dedup", "SELECT user_id, event_type, day, min(event_id) AS event_id FROM (SELECT *, ts::DATE AS day FROM events) GROUP BY 1, 2, 3", dates=("day",))
def stm04(t):
    rows = t.events.withColumn("day", F.to_date("ts"))
    return tb.first_by(rows, ["user_id", "event_type", "day"], F.asc("event_id")).select("user_id", "event_type", "day", "event_id")


@query("stm06_sliding_ban", "SELECT DISTINCT user_id FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 36000000000 PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error') WHERE n >= 6")
def stm06(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(us).rangeBetween(-36_000_000_000, 0)
    return t.events.where("event_type = 'error'").withColumn("n", F.count("*").over(w)).where("n >= 6").select("user_id").distinct()


@query("stm10_tumbling", "SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2", dates=("day",))
def stm10(t):
    return t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")
