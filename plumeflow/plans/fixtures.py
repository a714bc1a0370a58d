"""Stand-in views over the driver's tables, in Spark and as SQL for the oracle.

Each view plays a table of a content-feed application: analytics events,
contents with providers and category scores, users with categories, exposures,
statuses, pages and access-log lines.  Clock values are arguments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AS_OF = "2024-01-31"


class Tables:
    """Lazily read tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def ga_events(t: Tables) -> DataFrame:
    day = F.to_date("ts")
    return t.events.select(
        "event_id",
        F.col("event_type").alias("event_name"),
        F.regexp_extract("props", '"k": ?([0-9]+)', 1).alias("object_id"),
        day.alias("event_date"),
        "ts",
        "user_id",
        "value",
        F.when(day == F.min(day).over(Window.partitionBy("user_id")), "new").otherwise("returning").alias("user_type"),
    )


def contents(t: Tables) -> DataFrame:
    provider = F.regexp_extract("source", "src([0-9]+)", 1).cast("long")
    return t.documents.select(
        F.col("doc_id").alias("content_id"),
        F.col("source").alias("newsletter_name"),
        provider.alias("provider_id"),
        F.when(provider % 2 == 0, "BLOG").otherwise("NEWSLETTER").alias("provider_type"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        F.col("lang").alias("language"),
        F.date_sub(F.lit(AS_OF).cast("date"), (F.col("doc_id") % 400).cast("int")).alias("published_at"),
    )


def category_score(t: Tables) -> DataFrame:
    d, c, p = F.col("doc_id"), F.col("category_id"), F.regexp_extract("source", "src([0-9]+)", 1).cast("long")
    ks = F.when(d % 10 == 0, 0).when((d + c) % 5 == 0, 6 + d % 9).when((d + 2 * c) % 7 == 0, d % 8).otherwise(0)
    ps = F.when((d % 10 == 0) | (d % 3 == 0), 0).when((p % 5 + 1 == c) | ((d + c) % 5 == 0), 4).otherwise(0)
    rows = t.documents.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("category_id"))
    return rows.select(d.alias("content_id"), c.cast("long").alias("category_id"), ks.cast("double").alias("keyword_score"), ps.cast("double").alias("provider_score"), (ks + ps).cast("double").alias("total_score"))


def users(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("user_id"), (1 + F.col("c_nationkey") % 5).cast("long").alias("category_id"), F.col("c_mktsegment").alias("segment"))


def exposed(t: Tables) -> DataFrame:
    """(user, content) pairs already shown; contents are dealt over the number of documents, one row."""
    n = t.documents.agg(F.count("*").alias("n"))
    return t.orders.join(F.broadcast(n)).select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % F.col("n")).alias("content_id")).distinct()


def statuses(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").select("doc_id", "source", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("ai_processed"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("has_error"), F.col("quality").isNotNull().alias("processed"))


def access_lines(t: Tables) -> DataFrame:
    """(line_no, line) in the detailed format; every 97th line is broken."""
    status = F.expr("CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN '500' ELSE '404' END WHEN 'signup' THEN '429' ELSE '200' END")
    target = F.expr("CASE WHEN event_id % 11 = 0 THEN '/wp-login.php' WHEN event_id % 13 = 0 THEN '/favicon.ico' WHEN event_id % 17 = 0 THEN '/' WHEN event_id % 3 = 0 THEN concat('/api/newsletters/contents/', cast(user_id AS string), '?page=', cast(event_id % 7 AS string)) ELSE concat('/api/items/3f2504e0-4f89-11d3-9a0c-0305e82c3301/', cast(event_id % 50 AS string)) END")
    method = F.expr("CASE WHEN event_id % 17 = 0 THEN 'POST' ELSE 'GET' END")
    agent = F.expr("CASE WHEN event_id % 19 = 0 THEN 'sqlmap/1.7' ELSE 'Mozilla/5.0' END")
    ip = F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    rt = F.expr("cast(cast(round(value * 10) AS bigint) AS string)")
    whole = F.concat(ip, F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] \""), method, F.lit(" "), target, F.lit(' HTTP/1.1" '), status, F.lit(" "), (F.col("event_id") * 7).cast("string"), F.lit(' "-" "'), agent, F.lit('" "-" rt='), rt, F.lit('.5 uct="0.1" uht="-" urt="0.2, 0.3"'))
    return t.events.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 97 == 0, "garbage line").otherwise(whole).alias("line"))


#: The same views for DuckDB, as the bodies of common table expressions.
SQL = {
    "ga": r"""SELECT event_id, event_type AS event_name, regexp_extract(props, '"k": ?([0-9]+)', 1) AS object_id, ts::DATE AS event_date, ts, user_id, value,
      CASE WHEN ts::DATE = min(ts::DATE) OVER (PARTITION BY user_id) THEN 'new' ELSE 'returning' END AS user_type FROM events""",
    "contents": r"""SELECT doc_id AS content_id, source AS newsletter_name, regexp_extract(source, 'src([0-9]+)', 1)::BIGINT AS provider_id,
      CASE WHEN regexp_extract(source, 'src([0-9]+)', 1)::BIGINT % 2 = 0 THEN 'BLOG' ELSE 'NEWSLETTER' END AS provider_type,
      split_part(text, chr(10), 1) AS title, text AS content, lang AS language, DATE '2024-01-31' - (doc_id % 400)::INT AS published_at FROM documents""",
    "category_score": r"""SELECT content_id, category_id, ks::DOUBLE AS keyword_score, ps::DOUBLE AS provider_score, (ks + ps)::DOUBLE AS total_score FROM (
      SELECT doc_id AS content_id, c AS category_id,
        CASE WHEN doc_id % 10 = 0 THEN 0 WHEN (doc_id + c) % 5 = 0 THEN 6 + doc_id % 9 WHEN (doc_id + 2 * c) % 7 = 0 THEN doc_id % 8 ELSE 0 END AS ks,
        CASE WHEN doc_id % 10 = 0 OR doc_id % 3 = 0 THEN 0 WHEN regexp_extract(source, 'src([0-9]+)', 1)::BIGINT % 5 + 1 = c OR (doc_id + c) % 5 = 0 THEN 4 ELSE 0 END AS ps
      FROM documents, (SELECT unnest(range(1, 6)) AS c))""",
    "users": "SELECT c_custkey AS user_id, (1 + c_nationkey % 5)::BIGINT AS category_id, c_mktsegment AS segment FROM customer",
    "exposed": "SELECT DISTINCT o_custkey AS user_id, o_orderkey % (SELECT count(*) FROM documents) AS content_id FROM orders",
    "statuses": "SELECT d.doc_id, source, coalesce(quality = 1, false) AS ai_processed, coalesce(toxic = 1, false) AS has_error, quality IS NOT NULL AS processed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "access": r"""SELECT event_id AS line_no, CASE WHEN event_id % 97 = 0 THEN 'garbage line' ELSE
      '10.0.' || (user_id // 256) || '.' || (user_id % 256) || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "' || CASE WHEN event_id % 17 = 0 THEN 'POST' ELSE 'GET' END || ' ' ||
      CASE WHEN event_id % 11 = 0 THEN '/wp-login.php' WHEN event_id % 13 = 0 THEN '/favicon.ico' WHEN event_id % 17 = 0 THEN '/' WHEN event_id % 3 = 0 THEN '/api/newsletters/contents/' || user_id || '?page=' || (event_id % 7)
        ELSE '/api/items/3f2504e0-4f89-11d3-9a0c-0305e82c3301/' || (event_id % 50) END ||
      ' HTTP/1.1" ' || CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN '500' ELSE '404' END WHEN 'signup' THEN '429' ELSE '200' END || ' ' || (event_id * 7) || ' "-" "' ||
      CASE WHEN event_id % 19 = 0 THEN 'sqlmap/1.7' ELSE 'Mozilla/5.0' END || '" "-" rt=' || round(value * 10)::BIGINT || '.5 uct="0.1" uht="-" urt="0.2, 0.3"' END AS line FROM events""",
}


def with_views(body: str, *names: str) -> str:
    """SQL text with the named views ahead; body may begin with further expressions ('x AS (...)') and ends in a SELECT."""
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {views}{', ' if body.lstrip()[:6].upper() != 'SELECT' else ' '}{body}"
