"""More registered queries: filters, lookups, scalar functions and the contracts of keyed services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import analytics as an
from ..operators import recommend as rec
from ..operators import tables as tb
from . import fixtures as fx
from .catalog import CAND_VIEWS, END, POOL, SCORED, _pool, _scored, query
from .fixtures import AS_OF, Tables


@query("flt01_exact_match", "SELECT event_id, user_id FROM ga WHERE event_name = 'click'", ("ga",))
def flt01(t: Tables) -> DataFrame:
    return fx.ga_events(t).where(F.col("event_name") == "click").select("event_id", "user_id")


@query("flt02_or_group", "SELECT event_id FROM ga WHERE event_name = 'click' OR event_name = 'signup' OR event_name = 'none'", ("ga",))
def flt02(t):
    return fx.ga_events(t).where(F.col("event_name").isin("click", "signup", "none")).select("event_id")


@query("flt04_and_group", "SELECT event_id FROM ga WHERE event_name = 'view' AND user_type = 'returning' AND object_id <> '5'", ("ga",))
def flt04(t):
    return fx.ga_events(t).where((F.col("event_name") == "view") & (F.col("user_type") == "returning") & (F.col("object_id") != "5")).select("event_id")


@query("flt06_limit_then_filter", "SELECT object_id, n FROM (SELECT object_id, count(*) AS n FROM ga GROUP BY 1 ORDER BY n DESC, object_id LIMIT 20) WHERE NOT starts_with(object_id, '1')", ("ga",))
def flt06(t):
    top = an.top_k(fx.ga_events(t).groupBy("object_id").agg(F.count("*").alias("n")), 20, F.desc("n"), F.asc("object_id"))
    return top.where(~F.startswith("object_id", F.lit("1")))


@query("flt14_positive", "SELECT content_id, category_id, total_score FROM category_score WHERE total_score > 0", ("category_score",))
def flt14(t):
    return fx.category_score(t).where("total_score > 0").select("content_id", "category_id", "total_score")


@query("flt17_allow_list", r"SELECT page_id FROM pages WHERE regexp_extract(url, 'https?://([^/?#]+)', 1) LIKE '%.example.com' AND regexp_matches(regexp_extract(url, 'https?://[^/?#]+([^?#]*)', 1), '^/(en|de)/')")
def flt17(t):
    return t.pages.where(F.col("url").isNotNull() & F.endswith(F.try_parse_url("url", F.lit("HOST")), F.lit(".example.com")) & F.rlike(F.try_parse_url("url", F.lit("PATH")), F.lit("^/(en|de)/"))).select("page_id")


@query("flt19_sponsor", r"SELECT conv_id, turn FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN text || ' SPONSORED' ELSE text END AS x FROM conversations) WHERE NOT regexp_matches(x, '\bSPONSOR(ED)?\b')")
def flt19(t):
    x = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" SPONSORED"))).otherwise(F.col("text"))
    return t.conversations.where(~F.rlike(x, F.lit("(?<![A-Za-z0-9_])SPONSOR(ED)?(?![A-Za-z0-9_])"))).select("conv_id", "turn")


@query("flt25_spaced_hosts", r"SELECT page_id, row_number() OVER (PARTITION BY host ORDER BY page_id) * 15 - 15 AS wait_s FROM (SELECT page_id, regexp_extract(url, 'https?://([^/?#]+)', 1) AS host FROM pages) WHERE starts_with(host, 'blog.')")
def flt25(t):
    host = F.try_parse_url("url", F.lit("HOST"))
    rows = t.pages.select("page_id", host.alias("host")).where(F.startswith("host", F.lit("blog.")))
    return rows.select("page_id", ((F.row_number().over(Window.partitionBy("host").orderBy("page_id")) - 1) * 15).cast("long").alias("wait_s"))


@query("agg04_previous_total", "SELECT coalesce((SELECT count(DISTINCT user_id) FROM ga WHERE event_date BETWEEN DATE '2024-01-17' AND DATE '2024-01-23'), 0) AS users", ("ga",))
def agg04(t):
    return fx.ga_events(t).where(an.rolling_window(F.col("event_date"), "2024-01-23", 7)).agg(F.coalesce(F.count_distinct("user_id"), F.lit(0)).alias("users"))


@query("agg15_best_per_source", "SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def agg15(t):
    return tb.first_by(t.events, ["user_id", "event_type"], F.desc("value"), F.asc("event_id")).select("user_id", "event_type", "value", "event_id")


@query("agg16_requested_competing", "SELECT content_id, coalesce(sum(total_score) FILTER (category_id IN (1, 3)), 0.0) AS requested, coalesce(max(total_score) FILTER (category_id NOT IN (1, 3)), 0.0) AS competing FROM category_score GROUP BY 1", ("category_score",))
def agg16(t):
    asked = F.col("category_id").isin(1, 3)
    return fx.category_score(t).groupBy("content_id").agg(F.coalesce(F.sum(F.when(asked, F.col("total_score"))), F.lit(0.0)).alias("requested"), F.coalesce(F.max(F.when(~asked, F.col("total_score"))), F.lit(0.0)).alias("competing"))


@query("agg17_groups_in_order", "SELECT newsletter_name, language, min(content_id) AS first, string_agg(content_id, ',' ORDER BY content_id) AS ids FROM contents GROUP BY 1, 2", ("contents",))
def agg17(t):
    ids = F.array_join(F.sort_array(F.collect_list("content_id")).cast("array<string>"), ",")
    return fx.contents(t).groupBy("newsletter_name", "language").agg(F.min("content_id").alias("first"), ids.alias("ids"))


@query("agg23_sample", "SELECT content_id, title FROM contents ORDER BY content_id LIMIT 20", ("contents",))
def agg23(t):
    return fx.contents(t).select("content_id", "title").orderBy("content_id").limit(20)


@query("win01_rank", "SELECT content_id, category_id, row_number() OVER (PARTITION BY category_id ORDER BY total_score DESC, content_id) AS rank FROM category_score WHERE total_score > 0", ("category_score",))
def win01(t):
    rank = F.row_number().over(Window.partitionBy("category_id").orderBy(F.desc("total_score"), F.asc("content_id")))
    return fx.category_score(t).where("total_score > 0").select("content_id", "category_id", rank.cast("long").alias("rank"))


@query("top09_sorted", "SELECT newsletter_name, provider_id, content_id FROM contents WHERE provider_id < 3 ORDER BY newsletter_name, provider_id, content_id", ("contents",))
def top09(t):
    return fx.contents(t).where("provider_id < 3").select("newsletter_name", "provider_id", "content_id").orderBy("newsletter_name", "provider_id", "content_id")


@query("jon08_semi_join", "SELECT user_id FROM users u WHERE EXISTS (SELECT 1 FROM exposed e WHERE e.user_id = u.user_id AND e.content_id % 50 = 0)", ("users", "exposed"))
def jon08(t):
    return fx.users(t).select("user_id").join(fx.exposed(t).where("content_id % 50 = 0"), "user_id", "left_semi")


@query("jon10_feed_status", "SELECT source, count(*) AS n, count(*) FILTER (has_error) AS errors FROM statuses WHERE source IN ('src1', 'src2') GROUP BY 1", ("statuses",))
def jon10(t):
    feeds = t.spark.createDataFrame([("src1",), ("src2",)], "source string")
    return fx.statuses(t).join(F.broadcast(feeds), "source").groupBy("source").agg(F.count("*").alias("n"), F.count_if("has_error").alias("errors"))


@query("prj03_enum_lookup", "SELECT user_id, CASE segment WHEN 'BUILDING' THEN 'BACKEND' WHEN 'MACHINERY' THEN 'INFRA' WHEN 'HOUSEHOLD' THEN 'FRONTEND' ELSE 'OTHER' END AS preference FROM users", ("users",))
def prj03(t):
    names = F.create_map(*(F.lit(x) for pair in (("BUILDING", "BACKEND"), ("MACHINERY", "INFRA"), ("HOUSEHOLD", "FRONTEND")) for x in pair))
    return fx.users(t).select("user_id", F.coalesce(F.try_element_at(names, F.col("segment")), F.lit("OTHER")).alias("preference"))


@query("set04_ordered_union", """SELECT provider_id, content_id FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY side, content_id) AS r FROM (
  SELECT provider_id, content_id, min(side) AS side FROM (SELECT provider_id, content_id, 0 AS side FROM contents WHERE content_id % 5 = 0 UNION ALL SELECT provider_id, content_id, 1 FROM contents WHERE content_id % 2 = 0) GROUP BY 1, 2)) WHERE r <= 12""", ("contents",))
def set04(t):
    ids = fx.contents(t).select("provider_id", "content_id")
    both = ids.where("content_id % 5 = 0").withColumn("side", F.lit(0)).union(ids.where("content_id % 2 = 0").withColumn("side", F.lit(1)))
    once = both.groupBy("provider_id", "content_id").agg(F.min("side").alias("side"))
    return once.withColumn("r", F.row_number().over(Window.partitionBy("provider_id").orderBy("side", "content_id"))).where("r <= 12").select("provider_id", "content_id")


@query("src07_dynamic_scan", "SELECT c.content_id, c.newsletter_name, p.n FROM contents c LEFT JOIN (SELECT provider_id, count(*) AS n FROM contents GROUP BY 1) p ON p.provider_id = c.provider_id WHERE c.newsletter_name IN ('src3', 'src4') AND c.content NOT LIKE '%token%' AND c.published_at >= DATE '2023-03-01'", ("contents",))
def src07(t):
    provider = fx.contents(t).groupBy("provider_id").agg(F.count("*").alias("n"))
    rows = fx.contents(t).where(F.col("newsletter_name").isin("src3", "src4") & ~F.col("content").like("%token%") & (F.col("published_at") >= F.lit("2023-03-01").cast("date")))
    return rows.join(provider, "provider_id", "left").select("content_id", "newsletter_name", "n")


@query("src09_report_scan", "SELECT event_name, user_type, count(*) AS event_count, count(DISTINCT user_id) AS users FROM ga WHERE event_date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30' GROUP BY 1, 2 ORDER BY event_count DESC, event_name, user_type LIMIT 5", ("ga",))
def src09(t):
    rows = fx.ga_events(t).where(an.rolling_window(F.col("event_date"), END, 7)).groupBy("event_name", "user_type").agg(F.count("*").alias("event_count"), F.count_distinct("user_id").alias("users"))
    return an.top_k(rows, 5, F.desc("event_count"), F.asc("event_name"), F.asc("user_type"))


@query("rec13_features", """w AS (SELECT category_id, content_id % 20 AS keyword_id, (content_id % 7 - 2)::DOUBLE AS weight FROM category_score)
SELECT keyword_id, list_aggregate(list_sort(list(CASE WHEN weight > 0 THEN weight * 2 END) FILTER (weight > 0)), 'sum') AS positive, sum(weight) FILTER (weight < 0) AS negative FROM w WHERE category_id = 1 GROUP BY 1""", ("category_score",))
def rec13(t):
    w = fx.category_score(t).where("category_id = 1").select((F.col("content_id") % 20).alias("keyword_id"), (F.col("content_id") % 7 - 2).cast("double").alias("weight"))
    return w.groupBy("keyword_id").agg(F.sum(F.when(F.col("weight") > 0, F.col("weight") * 2)).alias("positive"), F.sum(F.when(F.col("weight") < 0, F.col("weight"))).alias("negative"))


@query("rec14_selection", POOL + ", " + SCORED + " SELECT user_id, count(*) AS positives, max(score)::DOUBLE AS best, count(*) >= 6 AS diverse FROM sc GROUP BY 1", CAND_VIEWS)
def rec14(t):
    return _scored(t).groupBy("user_id").agg(F.count("*").alias("positives"), F.max("score").alias("best"), (F.count("*") >= 6).alias("diverse"))


@query("rec02_windows", "SELECT content_id, CASE WHEN age <= 30 THEN 1 WHEN age <= 90 THEN 2 WHEN age <= 365 THEN 3 ELSE 4 END AS w FROM (SELECT content_id, DATE '2024-01-31' - published_at AS age FROM contents)", ("contents",))
def rec02(t):
    age = F.datediff(F.lit(AS_OF).cast("date"), F.col("published_at"))
    w = F.lit(len(rec.WINDOWS))
    for i, (days, _) in reversed(list(enumerate(rec.WINDOWS))):
        w = F.when(age <= days, i + 1).otherwise(w) if days is not None else w
    return fx.contents(t).select("content_id", w.alias("w"))


@query("str12_invisible", "SELECT doc_id, length(replace(replace(text, 'e', ''), chr(8203), '')) AS n FROM documents")
def str12(t):
    x = F.translate("text", "e", "​")
    return t.documents.select("doc_id", F.length(F.translate(x, tx.INVISIBLE, "")).cast("long").alias("n"))


@query("str14_base64", "SELECT doc_id, text, NULL::VARCHAR AS broken FROM documents")
def str14(t):
    decoded = "cast(try_to_binary(x, 'base64') AS string)"
    coded = t.documents.select("doc_id", F.base64(F.col("text").cast("binary")).alias("x"))
    return coded.select("doc_id", F.expr(decoded).alias("text"), F.expr("cast(try_to_binary(concat('%', x), 'base64') AS string)").alias("broken"))


@query("str15_url_parameter", r"SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages")
def str15(t):
    return t.pages.select("page_id", F.nullif(F.url_decode(F.regexp_extract("url", "[?&]page=([^&#]*)", 1)), F.lit("")).alias("page"))


@query("str19_formats", "SELECT event_id, printf('%.2f', value) AS short, lpad(event_id::VARCHAR, 8, '0') AS padded FROM events")
def str19(t):
    return t.events.select("event_id", F.format_string("%.2f", "value").alias("short"), F.lpad(F.col("event_id").cast("string"), 8, "0").alias("padded"))


@query("mth01_clamp", "SELECT event_id, greatest(least(value, 40.0), 5.0) AS value FROM events")
def mth01(t):
    return t.events.select("event_id", F.greatest(F.least("value", F.lit(40.0)), F.lit(5.0)).alias("value"))


@query("map01_headers", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source END AS feed, coalesce(CASE WHEN doc_id % 3 = 0 THEN source END, 'none') AS feed_or FROM documents")
def map01(t):
    headers = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("RSS-Feed-URL"), F.col("source"))).otherwise(F.create_map(F.lit("x.y"), F.lit("z")))
    feed = F.try_element_at(headers, F.lit("RSS-Feed-URL"))
    return t.documents.select("doc_id", feed.alias("feed"), F.coalesce(feed, F.lit("none")).alias("feed_or"))


@query("ing03_received", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN ts END, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY END, TIMESTAMP '2024-01-31')::DATE AS day FROM events", dates=("day",))
def ing03(t):
    i = F.col("event_id")
    at = F.coalesce(F.when(i % 2 == 0, F.col("ts")), F.when(i % 3 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return t.events.select("event_id", F.to_date(at).alias("day"))


@query("dat03_zoned_times", "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT - 9 * 3600 AS s FROM events")
def dat03(t):
    text = F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0900"))
    return t.events.select("event_id", F.unix_seconds(F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))).alias("s"))


@query("ext04_score_lists", "SELECT content_id, string_agg(category_id || '=' || total_score::BIGINT, ',' ORDER BY category_id) AS scores FROM category_score GROUP BY 1", ("category_score",))
def ext04(t):
    entry = F.concat_ws("=", F.col("category_id").cast("string"), F.col("total_score").cast("long").cast("string"))
    lists = F.sort_array(F.collect_list(F.struct("category_id", entry.alias("x"))))
    return fx.category_score(t).groupBy("content_id").agg(F.array_join(F.transform(lists, lambda s: s["x"]), ",").alias("scores"))


@query("ext10_object_resolution", "SELECT object_id, doc_id AS content_id, CASE WHEN doc_id IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status FROM (SELECT DISTINCT CASE WHEN object_id::BIGINT % 9 = 0 THEN 'x' || object_id ELSE object_id END AS object_id FROM ga) g LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 0) d ON d.doc_id = try_cast(object_id AS BIGINT)", ("ga",))
def ext10(t):
    name = F.when(F.col("object_id").cast("long") % 9 == 0, F.concat(F.lit("x"), "object_id")).otherwise(F.col("object_id"))
    ids = fx.ga_events(t).select(name.alias("object_id")).distinct().withColumn("content_id", F.col("object_id").try_cast("long"))
    known = t.documents.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("content_id"), F.lit("RESOLVED").alias("status"))
    out = tb.resolve(ids, known, "content_id")
    return out.select("object_id", F.when(F.col("status") == "RESOLVED", F.col("content_id")).alias("content_id"), "status")


@query("ext11_latest_featured", "SELECT day, object_id, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, object_id) AS k FROM (SELECT event_date AS day, object_id, count(*) AS n FROM ga WHERE event_date = (SELECT max(event_date) FROM ga) GROUP BY 1, 2)) WHERE k <= 10", ("ga",), dates=("day",))
def ext11(t):
    ga = fx.ga_events(t)
    last = ga.agg(F.max("event_date").alias("day"))
    rows = ga.join(F.broadcast(last), F.col("event_date") == F.col("day")).groupBy("day", "object_id").agg(F.count("*").alias("n"))
    return an.top_k(rows, 10, F.desc("n"), F.asc("object_id"))


@query("ext12_exposed_of_list", "SELECT user_id, content_id FROM exposed WHERE content_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)", ("exposed",))
def ext12(t):
    return fx.exposed(t).where(F.col("content_id").isin(1, 2, 3, 5, 8, 13, 21, 34, 55, 89)).select("user_id", "content_id")


@query("ext16_best_summary", "SELECT doc_id, text FROM (SELECT doc_id, v AS text, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, v) AS k FROM (SELECT doc_id, lang AS v, doc_id % 3 AS p FROM documents UNION ALL SELECT doc_id, source, doc_id % 2 FROM documents)) WHERE k = 1")
def ext16(t):
    both = t.documents.select("doc_id", F.col("lang").alias("text"), (F.col("doc_id") % 3).alias("p")).union(t.documents.select("doc_id", "source", F.col("doc_id") % 2))
    return tb.first_by(both, ["doc_id"], F.desc("p"), F.asc("text")).select("doc_id", "text")


@query("udx02_source_registry", POOL + " SELECT sources, count(*) AS n, avg(confidence) AS confidence FROM pool GROUP BY 1", CAND_VIEWS)
def udx02(t):
    return _pool(t).groupBy("sources").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
