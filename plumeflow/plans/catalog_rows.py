"""Registered queries, third part: text and log functions, ingestion, lookups, each with its SQL.

Where a function undoes a coding, the coded text is made from a column here, and the SQL is that column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import web
from ..operators import analytics as an
from ..operators import digest as dg
from ..operators import ingest as ing
from ..operators import recommend as rec
from ..operators import tables as tb
from ..sources import logs
from . import fixtures as fx
from .catalog import query
from .fixtures import AS_OF, Tables


# --- text -----------------------------------------------------------------------------------------------------------


@query("str02_line_ends", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM documents")
def str02(t):
    dos = F.replace(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit(" "), F.lit("\u00a0"))
    return t.documents.select("doc_id", tx.clean_lines(dos).alias("text"))


@query(
    "str04_parts",
    """SELECT doc_id, CASE WHEN instr(text, ' the ') > 0 THEN substring(text, 1, instr(text, ' the ') - 1) ELSE text END AS before,
    CASE WHEN instr(text, ' the ') > 0 THEN substring(text, instr(text, ' the ') + 5) ELSE text END AS after, substring(source, 4) AS bare FROM documents""",
)
def str04(t):
    return t.documents.select("doc_id", tx.before(F.col("text"), " the ").alias("before"), tx.after(F.col("text"), " the ").alias("after"), tx.without_ends(F.concat("source", F.lit(".x")), "src", ".x").alias("bare"))


@query("str06_contains_any", "SELECT doc_id, contains(lower(text), 'token') OR contains(lower(text), 'licen') AS has FROM documents")
def str06(t):
    return t.documents.select("doc_id", tx.contains_any(F.col("text"), "TOKEN", "Licen").alias("has"))


@query(
    "str07_remove_block",
    """SELECT doc_id, CASE WHEN pos > 0 AND near IS NOT NULL THEN substring(text, 1, pos - 1) || substring(tail, near) ELSE text END AS text FROM (
      SELECT *, least(nullif(instr(tail, 'and'), 0), nullif(instr(tail, 'of'), 0)) AS near FROM (SELECT doc_id, text, instr(text, 'the') AS pos, substring(text, instr(text, 'the') + 3) AS tail FROM documents))""",
)
def str07(t):
    return t.documents.select("doc_id", tx.remove_block(F.col("text"), "the", "and", "of").alias("text"))


@query("str08_patterns", r"SELECT doc_id, nullif(regexp_extract(text, '[0-9]{3,}', 0), '') AS first, len(regexp_extract_all(text, '[A-Z][a-z]+'))::BIGINT AS n, CASE WHEN instr(text, ' ') > 0 THEN substring(text, instr(text, ' ') + 1) END AS rest FROM documents")
def str08(t):
    parts = tx.split_at(F.col("text"), " ", 2)
    return t.documents.select("doc_id", tx.first_match(F.col("text"), "[0-9]{3,}").alias("first"), F.size(tx.all_matches(F.col("text"), "[A-Z][a-z]+")).cast("long").alias("n"), F.get(parts, F.lit(1)).alias("rest"))


@query("str09_quoted_printable", "SELECT doc_id, replace(text, chr(160), ' ') AS text FROM documents")
def str09(t):
    coded = F.replace(F.replace(F.col("text"), F.lit("="), F.lit("=3D")), F.lit("é"), F.lit("=C3=A9"))
    entities = F.replace(F.replace(coded, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return t.documents.select("doc_id", tx.sanitize_udf(entities).alias("text"))


@query("str10_entities", "SELECT doc_id, '<' || source || '> é €' AS text FROM documents")
def str10(t):
    return t.documents.select("doc_id", tx.sanitize_udf(F.concat(F.lit("&l t;"), "source", F.lit("&gt; &#233; &#x20AC;\u200b"))).alias("text"))


@query("str18_literal", "SELECT doc_id, contains(text, '. The') AS has FROM documents")
def str18(t):
    return t.documents.select("doc_id", F.rlike("text", F.lit(tx.literal(". The"))).alias("has"))


@query("flt18_title_relevance", """SELECT doc_id, n = 0 OR met >= least(2, n) AS ok FROM (SELECT doc_id, len(l) AS n, len(list_filter(l, lambda w: contains(lower(text), w))) AS met FROM (
  SELECT doc_id, text, list_distinct(list_filter(string_split(regexp_replace(lower(split_part(text, chr(10), 1)), '[^0-9a-z가-힣]+', ' ', 'g'), ' '), lambda w: length(w) >= 4 AND w NOT IN ('about', 'after', 'into', 'that', 'this', 'what', 'when', 'where', 'which', 'with', 'your'))) AS l FROM documents))""")
def flt18(t):
    return t.documents.select("doc_id", tx.relevant(F.substring_index("text", "\n", 1), F.col("text")).alias("ok"))


@query("prj02_exposure", "SELECT doc_id, CASE WHEN lang = 'es' THEN 'KOREAN' ELSE 'ENGLISH' END AS language FROM documents")
def prj02_more(t):
    return t.documents.select("doc_id", tx.language(F.when(F.col("lang") == "es", "한국어").otherwise(F.col("lang"))).alias("language"))


@query("enr06_limit_at_line", r"SELECT doc_id, CASE WHEN length(text) > 300 THEN trim(regexp_replace(substring(text, 1, 300), '\n[^\n]*$', '')) || '...' ELSE text END AS text FROM documents")
def enr06(t):
    return t.documents.select("doc_id", tx.limit_at_line(F.col("text"), 300).alias("text"))


@query("dat04_literals", "SELECT event_id, (event_id % 90)::DOUBLE * CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 60 ELSE 3600 END AS seconds, CASE WHEN event_id % 2 = 0 THEN 540 ELSE -330 END::INT AS zone FROM events")
def dat04(t):
    i = F.col("event_id")
    unit = F.when(i % 3 == 0, "s").when(i % 3 == 1, "m").otherwise(" H")
    return t.events.select("event_id", tx.seconds(F.concat((i % 90).cast("string"), unit)).alias("seconds"), tx.zone_offset(F.when(i % 2 == 0, "+0900").otherwise("UTC-05:30")).alias("zone"))


@query("chr01_charset", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'utf-16le' END AS charset, text FROM documents")
def chr01(t):
    even = F.col("doc_id") % 2 == 0
    kind = F.when(even, "text/html; Charset=\"UTF-16LE\"").otherwise("text/html")
    raw = F.when(even, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-8"))
    rows = t.documents.select("doc_id", tx.declared_charset(kind).alias("charset"), raw.alias("raw"))
    return rows.select("doc_id", "charset", tx.decoded_udf("raw", "charset").alias("text"))


# --- addresses and pages ----------------------------------------------------------------------------------------------


@query(
    "url02_raw_normalise",
    r"""SELECT page_id, 'https://a.example.com/p/' || page_id || CASE page_id % 3 WHEN 0 THEN '?a=1&b=%20x' WHEN 1 THEN '' ELSE '?z' END AS url FROM pages""",
)
def url02(t):
    i = F.col("page_id")
    tail = F.when(i % 3 == 0, "/?utm_source=feed&b=%20x&gclid=9&a=1#top").when(i % 3 == 1, "/#x").otherwise("?z&utm_x=1")
    return t.pages.select("page_id", web.raw_normal_url_udf(F.concat(F.lit("  HTTPS://A.Example.com/p/"), i.cast("string"), tail, F.lit(" "))).alias("url"))


@query("url03_hosts", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, 'https?://([^/?#]+)', 1)), '^www\.', '') AS host, regexp_extract(url, '^https?://[^/?#]+', 0) || '/i/' || page_id || '.png' AS image FROM pages")
def url03(t):
    return t.pages.select("page_id", web.host_of(F.col("url")).alias("host"), web.absolute_udf("url", F.concat(F.lit("/i/"), F.col("page_id").cast("string"), F.lit(".png"))).alias("image"))


@query("url04_request_path", r"SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '/' ELSE '/' || array_to_string(string_split(split_part(split_part(url, '?', 1), '#', 1), '/')[4:], '/') END AS path FROM pages")
def url04(t):
    target = F.when(F.col("page_id") % 4 == 0, "https://a.example.com?x=1").otherwise(F.col("url"))
    return t.pages.select("page_id", logs.request_path(target).alias("path"))


@query("enr04_page_image", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://i.example.com/og.png' WHEN 1 THEN 'https://i.example.com/tw.png' WHEN 2 THEN 'https://a.example.com/first.png' END AS image FROM pages")
def enr04(t):
    i = F.col("page_id") % 4
    head = F.when(i == 0, '<meta name="twitter:image" content="/tw.png"><meta property="og:image" content="https://i.example.com/og.png">').when(i == 1, '<meta name="twitter:image" content="https://i.example.com/tw.png">').otherwise("")
    body = F.when(i == 3, "<p>none</p>").otherwise('<img alt="no source"><img src=" /first.png ">')
    return t.pages.select("page_id", web.image_udf(F.concat(F.lit("<html><head>"), head, F.lit("</head><body>"), body, F.lit("</body></html>")), F.lit("https://a.example.com/x")).alias("image"))


@query("enr05_outcomes", """SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'http-404' WHEN page_id % 10 = 1 THEN 'non-html' WHEN length(html) < 700 THEN 'too-short' WHEN page_id % 10 = 2 THEN 'title-mismatch' ELSE 'success' END AS outcome FROM pages""")
def enr05(t):
    i = F.col("page_id") % 10
    return t.pages.select("page_id", web.fetch_outcome(F.when(i == 0, 404).otherwise(200), F.when(i == 1, "application/pdf").otherwise("Text/HTML; charset=utf-8"), F.col("html"), i != 2).alias("outcome"))


@query("htm01_parts", "SELECT page_id, 'https://a.example.com/l/' || page_id AS url, 'Read ' || page_id AS text FROM pages")
def htm01_more(t):
    i = F.col("page_id").cast("string")
    page = F.concat(F.lit('<div><a href="mailto:x@y.z">mail</a><a href="#top">top</a><p><a href="/l/'), i, F.lit('?utm_source=a">Read <b>'), i, F.lit('</b></a></p><a href="https://a.example.com/l/'), i, F.lit('">again</a></div>'))
    out = t.pages.select("page_id", F.explode(web.links_udf(page, F.lit("https://a.example.com/"))).alias("x"))
    return out.select("page_id", F.regexp_replace("x.url", r"\?.*$", "").alias("url"), "x.text")


# --- logs -------------------------------------------------------------------------------------------------------------


def _error_lines(t: Tables) -> DataFrame:
    """(line_no, line): six kinds of lines of an error log, and every 50th broken."""
    i = F.col("event_id")
    k = i % 6
    said = (
        F.when(k == 0, 'limiting requests, excess: 20.1 by zone "api"')
        .when(k == 3, '"/usr/share/web/index.html" is not found (2: No such file or directory)')
        .when(k == 5, "upstream timed out")
        .otherwise('open() "/usr/share/web/x" failed (2: No such file or directory)')
    )
    request = F.when(k == 1, "GET /favicon.ico HTTP/1.1").when(k == 2, "GET /.env?x=1 HTTP/1.1").when(k == 3, "POST / HTTP/1.1").when(k == 4, F.concat(F.lit("GET /img/"), i.cast("string"), F.lit(".png HTTP/1.1"))).otherwise("GET /api/items HTTP/1.1")
    line = F.concat(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit(" [error] 7#7: *1 "), said, F.lit(", client: 10.1.2.3, server: s, request: \""), request, F.lit('", host: "h.example.com"'))
    return t.events.select(i.alias("line_no"), F.when(i % 50 == 0, "broken line").otherwise(line).alias("line"))


@query("log02_error_fields", """SELECT event_id AS line_no, event_id % 50 <> 0 AS parsed, CASE WHEN event_id % 50 <> 0 THEN 'error' END AS level, CASE WHEN event_id % 50 <> 0 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') END AS ts_text, CASE WHEN event_id % 50 = 0 THEN '' ELSE '10.1.2.3' END AS ip,
  CASE WHEN event_id % 50 = 0 THEN '' ELSE 'h.example.com' END AS host, CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 6 = 3 THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN event_id % 50 = 0 THEN '-' ELSE CASE event_id % 6 WHEN 1 THEN '/favicon.ico' WHEN 2 THEN '/.env' WHEN 3 THEN '/' WHEN 4 THEN '/img/' || event_id || '.png' ELSE '/api/items' END END AS path FROM events""")
def log02(t):
    return logs.parse_error(_error_lines(t)).drop("category")


@query("log04_error_classes", """SELECT CASE event_id % 6 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'favicon' WHEN 2 THEN 'bot_scan' WHEN 3 THEN 'root_probe' WHEN 4 THEN 'missing_static' ELSE 'other' END AS category, count(*) AS n FROM events WHERE event_id % 50 <> 0 GROUP BY 1""")
def log04(t):
    return logs.parse_error(_error_lines(t)).where("parsed").groupBy("category").agg(F.count("*").alias("n"))


@query("stm07_bot_lines", "SELECT '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip, count(*) AS n FROM events WHERE event_id % 97 <> 0 AND event_type <> 'signup' AND (event_id % 11 = 0 OR event_id % 19 = 0) GROUP BY 1")
def stm07(t):
    rows = logs.parse_access(fx.access_lines(t)).withColumn("category", logs.access_class())
    return rows.where("category = 'bot_scan'").groupBy("ip").agg(F.count("*").alias("n"))


@query("mth03_numbers", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id / 4.0 END::DOUBLE AS n FROM events")
def mth03(t):
    i = F.col("event_id")
    return t.events.select("event_id", logs.first_number(F.when(i % 3 == 0, "-").otherwise(F.concat(F.lit(" "), (i / 4).cast("string"), F.lit(", 7.5")))).alias("n"))


# --- digests ----------------------------------------------------------------------------------------------------------


@query("dig08_descriptions", r"SELECT doc_id, trim(regexp_replace('x' || text, '\s+', ' ', 'g')) AS text FROM documents")
def dig08(t):
    return t.documents.select("doc_id", dg.clean_description(F.concat(F.lit(" Issue #"), F.col("doc_id").cast("string"), F.lit(": x"), "text")).alias("text"))


@query("dig10_library_week", "SELECT content_id, isoyear(published_at)::INT AS week_year, week(published_at)::INT AS week FROM contents", ("contents",))
def dig10(t):
    d, i = F.col("published_at"), F.col("content_id")
    said = F.when(i % 4 == 0, F.concat(F.lit("Libraries of "), F.date_format(d, "MMMM d"), F.lit("th, "), F.date_format(d, "yyyy"))).when(i % 4 == 1, F.date_format(d, "yyyy-MM-dd")).when(i % 4 == 2, F.concat(F.lit("on "), F.date_format(d, "d MMMM yyyy"))).otherwise(F.date_format(d, "yyyy.MM.dd"))
    year, week = dg.library_week(said)
    return fx.contents(t).select("content_id", year.cast("int").alias("week_year"), week.cast("int").alias("week"))


@query("win04_running_length", "SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS running FROM conversations")
def win04(t):
    return t.conversations.select("conv_id", "turn", F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn")).alias("running"))


# --- joins and lookups ------------------------------------------------------------------------------------------------


def _labels(t: Tables) -> DataFrame:
    label = F.concat(F.lit("n"), F.floor(F.col("turn") / 2).cast("string"), F.when(F.col("turn") % 2 == 0, "Title").otherwise("Description"))
    return t.conversations.select(F.col("conv_id").alias("doc"), label.alias("label"), F.col("text").alias("value"))


@query("jon13_label_pairs", "SELECT a.conv_id AS doc, 'n' || (a.turn // 2) || 'Title' AS label, a.text AS title, b.text AS description FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0")
def jon13(t):
    return tb.paired_labels(_labels(t))


@query("jon14_footnotes", "SELECT r.conv_id AS doc, r.turn % 5 AS n, r.turn, u.url FROM conversations r LEFT JOIN (SELECT conv_id, turn % 4 AS n, 'u' || max(turn) AS url FROM conversations GROUP BY 1, 2) u ON u.conv_id = r.conv_id AND u.n = r.turn % 5")
def jon14(t):
    c = t.conversations
    refs = c.select(F.col("conv_id").alias("doc"), (F.col("turn") % 5).alias("n"), "turn")
    return tb.footnotes(refs, c.select(F.col("conv_id").alias("doc"), (F.col("turn") % 4).alias("n"), F.concat(F.lit("u"), F.col("turn").cast("string")).alias("url"), F.col("turn").alias("pos")))


@query("jon09_not_exposed", "SELECT u.user_id, count(*) AS n FROM users u JOIN category_score s ON s.category_id = u.category_id WHERE total_score > 0 AND u.user_id <= 100 AND NOT EXISTS (SELECT 1 FROM exposed e WHERE e.user_id = u.user_id AND e.content_id = s.content_id) GROUP BY 1", ("users", "category_score", "exposed"))
def jon09(t):
    pairs = fx.users(t).where("user_id <= 100").join(fx.category_score(t).where("total_score > 0"), "category_id").select("user_id", "content_id")
    return pairs.join(fx.exposed(t), ["user_id", "content_id"], "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


@query("arr01_arrays", "SELECT conv_id, list_sum(l)::BIGINT AS total, list_max(l)::BIGINT AS most, len(list_distinct(l))::BIGINT AS different, len(list_filter(l, lambda x: x > 100)) > 0 AS any_long FROM (SELECT conv_id, list(length(text)) AS l FROM conversations GROUP BY 1)")
def arr01(t):
    rows = t.conversations.groupBy("conv_id").agg(F.collect_list(F.length("text")).alias("l"))
    return rows.select("conv_id", F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("l").cast("long").alias("most"), F.size(F.array_distinct("l")).cast("long").alias("different"), F.exists("l", lambda x: x > 100).alias("any_long"))


@query("nul01_blank_to_other", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''), lang) AS name FROM documents")
def nul01(t):
    return t.documents.select("doc_id", F.coalesce(F.nullif(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")), F.lit("")), "lang").alias("name"))


@query("agg14_signal_sum", """SELECT user_id, 20 * sum(value * 0.5) + 15 * greatest(count(DISTINCT event_type) - 1, 0) AS bonus FROM events GROUP BY 1""")
def agg14(t):
    return t.events.groupBy("user_id").agg((20 * F.sum(F.col("value") * 0.5) + 15 * F.greatest(F.count_distinct("event_type") - 1, F.lit(0))).alias("bonus"))


@query("win02_running_occurrence", "SELECT content_id, row_number() OVER (PARTITION BY newsletter_name ORDER BY published_at DESC, content_id DESC) - 1 AS earlier FROM contents", ("contents",))
def win02(t):
    nth = F.row_number().over(Window.partitionBy("newsletter_name").orderBy(F.desc("published_at"), F.desc("content_id"))) - 1
    return fx.contents(t).select("content_id", nth.cast("long").alias("earlier"))


# --- ingestion --------------------------------------------------------------------------------------------------------


@query("ing02_senders", "SELECT doc_id, source AS name, 'n' || doc_id || '@mail.example.com' AS address FROM documents")
def ing02(t):
    coded = F.concat(F.lit("=?utf-8?B?"), F.base64(F.col("source").cast("binary")), F.lit("?="))
    said = tx.header_udf(F.when(F.col("doc_id") % 2 == 0, coded).otherwise(F.concat(F.lit('"'), "source", F.lit('"'))))
    name, address = tx.sender_address(F.concat(F.col("said"), F.lit(" <n"), F.col("doc_id").cast("string"), F.lit("@mail.example.com>")))
    return t.documents.select("doc_id", said.alias("said")).select("doc_id", name.alias("name"), address.alias("address"))


@query("ing04_content_rows", """SELECT d.doc_id AS source_id, CASE WHEN p.page_id % 3 = 0 THEN 'from the page' ELSE d.text END AS content, CASE WHEN d.doc_id % 5 = 0 THEN 'https://h.example.com' ELSE 'l' || d.doc_id END AS url,
  CASE WHEN d.doc_id % 2 = 0 THEN 'own.png' ELSE 'page' || p.page_id || '.png' END AS image, CASE WHEN length(CASE WHEN p.page_id % 3 = 0 THEN 'from the page' ELSE d.text END) > 10000 THEN 'TOO_LONG' ELSE 'OK' END AS status
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id AND d.doc_id % 5 <> 0""")
def ing04(t):
    i = F.col("doc_id")
    items = t.documents.select(i.alias("source_id"), F.lit(0).alias("pos"), F.col("source").alias("title"), F.col("text").alias("content"), F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("l"), i.cast("string"))).alias("link"), F.when(i % 2 == 0, "own.png").otherwise("").alias("image"), F.lit("https://h.example.com").alias("header_url"))
    p = F.col("page_id")
    pages = t.pages.select(F.concat(F.lit("l"), p.cast("string")).alias("url"), F.when(p % 3 == 0, "from the page").otherwise("").alias("body"), F.concat(F.lit("page"), p.cast("string"), F.lit(".png")).alias("image_url"))
    return ing.content_rows(items, pages).select("source_id", "content", "url", "image", "status")


@query("ing07_title_priority", r"SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'breaking|urgent') THEN 100 WHEN regexp_matches(lower(text), 'release|launch') THEN 90 WHEN regexp_matches(lower(text), 'ai|llm') THEN 85 WHEN regexp_matches(lower(text), 'security') THEN 80 WHEN regexp_matches(lower(text), 'guide|tutorial') THEN 75 WHEN regexp_matches(lower(text), 'interview') THEN 70 WHEN regexp_matches(lower(text), 'review') THEN 65 ELSE 50 END::INT AS priority FROM documents")
def ing07(t):
    return t.documents.select("doc_id", tx.title_priority(F.col("text"), ing.TITLE_PRIORITY).alias("priority"))


@query("src04_feed_counts", "SELECT f.source AS url, CASE WHEN f.source = 'src1' THEN -1 ELSE coalesce(i.n, 0) END::BIGINT AS n FROM (SELECT DISTINCT source FROM documents) f LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE doc_id % 50 = 7 GROUP BY 1) i ON i.source = f.source")
def src04(t):
    feeds = t.documents.select(F.col("source").alias("url")).distinct().withColumn("failed", F.col("url") == "src1")
    return ing.feed_results(feeds, t.documents.where("doc_id % 50 = 7").select(F.col("source").alias("feed")))


@query("src05_pending", """SELECT event_id AS source_id, event_type AS outcome FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY AND (contains(props, '1') OR event_type = 'view') AND (event_id % 3 = 0 OR ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY OR event_type = 'error') ORDER BY ts DESC, event_id LIMIT 50""")
def src05(t):
    rows = t.events.select(F.col("event_id").alias("source_id"), F.col("ts").cast("timestamp").alias("received"), F.when(F.col("event_id") % 3 != 0, F.col("ts").cast("timestamp")).alias("processed_at"), F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")).alias("outcome"), "event_type", F.create_map(F.lit("X"), F.col("props")).alias("headers"))
    match = ing.names_any([F.col("event_type")], ["VIEW"]) | ing.names_any([], ["1"], F.col("headers"))
    out = ing.pending_sources(rows, match, f"{AS_OF} 00:00:00", look_back=20, stale=10)
    return out.select("source_id", F.col("event_type").alias("outcome"))


@query("snk07_nested_upsert", "SELECT doc_id AS source_id, lang, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS n_items FROM documents")
def snk07(t):
    i = F.col("doc_id")
    items = F.when(i % 3 == 0, F.array("source")).otherwise(F.array().cast("array<string>"))
    rows = t.documents.select(i.alias("source_id"), F.struct("lang", F.struct(items.alias("items"), F.lit("kept").alias("by")).alias("webPage")).alias("enrichment"))
    found = t.documents.where("doc_id % 2 = 0").select(i.alias("source_id"), F.array("source", "lang").alias("items"))
    out = ing.with_web_page(rows, found)
    return out.select("source_id", "enrichment.lang", F.size("enrichment.webPage.items").alias("n_items"))


@query("snk02_new_items", "SELECT page_id, url FROM (SELECT page_id, split_part(url, '?', 1) AS url, row_number() OVER (PARTITION BY split_part(url, '?', 1) ORDER BY page_id) AS k FROM pages) WHERE k = 1 AND url NOT IN (SELECT split_part(url, '?', 1) FROM pages WHERE page_id < 20)")
def snk02(t):
    rows = t.pages.select("page_id", F.split("url", r"\?")[0].alias("url"))
    return tb.insert_new(rows.where("page_id < 20"), rows, ["url"], F.asc("page_id")).select("page_id", "url")


@query("aib01_batch", """f AS (SELECT content_id, provider_type AS category, content FROM contents WHERE length(content) BETWEEN 500 AND 10000 AND content_id % 3 <> 0
), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY content_id) AS turn FROM f
), c AS (SELECT * FROM r WHERE turn <= 5 ORDER BY turn, category, content_id LIMIT 5)
SELECT content_id, running::BIGINT AS running FROM (SELECT content_id, sum(length(content)) OVER (ORDER BY turn, category, content_id ROWS UNBOUNDED PRECEDING) AS running FROM c) WHERE running <= 30000""", ("contents",))
def aib01(t):
    rows = fx.contents(t).select("content_id", F.col("provider_type").alias("category"), "content")
    return ing.model_batch(rows, rows.where("content_id % 3 = 0")).select("content_id", "running")


@query("aib02_replies", "SELECT content_id, CASE WHEN content_id % 7 <> 0 THEN newsletter_name END AS summary, (content_id % 11)::INT AS score, content_id % 7 <> 0 AND content_id % 5 <> 0 AS valid, content_id % 7 <> 0 AND content_id % 5 <> 0 AND content_id % 11 >= 7 AS passed FROM contents", ("contents",))
def aib02(t):
    i = F.col("content_id")
    heads = F.when(i % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    reply = F.to_json(F.struct(F.when(i % 7 != 0, F.col("newsletter_name")).alias("summary"), heads.alias("headlines"), F.array(F.lit("k")).alias("keywords"), (i % 11).cast("int").alias("score")))
    rows = fx.contents(t).select("content_id", reply.alias("reply"), F.lit(None).cast("string").alias("error"))
    return ing.checked_replies(rows).select("content_id", "summary", "score", "valid", "passed")


@query("aib03_markdown_batch", "SELECT content_id FROM contents c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.content_id AND l.quality = 1) ORDER BY content_id LIMIT 5", ("contents",))
def aib03(t):
    done = t.labels.where("quality = 1").select(F.col("doc_id").alias("content_id"))
    return ing.without_markdown(fx.contents(t), done).select("content_id")


@query("stm11_stale", "SELECT event_id FROM events WHERE event_id % 4 = 0 OR ts < TIMESTAMP '2024-01-31' - INTERVAL 15 DAY")
def stm11(t):
    at = F.lit(AS_OF).cast("timestamp_ntz")
    return t.events.where((F.col("event_id") % 4 == 0) | (F.col("ts") < at - F.expr("INTERVAL 15 DAYS"))).select("event_id")


@query("stm02_fan_out", "SELECT conv_id AS request, role AS token, count(*) AS n FROM conversations GROUP BY 1, 2")
def stm02(t):
    requests = t.conversations.groupBy("conv_id").agg(F.collect_list("role").alias("tokens")).withColumnRenamed("conv_id", "request")
    return ing.fan_out(requests, "request", "tokens")


@query("ext13_missing_archive", "SELECT u.user_id FROM users u WHERE NOT EXISTS (SELECT 1 FROM exposed e WHERE e.user_id = u.user_id AND e.content_id % 2 = 0)", ("users", "exposed"))
def ext13(t):
    archive = fx.exposed(t).where("content_id % 2 = 0").select("user_id", F.lit("d").alias("day"))
    return ing.missing_days(fx.users(t).select("user_id"), archive, "d")


@query("ext15_category_scores", "SELECT content_id, category_id, least(sum(keyword_score), 20.0) + least(sum(provider_score), 10.0) AS total FROM category_score GROUP BY 1, 2", ("category_score",))
def ext15(t):
    s = fx.category_score(t).groupBy("content_id", "category_id").agg(F.sum("keyword_score").alias("k"), F.sum("provider_score").alias("p"))
    return s.select("content_id", "category_id", (F.least("k", F.lit(20.0)) + F.least("p", F.lit(10.0))).alias("total"))


@query("udx03_rule_list", "SELECT content_id, greatest(length(newsletter_name) * 2.0 + CASE WHEN language = 'en' THEN 5.0 ELSE 0.0 END - 8.0, 0.0)::DOUBLE AS score FROM contents", ("contents",))
def udx03(t):
    rules = [F.length("newsletter_name") * 2.0, F.when(F.col("language") == "en", 5.0).otherwise(0.0), F.lit(-8.0)]
    return fx.contents(t).select("content_id", rec.total(rules).cast("double").alias("score"))


@query("udx04_provider_rules", "SELECT page_id, CASE WHEN contains(url, 'example.org') THEN 'org' WHEN contains(url, 'blog.') THEN 'blog' WHEN contains(url, 'www.') THEN 'www' END AS rule FROM pages")
def udx04(t):
    return t.pages.select("page_id", tb.first_hint(F.col("url"), [("example.org", "org"), ("blog.", "blog"), ("www.", "www")]).alias("rule"))


@query("udx06_filter_chain", "SELECT content_id FROM contents WHERE length(content) >= 500 AND language <> 'de' AND provider_id % 2 = 0", ("contents",))
def udx06(t):
    return an.chained(fx.contents(t), [F.length("content") >= 500, F.col("language") != "de", F.col("provider_id") % 2 == 0]).select("content_id")


@query("snk12_dry_run", "SELECT 'created' AS action, count(*) AS n FROM pages WHERE page_id % 2 = 1 UNION ALL SELECT 'kept', count(*) FROM pages WHERE page_id % 2 = 0")
def snk12(t):
    there, rows = t.pages.where("page_id % 2 = 0").select("page_id"), t.pages.select("page_id")
    return ing.dry_run(there, rows, ["page_id"])


@query("stm13_first_page", "SELECT content_id, published_at FROM contents ORDER BY published_at DESC, content_id DESC LIMIT 20", ("contents",), dates=("published_at",))
def stm13(t):
    return an.top_k(fx.contents(t).select("content_id", "published_at"), 20, F.desc("published_at"), F.desc("content_id"))
