from datetime import date

import pytest
from pyspark.sql import functions as F

from plumeflow.functions import text as tx
from plumeflow.functions import web
from plumeflow.operators import analytics as an
from plumeflow.operators import digest as dg
from plumeflow.operators import recommend as rec
from plumeflow.operators import tables as tb
from plumeflow.sources import logs, mail


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_sanitize_pairs():
    assert tx.sanitize("Hello=20World") == "Hello World"
    assert tx.mend_entities("&n bsp;") == "&nbsp;"
    assert tx.mend_entities("&n= bsp;") == "&nbsp;"
    assert tx.mend_entities("a & b; c") == "a & b; c"
    assert tx.sanitize("&ldquo;x&rdquo; &#128512;") == "“x” 😀"
    assert tx.guarded_base64("aGk=") == "hi" and tx.guarded_base64("%%") is None
    assert tx.decoded_header("=?utf-8?b?7ZWc6riA?= <a@b.c>") == "한글 <a@b.c>"


def test_text_columns(spark):
    x = F.lit("one--two--three")
    r = one(spark, b=tx.before(x, "--"), a=tx.after(x, "--"), n=tx.before(x, "?"), r=tx.remove_block(F.lit("a[b]c|d"), "[", "|", "]"), w=tx.without_ends(F.lit("<x>"), "<", ">"), t=tx.truncate(F.lit("abcdef"), 3), c=tx.contains_any(F.lit("ABC"), "x", "bc"), l=tx.limit_at_line(F.lit("ab\ncd\nef"), 7))
    assert (r.b, r.a, r.n, r.r, r.w, r.t, r.c, r.l) == ("one", "two--three", "one--two--three", "a]c|d", "x", "abc...", True, "ab\ncd...")


@pytest.mark.parametrize("text", ["ab\ncd\nef", "ab\ncde\nfg", "ab\nc\re\nfg", "ab\ncd\u2028\nfg", "ab\ncd\re", "ab\ncd\u2029efg", "\n\n\n\n\n\n\n\n", "\u3000a\u00a0\ncdefg", " a\t\u2003\ncdefg", "\u00a0abcdefgh", "abcdef\U0001f600x", None])
def test_limit_at_line_is_that_of_sql(spark, duck, text):
    sql = r"SELECT CASE WHEN length(x) > 7 THEN trim(regexp_replace(substring(x, 1, 7), '\n[^\n]*$', '')) || '...' ELSE x END FROM (SELECT ?::VARCHAR AS x)"
    assert one(spark, x=tx.limit_at_line(F.lit(text).cast("string"), 7)).x == duck.execute(sql, [text]).fetchone()[0]


def test_relevance(spark):
    ok = lambda t, c: one(spark, x=tx.relevant(F.lit(t), F.lit(c))).x
    assert ok("Spark streaming guide", "a guide to spark") and not ok("Spark streaming guide", "nothing here")
    assert ok("in of", "anything") and ok("kotlin2 released", "about kotlin2")


def test_sender(spark):
    name, address = tx.sender_address(F.lit('"News" <a@b.c>'))
    bare, same = tx.sender_address(F.lit("a@b.c"))
    r = one(spark, n=name, a=address, b=bare, s=same)
    assert (r.n, r.a, r.b, r.s) == ("News", "a@b.c", "a@b.c", "a@b.c")


@pytest.mark.parametrize(
    "url,out",
    [
        ("HTTPS://Example.com/a/?utm_source=x&b=2&a=1#f", "https://example.com/a?a=1&b=2"),
        ("https://example.com", "https://example.com/"),
        (" <https://example.com/x>. ".replace("<", ""), "https://example.com/x"),
        ("https://e.com/?q=%ED%95%9C", "https://e.com/?q=%ED%95%9C"),
        ("ftp://e.com/a", ""),
        (None, ""),
    ],
)
def test_normal_url(url, out):
    assert web.normal_url(url) == out


def test_raw_url():
    assert web.raw_normal_url("https://E.com/a/?b=%20&a=1&fbclid=2#x") == "https://e.com/a?a=1&b=%20"
    assert web.raw_normal_url("no url/#x") == "no url"


def test_pages():
    page = "<html><head><meta name='twitter:image' content='/t.png'></head><body><nav><p>Navigation text that is long enough</p></nav><p>short</p><p>A paragraph that is <b>long</b> enough.<p>A paragraph that is <b>long</b> enough.</p><a href='/x?utm_a=1'>X</a><a href='/x'>again</a></body></html>"
    assert web.article(page) == "A paragraph that is long enough."
    assert web.page_image(page, "https://e.com/a") == "https://e.com/t.png"
    assert web.links(page, "https://e.com/") == [("https://e.com/x?utm_a=1", "X")]
    assert web.article(None) is None and web.links("") == []


def test_outcomes(spark):
    f = lambda s, k, c, t: one(spark, x=web.fetch_outcome(F.lit(s), F.lit(k), F.lit(c), F.lit(t))).x
    assert [f(404, "text/html", "", True), f(200, "image/png", "", True), f(200, "text/html", "x", True), f(200, "text/html", "x" * 800, False), f(200, "text/html", "x" * 800, True)] == ["http-404", "non-html", "too-short", "title-mismatch", "success"]


ARR = "array<double>"


def affinity(spark, pos, neg, bonus):
    a = lambda v: F.array(*(F.lit(float(x)) for x in v)).cast(ARR)
    return one(spark, x=rec.keyword_affinity(a(pos), a(neg), F.lit(float(bonus)))).x


def test_keyword_affinity(spark):
    assert affinity(spark, [2, 3], [-2], 10) == 14.0
    assert affinity(spark, [100], [], 0) == 99.0
    assert affinity(spark, [], [], 5) == 5.0
    assert affinity(spark, [], [-10], 0) == 0.0


def test_signals(spark):
    s = F.array(*(F.struct(F.lit(n).alias("source"), F.lit(a).alias("score"), F.lit(b).alias("confidence")) for n, a, b in (("a", 1.0, 0.75), ("b", 0.7, 0.55))))
    assert abs(one(spark, x=rec.signal_bonus(s)).x - 37.7) < 1e-9


@pytest.mark.parametrize("text,new,ai,platform", [("AI가 왔다", False, True, False), ("maintain the domain", False, False, False), ("Released: node.js API", True, False, True), ("새로운 언어 모델", True, True, False)])
def test_rerank_words(spark, text, new, ai, platform):
    p = rec.rerank_parts(F.lit(text), F.lit(date(2026, 1, 1)), F.lit(date(2026, 1, 1)))
    r = one(spark, n=p["new_technology_signal"], a=p["ai_llm_signal"], p=p["platform_signal"], r=p["reranking_recency"])
    assert (r.n > 0, r.a > 0, r.p > 0, r.r) == (new, ai, platform, 60.0)


@pytest.mark.parametrize(
    "asked,scores,fit",
    [
        ([1], [(1, 4, 4)], True),
        ([1], [(1, 4, 0), (2, 4, 4)], False),
        ([4], [(4, 29, 0), (2, 8, 4)], False),
        ([1], [(1, 17, 4), (4, 20, 4)], False),
        ([1], [(1, 8, 4), (4, 7, 4)], False),
        ([1], [(1, 4, 4), (4, 0, 4)], True),
        ([1], [(1, 4, 0), (2, 4, 0)], False),
        ([1], [(1, 0, 0)], True),
    ],
)
def test_category_fit(spark, asked, scores, fit):
    df = spark.createDataFrame([(1, c, float(k), float(p), float(k + p)) for c, k, p in scores], "content_id long, category_id long, keyword_score double, provider_score double, total_score double")
    assert rec.category_fit(df, asked).first().fit is fit


def test_explain_floor(spark):
    parts = {"keyword_affinity": F.lit(0.0), "freshness": F.lit(-10.0), "candidate_source_signal": F.lit(0.0)}
    rows = one(spark, x=rec.explained(parts)).x
    assert [(r.rule, r.score, r.type) for r in rows] == [("keyword_affinity", 0.0, "SCORE"), ("freshness", -10.0, "PENALTY"), ("final_score_floor", 10.0, "ADJUSTMENT")]


def test_diversity(spark):
    rows = [(1, i, "Same" if i < 4 else "Other", 100.0 - i, date(2026, 1, 1)) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "user_id long, content_id long, publisher string, score double, published_at date")
    out = rec.diverse(df, 3).orderBy("rank").collect()
    assert len(out) == 3 and sum(r.publisher == "Same" for r in out) <= 2 and any(r.publisher == "Other" for r in out)
    assert rec.diverse(df, 0).count() == 0


def test_pages_of_ids(spark):
    df = spark.createDataFrame([(50,), (40,), (30,), (20,)], "content_id long")
    a = an.keyset_page(df, 2).collect()
    b = an.keyset_page(df, 2, a[0].next_offset).collect()
    assert [r.content_id for r in a] == [50, 40] and a[0].next_offset == 40
    assert [r.content_id for r in b] == [30, 20] and b[0].next_offset is None
    with pytest.raises(ValueError):
        an.keyset_page(df, 0)


def test_percentile_is_nearest_rank(spark):
    r = an.latency_stats(spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double"), "v").first()
    assert (r.p50, r.p95) == (2.0, 4.0)


def test_error_log(spark):
    lines = [
        (1, '2026/01/01 00:00:00 [error] 1#1: limiting requests, excess: 20.1 by zone "a", client: 1.2.3.4, server: x, request: "GET /api HTTP/1.1", host: "h"'),
        (2, '2026/01/01 00:00:00 [error] open() "/x/favicon.ico" failed (2: No such file or directory), client: 1.2.3.4, request: "GET /favicon.ico HTTP/1.1"'),
        (3, '2026/01/01 00:00:00 [error] x, client: 1.2.3.4, request: "GET /.env HTTP/1.1"'),
        (4, '2026/01/01 00:00:00 [error] x, client: 1.2.3.4, request: "POST / HTTP/1.1"'),
        (5, '2026/01/01 00:00:00 [error] "/a.txt" No such file or directory, request: "GET /a.txt HTTP/1.1"'),
        (6, "2026/01/01 00:00:00 [error] whatever"),
        (7, "garbage"),
    ]
    rows = logs.parse_error(spark.createDataFrame(lines, "line_no long, line string")).orderBy("line_no").collect()
    assert [r.category for r in rows] == ["rate_limited", "favicon", "bot_scan", "root_probe", "missing_static", "other", None]
    assert rows[0].ip == "1.2.3.4" and rows[0].host == "h" and not rows[6].parsed


def test_library_week(spark):
    for text, want in (("March 3rd, 2026 issue", (2026, 10)), ("2021-01-03", (2020, 53)), ("no date", (None, None))):
        y, w = dg.library_week(F.lit(text))
        r = one(spark, y=y, w=w)
        assert (r.y, r.w) == want


def test_insert_and_merge(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, url string")
    new = spark.createDataFrame([(1, "x"), (3, "b"), (4, "d"), (5, None)], "id long, url string")
    assert {r.id for r in tb.insert_not_exists(table, new, ["id", "url"]).collect()} == {4, 5}
    pairs = spark.createDataFrame([(1, "newsTitle", "T"), (1, "newsDescription", "D"), (2, "xTitle", "U")], "doc long, label string, value string")
    assert {(r.doc, r.title, r.description) for r in tb.paired_labels(pairs).collect()} == {(1, "T", "D"), (2, "U", None)}
    refs = spark.createDataFrame([(1, 1), (1, 2)], "doc long, n long")
    notes = spark.createDataFrame([(1, 1, 0, "old"), (1, 1, 1, "new")], "doc long, n long, pos long, url string")
    assert {(r.n, r.url) for r in tb.footnotes(refs, notes).collect()} == {(1, "new"), (2, None)}


def test_mail(spark, tmp_path):
    raw = b"From: =?utf-8?b?7ZWc?= <a@b.c>\r\nTo: x@y.z\r\nSubject: Hi\r\nDate: Thu, 01 Jan 2026 00:00:00 +0000\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\none\r\n--B\r\nContent-Type: text/html\r\n\r\n<p>two</p>\r\n--B\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=f.pdf\r\n\r\nxx\r\n--B--\r\n"
    (tmp_path / "a.eml").write_bytes(raw)
    r = mail.read_mail(spark, str(tmp_path)).first()
    assert r.subject == "Hi" and "한" in r.sender and r.text.strip() == "one" and "<p>two</p>" in r.html and r.attachments[0].name == "f.pdf" and r.error is None
    known = spark.createDataFrame([], "sender string, subject string, received timestamp")
    mails = mail.read_mail(spark, str(tmp_path))
    assert mail.accepted(mails, ["A@B.C"], known).count() == 1 and mail.accepted(mails, ["A@B.C"], mails).count() == 0
    assert mail.prompt("x {{A}} y", A="1") == "x 1 y"
