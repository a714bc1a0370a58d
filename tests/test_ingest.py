from pyspark.sql import functions as F

from plumeflow.operators import ingest as ing


def test_pending(spark):
    rows = [(1, "2026-01-10", None, None, "GeekNews"), (2, "2026-01-11", "2026-01-11", "success", "geeknews x"), (3, "2026-01-09", "2026-01-09", "failed", "GEEKNEWS"), (4, "2025-01-01", None, None, "GeekNews"), (5, "2026-01-12", None, None, "other")]
    df = spark.createDataFrame(rows, "source_id long, received string, processed_at string, outcome string, sender string").withColumns({k: F.col(k).cast("timestamp") for k in ("received", "processed_at")})
    out = ing.pending_sources(df, ing.names_any([F.col("sender")], ["geeknews"]), "2026-01-20")
    assert [r.source_id for r in out.collect()] == [1, 3]
    assert ing.pending_sources(df, ing.names_any([F.col("sender")], []), "2026-01-20").count() == 0
    m = spark.createDataFrame([({"a-b": "Hada.io"},), (None,)], "h map<string,string>")
    assert [r.x for r in m.select(ing.names_any([], ["hada"], F.col("h")).alias("x")).collect()] == [True, False]


def test_feeds(spark):
    feeds = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "url string, failed boolean")
    items = spark.createDataFrame([("a",), ("a",), ("b",)], "feed string")
    assert {(r.url, r.n) for r in ing.feed_results(feeds, items).collect()} == {("a", 2), ("b", -1), ("c", 0)}


def test_content_rows(spark):
    items = spark.createDataFrame([(1, 0, "t", "short", "u", "", "h"), (1, 1, "t", "x" * 10_001, "", "i", "h")], "source_id long, pos long, title string, content string, link string, image string, header_url string")
    enrichment = spark.createDataFrame([("u", "the body", "img")], "url string, body string, image_url string")
    a, b = ing.content_rows(items, enrichment).orderBy("pos").collect()
    assert (a.content, a.url, a.image, a.status) == ("the body", "u", "img", "OK") and (b.url, b.image, b.status) == ("h", "i", "TOO_LONG")


def test_nested(spark):
    kind = "struct<webPage:struct<items:array<struct<url:string>>>>"
    s = spark.createDataFrame([(1, ((([("a",)]),),)), (2, None), (3, None)], f"source_id long, enrichment {kind}")
    found = spark.createDataFrame([(1, [("b",)]), (2, [("c",)])], "source_id long, items array<struct<url:string>>")
    out = {r.source_id: r.enrichment and [x.url for x in r.enrichment.webPage["items"]] for r in ing.with_web_page(s, found).collect()}
    assert out == {1: ["a", "b"], 2: ["c"], 3: None}


def test_model_batch(spark):
    rows = [(i, "ab"[i % 2], "x" * (600 if i != 4 else 20)) for i in range(8)]
    df = spark.createDataFrame(rows, "content_id long, category string, content string")
    batch = ing.model_batch(df, df.where("content_id = 0").select("content_id"), size=4, budget=2000)
    assert [r.content_id for r in batch.orderBy("running").collect()] == [2, 1, 6]

    def ask(text):
        raise ValueError("no")

    assert {r.error for r in ing.answered(batch, ask).collect()} == {"ValueError: no"}
    good = '{"summary": "s", "headlines": ["h"], "keywords": ["k"], "score": 8}'
    out = ing.checked_replies(ing.answered(batch, lambda t: good)).first()
    assert out.valid and out.passed and out.headline == "h"
    bad = spark.createDataFrame([(1, '{"summary": "s", "headlines": ["h", "i"], "score": 9}', None), (2, "not json", None)], "content_id long, reply string, error string")
    assert not any(r.valid for r in ing.checked_replies(bad).collect())


def test_days(spark, tmp_path):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    path = str(tmp_path / "archive")
    ing.save_partition(users.where("user_id = 1"), path, "2026-01-01")
    ing.save_partition(users, path, "2026-01-02")
    ing.save_partition(users.where("user_id = 1"), path, "2026-01-01")
    got = spark.read.parquet(path)
    assert got.count() == 3
    assert [r.user_id for r in ing.missing_days(users, got.withColumn("day", F.col("day").cast("string")), "2026-01-01").collect()] == [2]
