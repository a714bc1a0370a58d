"""Ingestion: which sources to read, rows of new contents, batches for a language model, snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Limits in code points, and priorities of title keywords.
MAX_CONTENT = 10_000
TITLE_PRIORITY = (("breaking|urgent", 100), ("release|launch", 90), ("ai|llm", 85), ("security", 80), ("guide|tutorial", 75), ("interview", 70), ("review", 65))


def _has(name: str) -> Callable[[Column], Column]:
    return lambda v: F.contains(F.lower(v), F.lit(name.lower()))


def names_any(fields: list[Column], names: list[str], headers: Column | None = None) -> Column:
    """SRC06: true if any field, or any header's value, contains any of the names, case aside; no names match nothing."""
    columns = [F.lower(F.coalesce(f, F.lit(""))) for f in fields]
    tests = [F.contains(c, F.lit(n.lower())) for n in names for c in columns]
    if headers is not None:
        values = F.map_values(headers)
        tests += [F.coalesce(F.exists(values, _has(n)), F.lit(False)) for n in names]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def pending_sources(sources: DataFrame, match: Column, now: str, look_back: int = 90, stale: int = 30, most: int = 50) -> DataFrame:
    """SRC05/STM11: recent sources of known providers that were never processed, long ago, or without success; the newest first.

    sources: source_id, received, processed_at, outcome.
    """
    at = F.lit(now).cast("timestamp")
    recent = F.col("received") >= at - F.expr(f"INTERVAL {look_back} DAYS")
    due = F.col("processed_at").isNull() | (F.col("processed_at") < at - F.expr(f"INTERVAL {stale} DAYS")) | F.col("outcome").isin("partial", "failed")
    return sources.where(recent & match & due).orderBy(F.desc("received"), F.asc("source_id")).limit(most)


def feed_results(feeds: DataFrame, items: DataFrame) -> DataFrame:
    """SRC04: count of new items by feed: -1 where the feed failed, 0 where it gave none. feeds: url, failed."""
    n = items.groupBy(F.col("feed").alias("url")).agg(F.count("*").alias("n"))
    return feeds.join(n, "url", "left").select("url", F.when(F.col("failed"), -1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n"))


def content_rows(items: DataFrame, enrichment: DataFrame) -> DataFrame:
    """ING04/ING06: items (source_id, pos, title, content, link, image, header_url) with bodies of enrichment (url, body, image_url); too long contents are marked."""
    e = enrichment.select(F.col("url").alias("_u"), "body", F.col("image_url").alias("_image"))
    joined = items.join(e, F.col("link") == F.col("_u"), "left")
    content = F.coalesce(F.nullif("body", F.lit("")), "content")
    return joined.select(
        "source_id",
        "pos",
        "title",
        content.alias("content"),
        F.coalesce(F.nullif("link", F.lit("")), "header_url").alias("url"),
        F.coalesce(F.nullif("image", F.lit("")), "_image").alias("image"),
        F.when(F.length(content) > MAX_CONTENT, "TOO_LONG").otherwise("OK").alias("status"),
    )


def with_web_page(sources: DataFrame, found: DataFrame, key: str = "source_id") -> DataFrame:
    """SNK07/SET05: sources with the field enrichment.webPage.items set where found (key, items) has it: new items follow those there, and sibling fields stay."""
    f = found.select(F.col(key).alias("_k"), F.col("items").alias("_items"))
    joined = sources.join(f, F.col(key) == F.col("_k"), "left")
    items = F.concat(F.coalesce(F.col("enrichment.webPage.items"), F.array().cast(dict(found.dtypes)["items"])), F.col("_items"))
    kind = dict(sources.dtypes)["enrichment"]
    there = F.coalesce("enrichment", F.from_json(F.lit('{"webPage": {}}'), kind))
    page = F.coalesce(F.col("webPage"), F.from_json(F.lit("{}"), dict(sources.select("enrichment.*").dtypes)["webPage"]))
    with_page = joined.withColumn("_e", there).withColumn("webPage", F.col("_e.webPage")).withColumn("_e", F.col("_e").withField("webPage", page.withField("items", items)))
    return with_page.withColumn("enrichment", F.when(F.col("_k").isNotNull(), F.col("_e")).otherwise(F.col("enrichment"))).drop("_k", "_items", "_e", "webPage")


def model_batch(contents: DataFrame, done: DataFrame, size: int = 5, most: int = 10_000, least: int = 500, budget: int = 30_000) -> DataFrame:
    """AIB01/EXT07/FLT08: the next contents for a model: not done, of fit length, taken in turn from the categories, within a budget of length."""
    fit = contents.join(done.select("content_id").distinct(), "content_id", "left_anti").where(F.length("content").between(least, most))
    turn = F.row_number().over(Window.partitionBy("category").orderBy("content_id"))
    chosen = fit.withColumn("turn", turn).where(F.col("turn") <= size).orderBy("turn", "category", "content_id").limit(size)
    total = F.sum(F.length("content")).over(Window.orderBy("turn", "category", "content_id").rowsBetween(Window.unboundedPreceding, 0))  # ``size`` rows at most
    return chosen.withColumn("running", total).where(F.col("running") <= budget)


def answered(batch: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """AIB01/EXT17: replies of an injected function; an error gives a row with its text, and the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["content_id"], pdf["content"], strict=True):
                try:
                    rows.append((i, ask(text), None))
                except Exception as x:  # one item does not end the batch
                    rows.append((i, None, f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(rows, columns=["content_id", "reply", "error"])

    return batch.select("content_id", "content").mapInPandas(run, "content_id long, reply string, error string")


def checked_replies(replies: DataFrame, pass_score: int = 7) -> DataFrame:
    """AIB02/JSN01: replies as fields, valid with a summary, one headline and five keywords at most; passed by score."""
    r = F.from_json("reply", "summary string, headlines array<string>, keywords array<string>, score int")
    rows = replies.select("content_id", r.alias("r"), "error")
    valid = F.col("error").isNull() & (F.trim(F.coalesce(F.col("r.summary"), F.lit(""))) != "") & (F.size(F.coalesce(F.col("r.headlines"), F.array().cast("array<string>"))) == 1) & (F.size(F.coalesce(F.col("r.keywords"), F.array().cast("array<string>"))) <= 5)
    score = F.col("r.score").between(0, 10) & (F.col("r.score") >= pass_score)
    return rows.select("content_id", "r.summary", F.get(F.col("r.headlines"), F.lit(0)).alias("headline"), "r.keywords", "r.score", F.coalesce(valid, F.lit(False)).alias("valid"), F.coalesce(valid & score, F.lit(False)).alias("passed"))


def save_partition(rows: DataFrame, path: str, day: str) -> None:
    """SNK09/SNK10/REC18/STM12: a day's rows in place of what that day had; other days stay. Saving again changes nothing."""
    rows.withColumn("day", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def missing_days(users: DataFrame, archive: DataFrame, day: str) -> DataFrame:
    """REC18/EXT13: the users that have no archive of a day yet: what get-or-compute has to compute."""
    return users.join(archive.where(F.col("day") == day).select("user_id").distinct(), "user_id", "left_anti")


def without_markdown(contents: DataFrame, done: DataFrame, size: int = 5) -> DataFrame:
    """AIB03: the next contents, by id, that have no markdown yet."""
    return contents.join(done.select("content_id").distinct(), "content_id", "left_anti").orderBy("content_id").limit(size)


def fan_out(requests: DataFrame, key: str, list_col: str) -> DataFrame:
    """STM02: a row for each distinct token of a request, with how often it was asked for."""
    return requests.select(key, F.explode(list_col).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def dry_run(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """SNK12: what an insert would do, counted, with nothing written: created or kept."""
    there = table.select(*keys).distinct().withColumn("_there", F.lit(True))
    marked = rows.join(there, keys, "left").select(F.when(F.col("_there"), "kept").otherwise("created").alias("action"))
    return marked.groupBy("action").agg(F.count("*").alias("n"))
