"""Event analytics: filters, grouped counts, rankings, paging and reports."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rolling_window(day: Column, end: str, days: int) -> Column:
    """FLT05: the days end - days + 1 .. end, both inclusive; the bounds are literals, so they reach the scan."""
    last = date.fromisoformat(end)
    return day.between(F.lit(last - timedelta(days=days - 1)), F.lit(last))


def not_set(x: Column) -> Column:
    """FLT03: true unless x is '(not set)'; a null is kept."""
    return ~x.eqNullSafe(F.lit("(not set)"))


def count_by(events: DataFrame, *dims: str) -> DataFrame:
    """AGG01: events by dimensions."""
    return events.groupBy(*dims).agg(F.count("*").alias("event_count"))


def top_k(rows: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """TOP01/TOP08: the first k rows by an order that ends in a unique key; None: no limit; below 0 counts as 0."""
    ordered = rows.orderBy(*order)
    return ordered if k is None else ordered.limit(max(k, 0))


def fixed_list(counts: DataFrame, names: list[str], key: str = "event_name") -> DataFrame:
    """AGG06: a count for each of a fixed list of names, 0 where there is none, with its place."""
    listed = counts.sparkSession.createDataFrame(list(enumerate(names)), f"ord long, {key} string")
    return listed.join(counts, key, "left").select("ord", key, F.coalesce("event_count", F.lit(0)).alias("event_count"))


def user_stats(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """AGG02: users, sessions and views by user type. A session ends after a gap; this definition is ours."""
    per_user = Window.partitionBy("user_type", "user_id").orderBy("ts", "event_id")
    start = F.coalesce(F.col("ts") - F.lag("ts").over(per_user) > F.expr(f"INTERVAL {gap_minutes} MINUTES"), F.lit(True))
    return events.withColumn("_start", start).groupBy("user_type").agg(F.countDistinct("user_id").alias("total_users"), F.count_if("_start").alias("sessions"), F.count_if(F.col("event_name") == "view").alias("page_views"))


def user_totals(stats: DataFrame) -> DataFrame:
    """AGG03: one row over user types: sessions and views of all rows, users by type, total of the two types."""
    new, back = (F.coalesce(F.max(F.when(F.col("user_type") == k, F.col("total_users"))), F.lit(0)) for k in ("new", "returning"))
    return stats.agg(new.alias("new_users"), back.alias("returning_users"), (new + back).alias("total_users"), F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"), F.coalesce(F.sum("page_views"), F.lit(0)).alias("page_views"))


def percentage(part: Column, whole: Column) -> Column:
    """AGG05: part / whole * 100, 0 for an empty whole."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def nested_report(events: DataFrame, names: list[str], k: int) -> DataFrame:
    """AGG07: for each event its total and its top-k objects as 'id=count' in order."""
    counts = events.where(F.col("event_name").isin(names)).groupBy("event_name", "object_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("event_name").orderBy(F.desc("n"), F.asc("object_id")))
    ranked = counts.withColumn("_rank", rank)
    top = F.sort_array(F.collect_list(F.when(F.col("_rank") <= k, F.struct("_rank", F.concat_ws("=", "object_id", F.col("n").cast("string")).alias("x")))))
    return ranked.groupBy("event_name").agg(F.sum("n").alias("total"), F.array_join(F.transform(top, lambda s: s["x"]), ",").alias("top"))


def click_ranking(events: DataFrame, titles: DataFrame, resolution: DataFrame, end: str, days: int = 365, k: int = 20, preview: str = "Preview Title") -> DataFrame:
    """RNK01: top-k clicked objects of a rolling window; previews go after the limit; the rest are resolved and ranked.

    titles: object_id, title. resolution: object_id, resolved_id.
    """
    clicks = events.where((F.col("event_name") == "click") & rolling_window(F.col("event_date"), end, days))
    top = top_k(clicks.groupBy("object_id").agg(F.count("*").alias("clicks")), k, F.desc("clicks"), F.asc("object_id"))
    named = top.join(titles, "object_id", "left").where(~F.coalesce(F.col("title").startswith(preview), F.lit(False)))
    found = named.join(resolution, "object_id", "left")
    rank = F.row_number().over(Window.orderBy(F.desc("clicks"), F.asc("object_id")))  # k rows at most
    return found.select(rank.cast("long").alias("rank"), "object_id", "title", "clicks", F.when(F.col("resolved_id").isNotNull(), "RESOLVED").otherwise("UNRESOLVED").alias("status"), "resolved_id")


def keyset_page(rows: DataFrame, size: int, offset: int = 0, key: str = "content_id") -> DataFrame:
    """TOP05/TOP07: a page of ids in descending order; more than ``size`` left gives next_offset, else null."""
    if size < 1 or offset < 0:
        raise ValueError("size must be 1 or more, offset 0 or more")
    ahead = (rows.where(F.col(key) < offset) if offset else rows).orderBy(F.desc(key)).limit(size + 1)
    n = F.count("*").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(key)))  # size + 1 rows at most
    last = F.min(F.when(F.col("_place") <= size, F.col(key))).over(Window.partitionBy())
    marked = ahead.withColumn("_place", place).withColumn("_n", n).withColumn("_last", last)
    return marked.where(F.col("_place") <= size).select(*rows.columns, (F.col("_n") > size).alias("has_more"), F.when(F.col("_n") > size, F.col("_last")).alias("next_offset"))


def published_page(rows: DataFrame, size: int, cursor: tuple[str, int] | None = None, descending: bool = True) -> DataFrame:
    """TOP06: a page by (published_at, id) in either direction, after the cursor row's values."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    key = F.struct("published_at", "content_id")
    if cursor is not None:
        at = F.struct(F.lit(cursor[0]).cast("date").alias("published_at"), F.lit(cursor[1]).cast("long").alias("content_id"))
        rows = rows.where(key < at if descending else key > at)
    order = (F.desc, F.asc)[not descending]
    return rows.orderBy(order("published_at"), order("content_id")).limit(size)


def source_stats(rows: DataFrame) -> DataFrame:
    """AGG08: rows and latest day by source."""
    return rows.groupBy("newsletter_name").agg(F.count("*").alias("n"), F.max("published_at").alias("latest"))


def feed_stats(rows: DataFrame) -> DataFrame:
    """AGG09: conditional counts and truncated percentage by source."""
    done = F.count_if("ai_processed")
    return rows.groupBy("source").agg(
        F.count("*").alias("total"),
        done.alias("processed"),
        F.count_if(~F.col("ai_processed") & F.col("processed")).alias("pending"),
        F.count_if("has_error").alias("errors"),
        F.coalesce((done * 100 / F.count("*")).cast("int"), F.lit(0)).cast("long").alias("percent"),
    )


def counter_top(rows: DataFrame, value: str, k: int, place: str = "line_no") -> DataFrame:
    """AGG11: most frequent values; ties by first appearance."""
    counted = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    return top_k(counted, k, F.desc("n"), F.asc("first")).select(value, "n", "first")


def latency_stats(rows: DataFrame, value: str, *dims: str) -> DataFrame:
    """AGG12: count, average, extremes and nearest-rank percentiles."""
    at = {f"p{p}": F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})") for p in (50, 95, 99)}
    return rows.groupBy(*dims).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), *(c.alias(k) for k, c in at.items()), F.max(value).alias("most"))


def period_report(events: DataFrame, end: str, days: int) -> DataFrame:
    """RPT01/RPT02, WIN10/WIN11: one pass over a period and the one before it: events by kind, users, averages, change."""
    now = rolling_window(F.col("event_date"), end, days)
    before = rolling_window(F.col("event_date"), (date.fromisoformat(end) - timedelta(days=days)).isoformat(), days)
    seen = events.where(now | before)

    def kind(name: str, when: Column) -> Column:
        return F.count_if((F.col("event_name") == name) & when)

    kinds = ("click", "view", "signup", "purchase", "error")
    base = seen.agg(
        *(kind(k, now).alias(f"{k}s") for k in kinds),
        F.count_if(now).alias("events"),
        F.count_if(before).alias("events_before"),
        F.count_distinct(F.when(now, F.col("user_id"))).alias("users"),
        F.count_distinct(F.when(before, F.col("user_id"))).alias("users_before"),
        F.count_distinct(F.when(now & (F.col("user_type") == "returning"), F.col("user_id"))).alias("returning_users"),
    )
    return base.withColumn("per_day", F.col("events") / float(days)).withColumn("returning_rate", percentage(F.col("returning_users"), F.col("users_before")))


def short_number(x: Column) -> Column:
    """RPT03: 950, 1.2K, 3.4M."""
    return F.when(x >= 1_000_000, F.format_string("%.1fM", x / 1e6)).when(x >= 1000, F.format_string("%.1fK", x / 1e3)).otherwise(x.cast("string"))


def report_lines(ranking: DataFrame, empty: str = "no data") -> DataFrame:
    """RPT03: the rows of a ranking as one text, in order; ``empty`` if there are none."""
    line = F.format_string("%d. %s (%s)", "rank", "object_id", short_number(F.col("clicks")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n")
    return ranking.agg(F.count("*").alias("n"), F.when(F.count("*") == 0, F.lit(empty)).otherwise(text).alias("report"))


def budget_cut(rows: DataFrame, size: Column, budget: int, *order: Column, by: str | None = None) -> DataFrame:
    """FLT08, WIN04: rows in order while the running total stays within the budget; the first overflow stops.

    Sizes are 1 at least. Without ``by`` all rows are one list, of which the first ``budget`` rows can be within the
    budget; only these are brought together.
    """
    if by is None:
        rows = rows.orderBy(*order).limit(budget + 1)
    window = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_total", F.sum(size).over(window)).where(F.col("_total") <= budget).withColumnRenamed("_total", "running")


def chained(rows: DataFrame, conditions: list[Column]) -> DataFrame:
    """UDX06: rows that meet all of a list of conditions; an empty list lets all through."""
    for condition in conditions:
        rows = rows.where(condition)
    return rows
