"""Keyed joins, inserts, merges and set operations, all as new tables (Parquet has no UPDATE)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import sequential as seq


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """FLT11/AGG22/SET01: the first row of each key in a given order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def resolve(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """JON04: one-to-one lookup with a status for what is missing."""
    return rows.join(found, key, "left").withColumn("status", F.coalesce("status", F.lit("UNRESOLVED")))


def in_list_order(ids: DataFrame, list_col: str, rows: DataFrame, key: str) -> DataFrame:
    """JON05: rows of an id list with their place in it; ids without a row are left out."""
    places = ids.select(*[c for c in ids.columns if c != list_col], F.posexplode(list_col).alias("pos", key))
    return places.join(rows, key)


def weighted_lookup(rows: DataFrame, weights: DataFrame, requested: list[int]) -> DataFrame:
    """JON07: weight of (provider, category) summed over the requested categories, 0 if there is none."""
    total = weights.where(F.col("category_id").isin(requested)).groupBy("provider_id").agg(F.sum("weight").alias("bonus"))
    return rows.join(total, "provider_id", "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))


def referenced(rows: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """JON02: rows with has_references: the key is in any of the other tables (each with that one column)."""
    keys = reduce(DataFrame.union, [o.select(key) for o in others]).where(F.col(key).isNotNull()).distinct().withColumn("_there", F.lit(True))
    return rows.join(keys, key, "left").withColumn("has_references", F.coalesce("_there", F.lit(False))).drop("_there")


def grouped_count(rows: DataFrame, key: str, pattern: str, text: str = "content") -> DataFrame:
    """JON03: rows with the number of rows of the same key whose text is LIKE the pattern."""
    n = rows.where(F.col(text).like(pattern)).groupBy(key).agg(F.count("*").alias("existing_grouped"))
    return rows.join(n, key, "left").withColumn("existing_grouped", F.coalesce("existing_grouped", F.lit(0)))


def carry_forward(lines: DataFrame, key: str, order: str, header: Column) -> DataFrame:
    """JON11/WIN06: each line gets the nearest header at or above it."""
    above = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(header, ignorenulls=True).over(above))


def by_priority(rows: DataFrame, lookups: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """JON12: the value of the first lookup that has one. lookups: (column of rows, table (k, value, ord)); the first by ord counts."""
    out = rows
    for i, (column, table) in enumerate(lookups):
        first = table.where("value is not null").groupBy("k").agg(F.min_by("value", "ord").alias(f"_v{i}"))
        out = out.join(first.withColumnRenamed("k", f"_k{i}"), F.col(column) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    value = F.coalesce(*(F.col(f"_v{i}") for i in range(len(lookups))))
    level = reduce(lambda a, i: F.when(F.col(f"_v{i}").isNotNull(), i + 1).otherwise(a), reversed(range(len(lookups))), F.lit(None).cast("int"))
    return out.select(*rows.columns, value.alias("value"), level.cast("long").alias("level"))


def first_hint(text: Column, hints: list[tuple[str, str]], default: str | None = None) -> Column:
    """JON15/JON16: the name of the first hint that the text contains, case aside."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(default).cast("string")
    for hint, name in reversed(hints):
        out = F.when(F.contains(low, F.lit(hint.lower())), name).otherwise(out)
    return out


def paired_labels(items: DataFrame) -> DataFrame:
    """JON13: xTitle rows with the value of their xDescription."""
    titles = items.where(F.col("label").endswith("Title")).withColumn("other", F.regexp_replace("label", "Title$", "Description"))
    texts = items.select(F.col("doc").alias("_d"), F.col("label").alias("other"), F.col("value").alias("description"))
    return titles.join(texts, (F.col("doc") == F.col("_d")) & (titles.other == texts.other), "left").select("doc", "label", F.col("value").alias("title"), "description")


def footnotes(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """JON14: [n] of each document to its URL; the last definition counts."""
    last = notes.groupBy("doc", "n").agg(F.max_by("url", "pos").alias("url"))
    return refs.join(last, ["doc", "n"], "left")


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """SNK01/SNK02/FLT10: the rows to append: new by key, the first of each key."""
    return first_by(rows.join(table.select(*keys).distinct(), keys, "left_anti"), keys, *order)


def insert_not_exists(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """SNK04: rows for which no row of the table agrees in any one of the keys; null agrees with nothing."""
    return reduce(lambda r, k: r.join(table.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti"), keys, rows).select(*rows.columns)


def fill_missing(table: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """SNK05: column of table filled from found (key, value) where it is null."""
    return table.join(found.select(key, F.col("value").alias("_v")), key, "left").withColumn(column, F.coalesce(column, "_v")).drop("_v")


def get_or_create(names: DataFrame, table: DataFrame) -> DataFrame:
    """SNK06: id of each name: the lowest there is, else a new one above all, in the order of names.

    New names are numbered by a scan over slices of their order; no task holds all names, whatever they begin with.
    """
    known = table.groupBy("name").agg(F.min("id").alias("id"))
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    asked = names.select("name").distinct().join(known, "name", "left")
    fresh = asked.where("id is null").select("name", F.lit(1).alias("_all"))
    numbered = seq.positions(fresh, ["_all"], ["name"], "_n")
    created = numbered.join(F.broadcast(top)).select("name", (F.col("top") + F.col("_n") + 1).cast("long").alias("id"), F.lit(True).alias("created"))  # top is one row
    return asked.where("id is not null").select("name", F.col("id").cast("long").alias("id"), F.lit(False).alias("created")).union(created)


def merge_longer(table: DataFrame, new: DataFrame, key: str, cap: int, marker: str) -> DataFrame:
    """UPD01/SNK03/NUL01: a matched row takes the new content if its own is at most ``cap`` long and shorter, or holds the marker; an empty image is filled."""
    n = new.select(F.col(key).alias("_k"), F.col("content").alias("_content"), F.col("image").alias("_image"))
    both = table.join(n, F.col(key) == F.col("_k"), "left")
    marked = F.contains("content", F.lit(marker))
    take = F.col("_k").isNotNull() & (((F.length("content") <= cap) & (F.length("content") < F.length("_content"))) | marked)
    take = F.coalesce(take, F.lit(False))
    return both.select(
        key,
        F.when(take, F.col("_content")).otherwise(F.col("content")).alias("content"),
        F.when(take, F.coalesce(F.nullif("image", F.lit("")), "_image")).otherwise(F.col("image")).alias("image"),
        take.alias("updated"),
    )


def keep_first(rows: DataFrame, group: str, key: str, merged: DataFrame) -> DataFrame:
    """SNK08: rows after grouping: the first of each merged group with the merged text, the others of these groups gone."""
    keeper = rows.groupBy(group).agg(F.min(key).alias("_keep"))
    both = rows.join(keeper, group).join(merged.select(group, F.col("content").alias("_merged")), group, "left")
    return both.where(F.col("_merged").isNull() | (F.col(key) == F.col("_keep"))).select(key, group, F.coalesce("_merged", "content").alias("content"))


def union_first(left: DataFrame, right: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """SET01: both tables, one row for each key; the left one wins."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    return first_by(both, keys, F.asc("_side"), *order).drop("_side")


def keyed_merge(parts: list[DataFrame], key: str) -> DataFrame:
    """SET02: candidates of many sources: one row for each key, the first source's, with all signals. parts: key, published_at, source, score, confidence."""
    tagged = reduce(DataFrame.union, [p.select(key, "published_at", F.lit(i).alias("ord"), F.struct("source", "score", "confidence").alias("signal")) for i, p in enumerate(parts)])
    return tagged.groupBy(key).agg(F.min_by("published_at", "ord").alias("published_at"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "signal"))), lambda s: s["signal"]).alias("signals"))


def backfill_status(rows: DataFrame, existing: DataFrame, force: bool = False, fallback: tuple[str, ...] = ()) -> DataFrame:
    """BKF01/FLT12/FLT13/AGG20: status of each row: INVALID, EXISTS, DUPLICATE or CREATED. Rows: row_id, title, content, url.

    Fallback home URLs (compared without case and outer slashes) are never duplicates. row_id tells rows apart.
    """
    norm = F.regexp_replace(F.lower(F.trim("url")), "^/+|/+$", "")
    home = norm.isin(*fallback) if fallback else F.lit(False)
    blank = reduce(lambda a, b: a | b, (F.trim(F.coalesce(F.col(c), F.lit(""))) == "" for c in ("title", "content", "url")))
    urls = rows.select("row_id", "url", blank.alias("_blank"), home.alias("_home")).where("not _blank and not _home").select("row_id", "url")
    # ids and URLs only: a URL that very many rows have is split, by adaptive execution here and by slices there
    there = urls.join(existing.select("url"), "url", "left_semi").select(F.col("row_id").alias("_id"), F.lit(True).alias("_there"), F.lit(False).alias("_again"))
    again = seq.positions(urls, ["url"], ["row_id"]).where("pos > 0").select("row_id", F.lit(False), F.lit(True))
    flags = there.union(again).groupBy("_id").agg(F.bool_or("_there").alias("_there"), F.bool_or("_again").alias("_again"))
    joined = rows.join(flags, F.col("row_id") == F.col("_id"), "left").withColumn("_blank", blank).withColumn("_home", home)
    skip = F.lit(force)
    status = (
        F.when(F.col("_blank"), "INVALID")
        .when(~skip & ~F.col("_home") & F.coalesce("_there", F.lit(False)), "EXISTS")
        .when(~F.col("_home") & F.coalesce("_again", F.lit(False)), "DUPLICATE")
        .otherwise("CREATED")
    )
    return joined.withColumn("status", status).select(*rows.columns, "status")


def roll_up(rows: DataFrame, key: str) -> DataFrame:
    """AGG21: SUCCESS if any, else FAILED if any, else SKIPPED."""
    return rows.groupBy(key).agg(F.when(F.max(F.col("outcome") == "SUCCESS"), "SUCCESS").when(F.max(F.col("outcome") == "FAILED"), "FAILED").otherwise("SKIPPED").alias("outcome"))


def preload(users: DataFrame, archived: DataFrame, most: int) -> DataFrame:
    """REC19/TOP12/BKF02: the first users of the previous day without an archive yet."""
    first = users.orderBy("user_id").limit(most)
    return first.join(archived.select("user_id").distinct(), "user_id", "left_anti")


def trending(featured: DataFrame, cards: DataFrame, seen: DataFrame) -> DataFrame:
    """REC20/TOP10: for each user the first featured content not seen, else the first featured, else the first card. featured, cards: user_id, content_id, ord."""
    marked = featured.join(seen.withColumn("_s", F.lit(1)), ["user_id", "content_id"], "left").select("user_id", "content_id", F.when(F.col("_s").isNull(), 0).otherwise(1).alias("tier"), "ord")
    both = marked.union(cards.select("user_id", "content_id", F.lit(2), "ord"))
    return first_by(both, ["user_id"], F.asc("tier"), F.asc("ord"), F.asc("content_id")).select("user_id", "content_id", F.col("tier").cast("long").alias("tier"))
