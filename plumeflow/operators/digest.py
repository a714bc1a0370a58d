"""Grouping of short items of one issue into digests, within length limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sequential as seq

# Limits in code points, and the words of the rendering.
SHORT, MIN_SHORT, LEAST, MOST = 500, 3, 500, 10_000
INTRO = "입니다. 같은 뉴스레터에서 소개된 짧은 항목들을 한 번에 볼 수 있도록 묶었습니다."


def groupable(rows: DataFrame, group: str) -> DataFrame:
    """DIG02/DIG03: groups with enough short items and no referenced row."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.length("content") < SHORT).alias("n_short"), F.coalesce(F.bool_or("has_references"), F.lit(False)).alias("refs")).select(group, "n", "n_short", ((F.col("n_short") >= MIN_SHORT) & ~F.col("refs")).alias("groupable"))


def clean_description(text: Column) -> Column:
    """DIG08: without an 'Issue #n' prefix, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^\s*issue\s*:?\s*#?[0-9]+\s*[-:.]?\s*", ""), r"\s+", " "))


def issue_number(name: Column, text: Column) -> Column:
    """DIG07: the issue number in a text; none above 10000, and never for React Status."""
    n = F.regexp_extract(text, r"(?i)issue\s*:?\s*#?([0-9]{1,9})", 1).try_cast("long")
    return F.when((name != "React Status") & (n <= 10_000), n)


def group_title(name: Column, issue: Column, published: Column, existing: Column, number: Column, count: Column) -> Column:
    """DIG06: title of a digest, with suffixes for chunks and for later additions."""
    base = F.when(issue.isNotNull(), F.concat(name, F.lit(" Issue #"), issue.cast("string"), F.lit(" 모음"))).otherwise(
        F.concat(F.year(published).cast("string"), F.lit("년 "), F.month(published).cast("string"), F.lit("월 "), F.day(published).cast("string"), F.lit("일 "), name, F.lit(" 모음"))
    )
    part = F.concat(number.cast("string"), F.lit("/"), count.cast("string"))
    return F.when((count > 1) & (existing > 0), F.concat(base, F.lit(" (추가 "), part, F.lit(")"))).when(count > 1, F.concat(base, F.lit(" ("), part, F.lit(")"))).when(existing > 0, F.concat(base, F.lit(" (추가)"))).otherwise(base)


def numbered(rows: DataFrame, group: str, order: str, title: str, text: str) -> DataFrame:
    """AGG18: items of a group as one numbered text, in order."""
    items = F.sort_array(F.collect_list(F.struct(order, title, text)))
    lines = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x[title], F.lit("\n"), x[text]))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.array_join(lines, "\n\n").alias("merged"))


def _title(head: Column, number: Column, count: Column) -> Column:
    """A digest's title: that of group_title without issue number or earlier digests."""
    return group_title(head["name"], F.lit(None).cast("long"), head["published"], F.lit(0), number, count)


def _item_length() -> Column:
    """Length of an item's text in a digest, with what parts it from the next one, without its number."""
    description = F.when(F.col("content") == "", 0).otherwise(F.length("content") + 1)
    return (F.length(F.lit(". \n")) + F.length("title") + description + F.length(F.lit("Link: ")) + F.length("url") + F.length(F.lit("\n\n"))).cast("long")


def _digits(n: Column) -> Column:
    """Digits of the numbers 1 to n in all, for n below 10 ** 9: the greatest of the lines that the counts of each number of digits lie on."""
    return F.greatest(*(n * d - _before(d) for d in range(1, 10)))


def _before(d: int) -> int:
    """What a line of d digits a number counts too many for the shorter numbers."""
    return (10**d - 10) // 9 - (d - 1)


def _rendered(chunks: DataFrame, number: str, count: str) -> DataFrame:
    """Chunks (head, items) with title and text: introduction, and items with number, description and link."""
    lines = F.transform(
        "items",
        lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["title"], F.lit("\n"), F.when(x["content"] == "", "").otherwise(F.concat(x["content"], F.lit("\n"))), F.lit("Link: "), x["url"]),
    )
    title = _title(F.col("head"), F.col(number), F.col(count))
    return chunks.withColumn("title", title).withColumn("content", F.concat(title, F.lit(INTRO + "\n\n"), F.array_join(lines, "\n\n")))


def chunk_starts(items: DataFrame, most: int) -> DataFrame:
    """WIN05: (group_id, pos) where greedy filling begins a chunk: the first item that would make a chunk's text, titled as an only one, longer than ``most``.

    items: group_id, pos from 0, upto (running sum of item lengths) and own (length of this item), room (``most`` less title and introduction).
    Each item points to the one after the last that fits if a chunk began with it. The text's length grows with the
    items' lengths and the digits of their numbers; as the digits are the greatest of a few lines, the last item that fits is the least of as many range searches.
    """
    classes = range(1, len(str(max(most, 1))) + 1)
    lines = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(_before(d)).alias("less")) for d in classes)))
    by_class = items.select("group_id", "pos", "upto", "own", "room", lines.alias("c")).select("*", "c.*").drop("c")
    rows = by_class.select("group_id", "d", "pos", (F.col("upto") + F.col("pos") * F.col("d")).alias("value"))
    fits = F.col("room") + F.col("upto") - F.col("own") + (F.col("pos") - 1) * F.col("d") + F.col("less")
    found = seq.nearest(rows, by_class.select("group_id", "d", "pos", fits.alias("fits")), ["group_id", "d"], "value", "pos", F.col("fits"), "last")
    following = found.groupBy("group_id", "pos").agg(F.min(F.coalesce("last", F.lit(-1))).alias("last")).select("group_id", "pos", (F.greatest("last", "pos") + 1).alias("next"))
    return seq.reached(following, ["group_id"])


def digests(rows: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """DIG01/DIG04/DIG05: (group_id, chunk, n_items, title, content): digests of groups (group_id, ord, name, published, title, content, url).

    Groups with fewer than MIN_SHORT short items give none. A group whose text is within the limits is one digest; one that is too short
    gives none; else it is filled greedily, and chunks out of the limits or of fewer than MIN_SHORT items, titled by the number of all chunks, are dropped.
    Those that stay are numbered anew. Groups may have any length: only a chunk's items, which ``most`` bounds, stand together. (group_id, ord) tells rows apart.
    Null names, titles, contents and links are empty, a null day is that of 1970-01-01; null groups are one group.
    """
    text = F.coalesce("content", F.lit(""))
    head = F.struct(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("published", F.lit("1970-01-01").cast("date")).alias("published"))
    items = rows.select("group_id", "ord", F.coalesce("title", F.lit("")).alias("title"), F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")).alias("content"), F.coalesce("url", F.lit("")).alias("url"), (F.length(text) < SHORT).alias("short"), head.alias("head"))
    heads = items.groupBy("group_id").agg(F.min_by("head", "ord").alias("head"), F.count_if("short").alias("n_short"), F.sum(_item_length()).alias("length"), F.count("*").alias("n"))
    room = F.lit(most) - F.length(_title(F.col("head"), F.lit(1), F.lit(1))) - F.length(F.lit(INTRO))
    heads = seq.kept(heads.where(F.col("n_short") >= MIN_SHORT).select("group_id", "head", room.alias("room"), (F.col("length") + _digits(F.col("n"))).alias("whole")))
    items = items.drop("head", "short")
    listed = F.array_sort(F.collect_list(F.struct("ord", "title", "content", "url"))).alias("items")

    fitting = items.join(heads.where("whole <= room"), "group_id").groupBy("group_id", "head").agg(listed)
    one = _rendered(fitting.select("*", F.lit(1).cast("long").alias("chunk"), F.lit(1).cast("long").alias("count")), "chunk", "count")
    columns = ["group_id", "chunk", F.size("items").cast("long").alias("n_items"), "title", "content"]
    out = one.where(F.length("content") >= least).select(*columns)

    long = items.join(heads.where("whole > room"), "group_id")
    if heads.where("whole > room").isEmpty():
        return out
    length = _item_length()
    scanned = seq.running(long.withColumn("own", length), ["group_id"], ["ord"], {"upto": ("sum", F.col("own")), "pos": ("sum", F.lit(1).cast("long"))})
    scanned = seq.kept(scanned.withColumn("pos", F.col("pos") - 1))
    starts = chunk_starts(scanned, most).withColumn("first", F.lit(1).cast("long"))
    numbered = seq.running(scanned.join(starts, ["group_id", "pos"], "left"), ["group_id"], ["pos"], {"number": ("sum", F.coalesce("first", F.lit(0).cast("long")))})
    chunks = seq.kept(numbered.groupBy("group_id", "number").agg(F.first("head").alias("head"), listed))
    counts = chunks.groupBy("group_id").agg(F.count("*").alias("of_all"))
    drafts = _rendered(chunks.join(counts, "group_id"), "number", "of_all")
    good = drafts.where((F.size("items") >= MIN_SHORT) & F.length("content").between(least, most)).select("group_id", "number", "head", "items")
    renumbered = seq.kept(seq.running(good, ["group_id"], ["number"], {"chunk": ("sum", F.lit(1).cast("long"))}))
    left = renumbered.groupBy("group_id").agg(F.count("*").alias("count"))
    return out.unionByName(_rendered(renumbered.join(left, "group_id"), "chunk", "count").select(*columns))


def library_rows(items: DataFrame, key: str = "doc") -> DataFrame:
    """DIG09: library items of a document replaced by one at the first one's place; its link is the issue link, else the first. items: key, pos, is_library, title, link, issue_link."""
    libs = items.where("is_library").groupBy(key).agg(F.min("pos").alias("pos"), F.count("*").alias("n_items"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]), ", ").alias("title"), F.coalesce(F.first("issue_link", ignorenulls=True), F.min_by("link", "pos")).alias("link"))
    rest = items.where("not is_library").select(key, "pos", F.lit(1).cast("long").alias("n_items"), "title", "link")
    return rest.union(libs.select(key, "pos", "n_items", "title", "link"))


def library_week(text: Column) -> tuple[Column, Column]:
    """DIG10/DAT02: (ISO week-based year, week) of the first date in a text, of several formats; ordinal days too."""
    plain = F.regexp_replace(text, r"(?i)\b([0-9]{1,2})(st|nd|rd|th)\b", "$1")
    month = "(January|February|March|April|May|June|July|August|September|October|November|December)"
    found = F.coalesce(
        F.regexp_extract(plain, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).try_cast("date"),
        F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(plain, rf"({month} [0-9]{{1,2}}, [0-9]{{4}})", 1), F.lit("")), F.lit("MMMM d, yyyy"))),
        F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(plain, rf"([0-9]{{1,2}} {month} [0-9]{{4}})", 1), F.lit("")), F.lit("d MMMM yyyy"))),
        F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(plain, r"([0-9]{4}/[0-9]{2}/[0-9]{2})", 1), F.lit("")), F.lit("yyyy/MM/dd"))),
        F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(plain, r"([0-9]{4}\.[0-9]{2}\.[0-9]{2})", 1), F.lit("")), F.lit("yyyy.MM.dd"))),
    )
    return F.extract(F.lit("YEAROFWEEK"), found), F.extract(F.lit("WEEK"), found)


