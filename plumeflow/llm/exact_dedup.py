"""Exact deduplication by progressive refinement, in DataFrame functions only.

Texts are equal when they are the same without blanks (``[\\x20\\x09-\\x0D]``).  They are told apart in steps of growing cost:

1. by length without blanks: a length that only one row has is settled;
2. by a hash of the first ``prefix`` characters, within a length: so is a pair of length and prefix that only one row has;
3. by SHA-256 of the whole text, for rows of the pairs that are left.

Both keys of steps 1 and 2 come from one scan that counts them before anything is shuffled; what is left is a
table of keys with no texts in it.  Texts are never shuffled.  In step 3 the keys go to the texts as long as they
are few (counted, 16 MB at most); beyond that the digest is taken where a text lies and 60 bytes of each row go to
the keys.  The best row and the size of a group of copies are found in each task before the shuffle; no list of members stands in one task.
A group that holds a third of all rows is one row on the side of the groups, and its members' side of the join is split by adaptive execution.

Of equal texts stays the row with the most code points, then the smallest id, null ids last. Of rows that agree in
all three, exactly one stays.

Defined results.  A null text counts as empty; null, empty and blank texts are equal.  Null ids are members like
others; a group of null ids only has a null keep_id.  No rows give no rows.  Only the two named columns are read by
``groups``; ``deduplicated`` returns all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import drop, is_small, settle, unused

#: Fixed value: what does not count in a comparison.
BLANK = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def _keyed(docs: DataFrame, id_col: str, text_col: str, prefix: int, *more: Column) -> DataFrame:
    """Rows with length and prefix hash of the text without blanks, which is there for further columns as ``bare``."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("bare"))
    return rows.select("id", "n_chars", F.length("bare").alias("n"), F.xxhash64(F.substring("bare", 1, prefix)).alias("p"), *more)


def _twins(docs: DataFrame, id_col: str, text_col: str, prefix: int) -> DataFrame:
    """Pairs (n, p) of length and prefix hash that more than one row has, settled."""
    pairs = settle(_keyed(docs, id_col, text_col, prefix).groupBy("n", "p").agg(F.count("*").alias("rows")), "pairs")
    lengths = pairs.groupBy("n").agg(F.sum("rows").alias("of_length")).where("of_length > 1").select("n")
    out = settle(pairs.where("rows > 1").join(lengths, "n", "left_semi").select("n", "p"), "twins")
    drop(pairs)
    return out


def _digested(docs: DataFrame, id_col: str, text_col: str, prefix: int, every: bool) -> DataFrame:
    """(id, n_chars, n, sha, twin) of each row; sha is null where the steps before have settled a row, unless every is set."""
    twins = _twins(docs, id_col, text_col, prefix).withColumn("twin", F.lit(True))
    if is_small(twins):
        rows = _keyed(docs, id_col, text_col, prefix, F.col("bare")).join(F.broadcast(twins), ["n", "p"], "left")
        return rows.select("id", "n_chars", "n", F.when(F.col("twin") | F.lit(every), F.sha2("bare", 256)).alias("sha"), F.coalesce("twin", F.lit(False)).alias("twin"))
    rows = _keyed(docs, id_col, text_col, prefix, F.sha2("bare", 256).alias("sha")).join(twins, ["n", "p"], "left")
    return rows.select("id", "n_chars", "n", "sha", F.coalesce("twin", F.lit(False)).alias("twin"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, every_digest: bool = False) -> DataFrame:
    """(id, keep_id, group_size, kept, sha) for each row of docs.

    sha is the SHA-256 of the text without blanks; null for rows that length or prefix tells apart from all
    others, as nothing has read them in full, unless every_digest is set.
    """
    # the place of a row is written with it, so that it stays the same whatever is run again
    rows = settle(_digested(docs, id_col, text_col, prefix, every_digest).withColumn("place", F.monotonically_increasing_id()), "digests")
    rank = F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("place").alias("place"))
    found = settle(rows.where("twin").groupBy("sha", "n").agg(F.min(rank).alias("keep"), F.count("*").alias("size")).where("size > 1"), "groups")
    judged = rows.where("twin").join(found, ["sha", "n"], "left")
    alone = F.col("size").isNull()
    judged = judged.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("place") == F.col("keep.place"))).alias("kept"),
        "sha",
    )
    settled = rows.where("not twin").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return judged.unionByName(settled)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256) -> DataFrame:
    """docs without the rows that a better equal text stands for; all columns stay as they are.

    Rows of texts without an equal pass by. The others are compared by digest within their tasks, and only the best one of
    each task and group is shuffled, with its columns.
    """
    twins = _twins(docs, id_col, text_col, prefix)
    names = [unused(docs, c) for c in ("_length", "_prefix", "_digest", "_twin")]
    n, p, sha, twin = names
    bare = normalised(F.col(text_col))
    marked = docs.withColumns({n: F.length(bare), p: F.xxhash64(F.substring(bare, 1, prefix))})
    keys = twins.select(F.col("n").alias(n), F.col("p").alias(p), F.lit(True).alias(twin))
    marked = marked.join(F.broadcast(keys) if is_small(twins) else keys, [n, p], "left")
    apart = marked.where(F.col(twin).isNull()).select(*docs.columns)
    whole = F.struct(*(F.col(c) for c in docs.columns))
    rank = F.struct(-F.length(F.coalesce(F.col(text_col), F.lit(""))), F.col(id_col).isNull(), F.col(id_col))
    best = marked.where(F.col(twin)).groupBy(F.sha2(bare, 256).alias(sha), n).agg(F.min_by(whole, rank).alias("row"))
    return apart.unionByName(best.select("row.*"))
