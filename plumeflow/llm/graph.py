"""Connected components of an edge table, by alternating star contraction.

Edges never leave the executors: each round is two grouped minima and two
joins, and its result is written in the shared folder; one count comes to the driver.  A round keeps
components as they are and shortens paths, so that the number of rounds is
logarithmic in the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, settle

MAX_ROUNDS = 60
#: Edges up to which they are dealt over as few partitions as hold EACH of them; more are dealt as the session says.
FEW, EACH = 400_000, 20_000


def _dealt(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.repartition(-(-n // EACH), key) if 0 < n <= FEW else rows


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = _dealt(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "a", n)
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    # here a > b in each row: b is the smaller neighbour
    edges = _dealt(edges, "a", n)
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _all_stars(edges: DataFrame, n: int) -> bool:
    """True if each id has one smaller neighbour at most, and none if it has larger ones."""
    ends = _dealt(edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1))), "v", n)
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of one orderable type -> (id, component), component being the smallest id reachable.

    edges should be a settled table: it is read twice in the first round. Null
    ends, loops and repeated edges are ignored. Ids without an edge to another
    id are not listed.
    """
    now = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    n = now.count()
    for _ in range(MAX_ROUNDS):
        before, now = now, settle(_small_star(_large_star(now, n), n), "stars")
        drop(before)
        if _all_stars(now, n):
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    raise RuntimeError("components did not settle")
