"""Sequential algorithms over groups of any length, without a task that holds a whole group.

``running`` is a prefix scan: rows are dealt by range over group and order, so that a long group lies in several slices;
each slice is scanned by itself, and what the slices before it add up to comes from a table with fewer rows than there are slices.
``nearest`` finds the last row at or before (or the first at or after) a value, as such a scan over rows and
probes together. ``reached`` follows pointers from row to row by doubling them: with n jumps it takes log2 n rounds.

Every step lies in the folder of ``spark.checkpoint.dir``, so that slices stay as they were dealt when tasks are run again.

Defined results.  Group columns may be null (nulls are one group). Null values do not count in a scan. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import shared_root

#: Rounds of doubling: enough for 2 ** 60 jumps.
MOST_ROUNDS = 60


def kept(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def running(rows: DataFrame, group: list[str], order: list[str], columns: dict[str, tuple[str, Column]], slices: int | None = None) -> DataFrame:
    """rows with columns name -> (kind, value): sum, max or min of the values from the group's first row to this one, in order.

    For sums, order has to tell all rows of a group apart. No column of rows may begin with ``_s_``.
    """
    n = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = {"sum": F.sum, "max": F.max, "min": F.min}
    values = {name: f"_s_{i}" for i, name in enumerate(columns)}
    dealt = rows.select("*", F.struct(*group).alias("_s_group"), *(columns[name][1].alias(v) for name, v in values.items()))
    dealt = kept(dealt.repartitionByRange(n, *group, *order).withColumn("_s_slice", F.spark_partition_id()))
    within = Window.partitionBy("_s_slice", "_s_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *(of[kind](values[name]).over(within).alias(f"{values[name]}_in") for name, (kind, _) in columns.items()))
    totals = dealt.groupBy("_s_group", "_s_slice").agg(*(of[kind](values[name]).alias(values[name]) for name, (kind, _) in columns.items()))
    before = Window.partitionBy("_s_group").orderBy("_s_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        F.col("_s_group").alias("_s_of"),
        F.col("_s_slice").alias("_s_at"),
        F.count("*").over(before).alias("_s_earlier"),
        *(of[kind](values[name]).over(before).alias(f"{values[name]}_out") for name, (kind, _) in columns.items()),
    ).where("_s_earlier > 0")
    # each border between two slices parts one group at most: carry has fewer rows than there are slices
    joined = local.join(F.broadcast(carry), (F.col("_s_slice") == F.col("_s_at")) & (F.col("_s_group") == F.col("_s_of")), "left")

    def whole(name: str, kind: str) -> Column:
        a, b = F.col(f"{values[name]}_in"), F.col(f"{values[name]}_out")
        if kind == "sum":
            return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
        # by hand, since greatest and least do not take structs
        first = a >= b if kind == "max" else a <= b
        return F.when(a.isNull(), b).when(b.isNull(), a).when(first, a).otherwise(b)

    return joined.select(*(c for c in rows.columns), *(whole(name, kind).alias(name) for name, (kind, _) in columns.items()))


def positions(rows: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """rows with their place in the group, from 0."""
    return running(rows, group, order, {name: ("sum", F.lit(1).cast("long"))}).withColumn(name, F.col(name) - 1)


def nearest(rows: DataFrame, probes: DataFrame, group: list[str], value: str, carry: str, at: Column, name: str, after: bool = False) -> DataFrame:
    """probes with the column ``name``: carry of the group's last row whose value is ``at`` or less, or, with after, of the first whose value is ``at`` or more.

    value, at and carry are numbers; of rows with one value counts that of the largest carry, or, with after, the smallest. Null if there is no such row.
    """
    sign = -1 if after else 1
    shape = F.struct(*(F.col(c) for c in probes.columns))
    a = rows.select(*group, (F.col(value) * sign).alias("_at"), F.lit(0).alias("_probe"), (F.col(carry) * sign).alias("_carry"))
    b = probes.select(*group, (at * sign).alias("_at"), F.lit(1).alias("_probe"), shape.alias("_row"))
    both = a.unionByName(b, allowMissingColumns=True)
    found = F.when(F.col("_probe") == 0, F.struct("_at", "_carry"))
    out = running(both, group, ["_at", "_probe"], {"_found": ("max", found)}).where("_probe = 1")
    return out.select("_row.*", (F.col("_found._carry") * sign).alias(name))


def reached(links: DataFrame, group: list[str], start: int = 0) -> DataFrame:
    """(group, pos) of the rows that the pointers lead to from the row at ``start`` of each group, which is one of them.

    links has the group's columns, pos (once in a group) and next, which is larger than pos, or null at an end.
    """
    links = links.select(F.struct(*group).alias("_g"), "pos", "next")
    jump = kept(links.where("next is not null"))
    marks = kept(links.where(F.col("pos") == start).select("_g", "pos"))
    for _ in range(MOST_ROUNDS):
        new = kept(marks.join(jump, ["_g", "pos"]).select("_g", F.col("next").alias("pos")))
        if new.isEmpty():
            return marks.select("_g.*", "pos")
        marks = marks.union(new)
        far = jump.select("_g", F.col("pos").alias("next"), F.col("next").alias("_far"))
        jump = kept(jump.join(far, ["_g", "next"]).select("_g", "pos", F.col("_far").alias("next")))
    raise RuntimeError("pointers do not end")


def bans(events: DataFrame, key: str, most: int, find_s: int, ban_s: int, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """STM06: (key, from_ts, until_ts): a ban begins with the event that makes ``most`` within less than ``find_s`` seconds; events during a ban do not count.

    From a fresh start at place p the next ban comes with the first event from p + most - 1 on that has its ``most`` - 1
    predecessors near enough, and the next fresh start is the first event at its end or later: a pointer for each event.
    """
    rows = positions(events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), order).where("_t is not null"), [key], ["_t", order])
    rows = kept(rows.select(key, "_t", "pos"))
    earlier = rows.select(F.struct(key).alias("_g"), (F.col("pos") + (most - 1)).alias("pos"), F.col("_t").alias("_t0"))
    near = rows.withColumn("_g", F.struct(key)).join(earlier, ["_g", "pos"]).where(F.col("_t") - F.col("_t0") < find_s * 1_000_000).select(key, "pos", "_t")
    marked = nearest(near, rows, [key], "pos", "_t", F.col("pos") + (most - 1), "_ban", after=True)
    until = F.col("_ban") + ban_s * 1_000_000
    links = kept(nearest(rows, marked.where("_ban is not null"), [key], "_t", "pos", until, "next", after=True))
    fresh = reached(links, [key]).select(F.struct(key).alias("_g"), "pos")
    found = links.withColumn("_g", F.struct(key)).join(fresh, ["_g", "pos"], "left_semi")
    return found.select(key, F.timestamp_micros("_ban").alias("from_ts"), F.timestamp_micros(until).alias("until_ts"))


def spaced(calls: DataFrame, host: str, arrival: str, order: str, spacing: int) -> DataFrame:
    """STM09: calls with start and wait: those of one host begin in order of arrival, ``spacing`` apart at least.

    start = spacing * rank + the largest arrival - spacing * rank so far, which is a running maximum.
    """
    ranked = positions(calls, [host], [arrival, order], "_rank")
    slack = F.col(arrival) - F.col("_rank") * spacing
    out = running(ranked, [host], [arrival, order], {"_slack": ("max", slack)})
    start = F.col("_slack") + F.col("_rank") * spacing
    return out.select(*calls.columns, start.alias("start"), (start - F.col(arrival)).alias("wait"))


def flights(calls: DataFrame, key: str, at: str, took: str, order: str) -> DataFrame:
    """STM12: calls with leader and shared: a call while another of its key is under way gets that one's answer; else it is computed and takes ``took``.

    A leader points to the first call at its end or later; the calls that the first one leads to are leaders, and each call follows the last leader before it.
    leader is the place of the computed call among the key's calls, ends its end. Times are whole numbers.
    """
    rows = kept(positions(calls, [key], [at, order]))
    links = nearest(rows.select(key, at, "pos"), rows.select(key, "pos", (F.col(at) + F.greatest(F.col(took), F.lit(1))).alias("_end")), [key], at, "pos", F.col("_end"), "next", after=True)
    leads = reached(links, [key]).select(F.struct(key).alias("_g"), "pos", F.lit(True).alias("_leads"))
    marked = rows.withColumn("_g", F.struct(key)).join(leads, ["_g", "pos"], "left").drop("_g")
    lead = F.when(F.col("_leads"), F.struct(F.col("pos").alias("pos"), (F.col(at) + F.greatest(F.col(took), F.lit(1))).alias("ends")))
    out = running(marked, [key], [at, order], {"_lead": ("max", lead)})
    return out.select(*calls.columns, F.col("_lead.pos").alias("leader"), F.col("_lead.ends").alias("ends"), F.col("_leads").isNull().alias("shared"))


def filled(rows: DataFrame, group: str, order: str, weight: str, most: int) -> DataFrame:
    """WIN05: rows with bin and load: a bin takes the next row as long as its load stays within ``most``; a row that is too heavy alone has a bin of its own.

    weight is a whole number of 0 or more. Each row points to the one after the last that fits if a bin began with it.
    """
    scanned = kept(running(rows, [group], [order], {"_upto": ("sum", F.col(weight)), "pos": ("sum", F.lit(1).cast("long"))}).withColumn("pos", F.col("pos") - 1))
    probes = scanned.select(group, "pos", (F.lit(most) + F.col("_upto") - F.col(weight)).alias("_room"))
    links = nearest(scanned, probes, [group], "_upto", "pos", F.col("_room"), "_last").select(group, "pos", (F.greatest(F.coalesce("_last", F.lit(-1)), "pos") + 1).alias("next"))
    starts = reached(links, [group]).select(F.struct(group).alias("_g"), "pos", F.lit(True).alias("_first"))
    marked = scanned.withColumn("_g", F.struct(group)).join(starts, ["_g", "pos"], "left").drop("_g")
    one, before = F.coalesce(F.col("_first").cast("long"), F.lit(0).cast("long")), F.when(F.col("_first"), F.col("_upto") - F.col(weight))
    out = running(marked, [group], ["pos"], {"bin": ("sum", one), "_before": ("max", before)})
    return out.select(*rows.columns, "bin", (F.col("_upto") - F.col("_before")).alias("load"))
