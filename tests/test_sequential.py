"""Sequential operators against plain loops, over groups that lie in many slices."""

import random

import pytest
from pyspark.sql import functions as F

from plumeflow.operators import digest as dg
from plumeflow.operators import schedules as sch
from plumeflow.operators import sequential as seq

SLICES = [1, 7]


@pytest.fixture(autouse=True, params=SLICES)
def slices(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def hot(seed, n=400, groups=5):
    """(group, id, number): one group has most rows, one is null."""
    r = random.Random(seed)
    return [(None if i % 41 == 0 else 0 if i % 4 else r.randint(1, groups), i, r.randint(0, 60)) for i in range(n)]


def by_group(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return out


def test_running(spark):
    rows = hot(1)
    df = spark.createDataFrame(rows, "g int, i int, v int")
    out = seq.running(df, ["g"], ["i"], {"total": ("sum", F.col("v")), "most": ("max", F.col("v")), "least": ("min", F.when(F.col("v") > 30, F.col("v")))}).collect()
    got = {r.i: (r.total, r.most, r.least) for r in out}
    assert len(out) == len(rows)
    for members in by_group(rows).values():
        for k, (_, i, _) in enumerate(members):
            seen = [v for _, _, v in members[: k + 1]]
            assert got[i] == (sum(seen), max(seen), min((v for v in seen if v > 30), default=None))


@pytest.mark.parametrize("after", [False, True])
def test_nearest(spark, after):
    rows, probes = hot(2), hot(3, 200, 8)
    a = spark.createDataFrame(rows, "g int, id int, at int")
    b = spark.createDataFrame(probes, "g int, p int, want int")
    got = {r.p: r.found for r in seq.nearest(a, b, ["g"], "at", "id", F.col("want"), "found", after).collect()}
    for g, p, want in probes:
        near = [(v, i) for h, i, v in rows if h == g and (v >= want if after else v <= want)]
        assert got[p] == ((min(near) if after else max(near))[1] if near else None)


def test_reached(spark):
    r = random.Random(4)
    links = [(g, p, p + r.randint(1, 3) if p < n - 4 else None) for g, n in ((1, 1), (2, 9), (3, 200), (None, 20)) for p in range(n)]
    got = {(x.g, x.pos) for x in seq.reached(spark.createDataFrame(links, "g int, pos long, next long"), ["g"]).collect()}
    by, want = {(g, p): n for g, p, n in links}, set()
    for g in (1, 2, 3, None):
        p = 0
        while p is not None:
            want.add((g, p))
            p = by[g, p]
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "g int, i int, v long")
    assert seq.running(df, ["g"], ["i"], {"s": ("sum", F.col("v"))}).count() == 0
    assert seq.filled(df, "g", "i", "v", 5).count() == 0
    assert seq.spaced(df, "g", "v", "i", 5).count() == 0
    assert seq.flights(df.withColumn("took", F.lit(1)), "g", "v", "took", "i").count() == 0


@pytest.mark.parametrize("most", [0, 50, 200])
def test_filled(spark, most):
    rows = hot(5)
    got = {r.i: (r.bin, r.load) for r in seq.filled(spark.createDataFrame(rows, "g int, i int, v int"), "g", "i", "v", most).collect()}
    for members in by_group(rows).values():
        number, load = 1, None
        for _, i, v in members:
            number, load = (number, v) if load is None else (number, load + v) if load + v <= most else (number + 1, v)
            assert got[i] == (number, load)


@pytest.mark.parametrize("most", [1, 3])
def test_bans(spark, most):
    rows = [(g, i, v * 7 % 61 + i) for g, i, v in hot(6)]
    df = spark.createDataFrame(rows, "k int, event_id int, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((str(r.k), r.a, r.b) for r in seq.bans(df, "k", most, 8, 40).select("k", F.unix_seconds("from_ts").alias("a"), F.unix_seconds("until_ts").alias("b")).collect())
    want = []
    for g, members in by_group(rows).items():
        recent, until = [], -1
        for t in sorted(m[2] for m in members):
            if t < until:
                continue
            recent = [x for x in recent if t - x < 8] + [t]
            if len(recent) == most:
                recent, until = [], t + 40
                want.append((str(g), t, until))
    assert got == sorted(want) and got


def test_spaced_and_flights(spark):
    rows = hot(7)
    df = spark.createDataFrame(rows, "g int, i int, v int").withColumn("took", F.col("i") % 9)
    start = {r.i: (r.start, r.wait) for r in seq.spaced(df, "g", "v", "i", 15).collect()}
    flight = {r.i: (r.leader, r.ends, r.shared) for r in seq.flights(df, "g", "v", "took", "i").collect()}
    for members in by_group(rows).values():
        last, lead, ends = None, 0, None
        for k, (_, i, v) in enumerate(sorted(members, key=lambda m: (m[2], m[1]))):
            last = v if last is None else max(v, last + 15)
            assert start[i] == (last, last - v)
            shared = ends is not None and v < ends
            if not shared:
                lead, ends = k, v + max(i % 9, 1)
            assert flight[i] == (lead, ends, shared)


def test_triggers(spark):
    assert [r.fire for r in sch.fixed_rate(spark, 10, 10 + 3 * sch.SECOND, 1).orderBy("fire").collect()] == [10 + k * sch.SECOND for k in range(4)]
    assert sch.fixed_rate(spark, 10, 9, 1).count() == 0
    days = sch.calendar(spark, "2024-01-01", 10, "00:05", "Asia/Seoul", (1, 4)).select(F.timestamp_micros("fire").cast("string").alias("t")).collect()
    assert sorted(r.t for r in days) == ["2023-12-31 15:05:00", "2024-01-03 15:05:00", "2024-01-07 15:05:00"]
    runs = spark.createDataFrame([(k, (k + 1) * sch.SECOND) for k in range(50)], "k int, took long")
    at = {r.k: r.fire for r in sch.fixed_delay(runs, "k", F.col("took"), 5, 10).collect()}
    fire = 5
    for k in range(50):
        assert at[k] == fire
        fire += (k + 11) * sch.SECOND


# --- digests ---


def render(title, items):
    lines = [f"{i}. {name}\n" + (f"{text}\n" if text else "") + f"Link: {link}" for i, (name, text, link) in enumerate(items, 1)]
    return f"{title}{dg.INTRO}\n\n" + "\n\n".join(lines)


def plain_digests(items, least, most):
    """Greedy filling by rendering anew for each item."""
    base = "2024년 1월 31일 N 모음"
    title = lambda k, n: f"{base} ({k}/{n})" if n > 1 else base
    ranges, start = [], 0
    for i in range(1, len(items)):
        if len(render(base, items[start : i + 1])) > most:
            ranges.append((start, i))
            start = i
    ranges.append((start, len(items)))
    good = [(a, b) for k, (a, b) in enumerate(ranges, 1) if b - a >= dg.MIN_SHORT and least <= len(render(title(k, len(ranges)), items[a:b])) <= most]
    return [(k, b - a, title(k, len(good)), render(title(k, len(good)), items[a:b])) for k, (a, b) in enumerate(good, 1)]


@pytest.mark.parametrize("most", [130, 700, 6_000, 100_000])
def test_digests(spark, most):
    r = random.Random(most)
    groups = {g: [("t" * r.randint(0, 5), "x" * r.choice([0, 1, 20, 300, 900]) if g != 4 else "", "u" * r.randint(0, 9)) for _ in range(n)] for g, n in ((1, 2), (2, 5), (3, 60), (4, 1200))}
    rows = [(g, k, "N", t, x, u) for g, items in groups.items() for k, (t, x, u) in enumerate(items)]
    df = spark.createDataFrame(rows, "group_id long, ord long, name string, title string, content string, url string").withColumn("published", F.lit("2024-01-31").cast("date"))
    out = {}
    for x in dg.digests(df, 100, most).orderBy("group_id", "chunk").collect():
        out.setdefault(x.group_id, []).append((x.chunk, x.n_items, x.title, x.content))
    want = {g: plain_digests(items, 100, most) for g, items in groups.items() if sum(len(x) < dg.SHORT for _, x, _ in items) >= dg.MIN_SHORT}
    assert out == {g: v for g, v in want.items() if v} and (out or most == 130)


def test_pools_by_category(spark, monkeypatch, slices):
    """The pools that share a category's list equal those worked out row by row, on either side of the bound of seen contents."""
    if slices > 1:
        pytest.skip("once is enough")
    from paths import SF

    from plumeflow.operators import recommend as rec
    from plumeflow.plans import fixtures as fx

    t = fx.Tables(spark, SF)
    users = fx.users(t).where("user_id % 5 = 0").union(fx.users(t).where("user_id % 50 = 0").withColumn("category_id", F.col("category_id") % 5 + 1))
    given = fx.category_score(t), fx.contents(t), users, fx.exposed(t)
    fit = rec.fit_by_category(given[0])
    monkeypatch.setattr(rec, "LIGHT", 9)
    monkeypatch.setattr(rec, "SOURCES", (("a", "total_score", 14, 1.0, 0.85), ("b", "keyword_score", 10, 1.0, 0.75), ("c", "provider_score", 6, 0.7, 0.55)))
    for target, most in ((12, 20), (0, 5), (10_000, 50)):
        want = rec.pools(rec.ranked_candidates(*given, fit), fx.AS_OF, target, most)
        got = rec.category_pools(*given, fit, fx.AS_OF, target, most)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_first_candidates(spark, monkeypatch, slices):
    """Rows equal those of a plain loop, for users who have seen few or many, repeat, or have no id, and contents that repeat; no user's rows are sorted."""
    if slices > 1:
        pytest.skip("once is enough")
    from plumeflow.operators import recommend as rec

    monkeypatch.setattr(rec, "SOURCES", (("a", "total_score", 7, 1.0, 0.85), ("b", "keyword_score", 5, 1.0, 0.75), ("c", "provider_score", 3, 0.7, 0.55)))
    r = random.Random(4)
    contents = [(i, r.randint(0, 20)) for i in range(60)] + [(i, 20) for i in (50, 51, 52)]
    contents += [x for x in contents if x[0] % 7 == 0 for _ in range(9)]
    scores = [(i, c, float(r.randint(0, 1)), float(r.randint(0, 1)), float(r.randint(0, 1))) for i in range(60) for c in (1, 2)]
    users = [(u, 1 + u % 3) for u in range(40)] + [(3, 2), (None, 1), (None, 1), (41, None)]
    exposed = sorted({(u, r.randrange(60)) for u in range(40) for _ in range(r.choice([0, 1, 5, 50]))}) + [(1, 900), (None, 5), (99, 3)]
    given = (
        spark.createDataFrame(scores, "content_id long, category_id long, total_score double, keyword_score double, provider_score double"),
        spark.createDataFrame(contents, "content_id long, day int").select("content_id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("published_at")),
        spark.createDataFrame(users, "user_id long, category_id long"),
        spark.createDataFrame(exposed, "user_id long, content_id long"),
    )
    want = []
    for user in dict.fromkeys(u for u, _ in users):
        for k, (_, _, limit, *_) in enumerate(rec.SOURCES):
            rows = [(d, i) for u, c in users if u == user for i, d in contents for s in scores if s[:2] == (i, c) and s[2 + k] > 0 and (user is None or (user, i) not in exposed)]
            want += [(user, i, k + 1, n) for n, (_, i) in enumerate(sorted(rows, reverse=True)[:limit], 1)]
    for light, listed in ((500, 200_000), (4, 200_000), (500, 10)):
        monkeypatch.setattr(rec, "LIGHT", light)
        monkeypatch.setattr(rec, "LISTED_ROWS", listed)
        assert sorted(map(str, (tuple(x) for x in rec.first_candidates(*given).collect()))) == sorted(map(str, want))

    from paths import SF

    from plumeflow.plans import catalog

    monkeypatch.undo()
    plan = catalog.QUERIES["rec01_candidates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
