"""Explainable, rule-scored recommendations for all users in one set-based plan."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Candidate sources (limit, score, confidence), windows (days, multiplier) and thresholds.
SOURCES = (("category_score", "total_score", 140, 1.0, 0.85), ("category_keyword", "keyword_score", 100, 1.0, 0.75), ("category_provider", "provider_score", 60, 0.7, 0.55))
WINDOWS = ((30, 1), (90, 2), (365, 3), (None, 4))
POOL_TARGET, POOL_MAX = 120, 200
DOMINANT_RATIO, DOMINANT_GAP = 1.5, 8.0
# Words of the re-ranking signals, ASCII words with word boundaries, and words of Korean text without.
NEW_WORDS = r"new|launch(ed|es)?|release(d|s)?|introduc(e|ed|es|ing)|announc(e|ed|es|ing)|preview|beta|alpha|stable|ga|rc|v[0-9]+(\.[0-9]+)*"
NEW_KOREAN = "출시|공개|발표|신규|새로운|최신|베타|정식|업데이트|릴리즈"
AI_WORDS = "ai|llm|agent(ic|s)?|mcp|rag|vector|embedding|prompt|copilot|claude|openai|gemini|anthropic|cursor|codex"
AI_KOREAN = r"인공지능|생성형\s*AI|언어\s*모델|에이전트|프롬프트|임베딩|벡터|코파일럿"
PLATFORM_WORDS = r"platform|api|sdk|framework|library|runtime|database|cloud|kubernetes|postgresql|node(\.js)?|react|android|kotlin|java|python|swift|wasm|browser|extension|infra(structure)?"
PLATFORM_KOREAN = r"플랫폼|API|SDK|프레임워크|라이브러리|런타임|데이터베이스|클라우드|인프라|확장\s*프로그램"


def keyword_affinity(positive: Column, negative: Column, bonus: Column) -> Column:
    """REC06: product of positive weights minus product of negated negative ones plus bonus, 0 at least. Empty products are 1."""
    up = F.aggregate(positive, F.lit(1.0), lambda a, x: a * x)
    down = F.aggregate(negative, F.lit(1.0), lambda a, x: a * x * -1)
    return F.greatest(up - down + bonus, F.lit(0.0))


def signal_bonus(signals: Column) -> Column:
    """REC07: 20 * score * confidence summed, and 15 for each source beyond the first. signals: array of (source, score, confidence)."""
    quality = F.aggregate(signals, F.lit(0.0), lambda a, s: a + s["score"] * s["confidence"] * 20.0)
    more = F.greatest(F.size(F.array_distinct(F.transform(signals, lambda s: s["source"]))) - 1, F.lit(0)) * 15.0
    return F.when(F.size(signals) > 0, quality + more).otherwise(F.lit(0.0))


def mentions(text: Column, words: str, korean: str) -> Column:
    """True if the text has one of the ASCII words as a whole word, or one of the others anywhere."""
    return F.rlike(text, F.lit(f"(?i)(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])")) | F.rlike(text, F.lit(korean))


def rerank_parts(text: Column, published: Column, today: Column) -> dict[str, Column]:
    """REC08: the parts of the re-ranking bonus."""
    new, ai, platform = mentions(text, NEW_WORDS, NEW_KOREAN), mentions(text, AI_WORDS, AI_KOREAN), mentions(text, PLATFORM_WORDS, PLATFORM_KOREAN)
    age = F.greatest(F.datediff(today, published), F.lit(0))
    return {
        "new_technology_signal": F.when(new, 40.0).otherwise(0.0),
        "ai_llm_signal": F.when(ai, 35.0).otherwise(0.0),
        "platform_signal": F.when(platform, 25.0).otherwise(0.0),
        "signal_synergy": F.when(new & ai & platform, 30.0).when(new & (ai | platform), 20.0).when(ai & platform, 10.0).otherwise(0.0),
        "reranking_recency": F.when(age <= 1, 60.0).when(age <= 3, 45.0).when(age <= 7, 30.0).when(age <= 14, 15.0).when(age <= 30, 5.0).otherwise(0.0),
    }


def freshness(published: Column, today: Column) -> Column:
    """REC09: a penalty of one for each day of age, ten at most."""
    return -F.least(F.greatest(F.datediff(today, published), F.lit(0)), F.lit(10)).cast("double")


def duplicate_penalty(index: Column) -> Column:
    """REC10: -50 for each earlier row of the same publisher."""
    return index * -50.0


def explained(parts: dict[str, Column], keep_zero: frozenset[str] = frozenset({"keyword_affinity", "freshness", "duplicate_publisher"})) -> Column:
    """REC11/REC12: rule rows (rule, score, type); bonus rows of zero are left out, and a floor row lifts a negative total to 0."""
    total = sum(parts.values(), F.lit(0.0))
    rows = F.array(*(F.struct(F.lit(k).alias("rule"), c.cast("double").alias("score"), F.when(c < 0, "PENALTY").otherwise("SCORE" if k == "keyword_affinity" else "BONUS").alias("type")) for k, c in parts.items()))
    shown = F.filter(rows, lambda r: r["rule"].isin(*keep_zero) | (r["score"] != 0))
    floor = F.struct(F.lit("final_score_floor").alias("rule"), (-total).alias("score"), F.lit("ADJUSTMENT").alias("type"))
    return F.when(total < 0, F.concat(shown, F.array(floor))).otherwise(shown)


def category_fit(scores: DataFrame, requested: list[int], margin: float = 2.0) -> DataFrame:
    """REC04/FLT15: (content_id, fit) for one set of requested categories. The margin of a single category is an assumed value."""
    positive = F.col("total_score") > 0
    asked = F.col("category_id").isin(requested)
    by_provider = positive & (F.col("provider_score") > 0)
    g = scores.groupBy("content_id").agg(
        F.count_if(positive).alias("n"),
        F.count_if(by_provider).alias("np"),
        F.count_if(by_provider & asked).alias("npr"),
        F.coalesce(F.sum(F.when(positive & asked, F.col("total_score"))), F.lit(0.0)).alias("requested"),
        F.coalesce(F.max(F.when(positive & ~asked, F.col("total_score"))), F.lit(0.0)).alias("competing"),
    )
    return g.select("content_id", "requested", "competing", _fit(len(requested) == 1, margin).alias("fit"))


def _fit(single: bool, margin: float) -> Column:
    one = (F.col("competing") <= 0) | (F.col("requested") >= F.col("competing") + margin)
    many = (F.col("competing") < F.col("requested") * DOMINANT_RATIO) | (F.col("competing") - F.col("requested") < DOMINANT_GAP)
    return F.when(F.col("n") == 0, True).when((F.col("np") > 0) & (F.col("npr") == 0), False).when(F.col("requested") <= 0, False).otherwise(one if single else many)


def fit_by_category(scores: DataFrame, margin: float = 2.0) -> DataFrame:
    """REC04 for each single category: (content_id, category_id, fit). The strongest competitor is the best or, for the best itself, the second best."""
    totals = F.transform(F.filter("s", lambda x: x["total_score"] > 0), lambda x: F.struct(x["total_score"].alias("t"), x["category_id"].alias("c"), x["provider_score"].alias("p")))
    g = scores.groupBy("content_id").agg(F.collect_list(F.struct("total_score", "category_id", "provider_score")).alias("s")).withColumn("pos", F.sort_array(totals, asc=False))
    each = g.select("content_id", "pos", F.explode(F.transform("s", lambda x: x["category_id"])).alias("category_id"))
    mine = F.filter("pos", lambda x: x["c"] == F.col("category_id"))
    rest = F.filter("pos", lambda x: x["c"] != F.col("category_id"))
    shaped = each.select(
        "content_id",
        "category_id",
        F.size("pos").alias("n"),
        F.size(F.filter("pos", lambda x: x["p"] > 0)).alias("np"),
        F.size(F.filter(mine, lambda x: x["p"] > 0)).alias("npr"),
        F.coalesce(F.get(mine, F.lit(0))["t"], F.lit(0.0)).alias("requested"),
        F.coalesce(F.get(rest, F.lit(0))["t"], F.lit(0.0)).alias("competing"),
    )
    return shaped.select("content_id", "category_id", _fit(True, margin).alias("fit"))


#: Rows of the listed contents up to which they are broadcast to the users; more are joined by category.
LISTED_ROWS = 200_000
#: Contents that a user has seen up to which the pool comes from the category's list; users who have seen more are worked out row by row.
LIGHT = 500


#: Users whose first candidates are worked out at once.
USERS = 2048


def _listed(scores: DataFrame, contents: DataFrame, most: int, fit: DataFrame | None = None, times: int = WINDOWS[-1][1]) -> DataFrame:
    """The newest contents of each category and source, as many as any user with ``most`` seen ones can need for ``times`` the source's limit: (category_id, content_id, published_at, source_ord, place, depth, _limit), and fit if it is given.

    place counts rows, depth contents: rows of a content that repeats go together, and one that is seen hides them all.
    """
    some = scores.where(reduce(Column.__or__, (F.col(s[1]) > 0 for s in SOURCES)))
    listed = some.join(contents.select("content_id", "published_at"), "content_id")
    if fit is not None:
        listed = listed.join(fit, ["content_id", "category_id"], "left").withColumn("fit", F.coalesce("fit", F.lit(True)))
    more = ["fit"] if fit is not None else []
    each = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("source_ord"), F.lit(s[2] * times).alias("_limit"), (F.col(s[1]) > 0).alias("has")) for i, s in enumerate(SOURCES))))
    listed = listed.select("category_id", "content_id", "published_at", *more, each.alias("s")).where("s.has").select("category_id", "content_id", "published_at", *more, "s.source_ord", "s._limit")
    # the first rows of 64 parts of a category hold the first rows of the category
    newest = [F.desc("published_at"), F.desc("content_id")]
    part = F.pmod(F.xxhash64("content_id"), F.lit(64))
    for keys in (["category_id", "source_ord", part], ["category_id", "source_ord"]):
        window = Window.partitionBy(*keys).orderBy(*newest)
        listed = listed.withColumns({"place": F.row_number().over(window), "depth": F.dense_rank().over(window)}).where(F.col("depth") <= F.col("_limit") + most)
    return listed


def ranked_candidates(scores: DataFrame, contents: DataFrame, users: DataFrame, exposed: DataFrame, fit: DataFrame | None = None, times: int = WINDOWS[-1][1]) -> DataFrame:
    """REC01, EXT01-03, JON09: what each user has not seen, by source, newest first, up to ``times`` the source's limit: (user_id, category_id, content_id, source_ord, rank, published_at), and fit if it is given.

    A user's first rows are among the first (limit + seen) of the category, so only these are listed; the list, a few
    thousand rows, goes to the users, whose rows are dealt by user once: all that follows by user stays where it is.
    """
    seen = exposed.join(users.select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.collect_set("content_id").alias("_seen"))
    rows = users.select("user_id", "category_id").join(seen, "user_id", "left").withColumn("_n", F.coalesce(F.array_size("_seen"), F.lit(0))).repartition("user_id")
    most = seen.agg(F.coalesce(F.max(F.size("_seen")), F.lit(0))).first()[0]
    listed = _listed(scores, contents, most, fit, times)
    more = ["fit"] if fit is not None else []
    categories = scores.select("category_id").distinct().count()
    small = categories * sum(s[2] * times + most for s in SOURCES) <= LISTED_ROWS
    bounded = rows.join(F.broadcast(listed) if small else listed, "category_id").where(F.col("depth") <= F.col("_limit") + F.col("_n"))
    fresh = bounded.where(~F.coalesce(F.array_contains("_seen", F.col("content_id")), F.lit(False)))
    # not by place, which is that in one category's list: a user may have several
    rank = F.row_number().over(Window.partitionBy("user_id", "source_ord").orderBy(F.desc("published_at"), F.desc("content_id")))
    return fresh.withColumn("rank", rank).where(F.col("rank") <= F.col("_limit")).select("user_id", "category_id", "content_id", "source_ord", "rank", "published_at", *more)


def first_candidates(scores: DataFrame, contents: DataFrame, users: DataFrame, exposed: DataFrame) -> DataFrame:
    """REC01: of ``ranked_candidates`` the rows up to each source's own limit: (user_id, content_id, source_ord, rank).

    The lists of the categories, LISTED_ROWS rows at most in all, go to the users in Arrow batches. Only contents in a list can
    be missing from a user's rows, so that only these are looked up, and no row is made or sorted that is not in the result.
    Users who have seen more than LIGHT of them or have several rows, and all users where the lists are larger, are
    worked out by ``ranked_candidates``.
    """
    lists = _listed(scores, contents, LIGHT, times=1).select("category_id", "source_ord", "place", "content_id").limit(LISTED_ROWS + 1).toArrow()

    def ranked(some: DataFrame) -> DataFrame:
        return ranked_candidates(scores, contents, some, exposed, times=1).select("user_id", "content_id", "source_ord", F.col("rank").cast("long").alias("rank"))

    if lists.num_rows > LISTED_ROWS:
        return ranked(users)
    session = users.sparkSession
    ids = session.createDataFrame(lists.select(["content_id"])).distinct()
    seen = exposed.join(F.broadcast(ids), "content_id", "left_semi").groupBy("user_id").agg(F.collect_set("content_id").alias("_seen"))
    tasks = int(session.conf.get("spark.sql.shuffle.partitions"))  # little to read, much to write: not to be coalesced
    own = users.repartition(tasks, "user_id").groupBy("user_id").agg(F.min("category_id").alias("category_id"), F.count("*").alias("_of")).join(seen, "user_id", "left")
    light = (F.col("_of") == 1) & (F.coalesce(F.array_size("_seen"), F.lit(0)) <= LIGHT)
    schema = f"user_id {dict(users.dtypes)['user_id']}, content_id {dict(contents.dtypes)['content_id']}, source_ord int, rank long"
    out = own.where(light).select("user_id", "category_id", "_seen").mapInArrow(_first_kernel(lists.sort_by("place")), schema)
    heavy = own.where(~light).select(F.col("user_id").alias("_heavy"))
    return out if heavy.isEmpty() else out.unionByName(ranked(users.join(heavy, F.col("user_id").eqNullSafe(F.col("_heavy")), "left_semi")))


def _first_kernel(lists: pa.Table):
    """Users in Arrow batches (user_id, category_id, _seen) to the first rows of their category's lists, sorted by place, that they have not seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict = {}
        for c in lists["category_id"].unique().drop_null().to_pylist():
            for i, s in enumerate(SOURCES):
                ids = lists.filter(pc.and_(pc.equal(lists["category_id"], c), pc.equal(lists["source_ord"], i + 1)))["content_id"].combine_chunks()
                code = pc.index_in(ids, value_set=ids.unique()).to_numpy()
                by.setdefault(c, []).append((i + 1, s[2], ids, code, np.bincount(code)))
        for batch in batches:
            for lo in range(0, batch.num_rows, USERS):
                some = batch.slice(lo, USERS)
                for c, sources in by.items():
                    mine = some.filter(pc.equal(some.column("category_id"), c))
                    if not mine.num_rows:
                        continue
                    user, gone = pc.list_parent_indices(mine.column("_seen")).to_numpy(), pc.list_flatten(mine.column("_seen"))
                    for source, limit, ids, code, rows_of in sources:
                        found = pc.index_in(gone, value_set=ids.unique())
                        hit = found.is_valid().to_numpy(zero_copy_only=False)
                        who, what = user[hit], found.drop_null().to_numpy()
                        # rows that a user's seen ones take, at most
                        width = limit + int(np.bincount(who, rows_of[what], minlength=1).max())
                        hidden = np.zeros((mine.num_rows, len(rows_of)), bool)
                        hidden[who, what] = True
                        fresh = ~hidden[:, code[:width]]
                        rank = fresh.cumsum(axis=1)
                        who, at = np.nonzero(fresh & (rank <= limit))
                        yield pa.RecordBatch.from_arrays(
                            [mine.column("user_id").take(pa.array(who)), ids.take(pa.array(at)), pa.array(np.full(len(who), source, np.int32)), pa.array(rank[who, at])],
                            names=["user_id", "content_id", "source_ord", "rank"],
                        )

    return run


def pools(candidates: DataFrame, today: str, target: int = POOL_TARGET, most: int = POOL_MAX) -> DataFrame:
    """REC02/REC03/SET02/TOP02: each user's pool after adaptive expansion, in closed form. candidates: as ranked_candidates gives them, with fit.

    Stages run window by window and source by source. As all windows of a
    source are prefixes of one order, a row's stages follow from its rank and
    age. Stages run until ``target`` rows are merged; after that window, as long
    as fewer than ``target`` fit the category, each further window runs its
    first source only. Counts are taken over each user's own rows, in place.
    """
    age = F.datediff(F.lit(today).cast("date"), F.col("published_at"))
    limits = F.element_at(F.array(*(F.lit(s[2]) for s in SOURCES)), F.col("source_ord"))
    window = F.lit(None).cast("int")
    for w, (days, times) in reversed(list(enumerate(WINDOWS))):
        inside = F.col("rank") <= limits * times
        window = F.when(inside & (age <= days) if days is not None else inside, w + 1).otherwise(window)
    staged = candidates.withColumn("w", window).where("w is not null").withColumn("stage", (F.col("w") - 1) * 3 + F.col("source_ord"))
    merged = staged.groupBy("user_id", "category_id", "content_id").agg(
        F.first("published_at").alias("published_at"),
        F.first("fit").alias("fit"),
        F.min("stage").alias("first_stage"),
        *(F.min(F.when(F.col("source_ord") == i + 1, F.col("w"))).alias(f"w{i + 1}") for i in range(3)),
    )
    user = Window.partitionBy("user_id")
    # the stage that brings the target: the least s with ``target`` rows of a first stage up to s
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("first_stage"))
    ranked = merged.withColumn("_nth", nth)
    star = F.coalesce(F.min(F.when(F.col("_nth") == target, F.col("first_stage"))).over(user), F.lit(12)) if target > 0 else F.lit(1)
    rows = ranked.withColumn("star", star).withColumn("ws", F.ceil(F.col("star") / 3).cast("int"))

    def inside(w: int) -> Column:
        return (F.col("first_stage") <= F.col("star")) | (F.col("w1") <= w)

    rows = rows.withColumns({f"fit{w}": F.count_if(F.col("fit") & inside(w)).over(user) for w in range(1, 4)})
    stop = F.lit(4)
    for w in (3, 2, 1):
        stop = F.when((F.col("ws") <= w) & (F.col(f"fit{w}") >= target), w).otherwise(stop)
    chosen = rows.withColumn("stop", stop).where(F.col("fit") & ((F.col("first_stage") <= F.col("star")) | (F.col("w1") <= F.col("stop"))))
    used = [F.col("w1") <= F.col("stop"), *(((F.col(f"w{i}") - 1) * 3 + i) <= F.col("star") for i in (2, 3))]
    total = {k: sum((F.when(F.coalesce(u, F.lit(False)), s[at]).otherwise(0.0) for u, s in zip(used, SOURCES, strict=True)), F.lit(0.0)) for k, at in (("confidence", 4), ("score", 3))}
    chosen = chosen.withColumn("confidence", F.round(total["confidence"], 4)).withColumn("score", F.round(total["score"], 4)).withColumn("sources", sum((F.coalesce(u, F.lit(False)).cast("long") for u in used), F.lit(0)))
    order = Window.partitionBy("user_id").orderBy(F.desc("published_at"), F.desc("confidence"), F.desc("score"), F.desc("content_id"))
    return chosen.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("user_id", "content_id", "published_at", "confidence", "score", "sources", "place")


def category_pools(scores: DataFrame, contents: DataFrame, users: DataFrame, exposed: DataFrame, fit: DataFrame, today: str, target: int = POOL_TARGET, most: int = POOL_MAX) -> DataFrame:
    """The pools of ``pools`` over ``ranked_candidates``, with what users of a category share done once for the category.

    A category's newest contents are one list with their places in the three sources; the lists have LISTED_ROWS rows at most in all and go to
    the users, in Arrow batches. A user's rank of a content is its place less the number of contents seen before it, so that only the few seen ones
    are looked at for each user, and no row is made before the pool's own. Users who have seen more than LIGHT contents
    or have several categories, and all users where the lists would be too large to broadcast, are worked out by ``pools``.
    """
    seen = exposed.join(users.select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.collect_set("content_id").alias("_seen"))
    own = users.groupBy("user_id").agg(F.min("category_id").alias("category_id"), F.count("*").alias("_of")).join(seen, "user_id", "left")
    light = (F.col("_of") == 1) & (F.coalesce(F.array_size("_seen"), F.lit(0)) <= LIGHT)
    counts = own.agg(F.count_if(~light).alias("heavy"), F.coalesce(F.max(F.when(light, F.array_size("_seen"))), F.lit(0)).alias("most")).first()
    categories = scores.select("category_id").distinct().count()
    if categories * sum(s[2] * WINDOWS[-1][1] + counts.most for s in SOURCES) > LISTED_ROWS:
        return pools(ranked_candidates(scores, contents, users, exposed, fit), today, target, most)
    age = F.datediff(F.lit(today).cast("date"), F.col("published_at"))
    merged = _listed(scores, contents, counts.most, fit).groupBy("category_id", "content_id", "published_at", "fit").agg(*(F.min(F.when(F.col("source_ord") == i + 1, F.col("place"))).alias(f"p{i + 1}") for i in range(3)))
    # LISTED_ROWS rows at most
    lists = merged.withColumn("age", age).orderBy("category_id", F.desc("published_at"), F.desc("content_id")).toArrow()
    kinds = {c: kind for c, kind in merged.dtypes}
    schema = f"user_id {dict(users.dtypes)['user_id']}, content_id {kinds['content_id']}, published_at {kinds['published_at']}, confidence double, score double, sources long, place long"
    out = own.where(light).select("user_id", "category_id", "_seen").mapInArrow(_pool_kernel(lists, target, most), schema)
    if counts.heavy:
        heavy = users.join(own.where(~light).select("user_id"), "user_id", "left_semi")
        out = out.unionByName(pools(ranked_candidates(scores, contents, heavy, exposed, fit), today, target, most))
    return out


class _List:
    """A category's newest contents: places in the sources (NOWHERE if not in it), ages, and the order of days."""

    NOWHERE = 1 << 30

    def __init__(self, rows: pa.Table):
        self.rows = rows.combine_chunks()
        self.index = {v: k for k, v in enumerate(rows["content_id"].to_pylist())}
        self.places = [rows[f"p{i}"].fill_null(self.NOWHERE).to_numpy() for i in (1, 2, 3)]
        self.ages = rows["age"].fill_null(self.NOWHERE).to_numpy()
        self.fit = rows["fit"].to_numpy(zero_copy_only=False).astype(bool)
        days = rows["published_at"].to_pylist()
        self.day = np.cumsum([k > 0 and days[k] != days[k - 1] for k in range(len(days))])


def _pool_kernel(lists: pa.Table, target: int, most: int):
    """The stages of ``pools`` for users in Arrow batches (user_id, category_id, _seen), on arrays of the category's list."""
    last = len(WINDOWS) * len(SOURCES)
    combos = [[bool(k >> i & 1) for i in range(3)] for k in range(8)]
    totals = {at: np.array([round(sum(s[at] for s, u in zip(SOURCES, c, strict=True) if u), 4) for c in combos]) for at in (4, 3)}

    def pool(of: _List, seen: list) -> tuple[np.ndarray, np.ndarray]:
        gone = np.array([of.index[x] for x in seen if x in of.index], dtype=np.int64)
        windows = []
        for places, source in zip(of.places, SOURCES, strict=True):
            ranks = places - np.searchsorted(np.sort(places[gone]), places) if len(gone) else places
            w = np.full(len(places), 99)
            for k, (days, times) in reversed(list(enumerate(WINDOWS))):
                inside = ranks <= source[2] * times
                w[inside & (of.ages <= days) if days is not None else inside] = k + 1
            w[gone] = 99
            windows.append(w)
        stage = np.min([w * 3 - 2 + i for i, w in enumerate(windows)], axis=0)
        reach = np.cumsum(np.bincount(stage[stage <= last], minlength=last + 1))
        star = (int(np.argmax(reach >= target)) if reach[-1] >= target else last) if target > 0 else 1
        first = stage <= star
        stop = len(WINDOWS)
        for w in range(-(-star // 3), len(WINDOWS)):
            if np.count_nonzero(of.fit & (first | (windows[0] <= w))) >= target:
                stop = w
                break
        chosen = np.flatnonzero(of.fit & (first | (windows[0] <= stop)))
        used = (windows[0][chosen] <= stop) + 2 * (windows[1][chosen] * 3 - 1 <= star) + 4 * (windows[2][chosen] * 3 <= star)
        order = np.lexsort((-totals[3][used], -totals[4][used], of.day[chosen]))[:most]
        return chosen[order], used[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {c: _List(lists.filter(pc.equal(lists["category_id"], c))) for c in lists["category_id"].unique().to_pylist() if c is not None}
        for batch in batches:
            categories, seen = batch.column("category_id").to_pylist(), batch.column("_seen").to_pylist()
            for category in set(categories) & set(by):
                of, users = by[category], [k for k, c in enumerate(categories) if c == category]
                found = [pool(of, seen[k] or []) for k in users]
                sizes = [len(at) for at, _ in found]
                rows = of.rows.take(pa.array(np.concatenate([at for at, _ in found]), pa.int64()))
                used = np.concatenate([u for _, u in found])
                columns = [
                    batch.column("user_id").take(pa.array(np.repeat(users, sizes), pa.int64())),
                    rows["content_id"].combine_chunks(),
                    rows["published_at"].combine_chunks(),
                    pa.array(totals[4][used]),
                    pa.array(totals[3][used]),
                    pa.array((used & 1) + (used >> 1 & 1) + (used >> 2), pa.int64()),
                    pa.array(np.concatenate([np.arange(1, n + 1) for n in sizes]), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["user_id", "content_id", "published_at", "confidence", "score", "sources", "place"])

    return run


def diverse(scored: DataFrame, limit: int, key: str = "user_id") -> DataFrame:
    """REC16, WIN02/WIN03, TOP03/TOP04: the first limit^2 rows by score, later rows of a publisher fined, publishers capped, the first ``limit`` of the rest.

    scored: key, content_id, publisher, score, published_at.
    """
    if limit <= 0:
        return scored.limit(0).withColumn("rank", F.lit(0).cast("long")).withColumn("final_score", F.col("score"))
    by_score = [F.desc("score"), F.desc("published_at"), F.desc("content_id")]
    first = scored.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*by_score))).where(F.col("_r") <= limit * limit)
    index = F.row_number().over(Window.partitionBy(key, "publisher").orderBy("_r")) - 1
    again = first.withColumn("final_score", F.greatest(F.col("score") + duplicate_penalty(index), F.lit(0.0)))
    order = [F.desc("final_score"), F.desc("published_at"), F.desc("content_id")]
    again = again.withColumn("_q", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    capped = again.withColumn("_n", F.row_number().over(Window.partitionBy(key, "publisher").orderBy("_q"))).where(F.col("_n") <= max(limit - 1, 1))
    return capped.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("_q")).cast("long")).where(F.col("rank") <= limit).drop("_r", "_q", "_n")


def fallback(scored: DataFrame, limit: int, key: str = "user_id") -> DataFrame:
    """REC15: rows that turn positive at multiplier 1, 2, 3 or 4, in rounds; the first ``limit``. scored: score1 .. score4."""
    turn = F.when(F.col("score1") > 0, 1).when(F.col("score2") > 0, 2).when(F.col("score3") > 0, 3).when(F.col("score4") > 0, 4)
    at = F.element_at(F.array("score1", "score2", "score3", "score4"), F.col("round"))
    rows = scored.withColumn("round", turn).where("round is not null").withColumn("score", at)
    order = Window.partitionBy(key).orderBy("round", F.desc("score"), F.desc("published_at"), F.desc("content_id"))
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= max(limit, 0))


def total(rules: list[Column]) -> Column:
    """UDX03/REC11: the sum of a list of rules, 0 at least. A rule is a column; a caller's own list takes the place of the built-in one."""
    return F.greatest(sum(rules, F.lit(0.0)), F.lit(0.0))
