"""Secret scans with multipart credential linking, in DataFrame functions only.

Positions.  Splitting a text by a pattern gives the gaps between its matches
and ``regexp_extract_all`` the matches; sums over both lengths give spans in
code points, end exclusive.  Sums are taken in two levels, so that a text with
very many matches costs no quadratic copying.

Base spans (always reported): ``assign``, ``access`` and ``hex``.

Linking.  Three kinds of weak candidates are worth nothing alone: ``ident``
(an account or client name), ``value`` (a long run of base64 letters) and
``endpoint`` (a URL).  Two parts are near where they are disjoint and the gap between them is
``scope`` code points at most, whatever their lengths and wherever they stand; a string is never a part that supports itself.  A weak
identifier is reported when a secret (``assign``, ``hex`` or ``value``) is near, a value when an access
identifier (``access`` or ``ident``) is, and an endpoint when an identifier
and a secret are that are also near each other.  The parts of a text are joined by sorts of their starts and
ends and running extremes, which is linear in their number; texts without complementary parts take no part in it.
Only spans are shuffled, never texts.

Defined results.  A null text counts as empty: no spans, and the digest of
the empty string.  Rows are independent; repeated rows get equal results.
Only the two named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import settle

#: The patterns of the contract, and those of weak candidates.
KEYWORDS = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
IDENT = r"""([Cc]lient_?[Ii][Dd]|[Aa]ccess_?[Kk]ey_?[Ii][Dd]|[Aa]ccount|[Uu]ser_?[Nn]ame|[Ll]ogin)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)"""
VALUE = "[A-Za-z0-9+/]{32,}=?=?"
ENDPOINT = r"""https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"""
KINDS = ("assign", "access", "hex", "ident", "value", "endpoint")
LEAF = 128


def _matches(text: Column, pattern: str, least: Column | None) -> Column:
    """(g, m, k) of the leftmost non-overlapping matches: length of the gap before a match, its own length, and whether it is kept, which ``least`` tells."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    keeps = least if least is not None else F.transform(found, lambda m: F.lit(True))
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"), keeps.alias("k"))
    return F.when(F.rlike(text, F.lit(pattern)), zipped).otherwise(F.array().cast("array<struct<g:int,m:int,k:boolean>>"))


def _placed(parts: Column) -> Column:
    """Spans (s, e, k) of the matches that are kept. parts has to be a column that is there already: it is looked up for each leaf."""
    leaves = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(parts) - 1) / LEAF).cast("int"), F.lit(0))), lambda i: F.slice(parts, i * LEAF + 1, LEAF))
    empty = F.array().cast("array<struct<s:int,e:int,k:boolean>>")

    def within(leaf: Column) -> Column:
        return F.aggregate(
            leaf,
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.array_append(a["out"], F.struct((a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["m"]).alias("e"), x["k"].alias("k"))).alias("out")),
        )

    shifted = F.aggregate(
        F.transform(leaves, within),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int,k:boolean>>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["at"]).alias("at"),
            F.array_append(a["out"], F.transform(x["out"], lambda o: F.struct((o["s"] + a["at"]).alias("s"), (o["e"] + a["at"]).alias("e"), o["k"].alias("k")))).alias("out"),
        ),
        lambda a: F.flatten(a["out"]),
    )
    return F.filter(shifted, lambda x: x["k"])


def _long_enough(text: Column, pattern: str, group: int, least: int) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m) >= least)


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("o"), x["e"].alias("e"), F.lit(kind).alias("k")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _swept(parts: DataFrame, before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """parts with, for each name in ``before``, the largest value of the parts of its text that end where this one starts or earlier, and for each in ``after`` the least of those that start where it ends or later.

    A sort of the starts and ends of a text in either direction gives all of them.
    """
    names = parts.columns
    # at one place ends come before starts: parts that touch are disjoint
    rows = parts.select("*", *(v.alias(f"_{k}") for k, v in {**before, **after}.items()), F.explode(F.array(F.lit(0), F.lit(1))).alias("_start"))
    at = F.when(F.col("_start") == 0, F.col("e")).otherwise(F.col("s"))
    # frames that reach back only, in either order: one that reaches to the end is worked out anew for each row
    back, on = (Window.partitionBy("place").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in ([at, F.asc("_start")], [at.desc(), F.desc("_start")]))
    swept = rows.select(
        *names,
        "_start",
        *(F.max(F.when(F.col("_start") == 0, F.col(f"_{k}"))).over(back).alias(k) for k in before),
        *(F.min(F.when(F.col("_start") == 1, F.col(f"_{k}"))).over(on).alias(k) for k in after),
    )
    return swept.groupBy(*names).agg(*(F.max(F.when(F.col("_start") == 1, F.col(k))).alias(k) for k in before), *(F.max(F.when(F.col("_start") == 0, F.col(k))).alias(k) for k in after))


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """The weak ones among parts (place, s, o, e, k) that complementary ones are near and disjoint to."""
    name, secret = F.col("k").isin("access", "ident"), F.col("k").isin("assign", "hex", "value")
    one = _swept(parts, {"name_before": F.when(name, F.col("e")), "secret_before": F.when(secret, F.col("e"))}, {"name_after": F.when(name, F.col("s")), "secret_after": F.when(secret, F.col("s"))})
    # of the pairs that lie before an endpoint the one whose first part ends last, and of those after it the one whose second part starts first
    pair_before = F.when(name, F.col("secret_before")).when(secret, F.col("name_before"))
    pair_after = F.when(name, F.col("secret_after")).when(secret, F.col("name_after"))
    two = _swept(one, {"pair_before": pair_before}, {"pair_after": pair_after})

    def near(kind: str) -> Column:
        return (F.col(f"{kind}_before") >= F.col("s") - scope) | (F.col(f"{kind}_after") <= F.col("e") + scope)

    around = (F.col("secret_after") - F.col("name_before") <= scope) | (F.col("name_after") - F.col("secret_before") <= scope)
    return two.where(F.when(F.col("k") == "ident", near("secret")).when(F.col("k") == "value", near("name")).when(F.col("k") == "endpoint", F.coalesce(near("pair"), F.lit(False)) | F.coalesce(around, F.lit(False))))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) of every row."""
    text = F.col("text")
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select(
        "doc_id",
        _matches(text, ASSIGN, _long_enough(text, ASSIGN, 2, 6)).alias("assign"),
        # a run that is long enough is found whole, and a shorter one holds no match: the least length may be in the pattern
        _matches(text, "AKIA[A-Z0-9]{16,}", None).alias("access"),
        _matches(text, "[0-9a-f]{24,}", None).alias("hex"),
        _matches(text, IDENT, _long_enough(text, IDENT, 2, 3)).alias("ident"),
        _matches(text, VALUE, None).alias("value"),
        _matches(text, ENDPOINT, None).alias("endpoint"),
    )
    # two references to a column keep Spark from working it out anew within each of them
    found = found.select("doc_id", *(_placed(F.col(k)).alias(k) for k in KINDS))
    # spans only, no text; the place of a row is written with it
    found = settle(found.withColumn("place", F.monotonically_increasing_id()), "spans")
    some = [reduce(lambda a, b: a | b, (F.size(k) > 0 for k in kinds)) for kinds in (("access", "ident"), ("assign", "hex", "value"), ("ident", "value", "endpoint"))]
    every = F.concat(*(_named(F.col(k), k) for k in KINDS))
    parts = found.where(some[0] & some[1] & some[2]).select("place", F.explode(every).alias("p")).select("place", "p.s", "p.o", "p.e", "p.k")
    linked = _linked(parts, scope).groupBy("place").agg(F.collect_list(F.struct("s", "o", "e", "k")).alias("weak"))
    base = F.concat(*(_named(F.col(k), k) for k in KINDS[:3]))
    weak = F.coalesce("weak", F.array().cast("array<struct<s:int,o:int,e:int,k:string>>"))
    found = found.join(linked, "place", "left")
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, weak)).alias("spans"),
        F.size(weak).cast("long").alias("n_linked"),
    )
