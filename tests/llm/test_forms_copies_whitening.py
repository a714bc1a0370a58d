"""Fill-in-the-middle forms, exact copies and whitening against plain re-implementations, with odd rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeflow.llm import exact_dedup, fim, queries, whitening


def plain_form(doc_id, text, seed=1):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    a, b, c = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    return len(units), *(("spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}") if h4 % 100 < 20 else ("psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"))


def test_forms(spark, odd, docs):
    more = [(k, t) for k, t in enumerate(["<P>", "x<S", ">a<<b>>" * 9, "\0\0a\0", "😀é\n" * 50, "<M", "S>", "P", "'quoted' {braces} \\1 %"] * 20, 100)]
    rows = odd.select("doc_id", "text").union(docs.select("doc_id", "text")).union(spark.createDataFrame(more, "doc_id long, text string"))
    out = fim.transformed(rows, batch_bytes=1 << 16).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((str(r.doc_id), *map(str, plain_form(r.doc_id, r.text)), r.text or "") for r in rows.collect())
    assert sorted((str(r.id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.back) for r in out) == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_forms_of_named_columns(spark):
    rows = spark.createDataFrame([("k1", "some words here", 1), (None, "others", 2)], "key string, body string, id int")
    out = {r.id: r for r in fim.transformed(rows, "key", "body", seed=7).collect()}
    assert {k: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for k, r in out.items()} == {k: plain_form(k, t, 7) for k, t in (("k1", "some words here"), (None, "others"))}
    assert fim.transformed(rows.limit(0), "key", "body").count() == 0


def plain_groups(rows):
    by = {}
    for i, (doc_id, text) in enumerate(rows):
        by.setdefault(re.sub("[ \t-\r]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, i, doc_id))
    out = []
    for bare, members in by.items():
        best = min(members)
        out += [(str(m[4]), str(best[4]), len(members), hashlib.sha256(bare.encode()).hexdigest()) for m in members]
    return sorted(out), len(by)


@pytest.mark.parametrize("prefix", [0, 3, 256])
def test_exact_copies(spark, odd, docs, prefix, monkeypatch):
    extra = [(900, "abc def"), (901, "abcd ef"), (902, "abc  def "), (903, "abcdeg"), (904, "xbcdef"), (905, "abc  def "), (None, "only null"), (None, "onlynull"), (906, " "), (906, " ")]
    rows = odd.select("doc_id", "text").union(docs.select("doc_id", "text")).union(spark.createDataFrame(extra, "doc_id long, text string"))
    want, n = plain_groups([tuple(r) for r in rows.collect()])
    for small in (True, False):  # keys go to texts, or digests go to keys
        monkeypatch.setattr(exact_dedup, "is_small", lambda side, small=small: small)
        out = exact_dedup.groups(rows, prefix=prefix, every_digest=True).collect()
        assert sorted((str(r.id), str(r.keep_id), r.group_size, r.sha) for r in out) == want
        assert sum(r.kept for r in out) == n and len({(r.sha) for r in out if r.kept}) == n
        assert all(r.id == r.keep_id for r in out if r.kept)
        found = exact_dedup.groups(rows, prefix=prefix).collect()
        assert sorted((str(r.id), str(r.keep_id), r.group_size, r.kept) for r in found) == sorted((str(r.id), str(r.keep_id), r.group_size, r.kept) for r in out)


def test_rows_that_stay(spark, odd):
    odd = odd.withColumns({"_length": F.lit(5), "sha": F.lit("s"), "twin": F.lit(None).cast("string")})
    kept = exact_dedup.deduplicated(odd)
    assert kept.columns == odd.columns
    _, n = plain_groups([(r.doc_id, r.text) for r in odd.collect()])
    rows = kept.collect()
    assert len(rows) == n and [r.doc_id for r in rows if (r.text or "").startswith("the same")] == [4]
    assert [r.text for r in rows if not (r.text or "").strip()] == [" \n\t\n "]
    for df in (exact_dedup.groups(odd.limit(0)), exact_dedup.deduplicated(odd.limit(0))):
        assert df.count() == 0


def test_copies_stay_in_the_jvm(spark, odd):
    for df in (exact_dedup.groups(odd), exact_dedup.deduplicated(odd)):
        assert not any(w in df._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))


def test_lanczos_against_eigh():
    random = np.random.default_rng(5)
    for d, block, basis, rank in ((40, 4, 24, 40), (60, 16, 128, 60), (30, 8, 30, 5), (5, 16, 128, 5), (64, 4, 200, 64), (80, 5, 30, 12)):
        a = random.standard_normal((d, rank)) * np.linspace(1, 3, rank)
        m = a @ a.T
        e, u = np.linalg.eigh(m)
        e, u = e[::-1], u[:, ::-1]
        values, vectors, residuals = whitening.block_lanczos(lambda q: m @ q, d, 10, block, basis)
        k = min(10, d)
        assert np.allclose(values, e[:k], rtol=1e-10, atol=1e-10 * e[0])
        sure = min(k, rank)
        assert np.allclose(np.abs((vectors[:, :sure] * u[:, :sure]).sum(axis=0)), 1, atol=1e-9)
        assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12) and residuals.max() <= 1e-11 * e[0]


def test_breakdown_finds_equal_eigenvalues():
    d = 40
    m = np.diag([5.0] * 12 + [1.0] * (d - 12))  # each start vector spans two dimensions only
    values, vectors, _ = whitening.block_lanczos(lambda q: m @ q, d, 16, block=3)
    assert np.allclose(values, [5.0] * 12 + [1.0] * 4, atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(16), atol=1e-12)


def test_whitening_of_odd_rows(spark):
    random = np.random.default_rng(2)
    rows = [(i, [float(v) for v in random.standard_normal(6) * [3, 2, 1, 1, 0.5, 0]]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    bad = [(2000, None), (2001, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] + [1.0] * 5), (2003, [float("inf")] + [1.0] * 5), (2004, [1.0]), (2005, []), (2006, [float("-inf")] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "x": F.lit(2), "whitened": F.lit("w")})
    out, fit = whitening.whitened(df)
    got = {r.id: r for r in out.collect()}
    assert set(got) == {r[0] for r in rows}
    x = np.floor(64 * np.array([r[1] for r in rows], dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    once = np.unique(x, axis=0)
    n, sums = len(once), once.sum(axis=0)
    v = np.cov(once.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:5], u[:, ::-1][:, :5]  # the last dimension is constant
    assert fit.n == n and np.allclose(fit.values, e, rtol=1e-9) and np.allclose(fit.explained, e / np.trace(v), rtol=1e-12) and fit.identity_error < 1e-10
    want = (x - sums / n) @ u / np.sqrt(e)
    have = np.array([got[r[0]].whitened for r in rows])
    assert np.allclose(have * np.sign((have * want).sum(axis=0)), want, atol=1e-8)
    assert [int(got[r[0]].deviation) for r in rows] == ((n * x - sums) ** 2).sum(axis=1).tolist()


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        out, fit = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert all(r.whitened == [] and r.deviation == 0 for r in out.collect()) and len(fit.values) == 0


def test_deviations_beyond_64_bits():
    x = np.array([[5, -7], [1 << 40, 3]], dtype=np.int64)
    sums = np.array([1 << 45, 9], dtype=np.int64)
    n = 1 << 20
    assert [int(v) for v in whitening.deviations(x, n, sums)] == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]
    small = whitening.deviations(x[:1], 3, np.array([1, 2]))
    assert small.tolist() == [(15 - 1) ** 2 + (-21 - 2) ** 2]


def test_whitening_query(spark):
    rows = queries.op13_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert rows.count() == 16 * 500 and rows.where("deviation is null or whitened is null").count() == 0
    first = rows.first()
    assert first.identity_error < 1e-4 and 0 < first.explained < 1
