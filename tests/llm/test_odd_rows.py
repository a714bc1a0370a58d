"""Nulls, blanks, repeats, long texts, clashing names and empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plumeflow.llm import chat, decontaminate, line_dedup, near_dups, packing, quality, secrets, site_bayes, suffix_dedup, token_rollup

ITEMS = "item_id long, text string"


def items(spark):
    return spark.createDataFrame([(1, None), (2, "the same short text"), (3, ""), (4, "the SAME short, text")], ITEMS)


def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (4, None, 1), (99, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": lambda s, d: quality.quality_table(d),
    "keep_good": lambda s, d: quality.keep_good(d),
    "lines": lambda s, d: line_dedup.deduplicated(d, cut_col="_which"),
    "secrets": lambda s, d: secrets.secret_spans(d),
    "contamination": lambda s, d: decontaminate.contamination(d, items(s)),
    "decontaminated": lambda s, d: decontaminate.decontaminated(d, items(s)),
    "bayes": lambda s, d: site_bayes.classified(d, labels(s), F.col("source"), F.col("lang")),
    "suffix": lambda s, d: suffix_dedup.removal_table(d),
    "near": lambda s, d: near_dups.near_duplicates(d),
    "packing": lambda s, d: packing.packed(d),
    "chat": lambda s, d: chat.rotated(d, "doc_id", "n_chars", "source", "text"),
    "counts": lambda s, d: token_rollup.with_counts(d.select("doc_id", "lang", "text"), "/opt/tokenizers/byte_bpe_50k.tiktoken"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, odd, name):
    assert OPERATORS[name](spark, odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("keep_good", "decontaminated", "packing", "chat")])
def test_a_row_for_each_row(spark, odd, name):
    assert OPERATORS[name](spark, odd).count() == odd.count()


def test_quality_of_odd_rows(spark, odd):
    rows = {r.doc_id: r for r in quality.quality_table(odd).collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept
    assert rows[5].n_words == 40_000 and rows[5].n_repeat_words == 40_000
    assert rows[8].n_dup_lines == 4 and rows[6].word_chars == 150_000
    assert quality.keep_good(odd).columns == odd.columns


def test_near_of_odd_rows(spark, odd):
    rows = near_dups.near_duplicates(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].component_id == 1 and by[1][0].n_shingles == 0 and by[1][0].kept
    assert all(r.component_id == 4 and r.kept and r.n_shingles == 1 for r in by[4])
    assert by[None][0].component_id == 4 and not by[None][0].kept
    assert all(r.kept for r in by[7])


def test_suffix_of_odd_rows(spark, odd):
    rows = suffix_dedup.removal_table(odd).collect()
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.n_bytes), []).append(r)
    assert by[(1, 0)][0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[(6, 150_000)][0].n_removed == 150_000 and by[(6, 150_000)][0].n_spans == 1
    assert by[(5, 200_000)][0].n_removed == 200_000


def test_lines_of_odd_rows(spark, odd):
    out = {}
    for r in line_dedup.deduplicated(odd, cut_col="_which").collect():
        out.setdefault(r.doc_id, []).append(r)
    assert out[1][0].text is None and out[2][0].text == ""
    assert out[8][0].text == "a line of some words that repeats" and out[8][0]._which == [1, 2, 3, 4]
    assert all(r.text == "the same short text" for r in out[4])


def test_contamination_of_odd_rows(spark, odd):
    for r in decontaminate.contamination(odd, items(spark)).collect():
        same = r.n_words == 4
        assert r.contaminated == same and r.n_items == (2 if same else 0)
        if same:
            assert r.items_sha256 == decontaminate.items_digest(["4", "2"])
    assert decontaminate.contamination(odd, spark.createDataFrame([], ITEMS)).where("contaminated").count() == 0


def test_packing_of_odd_rows(spark, odd):
    rows = packing.packed(odd, max_tokens=1000).collect()
    assert sum(r.n_tokens for r in rows if r.doc_id == 5) == 40_000 and len([r for r in rows if r.doc_id == 5]) == 40
    assert [r.n_tokens for r in rows if r.doc_id == 1] == [0]


def test_chat_of_odd_rows(spark, odd):
    rows = chat.rotated(odd, "doc_id", "n_chars", "source", "text").collect()
    assert {r.perspective for r in rows} == {"src1", "src2", "src3"}
