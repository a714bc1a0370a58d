"""Quality rules with host verdicts.

Each document gets measures of its words, symbols, lines and repeated
windows.  Rule failures are summed by host; every rule has a beta prior, its mean the
rate of all documents and its strength by moments over the hosts: the weighted variance of
their rates, less what sampling alone would give, so that hosts of a few documents do not pass
for different ones. It shrinks the rates of small hosts; a host
whose shrunk rate reaches ``host_limit`` is condemned for that rule.  A
document goes if it fails a base rule, or if it fails a rule that its host is
condemned for.  A document that fails no rule is kept whatever its host.

Defined results.  A null or blank text has no words and fails ``few_words``.
A null host is one host of its own.  Rows are independent: repeated rows get
equal results, and count as often as they occur in their host's rates.  With
no rows the result is empty.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import bounded_batches, settle, small_or_shuffled, unused
from .textkit import PLAIN_WORD, RangeHash, as_bytes, byte_class, chunks, code_points, mix, released, words

#: Characters counted as symbols.
SYMBOLS = byte_class(lambda b: b in b"#*$%&|<>")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _lines(data: np.ndarray, offsets: np.ndarray, word_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the lines that have a word."""
    cut = np.flatnonzero(data == 0x0A)
    start = np.concatenate((offsets[:-1], cut + 1))
    row = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, cut, "right") - 1))
    order = np.lexsort((row, start))
    start, row = start[order], row[order]
    end = np.minimum(np.concatenate((start[1:] - 1, offsets[-1:])), offsets[row + 1])
    end = np.where(np.concatenate((row[1:] != row[:-1], [True])), offsets[row + 1], end) if len(row) else end
    has = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
    return start[has], end[has], row[has]


def measures(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The MEASURES of each text."""
    n = len(offsets) - 1
    start, end, rows = words(data, offsets, PLAIN_WORD)
    n_words = np.diff(rows)
    word_chars = _per_row(code_points(data) & PLAIN_WORD[data], offsets)
    n_symbols = _per_row(SYMBOLS[data], offsets)
    hashed = RangeHash(data)
    a, b, row = _lines(data, offsets, start)
    n_lines = np.bincount(row, minlength=n)
    _, first = np.unique(mix(hashed(a, b) ^ mix(row.astype(np.uint64))), return_index=True)
    n_dup = n_lines - np.bincount(row[first], minlength=n)
    word = hashed(start, end)
    owner = np.repeat(np.arange(n), n_words)
    n_repeat = np.zeros(n, np.int64)
    if len(word) >= 3:
        inside = owner[:-2] == owner[2:]
        three = mix(mix(word[:-2]) + word[1:-1] * np.uint64(0x9E3779B97F4A7C15) + (word[2:] ^ owner[2:].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))
        at = np.flatnonzero(inside)
        _, back, count = np.unique(three[at], return_inverse=True, return_counts=True)
        at = at[count[back] > 1]
        hit = np.zeros(len(word), bool)
        for k in range(3):
            hit[at + k] = True
        n_repeat = _per_row(hit, rows)
    return [n_words, word_chars, n_symbols, n_lines, n_dup, n_repeat]


def with_measures(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the MEASURES of ``text_col`` appended, under ``prefix`` if that is needed to avoid names of docs."""
    names = [prefix + m for m in MEASURES]
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(where))
            parts = [measures(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in chunks(offsets)]
            found = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in found)], names=[*batch.schema.names, *names])

    return bounded_batches(docs).mapInArrow(released(run), T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)]))


def rules(prefix: str = "", min_words: int = 50, repeat_pct: int = 50, symbol_pct: int = 10, dup_pct: int = 30) -> dict[str, Column]:
    """What a document fails, by rule; the first two are the base rules."""
    m = {k: F.col(prefix + k) for k in MEASURES}
    return {
        "few_words": m["n_words"] < min_words,
        "repetition": 100 * m["n_repeat_words"] > repeat_pct * m["n_words"],
        "symbols": 100 * m["n_symbols"] > symbol_pct * m["word_chars"],
        "dup_lines": 100 * m["n_dup_lines"] > dup_pct * m["n_lines"],
    }


BASE = ("few_words", "repetition")


def beta_strength(hosts: float, docs: float, squares: float, fails: float, spread: float, most: float = 1000.0) -> tuple[float, float]:
    """(mean, strength) of a beta prior over hosts of n documents with k failures each.

    From the number of hosts and the sums of n, n * n, k and k * k / n: the variance of k / n weighted by n, less its
    binomial part, gives the correlation within hosts, 1 / (strength + 1). The strength lies between 1 and ``most``.
    """
    mean = fails / docs if docs else 0.0
    binomial = mean * (1 - mean)
    room = docs - squares / docs - (hosts - 1) if docs else 0.0
    if binomial <= 0 or room <= 0:
        return mean, most
    within = ((spread - fails * mean) / binomial - (hosts - 1)) / room
    return mean, most if within <= 1 / (most + 1) else max(1 / within - 1, 1.0)


def host_verdicts(measured: DataFrame, host: Column, failing: dict[str, Column], host_limit: float, max_strength: float = 1000.0) -> DataFrame:
    """(_host, n_docs, rate_<rule>, bad_<rule>) of every host. The prior of each rule is one row of sums over the hosts."""
    by_host = settle(
        measured.groupBy(F.coalesce(host, F.lit("")).alias("_host")).agg(F.count("*").alias("n_docs"), *(F.sum(c.cast("long")).alias(f"n_{r}") for r, c in failing.items())),
        "hosts",
    )
    n = F.col("n_docs").cast("double")
    sums = by_host.agg(
        F.count("*").alias("hosts"),
        F.sum(n).alias("docs"),
        F.sum(n * n).alias("squares"),
        *(x for r in failing for x in (F.sum(f"n_{r}").cast("double").alias(f"k_{r}"), F.sum(F.col(f"n_{r}").cast("double") * F.col(f"n_{r}") / n).alias(f"s_{r}"))),
    ).first()
    out = by_host
    for r in failing:
        mean, strength = beta_strength(sums["hosts"], sums["docs"] or 0.0, sums["squares"] or 0.0, sums[f"k_{r}"] or 0.0, sums[f"s_{r}"] or 0.0, max_strength)
        rate = (F.col(f"n_{r}") + mean * strength) / (F.col("n_docs") + strength)
        out = out.withColumn(f"rate_{r}", rate).withColumn(f"bad_{r}", rate >= host_limit)
    return out


def judge(measured: DataFrame, host: Column, prefix: str = "", host_limit: float = 0.08, verdicts: DataFrame | None = None) -> DataFrame:
    """measured with base_failed, host_failed and kept (each under ``prefix``)."""
    failing = rules(prefix)
    if verdicts is None:
        verdicts = host_verdicts(measured, host, failing, host_limit)
    key, flag = f"{prefix}host_key", f"{prefix}host_bad_"
    side = small_or_shuffled(settle(verdicts.select(F.col("_host").alias(key), *(F.col(f"bad_{r}").alias(flag + r) for r in failing)), "verdicts"))
    joined = measured.withColumn(key, F.coalesce(host, F.lit(""))).join(side, key, "left")
    base = reduce(lambda a, b: a | b, (failing[r] for r in BASE))
    bad = reduce(lambda a, b: a | b, (c & F.col(flag + r) for r, c in failing.items()))
    return (
        joined.withColumn(f"{prefix}base_failed", base)
        .withColumn(f"{prefix}host_failed", F.coalesce(bad, F.lit(False)))
        .withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & ~F.col(f"{prefix}host_failed"))
        .drop(key, *(flag + r for r in failing))
    )


def quality_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.08) -> DataFrame:
    """Measures and verdict of every row, without its text."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    measured = settle(with_measures(narrow).drop("text"), "measures")
    return judge(measured, F.col("host"), host_limit=host_limit)


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", host_limit: float = 0.08) -> DataFrame:
    """The rows of docs that are kept, with their own columns. Texts are read twice and never shuffled."""
    p = unused(docs, "_q_")
    host = F.col(host_col).cast("string")
    lean = with_measures(docs.select(F.col(host_col), F.col(text_col)), text_col, p)
    verdicts = host_verdicts(lean, host, rules(p), host_limit)
    judged = judge(with_measures(docs, text_col, p), host, p, host_limit, verdicts)
    return judged.where(F.col(f"{p}kept")).select(*docs.columns)
