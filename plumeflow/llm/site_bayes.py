"""Hierarchical empirical Bayes quality classifier.

Evidence.  Two logistic models, for low quality and for toxicity, over hashed
words (presence) and a few ratios of the text, trained here on at most
``sample`` labelled documents (the first by a hash of their id).  A document's
evidence is the probability that it is neither.

Sites.  Evidence is summed by path and by host with grouped aggregation.  The
global rate is the prior of each host, and a host's posterior the prior of its paths. How many
documents a prior counts for comes by moments: the variance of evidence within sites
over the variance between sites, which is that of their means (weighted by documents) less what the
variance within explains; for hosts between hosts, for paths between the paths of one host.
Sparse sites so shrink toward their host, and sparse hosts toward the global rate.

A document's posterior odds are its own odds times the odds of its path
relative to the global ones.  It is kept if the posterior reaches ``least``.

Defined results.  A null or blank text has no words and only constant
evidence.  Null hosts and paths are sites of their own.  Labels of unknown
documents, and null labels, are ignored; of contradicting labels of one document the worse one counts; if a label has fewer than two
values among those in use, its model is the constant rate.  Repeated rows count as
often as they occur.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import measures
from .storage import bounded_batches, settle, small_or_shuffled
from .textkit import ALNUM_WORD, LOWER, RangeHash, as_bytes, byte_class, chunks, released, words

HASH_BITS = 18
RATIOS = 8
_UPPER = byte_class(lambda b: 0x41 <= b <= 0x5A)
_DIGIT = byte_class(lambda b: 0x30 <= b <= 0x39)
_MARK = byte_class(lambda b: 0x21 <= b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7E)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ratios of each text, hashed distinct words, per-text offsets)."""
    n_words, word_chars, n_symbols, n_lines, n_dup, n_repeat = (m.astype(float) for m in measures(data, offsets))

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)

    ratios = np.stack(
        [
            np.log1p(n_words) / 10,
            np.minimum(word_chars / np.maximum(n_words, 1), 20) / 10,
            np.minimum(n_symbols / np.maximum(word_chars, 1), 1),
            n_dup / np.maximum(n_lines, 1),
            n_repeat / np.maximum(n_words, 1),
            share(_UPPER),
            share(_DIGIT),
            share(_MARK),
        ],
        axis=1,
    )
    low = LOWER[data]
    start, end, rows = words(low, offsets, ALNUM_WORD)
    hashed = (RangeHash(low)(start, end) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    distinct = np.unique(owner << HASH_BITS | hashed)
    return ratios, distinct & ((1 << HASH_BITS) - 1), np.searchsorted(distinct >> HASH_BITS, np.arange(len(offsets)))


class Logistic:
    """Logistic regression on ratios and the presence of telling words."""

    def __init__(self, words_: np.ndarray, ratios: np.ndarray, bias: float):
        self.words, self.ratios, self.bias = words_, ratios, bias

    def logit(self, ratios: np.ndarray, hashed: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.words[hashed])))
        return (sums[at[1:]] - sums[at[:-1]]) + ratios @ self.ratios + self.bias

    @classmethod
    def trained(cls, y: np.ndarray, ratios: np.ndarray, hashed: np.ndarray, at: np.ndarray, telling: float = 4.0, rounds: int = 300, rate: float = 0.3, decay: float = 1e-4) -> Logistic:
        share = float(y.mean()) if len(y) else 0.0
        if not 0 < share < 1:
            return cls(np.zeros(1 << HASH_BITS), np.zeros(RATIOS), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
        owner = np.repeat(np.arange(len(y)), np.diff(at))
        # words that tell: their odds in the two classes differ by ``telling`` standard errors
        yes = np.bincount(hashed, y[owner], 1 << HASH_BITS)
        no = np.bincount(hashed, 1 - y[owner], 1 << HASH_BITS)
        n_yes, n_no = float(y.sum()), float(len(y) - y.sum())
        odds = np.log((yes + 0.5) / (n_yes - yes + 0.5)) - np.log((no + 0.5) / (n_no - no + 0.5))
        error = np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5) + 1 / (n_yes - yes + 0.5) + 1 / (n_no - no + 0.5))
        tells = (np.abs(odds) > telling * error) & (yes + no >= 5)
        used = tells[hashed]
        slot = np.cumsum(tells) - 1
        h, o = slot[hashed[used]], owner[used]
        n = int(tells.sum())
        w, r, b = np.zeros(n), np.zeros(RATIOS), float(np.log(share / (1 - share)))
        gw, gr, gb = np.full(n, 1e-6), np.full(RATIOS, 1e-6), 1e-6
        for _ in range(rounds):  # AdaGrad over all rows
            z = np.bincount(o, w[h], len(y)) + ratios @ r + b
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
            g = np.bincount(h, d[o], n) + decay * w
            q = ratios.T @ d
            gw += g * g
            gr += q * q
            gb += float(d.sum()) ** 2
            w -= rate * g / np.sqrt(gw)
            r -= rate * q / np.sqrt(gr)
            b -= rate * float(d.sum()) / np.sqrt(gb)
        full = np.zeros(1 << HASH_BITS)
        full[tells] = w
        return cls(full, r, b)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = as_bytes(batch.column("text"))
        for lo, hi in chunks(offsets):
            ratios, hashed, at = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays(
                [batch.column("quality").slice(lo, hi - lo), batch.column("toxic").slice(lo, hi - lo), pa.array([x.tobytes() for x in ratios], pa.binary()), pa.array([hashed[at[i] : at[i + 1]].astype(np.int32).tobytes() for i in range(hi - lo)], pa.binary())],
                names=["quality", "toxic", "ratios", "hashed"],
            )


def train(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[Logistic, Logistic]:
    """(low quality, toxic). docs: doc_id, text; labels: doc_id, quality, toxic. At most ``sample`` rows come to the driver, as features."""
    chosen = settle(labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labels")
    rows = docs.join(small_or_shuffled(chosen), "doc_id").select("text", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    table = rows.mapInArrow(_feature_batches, "quality int, toxic int, ratios binary, hashed binary").toArrow()
    packed = table.column("hashed").to_pylist()
    order = np.array(sorted(range(len(packed)), key=packed.__getitem__), np.int64)  # sums in one order on any cluster
    ratios = np.frombuffer(b"".join(table.column("ratios").to_pylist()), float).reshape(-1, RATIOS)[order]
    parts = [np.frombuffer(packed[i], np.int32) for i in order]
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    hashed = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    quality = np.array(table.column("quality").to_pylist(), float)[order] if len(order) else np.zeros(0)
    toxic = np.array(table.column("toxic").to_pylist(), float)[order] if len(order) else np.zeros(0)
    return Logistic.trained(1 - quality, ratios, hashed, at), Logistic.trained(toxic, ratios, hashed, at)


def _score_batches(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low_quality, toxic = models.value
        for batch in batches:
            data, offsets = as_bytes(batch.column(3))
            for lo, hi in chunks(offsets):
                found = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                bad, tox = (1 / (1 + np.exp(-np.clip(m.logit(*found), -30, 30))) for m in (low_quality, toxic))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(3)), pa.array(bad), pa.array(tox)], names=["doc_id", "host", "path", "p_low", "p_toxic"])

    return released(run)


def _credibility(spread: float, squares: float, sites: float, groups: float, docs: float, within: float, most: float) -> float:
    """Documents that a prior counts for: variance within sites over that between them.

    spread: sum of n * (mean of the site - mean of its group) ** 2; squares: docs less the sum of n * n / n of the group.
    """
    free = docs - sites
    inside = within / free if free > 0 else 0.0
    between = (spread - (sites - groups) * inside) / squares if squares > 0 else 0.0
    if between <= 0:
        return most
    return min(max(inside / between, 1.0), most)


def strengths(paths: DataFrame, most: float) -> tuple[float, float, float]:
    """(mean over all documents, strength of the prior of hosts, of paths). paths: host, path, n, good, good2 (sum of squares)."""
    hosts = paths.groupBy("host").agg(F.count("*").alias("paths"), F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("good2").alias("good2"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("by_path"))
    r = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("paths").alias("paths"),
        F.sum("n").alias("n"),
        F.sum("good").alias("good"),
        F.sum("good2").alias("good2"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("nn") / F.col("n")).alias("nn_in"),
        F.sum(F.col("good") * F.col("good") / F.col("n")).alias("by_host"),
        F.sum("by_path").alias("by_path"),
    ).first()
    if not r["n"]:
        return 0.5, most, most
    mean = r["good"] / r["n"]
    host = _credibility(r["by_host"] - r["good"] * mean, r["n"] - r["nn"] / r["n"], r["hosts"], 1, r["n"], r["good2"] - r["by_host"], most)
    path = _credibility(r["by_path"] - r["by_host"], r["n"] - r["nn_in"], r["paths"], r["hosts"], r["n"], r["good2"] - r["by_path"], most)
    return min(max(mean, 1e-6), 1 - 1e-6), host, path


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classified(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, least: float = 0.5, most: float = 1000.0) -> DataFrame:
    """(doc_id, p_low, p_toxic, host_rate, path_rate, posterior, kept) of every row."""
    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    models = docs.sparkSession.sparkContext.broadcast(train(rows.select("doc_id", "text"), labels, sample))  # 2 ** HASH_BITS weights each
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("p_low", T.DoubleType()), T.StructField("p_toxic", T.DoubleType())])
    scored = settle(rows.mapInArrow(_score_batches(models), schema), "scores")
    good = (1 - F.col("p_low")) * (1 - F.col("p_toxic"))
    paths = settle(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(good).alias("good"), F.sum(good * good).alias("good2")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    mean, k_host, k_path = strengths(paths, most)
    hosts = hosts.select("host", ((F.col("good") + mean * k_host) / (F.col("n") + k_host)).alias("host_rate"))
    sites = paths.join(hosts, "host").select("host", "path", "host_rate", ((F.col("good") + F.col("host_rate") * k_path) / (F.col("n") + k_path)).alias("path_rate"))
    joined = scored.join(small_or_shuffled(settle(sites, "sites")), ["host", "path"])
    z = _logit(good) + _logit(F.col("path_rate")) - float(np.log(mean / (1 - mean)))
    out = joined.withColumn("posterior", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", "p_low", "p_toxic", "host_rate", "path_rate", "posterior", (F.col("posterior") >= least).alias("kept"))
