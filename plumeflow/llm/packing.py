"""Packing into length buckets of least padding.

Texts become pieces of at most ``max_tokens`` tokens.  The histogram of all
piece lengths, which has at most ``max_tokens`` + 1 rows, comes to the driver;
dynamic programming over it chooses the ``buckets`` upper lengths (any, or multiples of
``step``) with the least padding in total.  Each bucket's pieces are dealt into
slices by a hash, about ``slice_rows`` each, and in a slice consecutive pieces
form batches of ``budget`` tokens with padding, so that no bucket is sorted in
one task. Only the last batch of a slice may be short.

Tokens are runs of non-blank bytes, or what a given column counts.

Defined results.  A null or blank text is one piece of no tokens, in the
smallest bucket.  Repeated rows are packed as often as they occur; ties between
equal pieces are as good as each other, as they have equal rows.  Null ids are
packed too.  No rows give no batches.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import bounded_batches, settle
from .textkit import PLAIN_WORD, as_bytes, chunks, released, words


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = as_bytes(batch.column(1))
        counts = [np.diff(words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], PLAIN_WORD)[2]) for lo, hi in chunks(offsets)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=["doc_id", "n_tokens"])


def best_bounds(histogram: dict[int, int], buckets: int, step: int, most: int) -> list[int]:
    """Upper lengths, ascending, the last at least the longest: at most ``buckets`` multiples of step with the least padding."""
    longest = max(histogram, default=1)
    ends = np.arange(1, -(-max(longest, 1) // step) + 1) * step
    ends[-1] = min(ends[-1], max(most, longest))
    n = len(ends)
    count, total = np.zeros(n + 1), np.zeros(n + 1)
    for length, k in histogram.items():
        at = max(-(-length // step), 1)
        count[at] += k
        total[at] += k * length
    count, total = np.cumsum(count), np.cumsum(total)
    # pad[i, j]: padding of one bucket of the steps i .. j-1
    pad = ends[None, :] * (count[None, 1:] - count[:-1, None]) - (total[None, 1:] - total[:-1, None])
    pad[np.tril_indices(n, -1)] = np.inf
    cost, back = pad[0].copy(), []
    for _ in range(min(buckets, n) - 1):
        whole = cost[:-1, None] + pad[1:, :]
        choice = np.argmin(whole, axis=0)
        better = whole[choice, np.arange(n)]
        take = better < cost
        back.append(np.where(take, choice, -1))
        cost = np.where(take, better, cost)
    out, j = [], n - 1
    for level in reversed(back):
        if level[j] >= 0:
            out.append(int(ends[j]))
            j = int(level[j])
    return sorted([*out, int(ends[j])])


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None, max_tokens: int = 2048, buckets: int = 8, step: int = 1, budget: int = 32_768, slice_rows: int = 8192) -> DataFrame:
    """(doc_id, piece, n_tokens, bucket_len, slice, batch, place) of every piece."""
    if tokens_col is None:
        counted = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(_count_batches), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long")
    else:
        counted = docs.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(F.col(tokens_col), F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"))
    # rows that repeat are numbered, so that they too are dealt over all slices
    counted = settle(counted.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("times")), "counted").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_nth"))
    whole = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / max_tokens).cast("int")
    pieces = counted.select("doc_id", "n_tokens", "_nth", F.explode(F.sequence(F.lit(0), whole)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", "_nth", F.least(F.col("n_tokens") - F.col("piece") * max_tokens, F.lit(max_tokens)).cast("long").alias("n_tokens"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("n_tokens").count().collect()}  # max_tokens + 1 rows at most
    bounds = best_bounds(histogram, buckets, step, max_tokens)
    held = {b: sum(k for n, k in histogram.items() if lo < n <= b or n == 0 and lo == 0) for lo, b in zip([0, *bounds], bounds, strict=False)}
    bucket, slices, size = F.lit(None).cast("long"), F.lit(1), F.lit(1)
    for b in reversed(bounds):
        inside = F.col("n_tokens") <= b
        bucket = F.when(inside, F.lit(b).cast("long")).otherwise(bucket)
        slices = F.when(inside, F.lit(max(1, -(-held[b] // slice_rows)))).otherwise(slices)
        size = F.when(inside, F.lit(max(1, budget // b))).otherwise(size)
    dealt = pieces.withColumn("bucket_len", bucket).withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "_nth"), slices).cast("long")).withColumn("_size", size)
    rank = F.row_number().over(Window.partitionBy("bucket_len", "slice").orderBy("doc_id", "piece", "n_tokens", "_nth")) - 1
    return dealt.withColumn("_rank", rank).select("doc_id", F.col("piece").cast("long").alias("piece"), "n_tokens", "bucket_len", "slice", F.floor(F.col("_rank") / F.col("_size")).cast("long").alias("batch"), (F.col("_rank") % F.col("_size")).cast("long").alias("place"))
