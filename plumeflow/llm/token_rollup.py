"""Delta-maintained token totals by source, language and tokenizer version.

A batch is a table of events: inserts (+1 document, +tokens), deletes (-1,
-tokens) and revisions of a count (0, new - old).  ``commit`` sums a batch by
key, adds the sums to the totals of the last version and writes the new totals, a row
for each key.  A version exists once its manifest does: a small file that names the totals and
the last batches in them, written under another name and renamed into place, which only one writer can do for a version. Who comes second adds the same
sums to the newer totals; a batch that is committed is not applied again, whoever retries it.
Ids of batches before the last ones lie in a table in buckets, so that neither a manifest nor a look-up grows with all history.
A manifest that cannot be read (of a store whose renames are not whole, say) is passed over: its version never was.
So totals are kept, not summed anew from all history, and a reader sees whole batches.
Totals before the last but one are deleted.

Defined results.  Null keys are keys of their own; null counts are 0.  Events
that repeat within a batch count as often as they occur (or as ``times`` says): a batch, not an event,
is applied once.  An empty batch commits and changes nothing.  Keys whose
documents and tokens are all gone are left out of the totals. Columns of events beyond
those named are not read.
"""

from __future__ import annotations

import base64
import json
import random
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import shared
from .storage import bounded_batches, drop, settle
from .textkit import PLAIN_WORD, as_bytes, chunks, released, words

KEYS = ["source", "lang", "tokenizer"]
#: Batch ids in a manifest, after which they go to the table of older ones; its buckets; and tries of a commit.
RECENT, BUCKETS, ATTEMPTS = 100, 64, 20
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(op: Column, tokens: Column, old: Column) -> tuple[Column, Column]:
    """(documents, tokens) that an event adds."""
    tokens, old = F.coalesce(tokens, F.lit(0)), F.coalesce(old, F.lit(0))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
    return docs, F.when(op == "insert", tokens).when(op == "delete", -tokens).when(op == "revise", tokens - old).otherwise(0)


class Ledger:
    """Totals and their versions under one folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        """Manifests, the newest first."""
        return [n for n in reversed(shared.names(self.spark, f"{self.path}/manifest")) if n.endswith(".json") and n[:1] not in "._"]

    def _read(self, name: str) -> dict | None:
        """A manifest; None if it is torn."""
        stream = self._fs.open(self._at(f"{self.path}/manifest/{name}"))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()
        return found if isinstance(found, dict) and {"totals", "before", "recent"} <= set(found) else None

    def _latest(self) -> dict:
        """The newest manifest that can be read, with the number of the next one; before the first, one without totals."""
        names = self._names()
        following = int(names[0].removesuffix(".json")) + 1 if names else 1
        for name in names:
            if found := self._read(name):
                return found | {"next": following}
        return {"totals": None, "before": None, "recent": [], "next": following}

    def _has(self, manifest: dict, batch_id: str) -> bool:
        """True if a batch was committed by this manifest or before: it is among the recent ones, or in its bucket of the table of older ones."""
        if batch_id in manifest["recent"]:
            return True
        folder = f"{self.path}/batches"
        if not shared.exists(self.spark, folder):
            return False
        rows = self.spark.read.schema("batch_id string, bucket int").parquet(folder)
        return not rows.where((F.col("bucket") == self._bucket(F.lit(batch_id))) & (F.col("batch_id") == batch_id)).isEmpty()

    @staticmethod
    def _bucket(batch_id: Column) -> Column:
        return F.pmod(F.hash(batch_id), F.lit(BUCKETS)).cast("int")

    def _folded(self, recent: list[str]) -> list[str]:
        """recent, or, when it has become long, an empty list, its ids being added to the table. They are committed, so that adding them twice does no harm."""
        if len(recent) < RECENT:
            return recent
        rows = self.spark.createDataFrame([(b,) for b in recent], "batch_id string").withColumn("bucket", self._bucket(F.col("batch_id")))
        rows.repartition(1).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/batches")
        return []

    def committed(self, batch_id: str) -> bool:
        return self._has(self._latest(), batch_id)

    def commit(self, batch_id: str, events: DataFrame, seen: dict | None = None) -> bool:
        """events: source, lang, tokenizer, op, n_tokens, old_tokens, and times (1) if they stand for several. False if the batch was there already.

        ``seen`` is the manifest that the writer starts from, the last one by default. A writer that others are ahead of
        tries again, a little later each time, and gives up after ATTEMPTS.
        """
        last = seen or self._latest()
        if self._has(last, batch_id):
            return False
        docs, tokens = signed(F.col("op"), F.col("n_tokens"), F.col("old_tokens"))
        times = F.coalesce(F.col("times"), F.lit(1)) if "times" in events.columns else F.lit(1)
        sums = settle(events.groupBy(*KEYS).agg(F.sum(docs * times).cast("long").alias("n_docs"), F.sum(tokens * times).cast("long").alias("n_tokens")), "sums")
        try:
            for attempt in range(ATTEMPTS):
                path = f"{self.path}/totals/{uuid.uuid4().hex}"
                self._merged(last, sums).write.parquet(path)
                manifest = {"version": last["next"], "totals": path, "before": last["totals"], "recent": [*self._folded(last["recent"]), batch_id]}
                if shared.publish(self.spark, f"{self.path}/manifest/{last['next']:012d}.json", json.dumps(manifest)):
                    if last["before"]:
                        self._fs.delete(self._at(last["before"]), True)
                    return True
                self._fs.delete(self._at(path), True)  # another writer was first
                time.sleep(random.uniform(0, min(2**attempt, 32) / 20))
                last = self._latest()
                if self._has(last, batch_id):
                    return False
        finally:
            drop(sums)
        raise RuntimeError(f"{ATTEMPTS} other commits came before that of batch {batch_id}")

    def _merged(self, manifest: dict, sums: DataFrame | None = None) -> DataFrame:
        rows = self.spark.read.schema(SUMS).parquet(manifest["totals"]) if manifest["totals"] else self.spark.createDataFrame([], SUMS)
        if sums is None:
            return rows
        both = rows.unionByName(sums).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return both.where("n_docs != 0 or n_tokens != 0")

    def totals(self) -> DataFrame:
        return self._merged(self._latest())


_encoders: dict[str, object] = {}


def _encoder(path: str):
    """A byte-level BPE from a file of ranks, loaded once in each Python worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def with_counts(docs: DataFrame, ranks_path: str, text_col: str = "text", revised_col: str | None = None) -> DataFrame:
    """docs without its texts, with n_bpe and n_plain (runs of non-blank bytes); with ``revised_col`` also m_bpe and m_plain of that text, and revised: whether it differs."""
    taken = [docs.columns.index(c) for c in (text_col, revised_col) if c is not None]
    rest = [i for i in range(len(docs.columns)) if i not in taken]
    names = ["n_bpe", "n_plain"] + (["m_bpe", "m_plain", "revised"] if revised_col else [])

    def plain(column) -> list[int]:
        data, offsets = as_bytes(column)
        return [n for lo, hi in chunks(offsets) for n in np.diff(words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], PLAIN_WORD)[2]).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path)
        for batch in batches:
            column = batch.column(taken[0])
            texts = column.to_pylist()
            bpe, of = [len(encoder.encode_ordinary(t)) if t else 0 for t in texts], plain(column)
            out = [pa.array(bpe, pa.int64()), pa.array(of, pa.int64())]
            if revised_col:
                other = batch.column(taken[1])
                new = other.to_pylist()
                differs = [a != b for a, b in zip(texts, new, strict=True)]
                out.append(pa.array([(len(encoder.encode_ordinary(t)) if t else 0) if d else n for t, d, n in zip(new, differs, bpe, strict=True)], pa.int64()))
                out += [pa.array(plain(other), pa.int64()), pa.array(differs, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *out], names=[*(batch.schema.names[i] for i in rest), *names])

    schema = T.StructType([*(docs.schema.fields[i] for i in rest), *(T.StructField(n, T.BooleanType() if n == "revised" else T.LongType()) for n in names)])
    return bounded_batches(docs).mapInArrow(released(run), schema)
