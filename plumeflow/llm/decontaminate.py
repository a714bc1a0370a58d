"""Benchmark decontamination by a generalised suffix automaton.

Test items and documents are sequences of words (ASCII letters lower-cased;
runs of letters, digits and non-ASCII bytes).  The items' words go into one
automaton; each document streams through it, and the state and the length of
the longest match are tracked word by word.  Where the length reaches
``window``, the last ``window`` words are a window of some item, and the state
that holds them names the items.  An item of fewer words is one window.

Words that no item has reset the automaton to its root, so only runs of known
words are walked; this changes no result.

The items are counted first: up to ``max_words`` words make one automaton,
which goes to the executors as a broadcast of that bounded size, and is built
once in each Python worker; nothing is shuffled then.  More items are dealt into
blocks of about that size. The documents stream through each block by itself, so that a
worker holds one automaton at a time however many items there are; what a block finds, a row
for each document that it hits, is merged by text and joined back.

Defined results.  A null text, of a document or an item, has no words and
meets nothing.  Items with equal texts are all reported.  Items without an id
hit as others do, count together as one item, and are not in the digest of
ids.  Rows are independent, so that repeated rows get equal results; columns of any name pass
through.  No items: no hits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import BROADCAST_BYTES, bounded_batches, settle, unused
from .textkit import ALNUM_WORD, LOWER, RangeHash, as_bytes, chunks, released, words


class Automaton:
    """Generalised suffix automaton over integer sequences."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[int]] = []
        for _, seq in items:
            last, path = 0, []
            for c in seq:
                last = self._extend(last, c)
                path.append(last)
            ends.append(path)
        self._name(items, ends)

    def _new(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the strings of q up to those that p reaches by c."""
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _state_of(self, seq: list[int]) -> int:
        s = 0
        for c in seq:
            s = self.next[s][c]
        return s

    def _name(self, items, ends) -> None:
        """For each state the items of its window, and the short items that its strings end with."""
        n = len(self.length)
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.holder = [-1] * n  # the state with the strings of just ``window`` words
        for s in order:
            if self.length[s] >= self.window:
                up = self.link[s]
                self.holder[s] = s if self.length[up] < self.window else self.holder[up]
        self.items: dict[int, set[str]] = {}
        own: dict[int, list[tuple[int, str]]] = {}
        for (name, seq), _ in zip(items, ends, strict=True):
            if len(seq) >= self.window:
                s, l = 0, 0
                for c in seq:  # each window of the item, walked as a document is
                    s, l = self.step(s, l, c)
                    if l >= self.window:
                        self.items.setdefault(self.holder[s], set()).add(name)
            elif seq:
                own.setdefault(self._state_of(seq), []).append((len(seq), name))
        self.short: list[tuple] = [()] * n
        for s in order:
            up = self.short[self.link[s]]
            self.short[s] = (*own.get(s, ()), *up) if s in own else up

    def step(self, s: int, l: int, c: int) -> tuple[int, int]:
        while True:
            t = self.next[s].get(c)
            if t is not None:
                return t, l + 1
            if s == 0:
                return 0, 0
            s = self.link[s]
            l = self.length[s]

    def walk(self, seq: list[int], runs: list[list[int]], found: set[str], base: int) -> None:
        """Adds the hit runs [first, end) of words and the items met."""
        s = l = 0
        follow, link, length, short, holder, window = self.next, self.link, self.length, self.short, self.holder, self.window
        for at, c in enumerate(seq, base):
            while True:
                t = follow[s].get(c)
                if t is not None:
                    s, l = t, l + 1
                    break
                if s == 0:
                    l = 0
                    break
                s = link[s]
                l = length[s]
            size = 0
            if l >= window:
                found |= self.items[holder[s]]
                size = window
            if short[s]:
                for k, name in short[s]:
                    if k <= l:
                        found.add(name)
                        size = max(size, k)
            if size:
                lo = at + 1 - size
                while runs and runs[-1][1] >= lo:
                    lo = min(lo, runs.pop()[0])
                runs.append([lo, at + 1])


def item_words(column) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, per-text offsets)."""
    data, offsets = as_bytes(column)
    data = LOWER[data]
    start, end, rows = words(data, offsets, ALNUM_WORD)
    return RangeHash(data)(start, end), rows


_built: dict[str, tuple] = {}


class Block:
    """A bounded set of items, as executors get it; the automaton is built once in each Python worker."""

    def __init__(self, names: list[str], hashes: np.ndarray, rows: np.ndarray, window: int):
        self.names, self.hashes, self.rows, self.window = names, hashes, rows, window
        self.key = uuid.uuid4().hex

    def built(self):
        if self.key not in _built:  # one is kept
            _built.clear()
            _built[self.key] = self._build()
        return _built[self.key]

    def _build(self):
        vocabulary, ids = np.unique(self.hashes, return_inverse=True)
        ids = ids.tolist()
        counts = np.diff(self.rows)
        items = [(self.names[i], ids[self.rows[i] : self.rows[i + 1]]) for i in range(len(self.names))]
        some = counts[counts > 0]
        return vocabulary, Automaton(items, self.window), int(min(self.window, some.min())) if len(some) else 0


def _merge(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _ordered(names) -> list[str | None]:
    """Ids in order, that of items without one last."""
    return sorted(names, key=lambda x: (x is None, x or ""))


def _scan(where: int, block, added: list[str], only_hits: bool):
    """Appends _n_words, _runs (flat word indices) and _items to each row; with ``only_hits``, rows without a hit go, and the text as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, automaton, least = block.value.built()
        for batch in batches:
            data, offsets = as_bytes(batch.column(where))
            counts, all_runs, all_items = [], [], []
            for lo, hi in chunks(offsets):
                low = LOWER[data[offsets[lo] : offsets[hi]]]
                start, end, rows = words(low, offsets[lo : hi + 1] - offsets[lo], ALNUM_WORD)
                runs_of: dict[int, list] = {}
                items_of: dict[int, set] = {}
                if least and len(start):
                    hashes = RangeHash(low)(start, end)
                    ids = np.searchsorted(vocabulary, hashes)
                    ids[ids == len(vocabulary)] = 0
                    known = vocabulary[ids] == hashes
                    first, last = known.copy(), known.copy()
                    first[1:] &= ~known[:-1]
                    last[:-1] &= ~known[1:]
                    edge = rows[1:-1]
                    edge = edge[(edge > 0) & (edge < len(known))]
                    first[edge], last[edge - 1] = known[edge], known[edge - 1]
                    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
                    long = b - a >= least
                    a, b = a[long], b[long]
                    for i, x, y in zip((np.searchsorted(rows, a, "right") - 1).tolist(), a.tolist(), b.tolist(), strict=True):
                        automaton.walk(ids[x:y].tolist(), runs_of.setdefault(i, []), items_of.setdefault(i, set()), x - int(rows[i]))
                counts.extend(np.diff(rows).tolist())
                all_runs.extend(runs_of.get(i, []) for i in range(hi - lo))
                all_items.extend(_ordered(items_of.get(i, ())) for i in range(hi - lo))
            flat = [[x for p in r for x in p] for r in all_runs]
            columns, names = list(batch.columns), list(batch.schema.names)
            if only_hits:
                at = [i for i, r in enumerate(flat) if r]
                columns = [c.take(pa.array(at, pa.int64())) for i, c in enumerate(columns) if i != where]
                names = [n for i, n in enumerate(names) if i != where]
                counts, flat, all_items = ([x[i] for i in at] for x in (counts, flat, all_items))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(flat, pa.list_(pa.int32())), pa.array(all_items, pa.list_(pa.string()))], names=[*names, *added])

    return released(run)


def _count_and_merge(where: int, added: list[str]):
    """Rows with the lists of all blocks' runs and items appended to _n_words, _runs and _items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(where))
            counts = [n for lo, hi in chunks(offsets) for n in np.diff(words(LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], ALNUM_WORD)[2]).tolist()]
            *columns, runs, items = batch.columns
            merged = [_merge([list(p) for r in rs for p in zip(r[::2], r[1::2], strict=True)]) if rs else [] for rs in runs.to_pylist()]
            names = [_ordered({x for r in rs for x in r}) if rs else [] for rs in items.to_pylist()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array([[x for p in r for x in p] for r in merged], pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=[*batch.schema.names[:-2], *added])

    return released(run)


def with_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, max_words: int = 200_000) -> DataFrame:
    """docs with _n_words, _runs and _items appended; underscores are added to these names where docs has them."""
    spark = docs.sparkSession
    narrow = items.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).alias("text"))
    # a word needs a separator or the text's end: no text has more words than half its bytes and one
    bound = narrow.agg(F.sum(F.floor((F.octet_length("text") + 1) / 2))).first()[0] or 0
    blocks = max(1, -(-int(bound) // max_words))
    narrow = narrow.withColumn("_block", F.pmod(F.xxhash64("name", "text"), F.lit(blocks)))
    names = [unused(docs, n) for n in ("_n_words", "_runs", "_items")]
    more = T.StructType().add(names[0], T.LongType()).add(names[1], T.ArrayType(T.IntegerType())).add(names[2], T.ArrayType(T.StringType()))
    schema = T.StructType([*docs.schema.fields, *more.fields])

    def block(k: int):
        table = narrow.where(F.col("_block") == k).select("name", "text").orderBy("name", "text").toArrow()
        hashes, rows = item_words(table.column("text"))
        return spark.sparkContext.broadcast(Block(table.column("name").to_pylist(), hashes, rows, window))

    docs = bounded_batches(docs)
    where = docs.columns.index(text_col)
    if blocks == 1:
        return docs.mapInArrow(_scan(where, block(0), names, only_hits=False), schema)
    ids = [F.xxhash64(text_col), F.xxhash64(text_col, F.lit(1))]  # what a text meets depends on the text alone
    texts = docs.select(ids[0].alias("h"), ids[1].alias("i"), F.col(text_col).alias("text"))
    found = None
    for k in range(blocks):
        own = settle(texts.mapInArrow(_scan(2, block(k), ["n", "runs", "items"], only_hits=True), "h long, i long, n long, runs array<int>, items array<string>"), "hits")
        found = own if found is None else found.union(own)
    h, i, runs, met = (unused(docs, x) for x in ("_h", "_i", "_found", "_met"))
    merged = settle(found.groupBy(F.col("h").alias(h), F.col("i").alias(i)).agg(F.collect_set("runs").alias(runs), F.collect_set("items").alias(met)), "merged")
    rows = merged.agg(F.sum(F.size(runs))).first()[0] or 0
    side = F.broadcast(merged) if rows * 512 <= BROADCAST_BYTES else merged
    joined = docs.join(side, (ids[0] == F.col(h)) & (ids[1] == F.col(i)), "left").select(*docs.columns, runs, met)
    return joined.mapInArrow(_count_and_merge(where, names), schema)


def _hit(runs: list[int]) -> int:
    return sum(runs[1::2]) - sum(runs[::2])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, per_hit: int = 20, **more) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row: contaminated if hit words are one of ``per_hit`` or more."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hits = with_hits(narrow, items, window=window, **more).drop("text")
    runs = F.col("_runs")
    n_hit = F.aggregate(F.transform(runs, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x).cast("long")
    out = hits.select("doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (per_hit * F.col("n_hit") >= F.col("n_words")))


def _cut(where: int, per_hit: int):
    """Drops contaminated rows, and cuts the hit runs of words from the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, runs, texts = batch.column(batch.num_columns - 3).to_pylist(), batch.column(batch.num_columns - 2), batch.column(where)
            keep, new = [], {}
            for i in range(batch.num_rows):
                own = runs[i].as_py()
                n = _hit(own)
                if n and per_hit * n >= n_words[i]:
                    continue
                keep.append(i)
                if n:
                    raw = texts[i].as_py().encode()
                    data = LOWER[np.frombuffer(raw, np.uint8)]
                    start, end, _ = words(data, np.array([0, len(data)]), ALNUM_WORD)
                    out, at = [], 0
                    for lo, hi in zip(own[::2], own[1::2], strict=True):
                        out.append(raw[at : start[lo]])
                        at = end[hi - 1]
                    new[i] = b"".join([*out, raw[at:]]).decode()
            picked = batch.take(pa.array(keep, pa.int64()))
            columns = list(picked.columns[:-3])
            if new:
                columns[where] = pa.array([new.get(i, texts[i].as_py()) for i in keep], columns[where].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-3])

    return released(run)


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", per_hit: int = 20, **more) -> DataFrame:
    """docs without contaminated rows; of the others, hit runs of words are cut from the text. Columns stay."""
    hits = with_hits(docs, items, text_col=text_col, **more)
    return hits.mapInArrow(_cut(docs.columns.index(text_col), per_hit), docs.schema)


def items_digest(names: list[str]) -> str:
    """The digest of a list of item ids, as in the query's column."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
