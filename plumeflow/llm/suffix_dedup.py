"""Removal of passages that occur more than once, by suffix arrays over content-anchored groups.

A byte goes if it is in a string of ``length`` bytes that also starts anywhere
else in the input, in the same text or another.

Anchors.  Every start of such a string is given to one anchor: the position
with the least hash of the GRAM bytes that follow it, among the first
``reach`` positions of the string.  Equal strings have their anchors at the
same offset, so they meet among the starts of equal anchor blocks (the bytes
that every string of the anchor has in common).  An anchor's context is the
bytes from its first start to the end of its last string.

1. Map: texts, long ones in overlapping pieces, to anchors, with hashes of block and
   context. Equal contexts fall together with partial sums before the shuffle; what
   occurs twice goes whole. Blocks with one context are done with.
2. Where one block has several contexts, these come together by block.  They
   are cut into cells of CELL bytes, counted from the anchor, and the
   suffix array of all cells is built by linear grouping (``suffix_sort``).
   The spans are read from its order: between neighbours the common prefix is
   measured in cells and bytes, and where neighbours share the cells that any string
   of ``length`` bytes holds whole, the bytes before these are taken in one by one:
   a start is repeated where ``b`` bytes before the first cell are equal and the
   common prefix from there reaches ``length - b``.
3. Blocks with more than ``hot`` different contexts are not brought together, whatever
   their number: each string of theirs becomes a row, and rows are counted by block,
   offset and hash, with partial sums before the shuffle.
4. Spans go back to their texts. Contexts that make up a thousandth of all rows or more, a
   thousand at most, are broadcast for that, the others are joined.

Defined results.  A null text is empty.  Rows are independent occurrences:
repeated rows are copies, and texts of ``length`` bytes or more lose all their
bytes.  Rows that share a doc_id are told apart by their text.  An empty table
gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, drop, is_small, settle
from .suffix_sort import suffix_array
from .textkit import CHUNK, RangeHash, as_bytes, chunks, mix, released

GRAM, CELL = 24, 50
_PLACE = 28  # bits of a position; the others are of the hash
_LOW = np.uint64((1 << _PLACE) - 1)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
ANCHORS = "doc_id long, th long, a int, s0 int, s1 int, bh long, ch long"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, reach: int):
    """(text, anchor, first start, last start, block hash, context hash) of all anchors; places count from the text's start."""
    n = len(data)  # bounded: longer texts come in pieces
    sizes = np.diff(offsets)
    edge = np.zeros(n + 1, np.int32)
    long = sizes >= length
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge)[:n] > 0)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashed = RangeHash(data)
    at = np.arange(n - GRAM + 1)
    key = np.full(-(-(n + reach) // reach) * reach, _MOST)
    key[: len(at)] = (hashed(at, at + GRAM) & ~_LOW) | at.astype(np.uint64)
    blocks = key.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = (np.minimum(behind[starts], ahead[starts + reach - 1]) & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    a, s0 = chosen[new], starts[new]
    s1 = starts[np.concatenate((new[1:], [len(starts)])) - 1]
    row = np.searchsorted(offsets, a, "right") - 1
    block = hashed(a, a + (length - reach + 1))
    context = mix(hashed(s0, s1 + length) ^ mix((a - s0).astype(np.uint64)))
    base = offsets[row]
    return row, a - base, s0 - base, s1 - base, block, context


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int, piece: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the piece in its text, bytes, offsets): runs of whole texts, and long texts in pieces that share no start."""
    for lo, hi in chunks(offsets, piece):
        own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if hi - lo > 1 or len(own) <= 2 * piece:
            yield lo, 0, own, at
            continue
        for begin in range(0, len(own) - length + 1, piece):
            part = own[begin : begin + piece + length - 1]
            yield lo, begin, part, np.array([0, len(part)])


def _anchor_batches(length: int, reach: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(2))
            for lo, begin, part, own in _pieces(data, offsets, length, piece):
                row, a, s0, s1, block, context = anchors(part, own, length, reach)
                who = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(who), batch.column(1).take(who), *(pa.array(x + begin, pa.int32()) for x in (a, s0, s1)), pa.array(block.view(np.int64)), pa.array(context.view(np.int64))],
                    names=["doc_id", "th", "a", "s0", "s1", "bh", "ch"],
                )

    return released(run)


def _context_batches(length: int):
    """Texts with the list of their anchors to (bh, ch, n, left, context bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            wanted = batch.column("wanted")
            out: list[list] = [[], [], [], [], []]
            size = 0
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                for w in wanted[i].as_py():
                    part = raw[w["s0"] : w["s1"] + length]
                    for x, v in zip(out, (w["bh"], w["ch"], w["n"], w["a"] - w["s0"], part), strict=True):
                        x.append(v)
                    size += len(part)
                if size > 4 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True))], names=["bh", "ch", "n", "l", "context"])
                    out, size = [[], [], [], [], []], 0

    return released(run)


def _cells(group: list[int], left: list[int], raw: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(ranks of all cells in the order of their bytes, the rest after a context's last cell having one of its own; of each cell its context and its place in it)."""
    cells: list[tuple[int, bytes, int]] = []
    owner, place = [], []
    for x, (g, l, r) in enumerate(zip(group, left, raw, strict=True)):
        for at in range(l % CELL, len(r) + 1, CELL):
            part = r[at : at + CELL]
            cells.append((g, part, -1 if len(part) == CELL else x))
            owner.append(x)
            place.append(at)
    rank = {c: k for k, c in enumerate(sorted(set(cells)))}
    return [rank[c] for c in cells], np.array(owner), np.array(place)


def _repeated(group: list[int], left: list[int], raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of the strings that occur in another context, from the order of the cells' suffixes."""
    text, owner, place = _cells(group, left, raw)
    order = np.array(suffix_array(text))
    data = np.frombuffer(b"".join(raw), np.uint8)
    base = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    need = (length - CELL + 1) // CELL
    most = -(-length // CELL)
    cells = np.concatenate((text, -1 - np.arange(most)))
    # bytes that neighbours of the order have in common, up to ``length``
    i, j = order[:-1], order[1:]
    same = np.ones(len(i), bool)
    shared = np.zeros(len(i), np.int64)
    for k in range(most):
        same &= cells[i + k] == cells[j + k]
        shared += same
    close = np.flatnonzero((shared >= need) & (shared < most))
    common = shared * CELL
    if len(close):
        at = [base[owner[e[close]]] + place[e[close]] + common[close] for e in (i, j)]
        room = np.minimum(base[owner[i[close]] + 1] - at[0], base[owner[j[close]] + 1] - at[1])
        step = np.arange(CELL)
        last = len(data) - 1
        equal = (data[np.minimum(at[0][:, None] + step, last)] == data[np.minimum(at[1][:, None] + step, last)]) & (step < room[:, None])
        common[close] += np.where(equal.all(axis=1), CELL, equal.argmin(axis=1))
    joined = np.concatenate(([False], shared >= need))
    who = np.flatnonzero(joined | np.concatenate((joined[1:], [False])))
    if not len(who):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = np.cumsum(~joined)[who]
    common = np.concatenate(([0], common))[who]  # with the one before
    x, first = owner[order[who]], place[order[who]]
    # the bytes before the cell, one at a time: ``back`` names what is equal so far
    _, back = np.unique(run, return_inverse=True)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for b in range(CELL):
        ahead = np.cumsum(np.concatenate(([True], (run[1:] != run[:-1]) | (common[1:] < length - b))))
        _, inverse, times = np.unique(ahead * (len(back) + 1) + back, return_inverse=True, return_counts=True)
        hit = times[inverse] > 1
        found.append((x[hit], first[hit] - b))
        # one more byte; what is alone in its run from here on is done with
        some = first > b
        byte = np.where(some, data[np.maximum(base[x] + first - b - 1, 0)], 0).astype(np.int64)
        _, back, times = np.unique(back * 256 + byte, return_inverse=True, return_counts=True)
        keep = some & (times[back] > 1)
        if not keep.any():
            break
        # the least common prefix with those that go is carried to the next that stays
        slot = np.cumsum(keep)
        least = np.full(int(slot[-1]) + 1, length, np.int64)
        np.minimum.at(least, np.where(keep, slot - 1, slot), common)
        common = least[:-1]
        x, first, back, run = x[keep], first[keep], back[keep], run[keep]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _compare(group: list[int], left: list[int], raw: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(context, first, last start that is repeated), starts counted from the context's own."""
    who, start = _repeated(group, left, raw, length)
    if not len(who):
        return []
    order = np.lexsort((start, who))
    who, start = who[order], start[order]
    cut = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1))))
    return list(zip(who[cut].tolist(), start[cut].tolist(), start[np.concatenate((cut[1:], [len(start)])) - 1].tolist(), strict=True))


def _compare_batches(length: int, most: int = 1 << 20):
    """Rows sorted by bh to (bh, ch, lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        size = 0

        def out() -> pa.RecordBatch:
            bh, ch, _, left, raw = held
            names = {b: i for i, b in enumerate(dict.fromkeys(bh))}
            spans = _compare([names[b] for b in bh], left, raw, length)
            return pa.RecordBatch.from_arrays([pa.array([f(s) for s in spans], t) for f, t in ((lambda s: bh[s[0]], pa.int64()), (lambda s: ch[s[0]], pa.int64()), (lambda s: s[1], pa.int32()), (lambda s: s[2], pa.int32()))], names=["bh", "ch", "lo", "hi"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("bh", "ch", "n", "l", "context")), strict=True):
                if size >= most and row[0] != held[0][-1]:
                    yield out()
                    held, size = [[], [], [], [], []], 0
                if held[0] and held[0][-1] == row[0] and held[1][-1] == row[1]:
                    continue  # the same context, found in two copies of its text
                for x, v in zip(held, row, strict=True):
                    x.append(v)
                size += len(row[4])
        if held[0]:
            yield out()

    return released(run)


def _string_batches(length: int):
    """Contexts to a row for each of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("context").to_pylist()
            base = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
            hashed = RangeHash(np.frombuffer(b"".join(raw), np.uint8))
            count = np.diff(base) - length + 1
            who = np.repeat(np.arange(len(raw)), count)
            start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = base[who] + start
            left = batch.column("l").to_numpy()[who]
            rows = pa.array(who)
            yield pa.RecordBatch.from_arrays([batch.column("bh").take(rows), batch.column("ch").take(rows), pa.array(start, pa.int32()), pa.array((left - start).astype(np.int32)), pa.array(hashed(at, at + length).view(np.int64))], names=["bh", "ch", "start", "d", "wh"])

    return released(run)


def _kept_batches(length: int):
    """(doc_id, text, spans of starts) to the digest columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            spans = batch.column(2).to_pylist()
            n_bytes, removed, runs, digest = [], [], [], []
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                kept, at, gone, k, end = hashlib.sha256(), 0, 0, 0, -1
                for s in sorted((s["lo"], s["hi"] + length) for s in spans[i] or ()):
                    if s[0] > end:
                        k += 1
                        kept.update(raw[at : s[0]])
                        gone += s[1] - s[0]
                        at = end = s[1]
                    elif s[1] > end:
                        gone += s[1] - end
                        at = end = s[1]
                kept.update(raw[at:])
                for x, v in zip((n_bytes, removed, runs, digest), (len(raw), gone, k, kept.hexdigest()), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, runs)), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return released(run)


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """texts that have a row in wanted (doc_id, th), with its columns. Few ids pick the texts before they are shuffled."""
    ids = settle(wanted.select("doc_id").distinct(), "ids")
    if is_small(ids):
        texts = texts.join(F.broadcast(ids), texts.doc_id.eqNullSafe(ids.doc_id), "left_semi")
    return texts.join(wanted.hint("shuffle_hash"), texts.doc_id.eqNullSafe(wanted.doc_id) & (texts.th == wanted.th)).drop(wanted.doc_id).drop(wanted.th)


def repeated_starts(texts: DataFrame, length: int = 400, reach: int = 320, hot: int = 20_000, piece: int = CHUNK) -> DataFrame:
    """texts (doc_id, th, text) -> (doc_id, th, spans): the starts of repeated strings, as runs [lo, hi]."""
    found = settle(texts.mapInArrow(_anchor_batches(length, reach, piece), ANCHORS), "anchors")
    counted = settle(found.groupBy("bh", "ch").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "a", "s0", "s1")).alias("rep")), "contexts")
    several = settle(counted.groupBy("bh").agg(F.count("*").alias("different")).where("different > 1"), "several")
    is_hot = settle(several.where(F.col("different") > hot).select("bh"), "hot")  # one of ``hot`` contexts each at most

    hot_side = F.broadcast(is_hot) if is_small(is_hot) else is_hot
    ahead = counted.join(hot_side, "bh", "left_anti").join(several.select("bh"), "bh").union(counted.join(hot_side, "bh", "left_semi")).select("bh", "ch", "n", "rep.*")
    listed = settle(ahead.groupBy("doc_id", "th").agg(F.collect_list(F.struct("bh", "ch", "n", "a", "s0", "s1")).alias("wanted")), "listed")
    contexts = _texts_of(texts, listed).select("text", "wanted").mapInArrow(_context_batches(length), "bh long, ch long, n long, l int, context binary")
    spans = kept = strings = None
    if not is_hot.isEmpty():
        contexts = kept = settle(contexts, "bytes")
        rows = contexts.join(hot_side, "bh", "left_semi").mapInArrow(_string_batches(length), "bh long, ch long, start int, d int, wh long").distinct()
        strings = settle(rows, "strings")
        twice = strings.groupBy("bh", "d", "wh").agg(F.count("*").alias("k")).where("k > 1").select("bh", "d", "wh")
        spans = strings.join(twice, ["bh", "d", "wh"]).select("bh", "ch", F.col("start").alias("lo"), F.col("start").alias("hi"))
        contexts = contexts.join(hot_side, "bh", "left_anti")
    within = contexts.repartition("bh").sortWithinPartitions("bh", "ch").mapInArrow(_compare_batches(length), "bh long, ch long, lo int, hi int")
    spans = settle(within if spans is None else within.union(spans), "spans")
    drop(listed, kept, strings, several, is_hot)

    # a context that occurs twice goes whole; the others by their runs
    whole = counted.where("n > 1").select("bh", "ch", "n", F.array(F.struct(F.lit(0).alias("lo"), (F.col("rep.s1") - F.col("rep.s0")).alias("hi"))).alias("runs"))
    once = counted.where("n = 1").select("bh", "ch", "n").join(spans.groupBy("bh", "ch").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), ["bh", "ch"])
    gone = settle(whole.union(once), "runs")
    frequent = gone.where(F.col("n") > found.count() / 1000)  # a thousand at most
    many = found.join(F.broadcast(frequent), ["bh", "ch"])
    rest = found.join(F.broadcast(frequent.select("bh", "ch")), ["bh", "ch"], "left_anti").join(gone, ["bh", "ch"])
    by_doc = many.union(rest).select("doc_id", "th", F.transform("runs", lambda r: F.struct((F.col("s0") + r["lo"]).alias("lo"), (F.col("s0") + r["hi"]).alias("hi"))).alias("runs"))
    out = settle(by_doc.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("runs")).alias("spans")), "gone")
    drop(found, counted, spans, gone)
    return out


def removal_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, **more) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    texts = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("th"), "text")
    gone = repeated_starts(texts, length, **more)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    ids = settle(gone.select("doc_id").distinct(), "ids")
    if not is_small(ids):
        joined = texts.join(gone.withColumnsRenamed({"doc_id": "_id", "th": "_th"}).hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
        return joined.select("doc_id", "text", "spans").mapInArrow(_kept_batches(length), schema)
    side = F.broadcast(ids.select(F.col("doc_id").alias("_id")))
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    some = texts.join(side, same, "left_semi").join(gone.withColumnsRenamed({"doc_id": "_id", "th": "_th"}), same & (F.col("th") == F.col("_th")), "left")
    rest = texts.join(side, same, "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return some.select("doc_id", "text", "spans").mapInArrow(_kept_batches(length), schema).union(rest)
