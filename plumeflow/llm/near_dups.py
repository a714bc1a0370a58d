"""Near-duplicate documents by a chosen-path set similarity join.

A text's set is its distinct shingles of ``words`` consecutive words (ASCII
letters lower-cased, words being runs of non-blank bytes); a text of fewer
words has its whole sequence as the one shingle. Two texts are linked when
100 * |intersection| >= threshold * |union|.

Method.  Equal sets fall together first (one class, named by a 128-bit hash
of its set).  Each class gets a sketch of minwise tokens.  ``trees``
independent trees branch recursively: at the root a class follows ``branch``
of its minwise tokens, and a node is the classes that followed the same path.
Nodes of one class end.  A node is small with at most ``node_limit`` classes
and ``node_shingles`` shingles in all, and small nodes are compared
exhaustively.  Large nodes are first compared within blocks of that size, and
branch again where they still hold several components, each class following
``child_branch`` tokens, up to ``depth`` levels; of a class with many large roots, the first
``large_roots`` do. What is large even then is
compared by pairs of blocks, so that no class is left out.

Comparing a node takes two steps, and what either makes is linear in the
node.  By sketch: a class is active if its sketch agrees in enough tokens with
one of another component that it meets in no earlier small root.  Then the
full sets of the active classes come to the node, once for all of its pairs,
intersections are counted over their shared shingles, and of the classes
linked an edge for each component is written.  The first tree goes ahead of
the others, so that what it joins needs no further comparison.

Recall.  A pair at similarity 0.75 misses all roots with probability
0.25 ** 16 = 2e-10 at the defaults. Where all its nodes are large, it goes on in
each of eight with probability 0.89 over any number of levels, and misses all with
2e-4. Its sketches agree in less than half of 64 tokens with probability 2e-6.
Links are exact: no pair is linked without its full sets.

Nothing but counts comes to the driver; all tables between steps lie in the
shared folder, and are deleted when they are used up.

Defined results.  A null or blank text has no shingles, links with nothing
and is kept; its component_id is its own doc_id.  Each row stands for itself:
rows of one doc_id but different texts may lie in different components, and
equal rows get equal results.  A row whose doc_id is null is in no
component_id (null) unless its set has a row with an id, and is kept only if
it has none.  An empty table gives an empty result.  Only the two named
columns are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .storage import BROADCAST_BYTES, bounded_batches, drop, settle, small_or_shuffled, unused
from .textkit import LOWER, PLAIN_WORD, RangeHash, as_bytes, chunks, fixed_width, mix, randoms, released, windows, words

COORDINATES = 64
_XOR = randoms(COORDINATES, 21)
_MUL = randoms(COORDINATES, 22) | np.uint64(1)
_SET_A, _SET_B = (int(x) for x in randoms(2, 23))
_ROOT = randoms(COORDINATES, 24)
_LOW32, _LOW8 = np.uint64(0xFFFFFFFF), np.uint64(0xFF)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, per-text offsets), repeats included."""
    data = LOWER[data]
    start, end, rows = words(data, offsets, PLAIN_WORD)
    return windows(RangeHash(data)(start, end), rows, size, short=True)


def distinct_sets(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)]


def minwise(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) minwise tokens; rows of texts without shingles are 0."""
    counts = np.diff(offsets)
    out = np.zeros((len(counts), COORDINATES), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        at = offsets[:-1][some]
        for j in range(COORDINATES):
            out[some, j] = np.minimum.reduceat((hashes ^ _XOR[j]) * _MUL[j], at)
    return mix(out)


def class_id(values: np.ndarray) -> bytes:
    """Hash of a set of shingles."""
    n = np.uint64(len(values))
    a = mix(values ^ np.uint64(_SET_A)).sum(dtype=np.uint64) + n
    b = mix(values ^ np.uint64(_SET_B)).sum(dtype=np.uint64) ^ n
    return a.tobytes() + b.tobytes()


def sketch_width(roots: int) -> int:
    return 4 * roots + COORDINATES - roots


def _sketch_batches(size: int, roots: int):
    """Texts to their sets' names, root nodes and sketches: 32 bits of each token that makes a root, 8 bits of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(2))
            for lo, hi in chunks(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                hashes, at = shingles(data[offsets[lo] : offsets[hi]], own, size)
                sets = distinct_sets(hashes, at)
                some = [len(s) > 0 for s in sets]
                tokens = minwise(hashes, at)
                node = mix(tokens[:, :roots] ^ _ROOT[:roots]).view(np.int64)
                rows = np.concatenate(((tokens[:, :roots] & _LOW32).astype("<u4").view(np.uint8), (tokens[:, roots:] & _LOW8).astype(np.uint8)), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([class_id(s) if k else None for s, k in zip(sets, some, strict=True)], pa.binary()),
                        pa.array([rows[i].tobytes() if k else None for i, k in enumerate(some)], pa.binary()),
                        pa.array([node[i].tolist() if k else None for i, k in enumerate(some)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "th", "n_shingles", "cid", "sketch", "roots"],
                )

    return released(run)


def _child_batches(branch: int, roots: int):
    """Of each member of a large node the children that it reaches: the node itself draws which tokens to follow."""
    step = randoms(branch, 25)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy().view(np.uint64)
            rows = fixed_width(batch.column(3), sketch_width(roots))
            tokens = np.concatenate((np.ascontiguousarray(rows[:, : 4 * roots]).view("<u4"), rows[:, 4 * roots :]), axis=1).astype(np.uint64)
            draw = mix(node[:, None] ^ step[None, :])
            token = np.take_along_axis(tokens, (draw % np.uint64(COORDINATES)).astype(np.int64), axis=1)
            child = mix(draw + mix(token))
            who = pa.array(np.repeat(np.arange(batch.num_rows), branch))
            yield pa.RecordBatch.from_arrays([pa.array(child.ravel().view(np.int64)), batch.column(1).take(who), batch.column(2).take(who)], names=["node", "cid", "n"])

    return released(run)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, cut anew so that none begins within a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if held and held[0].column(0)[0].as_py() != keys[0]:
            yield pa.concat_batches(held)
            held = []
        at = int(np.searchsorted(keys == keys[-1], True))
        if at == 0:
            held.append(batch)
        else:
            yield pa.concat_batches([*held, batch.slice(0, at)])
            held = [batch.slice(at)]
    if held:
        yield pa.concat_batches(held)


def _active_batches(need: int, roots: int, most: int = 1 << 15):
    """Rows (key, j, cid, comp, mask, sketch) sorted by key to the (key, cid) of those with a candidate in their group.

    A candidate is of another component and agrees in ``need`` tokens. A pair that shares a small root (bits of
    mask) is looked at in the first of these alone: in the group of root j no earlier one, in others (j < 0 or a
    large root) none at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches):
            m = batch.num_rows
            keys, j, mask = (batch.column(k).to_numpy() for k in (0, 1, 4))
            comp = np.ascontiguousarray(fixed_width(batch.column(3), 16)).view(np.uint64)
            rows = fixed_width(batch.column(5), sketch_width(roots))
            first = np.ascontiguousarray(rows[:, : 4 * roots]).view("<u4")
            small = (mask[:, None] >> np.arange(roots) & 1).astype(bool)
            own = (j >= 0) & small[np.arange(m), np.maximum(j, 0)]
            met = small & (~own[:, None] | (np.arange(roots)[None, :] < j[:, None]))
            cut = np.flatnonzero(np.concatenate((keys[1:] != keys[:-1], [True]))) + 1
            ends = cut[np.searchsorted(cut, np.arange(m), "right")]
            count = ends - 1 - np.arange(m)
            total = np.concatenate(([0], np.cumsum(count)))
            active = np.zeros(m, bool)
            lo = 0
            while lo < m:
                hi = max(int(np.searchsorted(total, total[lo] + most, "right")) - 1, lo + 1)
                a = np.repeat(np.arange(lo, hi), count[lo:hi])
                b = a + 1 + np.arange(len(a)) - np.repeat(total[lo:hi] - total[lo], count[lo:hi])
                apart = (comp[a] != comp[b]).any(axis=1)
                a, b = a[apart], b[apart]
                same = first[a] == first[b]
                agree = same.sum(axis=1)
                new = (agree + COORDINATES - roots >= need) & ~(same & met[a]).any(axis=1)
                a, b, agree = a[new], b[new], agree[new]
                agree = agree + (rows[a, 4 * roots :] == rows[b, 4 * roots :]).sum(axis=1)
                hit = agree >= need
                active[a[hit]] = active[b[hit]] = True
                lo = hi
            at = pa.array(np.flatnonzero(active))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in (0, 2, 3)], names=["key", "cid", "comp"])

    return released(run)


def _wanted_batches(size: int):
    """Texts with the groups in which their set is wanted to (key, cid, comp, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(0))
            for lo, hi in chunks(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                sets = distinct_sets(*shingles(data[offsets[lo] : offsets[hi]], own, size))
                out: list[list] = [[], [], [], []]
                for s, wanted in zip(sets, batch.column(1).slice(lo, hi - lo).to_pylist(), strict=True):
                    name, raw = class_id(s), s.tobytes()
                    for w in wanted:
                        if w["cid"] == name:
                            for x, v in zip(out, (w["key"], name, w["comp"], raw), strict=True):
                                x.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["key", "cid", "comp", "members"])

    return released(run)


def intersections(sets: list[np.ndarray], dense: int = 32, width: int = 1024) -> np.ndarray:
    """(sets, sets) sizes of all intersections, from the shingles that occur twice: rare ones by their pairs, frequent ones by products of 0/1 columns."""
    m = len(sets)
    out = np.zeros(m * m, np.int32)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    times = np.diff(np.concatenate((first, [len(values)])))
    rare = np.repeat((times > 1) & (times <= dense), times)
    o, v = owner[rare], values[rare]
    for d in range(1, dense):
        same = v[d:] == v[:-d] if len(v) > d else np.zeros(0, bool)
        if not same.any():
            break
        np.add.at(out, o[:-d][same] * m + o[d:][same], 1)
    out = out.reshape(m, m)
    out = out + out.T
    often = np.repeat(times > dense, times)
    if often.any():
        o = owner[often]
        column = np.cumsum(np.concatenate(([0], values[often][1:] != values[often][:-1])))
        for lo in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            table = np.zeros((m, width), np.float32)
            table[o[a:b], column[a:b] - lo] = 1
            out += (table @ table.T).astype(np.int32)
    return out


def _spanned(cids: list[bytes], comps: list[bytes], sets: list[np.ndarray], threshold: int) -> list[tuple[bytes, bytes]]:
    """Of each set of linked classes that spans several components, an edge from its first class to one of each other component."""
    sizes = np.array([threshold * len(s) for s in sets], np.int32)
    linked = (100 + threshold) * intersections(sets) >= sizes[:, None] + sizes[None, :]
    names = {c: k for k, c in enumerate(dict.fromkeys(comps))}
    comp = np.array([names[c] for c in comps])
    of = [np.flatnonzero(comp == k) for k in range(len(names))] if len(names) < len(cids) else [np.array([k]) for k in range(len(cids))]
    seen = np.zeros(len(names), bool)
    out = []
    for k in range(len(names)):
        if seen[k]:
            continue
        seen[k] = True
        front = of[k]
        while len(front):
            near = np.unique(comp[linked[front].any(axis=0)])
            near = near[~seen[near]]
            seen[near] = True
            out.extend((cids[of[k][0]], cids[of[x][0]]) for x in near.tolist())
            front = np.concatenate([of[x] for x in near.tolist()]) if len(near) else near
    return out


def _link_batches(threshold: int):
    """Rows (key, cid, comp, members) sorted by key and cid to edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, {}

        def close() -> list[tuple[bytes, bytes]]:
            return _spanned(list(group), [g[0] for g in group.values()], [g[1] for g in group.values()], threshold) if len(group) > 1 else []

        def out(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            edges = []
            members = batch.column(3)
            for k, (now, cid, comp) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                if now != key:
                    edges += close()
                    key, group = now, {}
                if cid not in group:
                    group[cid] = (comp, np.frombuffer(members[k].as_buffer(), np.uint64).copy())
            yield out(edges)
        yield out(close())

    return released(run)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _resolved(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: int = 75, trees: int = 4, branch: int = 4, child_branch: int = 2, depth: int = 6, large_roots: int = 8, node_limit: int = 2048, node_shingles: int = 1 << 21) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, cid, stays) of every row; stays marks rows that are, or equal, the one row of their component to stay."""
    roots = trees * branch
    if roots > COORDINATES:
        raise ValueError(f"trees * branch is {COORDINATES} at most")
    need = int(np.ceil((threshold / 100 - 0.25) * COORDINATES))
    texts = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), _text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    base = settle(texts.mapInArrow(_sketch_batches(size, roots), "doc_id long, th long, n_shingles long, cid binary, sketch binary, roots array<long>"), "sketches")
    classes = settle(
        base.where("cid is not null").groupBy("cid").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("stay"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch"), F.min("roots").alias("roots")),
        "classes",
    )

    # The root nodes that have several classes.
    large = (F.col("size") > node_limit) | (F.col("weight") > node_shingles)
    blocks = F.greatest(F.ceil(F.col("size") / node_limit), F.ceil(F.col("weight") / node_shingles))

    def sized(rows: DataFrame) -> DataFrame:
        """rows (node, cid, n, ...) of nodes with several classes, with the number of blocks if they are large, else 1."""
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).where("size > 1")
        return rows.join(sizes.select("node", F.when(large, blocks).otherwise(1).cast("long").alias("blocks")), "node")

    nodes = settle(sized(classes.select(F.posexplode("roots").alias("j", "node"), "cid", "n")), "nodes")
    is_small = F.when(F.col("blocks") == 1, F.expr("shiftleft(1L, j)")).otherwise(F.lit(0).cast("long"))
    masks = nodes.groupBy("cid").agg(F.bit_or(is_small).alias("mask"))
    narrow = settle(classes.select("cid", "sketch", "n").join(masks, "cid"), "narrow")
    label: DataFrame | None = None

    def labelled(rows: DataFrame) -> DataFrame:
        """rows (node, cid, ...) of nodes that span several components, with comp."""
        if label is None:
            return rows.withColumn("comp", F.col("cid"))
        known = rows.join(small_or_shuffled(label.withColumnRenamed("id", "cid")), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
        apart = known.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("node")
        return known.join(apart, "node", "left_semi")

    def block_of(seed: int) -> Column:
        return F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("cid", F.lit(seed)), F.col("blocks"))).otherwise(F.lit(0).cast("long"))

    def compare(rows: DataFrame) -> None:
        """Compares rows (key, j, cid, comp) of each key, and joins what is linked."""
        nonlocal label
        keyed = rows.join(narrow.select("cid", "mask", "sketch"), "cid").select("key", "j", "cid", "comp", "mask", "sketch")
        found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_active_batches(need, roots), "key long, cid binary, comp binary")
        active = settle(found, "active")
        reps = classes.select("cid", "rep.doc_id", "rep.th")
        wanted = settle(active.join(reps, "cid").groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "cid", "comp")).alias("wanted")), "wanted")
        entries = wanted.agg(F.sum(F.size("wanted")).alias("n")).first()["n"] or 0
        if entries:
            side = wanted.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
            side = F.broadcast(side) if 96 * entries <= BROADCAST_BYTES else side
            with_sets = texts.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("text", "wanted").mapInArrow(_wanted_batches(size), "key long, cid binary, comp binary, members binary")
            edges = settle(with_sets.repartition("key").sortWithinPartitions("key", "cid").mapInArrow(_link_batches(threshold), "a binary, b binary"), "links")
            if not edges.isEmpty():
                stars = label.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b")) if label is not None else None
                known = settle(edges.distinct() if stars is None else edges.distinct().union(stars), "all_links")
                before, label = label, components(known)
                drop(known, before)
                label = settle(label, "label")
            drop(edges)
        drop(active, wanted)

    # The first tree, then the others: small nodes whole, large ones within blocks.
    for k, own in enumerate((F.col("j") < branch, F.col("j") >= branch)):
        compare(labelled(nodes.where(own)).select(F.xxhash64("node", block_of(k)).alias("key"), "j", "cid", "comp"))

    # Large nodes branch again while they hold several components.
    nth = F.row_number().over(Window.partitionBy("cid").orderBy("j"))  # a class has ``roots`` rows at most
    level, levels = nodes.where("blocks > 1").withColumn("nth", nth).where(F.col("nth") <= large_roots), []
    todo: DataFrame | None = None
    for d in range(depth):
        rows = settle(labelled(level.select("node", "cid", "n", "blocks")), "level")
        levels.append(rows)
        if rows.isEmpty():
            break
        final = d == depth - 1
        ready = rows.where("blocks = 1").withColumn("key", F.xxhash64("node", F.lit(0).cast("long")))
        if final:
            mine = block_of(2)
            pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda y: F.least(mine, y) * F.col("blocks") + F.greatest(mine, y)))
            ready = rows.withColumn("pair", pair).withColumn("key", F.xxhash64("node", "pair"))
        ready = ready.select("key", F.lit(-1).alias("j"), "cid", "comp")
        todo = ready if todo is None else todo.union(ready)
        if final:
            break
        grown = rows.where("blocks > 1").select("node", "cid", "n").join(narrow.select("cid", "sketch"), "cid").select("node", "cid", "n", "sketch")
        level = settle(sized(grown.mapInArrow(_child_batches(child_branch, roots), "node long, cid binary, n long")), "children")
        levels.append(level)
    if todo is not None:
        compare(todo)
    drop(nodes, narrow, *levels)

    if label is None:
        label = classes.limit(0).select(F.col("cid").alias("id"), F.col("cid").alias("component"))
    own = classes.select("cid", "low", "stay")
    linked = label.withColumnRenamed("id", "cid").join(own, "cid")
    lowest = linked.groupBy("component").agg(F.min("low").alias("_low"), F.min("stay").alias("_stay"))
    joined = own.join(linked.join(lowest, "component").select("cid", "_low", "_stay"), "cid", "left")
    whole = joined.select("cid", F.coalesce("_low", "low").alias("component_id"), F.coalesce("_stay", "stay").alias("stay"))
    out = base.select("doc_id", "th", "n_shingles", "cid").join(whole, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    stays = F.col("cid").isNull() | (F.col("stay.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("stay.th") == F.col("th")))
    return out.select("doc_id", "th", "n_shingles", component.alias("component_id"), "cid", stays.alias("stays"))


def near_duplicates(docs: DataFrame, **more) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return _resolved(docs, **more).select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs with one row of each component, the one of least (doc_id, text hash), rows without an id coming last.

    Rows are told apart by id and text, not by id alone; of rows that agree in both one stays. Rows without shingles all stay.
    """
    rows = settle(_resolved(docs, id_col, text_col, **more).select("doc_id", "th", "stays", F.col("cid").isNotNull().alias("has")), "rows")
    i, t = unused(docs, "_n_id"), unused(docs, "_n_th")
    key, th = F.col(id_col).cast("long"), _text_hash(text_col)
    gone = settle(rows.where("not stays").select(F.col("doc_id").alias(i), F.col("th").alias(t)).distinct(), "gone")
    twice = settle(rows.where("stays and has").groupBy(F.col("doc_id").alias(i), F.col("th").alias(t)).agg(F.count("*").alias("k")).where("k > 1").select(i, t), "twice")
    same = key.eqNullSafe(F.col(i)) & (th == F.col(t))
    kept = docs.join(small_or_shuffled(gone), same, "left_anti")
    if twice.isEmpty():
        return kept
    side = small_or_shuffled(twice)
    one = kept.join(side, same, "left_semi").withColumns({i: key, t: th}).dropDuplicates([i, t]).drop(i, t)
    return kept.join(side, same, "left_anti").union(one)
