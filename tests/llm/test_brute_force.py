"""Operators and pipeline stages against plain re-implementations."""

import itertools
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumeflow.llm import chat, decontaminate, graph, line_dedup, near_dups, packing, quality, secrets, site_bayes, storage, suffix_dedup, token_rollup
from plumeflow.llm.suffix_sort import suffix_array
from plumeflow.llm.storage import shared_dir

SF_SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_suffix_array():
    random.seed(1)
    for t in range(3000):
        n, k = random.randint(0, 30), random.randint(1, 4)
        x = [random.randint(0, k) for _ in range(n)]
        if t % 3 == 0 and n:
            x = (x[: random.randint(1, n)] * 30)[: 2 * n]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_components(spark):
    random.seed(3)
    for edges in ([(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)], [(random.randint(0, 80), random.randint(0, 80)) for _ in range(50)], []):
        want = roots({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]])
        got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == want


def test_automaton():
    random.seed(5)
    for _ in range(200):
        window = random.randint(2, 4)
        items = [(str(i), [random.randint(0, 2) for _ in range(random.randint(0, 8))]) for i in range(5)]
        doc = [random.randint(0, 3) for _ in range(40)]
        runs, found = [], set()
        decontaminate.Automaton(items, window).walk([c if c < 3 else -1 for c in doc], runs, found, 0)
        hit, met = set(), set()
        for name, seq in items:
            size = min(window, len(seq))
            for i in range(len(seq) - size + 1 if seq else 0):
                for j in range(len(doc) - size + 1):
                    if doc[j : j + size] == seq[i : i + size]:
                        hit |= set(range(j, j + size))
                        met.add(name)
        assert {p for a, b in runs for p in range(a, b)} == hit and found == met


def test_decontamination_in_blocks(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    one = decontaminate.contamination(docs, items)
    many = decontaminate.contamination(docs, items, max_words=200)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_cut_passages(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    text = "A b. " + "x " * 400 + passage.upper() + ", end."
    docs = spark.createDataFrame([(1, text), (2, passage)], "doc_id long, text string")
    out = decontaminate.decontaminated(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.text) for r in out] == [(1, "A b. " + "x " * 400 + ", end.")]


def near_brute(rows, threshold=75):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    return roots(list(sets), links)


def family(seed, n, words, change):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, change)):
            w[rng.randrange(words)] = f"v{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_intersections():
    rng = np.random.default_rng(3)
    for m, top in ((2, 9), (40, 60), (70, 3000)):
        sets = [np.unique(rng.integers(0, top, rng.integers(1, 80))).astype(np.uint64) for _ in range(m)]
        for dense in (2, 8, 32):
            got = near_dups.intersections(sets, dense, 16)
            assert all(got[i, k] == len(np.intersect1d(sets[i], sets[k])) for i in range(m) for k in range(m) if i != k)


@pytest.mark.parametrize("more", [{}, {"node_limit": 4, "depth": 3}])
def test_near_duplicates_of_a_family(spark, more):
    texts = family(1, 40, 120, 5) + family(2, 20, 60, 3) + ["a passage that many share " * 3 + f"{i} " * 30 for i in range(20)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect()}
    want = near_brute(rows)
    if more:  # small nodes on purpose: more is left to chance, but no link may be wrong
        assert all(want[i] == want[c] for i, c in got.items()) and sum(got[i] == want[i] for i in got) >= 0.95 * len(got)
    else:
        assert got == want


@pytest.mark.parametrize("more", [{}, {"depth": 1}, {"node_shingles": 20_000}])
def test_a_tight_family_over_several_blocks(spark, more):
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(4000)]
    rows = [(i, " ".join([*base[: 100 * i], f"v{i}", *base[100 * i + 1 :]])) for i in range(30)]
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), node_limit=16, **more).collect()}
    assert got == near_brute(rows)


@pytest.mark.parametrize(("hot", "piece"), [(20_000, 1 << 18), (1, 1 << 18), (20_000, 450)])
def test_suffix_dedup(spark, hot, piece):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    common = [letters(700), letters(380), letters(410)]
    texts = [letters(rng.randint(0, 300)) + common[rng.randrange(3)] + letters(rng.randint(0, 500)) + (common[1] if i % 3 else common[0][100:600]) for i in range(24)]
    texts += ["ab" * 900, "z" * 450, "z" * 399, texts[0], letters(100) + "ab" * 300]
    raw = [t.encode() for t in texts]
    seen = {}
    for r in raw:
        for i in range(len(r) - 399):
            seen[r[i : i + 400]] = seen.get(r[i : i + 400], 0) + 1
    want = []
    for d, r in enumerate(raw):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - 399):
            if seen[r[i : i + 400]] > 1:
                gone[i : i + 400] = True
        want.append((d, len(r), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.removal_table(docs, hot=hot, piece=piece).collect())
    assert got == want


def test_secrets_are_linked_by_distance(spark):
    long = "Ab1/" * 125
    rows = [(i, "- " * i + f"client_id=abcd token={long}", 2) for i in range(0, 201, 25)]
    rows += [(300 + i, "- " * i + "client_id=abcdefghij " + "- " * 80 + "+" * 45, 2) for i in range(0, 201, 5)]
    rows += [(600, "client_id=abc " + "- " * 199 + "+" * 40, 2), (601, "client_id=abc " + "- " * 201 + "+" * 40, 0)]
    rows += [(700, "client_id=abc " + "- " * 190 + "+" * 40 + " https://e.com/", 2), (701, "client_id=abc " + "+" * 40 + " https://e.com/", 3), (702, "client_id=abc https://e.com/", 0)]
    got = {r.doc_id: r.n_linked for r in secrets.secret_spans(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")).collect()}
    # a token of 500 letters is a base span and, as a long run, a weak value too
    assert got == {i: n for i, _, n in rows}


def test_items_without_an_id(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    other = " ".join(f"x{i}" for i in range(13))
    docs = spark.createDataFrame([(1, passage), (2, passage + " " + other), (3, "none of it")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), (7, other)], "item_id long, text string")
    for more in ({}, {"max_words": 5}):
        rows = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs, items, **more).collect()}
        assert rows == {1: (13, 1, decontaminate.items_digest([]), True), 2: (26, 2, decontaminate.items_digest(["7"]), True), 3: (0, 0, decontaminate.items_digest([]), False)}


def test_bounds_at_any_length(spark):
    rows = [(i, (100, 1025, 1900)[i % 3]) for i in range(30)]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, n long"), tokens_col="n").collect()
    assert all(r.bucket_len == (r.n_tokens if r.n_tokens < 1900 else 2048) or r.bucket_len == r.n_tokens for r in out) and len(out) == 30


def plain_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randint(0, 70))) for _ in "ab")
        assert line_dedup.edit_distance(a, b) == plain_distance(a, b)
    for _ in range(300):
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 200)))
        b = list(a)
        for _ in range(rng.randint(0, 40)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "yz"])
        b = "".join(b)
        d, most = plain_distance(a, b), max(len(a), len(b))
        assert line_dedup.distance_bound(a, b) >= d
        assert line_dedup.similar(a, b, 75) == (100 * (most - d) >= 75 * most)


def lines_brute(rows, fuzzy_words=1, threshold=75):
    """Lines that go, as (doc, line), by comparing all pairs of lines: no pair is left out but by length and by how many of each letter differ."""
    norm = {}
    for d, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
            if w := re.findall("[0-9a-z\u0080-\U0010ffff]+", low):
                norm[(d, k)] = " ".join(w)
    texts = sorted(set(norm.values()))
    long = [t for t in texts if t.count(" ") + 1 >= fuzzy_words]
    letters = sorted({c for t in long for c in t})
    bags = np.array([[t.count(c) for c in letters] for t in long], np.int32).reshape(len(long), -1)
    size = bags.sum(axis=1)
    links = []
    for i, a in enumerate(long):
        more = np.maximum(bags[i + 1 :] - bags[i], 0).sum(axis=1)
        less = np.maximum(bags[i] - bags[i + 1 :], 0).sum(axis=1)
        most = np.maximum(size[i + 1 :], size[i])
        for j in np.flatnonzero(100 * (most - np.maximum(more, less)) >= threshold * most) + i + 1:
            n = max(len(a), len(long[j]))
            if 100 * (n - line_dedup.edit_distance(a, long[j])) >= threshold * n:
                links.append((a, long[j]))
    group = roots(texts, links)
    first = {}
    for place in sorted(norm):
        first.setdefault(group[norm[place]], place)
    return {p for p, t in norm.items() if first[group[t]] != p}, links


def test_edit_distances_together():
    r = random.Random(7)
    for letters, longest in (("ab", 3), ("ab", 200), ("abcdefgh ", 700), ("가나다라마 aé😀", 150)):
        pairs = []
        for _ in range(60):
            a = "".join(r.choice(letters) for _ in range(r.randint(1, longest)))
            b = "".join(r.choice(letters) if r.random() < 0.2 else c for c in a if r.random() > 0.1) or a
            if r.random() < 0.3:
                b = r.choice([a + letters[0] * 64, letters[0] * len(a), "".join(r.choice(letters) for _ in range(r.randint(1, longest)))])
            pairs.append((a, b))
        allowed = [r.choice([0, len(a) // 4, len(a) // 2, len(a)]) for a, _ in pairs]
        want = [line_dedup.edit_distance(a, b) <= k for (a, b), k in zip(pairs, allowed, strict=True)]
        assert line_dedup.within([(a, b, k) for (a, b), k in zip(pairs, allowed, strict=True)]).tolist() == want
        pairs += [("", ""), ("", "ab"), ("abc", "abc")]
        assert line_dedup.all_similar(pairs, 75).tolist() == [line_dedup.similar(a, b, 75) for a, b in pairs]
    assert line_dedup.all_similar([], 75).tolist() == []


def test_signatures_do_not_depend_on_the_number_of_lines():
    lines = [f"line {i} of a long text, {'with many words, ' * (i % 7)}the end {i * i}".encode() for i in range(200)]

    def signed(texts):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        size = np.array([len(x) for x in texts])
        first = np.cumsum(size + 1) - size - 1
        grams = line_dedup.gram_hashes(data)
        line, key = line_dedup.blocks(data, grams, first, size)
        return line_dedup.line_simhash(grams, first, size).tolist(), [set(key[line == i].tolist()) for i in range(len(texts))]

    alone = [signed([x]) for x in lines]
    sims, keys = signed(lines)
    assert sims == [s[0] for s, _ in alone]
    assert keys == [k[0] for _, k in alone]
    before, line_dedup.LINES = line_dedup.LINES, 16
    try:
        assert signed(lines) == (sims, keys)
    finally:
        line_dedup.LINES = before
    assert all(keys)


@pytest.mark.parametrize("part", [1024, 8])
def test_line_dedup(spark, part):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = []
    for d in range(30):
        lines = []
        for _ in range(rng.randint(1, 8)):
            w = rng.choice(base).split(" ")
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(["X!", "w0", "W1,"])
            lines.append(rng.choice([" ".join(w), "  " + " ; ".join(w).upper()]))
        rows.append((d, "\n".join(lines)))
    want, links = lines_brute(rows)
    assert links  # fuzzy links occur
    out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), part=part).collect()
    got = {(r.doc_id, k) for r in out for k in r._cut or []}
    assert got <= want and len(got) >= 0.97 * len(want)
    texts = dict(rows)
    for r in out:
        assert r.text == "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if k not in set(r._cut or []))


def test_recall_of_edited_lines(spark):
    """Pairs of a line and its copy with words replaced, left out or put in: which copies go, of those similar enough."""
    rng = random.Random(9)
    rows, kind = [], {}
    for n in (6, 10, 20, 50):
        for edits in (1, 2, 3, 4):
            for _ in range(60):
                w = [f"{rng.choice('abcdefgh')}{rng.randint(0, 10**6)}" for _ in range(n)]
                v = list(w)
                for _ in range(edits):
                    at = rng.randrange(len(v))
                    how = rng.random()
                    v[at : at + 1] = [f"z{rng.randint(0, 10**6)}"] if how < 0.6 else [] if how < 0.8 else [v[at], f"z{rng.randint(0, 10**6)}"]
                a, b = " ".join(w), " ".join(v)
                if b.count(" ") >= 4 and 100 * (max(len(a), len(b)) - line_dedup.edit_distance(a, b)) >= 75 * max(len(a), len(b)):
                    kind[len(rows) + 1] = (n, edits)
                    rows += [(len(rows), a), (len(rows) + 1, b)]
    gone = {r.doc_id for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r._cut}
    assert gone <= set(kind)
    share = {}
    for d, k in kind.items():
        share.setdefault(k, []).append(d in gone)
    for (n, edits), hits in share.items():
        least = 1.0 if edits == 1 else 0.85 if n >= 20 else 0.0
        assert sum(hits) >= least * len(hits), (n, edits, sum(hits), len(hits))
    assert len(gone) >= 0.9 * len(kind), {k: (sum(v), len(v)) for k, v in share.items()}


def test_recall_by_kind_of_edit(spark):
    """Letters changed in every so many words, words swapped, scripts without blanks, short lines: nine of ten of each kind are found."""
    rng = random.Random(12)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))

    def typo(w):
        at = rng.randrange(len(w))
        return w[:at] + rng.choice("0123456789") + w[at + 1 :]

    def changed(kind, n, every):
        if kind == "unspaced":
            a = [chr(rng.randint(0x4E00, 0x5FFF)) for _ in range(n)]
            b = list(a)
            for at in rng.sample(range(n), every):
                b[at] = "\u3042"
            return "".join(a), "".join(b)
        a = [word() for _ in range(n)]
        if kind == "typo":
            return " ".join(a), " ".join(typo(w) if i % every == every - 1 else w for i, w in enumerate(a))
        swapped = set(rng.sample(range(n), every))
        return " ".join(a), " ".join(word() if i in swapped else w for i, w in enumerate(a))

    kinds = [("typo", 12, 3), ("typo", 20, 4), ("typo", 50, 6), ("typo", 20, 5), ("typo", 4, 4), ("typo", 3, 3), ("words", 20, 3), ("words", 30, 6), ("words", 50, 8), ("unspaced", 40, 2), ("unspaced", 20, 1)]
    rows, kind = [], {}
    for k in kinds:
        for _ in range(40):
            a, b = changed(*k)
            n = max(len(a), len(b))
            if 100 * (n - line_dedup.edit_distance(a, b)) >= 75 * n:
                kind[len(rows) + 1] = k
                rows += [(len(rows), a), (len(rows) + 1, b)]
    gone = {r.doc_id for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r._cut}
    assert gone <= set(kind)
    for k in kinds:
        hits = [d in gone for d, x in kind.items() if x == k]
        assert len(hits) >= 20 and sum(hits) >= 0.9 * len(hits), (k, sum(hits), len(hits))


def test_lines_in_a_very_frequent_block(spark):
    rng = random.Random(10)
    rows = [(i, "all of these lines begin alike and go on " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(31))) for i in range(80)]
    rows += [(100 + i, rows[i][1].replace("alike", "alikes")) for i in range(0, 80, 2)]
    gone = {r.doc_id for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), part=2).collect() if r._cut}
    assert gone == {100 + i for i in range(0, 80, 2)}


def test_pairs_of_letters_reject(monkeypatch):
    """Texts of the same letters in another order get no distance; pairs that are similar do, whatever is edited."""
    r = random.Random(15)
    base = ["".join(r.sample("abcdefghijklmnopqrstuvwxyz" * 6, 156)) for _ in range(30)]
    reached = []
    undecided = line_dedup._undecided
    monkeypatch.setattr(line_dedup, "_undecided", lambda *x: reached.append(x) or undecided(*x))
    assert not line_dedup.all_similar([(a, b) for a in base for b in base if a < b], 75).any()
    assert len(reached) < 20
    for letters, longest in (("ab", 40), ("abcdefgh ", 300), ("가나다라마 aé😀", 150)):
        texts = []
        for _ in range(12):
            a = "".join(r.choice(letters) for _ in range(r.randint(1, longest)))
            for share in (0.05, 0.15, 0.3):
                texts.append("".join(c if r.random() > share else r.choice(["", r.choice(letters), c + r.choice(letters)]) for c in a) or a)
        pairs = [(a, b) for a in texts for b in texts]
        want = [100 * (max(len(a), len(b)) - plain_distance(a, b)) >= 75 * max(len(a), len(b)) for a, b in pairs]
        assert line_dedup.all_similar(pairs, 75).tolist() == want
    monkeypatch.setattr(line_dedup, "PLACES", 200)
    assert line_dedup.all_similar(pairs, 75).tolist() == want


@pytest.mark.parametrize("tile", [2048, 50])
def test_no_pair_of_a_large_block_is_left_out(spark, monkeypatch, tile):
    """Lines share runs of 12 bytes by a common phrase only, and so meet in large blocks alone; all that meet and are near enough are linked."""
    monkeypatch.setattr(line_dedup, "TILE", tile)
    rng = random.Random(14)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = []
    for _ in range(250):
        a = "".join(rng.choice(letters) for _ in range(130))
        b = "".join(rng.choice("0123456789") if k % 11 == 5 else c for k, c in enumerate(a))
        texts += [f"terms and conditions of use apply to all that is said here {x}" for x in (a, b)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "th", "text"])
    signed = pa.Table.from_batches(line_dedup._line_batches(1, 1)(iter([batch]))).to_pylist()
    met = {}
    for r in signed:
        for key in r["blocks"]:
            met.setdefault(key, []).append(r)
    assert max(map(len, met.values())) > 200
    links = set()
    for rows in met.values():
        for i, x in enumerate(rows):
            for y in rows[:i]:
                if ((x["sim"] ^ y["sim"]) & (2**64 - 1)).bit_count() <= line_dedup.RADIUS and line_dedup.similar(texts[x["doc_id"]], texts[y["doc_id"]], 75):
                    links.add((y["doc_id"], x["doc_id"]))
    group = roots(range(len(texts)), links)
    want = {d for d in range(len(texts)) if group[d] != d}
    assert len(want) > 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.deduplicated(df).collect() if r._cut} == want


def test_lines_that_share_blocks_are_compared_in_one_tile(monkeypatch):
    seen = []
    verify = line_dedup.all_similar
    monkeypatch.setattr(line_dedup, "all_similar", lambda pairs, threshold: seen.extend(pairs) or verify(pairs, threshold))
    texts = ["one line of some words", "one line of same words", "other words than all of these", "one line of some word"]
    # all lines are in blocks 1 and 2; the third and the fourth are linked already
    rows = [(key, 0, 0, 0, 0, len(t), 5 if k > 1 else None, [1] if key == 2 else [], bytes([k]) * 16, t) for key in (1, 2) for k, t in enumerate(texts)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string()]
    batch = pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[str(k) for k in range(10)])
    for batches in ([batch], [batch.slice(k, 1) for k in range(len(rows))]):
        seen.clear()
        links = pa.Table.from_batches(line_dedup._tile_batches(75)(iter(batches))).to_pylist()
        assert sorted(seen) == sorted((texts[a], texts[b]) for a, b in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3)))
        assert {(x["a"][0], x["b"][0]) for x in links} == {(0, 1), (0, 3), (1, 3)}


def test_shuffle_files_go_when_a_table_is_settled(spark):
    def files():
        env = spark._jvm.org.apache.spark.SparkEnv.get()
        return {f.name for d in env.blockManager().diskBlockManager().localDirsString() for f in Path(d).rglob("shuffle_*.data")}

    before = files()
    table = storage.settle(spark.range(10_000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "table")
    assert not files() - before
    assert {r["count"] for r in table.collect()} == {1428, 1429}
    storage.drop(table)


def test_best_bounds():
    rng = random.Random(6)
    for _ in range(40):
        hist = {rng.randint(0, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        step, k = rng.choice([1, 4]), rng.randint(1, 3)

        def padding(bounds):
            return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist.items())

        top = max(-(-max(hist) // step), 1) * step
        ends = list(range(step, top + 1, step))
        best = min(padding([*c, ends[-1]]) for m in range(k) for c in itertools.combinations(ends[:-1], m))
        got = packing.best_bounds(hist, k, step, 10**6)
        assert len(got) <= k and padding(got) == best


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.packed(docs, budget=4096, slice_rows=100).collect()
    for r in docs.collect():
        n = len(re.findall(r"[^ \t-\r]+", r.text))
        assert sum(x.n_tokens for x in rows if x.doc_id == r.doc_id) == n
        if r.doc_id > 50:
            break
    batches = {}
    for r in rows:
        assert r.n_tokens <= r.bucket_len
        batches.setdefault((r.bucket_len, r.slice, r.batch), []).append(r.place)
    for (b, _, _), places in batches.items():
        assert sorted(places) == list(range(len(places))) and len(places) * b <= max(4096, b)


def test_chat_masks(spark):
    turns = [(1, i, s, t) for i, (s, t) in enumerate([("system", "Be <|im_end|> kind"), ("Ann Lee", "hi"), ("Bob", ""), ("Ann Lee", "é😀"), (None, "who")])]
    rows = {r.perspective: r for r in chat.rotated(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(rows) == {"Ann Lee", "Bob"}
    r = rows["Ann Lee"]
    spans = [tuple(map(int, s.split(":"))) for s in r.mask.split(",")]
    assert [r.rendered[a:b] for a, b in spans] == ["hi<|im_end|>", "é😀<|im_end|>"]
    assert "<|im_start|>user name=Bob\n<|im_end|>" in r.rendered and "<|im_start|>system\nBe <| im_end|> kind<|im_end|>" in r.rendered and "name=unknown" in r.rendered
    assert "user name=Ann_Lee" in rows["Bob"].rendered


def test_chat_parts(spark):
    turns = spark.createDataFrame([(1, i, "ab"[i % 2], str(i)) for i in range(10)], "conv_id long, turn long, role string, text string")
    whole = {r.perspective: r.rendered for r in chat.rotated(turns).collect()}
    parts = chat.rotated(turns, part_turns=4).orderBy("part").collect()
    for p in ("a", "b"):
        assert "".join(r.rendered for r in parts if r.perspective == p) == whole[p]


def test_ledger(spark):
    ledger = token_rollup.Ledger(spark, f"{shared_dir(spark)}/ledger")
    rows = lambda *r: spark.createDataFrame(r, "source string, lang string, tokenizer string, op string, n_tokens long, old_tokens long")
    assert ledger.totals().count() == 0
    assert ledger.commit("a", rows(("s", "en", "t", "insert", 10, None), ("s", "en", "t", "insert", 5, None), ("s", None, "t", "insert", None, None)))
    assert ledger.commit("b", rows(("s", "en", "t", "revise", 8, 5), ("s", "en", "t", "delete", 10, None)))
    assert not ledger.commit("b", rows(("s", "en", "t", "delete", 10, None)))
    assert ledger.commit("c", rows(("s", "en", "t", "insert", 1, None)).limit(0))
    assert sorted(((r.lang or "", r.n_docs, r.n_tokens) for r in ledger.totals().collect())) == [("", 1, 0), ("en", 1, 8)]


def test_two_writers(spark):
    ledger, other = (token_rollup.Ledger(spark, f"{shared_dir(spark)}/ledger2") for _ in "ab")
    rows = lambda n: spark.createDataFrame([("s", "en", "t", "insert", n, None, 2)], "source string, lang string, tokenizer string, op string, n_tokens long, old_tokens long, times long")
    start = other._latest()
    assert ledger.commit("a", rows(5))
    assert other.commit("b", rows(7), seen=start)  # began before a was there, and adds to it
    assert not other.commit("a", rows(5), seen=start)  # another writer's batch, found when it comes second
    assert ledger.commit("c", rows(1)) and ledger.committed("b") and not ledger.committed("d")
    assert [(r.n_docs, r.n_tokens) for r in ledger.totals().collect()] == [(6, 26)]


def test_ledger_after_torn_manifests_and_lost_writers(spark, monkeypatch):
    monkeypatch.setattr(token_rollup, "RECENT", 3)
    path = f"{shared_dir(spark)}/ledger3"
    ledger = token_rollup.Ledger(spark, path)
    rows = lambda n: spark.createDataFrame([("s", "en", "t", "insert", n, None)], "source string, lang string, tokenizer string, op string, n_tokens long, old_tokens long")
    total, done = 0, []
    local = Path(path.removeprefix("file:"))
    for k in range(9):
        if k == 4:
            for torn in (5, 6):  # made and never written, as by a writer that was lost
                (local / "manifest" / f"{torn:012d}.json").write_text("" if torn == 5 else '{"version": 6, "tot')
        if k == 7:
            with monkeypatch.context() as m:  # a writer that is lost before it publishes
                m.setattr(token_rollup.shared, "publish", lambda *a: (_ for _ in ()).throw(ConnectionError()))
                with pytest.raises(ConnectionError):
                    ledger.commit("lost", rows(1000))
        assert ledger.commit(f"b{k}", rows(k))
        total, done = total + k, [*done, f"b{k}"]
        assert [(r.n_docs, r.n_tokens) for r in ledger.totals().collect()] == [(k + 1, total)]
    assert all(ledger.committed(b) and not ledger.commit(b, rows(1)) for b in done) and not ledger.committed("lost")
    assert all(len(ledger._read(n)["recent"]) <= 3 for n in ledger._names() if ledger._read(n))
    with monkeypatch.context() as m:  # others are always first
        m.setattr(token_rollup.shared, "publish", lambda *a: False)
        m.setattr(token_rollup, "ATTEMPTS", 2)
        with pytest.raises(RuntimeError):
            ledger.commit("late", rows(1))
    assert ledger.commit("lost", rows(1000)) and ledger.totals().first().n_tokens == total + 1000


def test_token_totals_of_repeated_rows(spark, registered, tmp_path):
    rows = [(1, "one two", "s"), (1, "one two", "s"), (1, "one two", "s"), (2, "three!!", "s"), (None, "three!!", "t"), (3, None, "s"), (1, "four", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' as lang", "1 as n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.source, r.n_docs, r.n_tokens) for r in registered.QUERIES["op7_token_counts"](spark, str(tmp_path)).where("tokenizer = 'plain_words/1'").collect()}
    assert got == {("s", 3, 3), (None, 1, 1)}


def test_token_totals(spark, registered):
    import tiktoken

    encoder = token_rollup._encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert isinstance(encoder, tiktoken.Encoding)
    docs, kept, want = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect(), set(), {}
    for d in docs:
        if d.text in kept:
            continue
        kept.add(d.text)
        text = re.sub(r"[#*$%&]{3}|!!", "", d.text)
        for name, n in (("byte_bpe_50k/1", len(encoder.encode_ordinary(text))), ("plain_words/1", len(re.findall(r"[^ \t-\r]+", text)))):
            a, b = want.get((d.source, d.lang, name), (0, 0))
            want[(d.source, d.lang, name)] = (a + 1, b + n)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in registered.QUERIES["op7_token_counts"](spark, SF_SMALL).collect()}
    assert got == want


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = site_bayes.classified(docs, labels.where("doc_id % 3 <> 0"), F.col("source"), F.col("lang")).join(labels.where("doc_id % 3 = 0"), "doc_id")
    r = out.agg(
        F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("kept").cast("int"))).alias("good"),
        F.avg(F.when(F.col("toxic") == 1, F.col("kept").cast("int"))).alias("toxic"),
        F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("low"),
    ).first()
    assert r.good > 0.98 and r.toxic < 0.25 and r.low < 0.25


def test_sparse_sites_shrink_to_their_host(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i}", "big", "p") for i in range(50)] + [(99, "plain words", "big", "lone")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in site_bayes.classified(docs, labels, F.col("source"), F.col("lang")).collect()}
    assert abs(rows[99].path_rate - rows[99].host_rate) < 0.05 and rows[99].kept


def test_sparse_hosts_shrink_to_the_global_rate(spark):
    good, bad = " ".join(f"word{i} is here" for i in range(60)), "too short"
    rows = [(f"big{h}", bad if i == 0 else good) for h in range(40) for i in range(50)] + [(f"one{h}", bad if h < 8 else good) for h in range(400)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    measured = quality.with_measures(docs)
    out = {r._host: r for r in quality.host_verdicts(measured, F.col("source"), quality.rules(), 0.08).collect()}
    assert not any(r.bad_few_words for r in out.values())
    assert all(abs(r.rate_few_words - 0.02) < 0.005 for r in out.values())
    # hosts that do differ keep their rates
    docs = spark.createDataFrame([(i, bad if h % 2 else good, f"h{h}") for i, h in enumerate(h for h in range(20) for _ in range(100))], "doc_id long, text string, source string")
    out = {r._host: r for r in quality.host_verdicts(quality.with_measures(docs), F.col("source"), quality.rules(), 0.08).collect()}
    assert all(r.bad_few_words == (int(h[1:]) % 2 == 1) for h, r in out.items())


def test_site_posteriors_by_hand(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = site_bayes.classified(docs, labels, F.col("source"), F.col("lang")).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
    good = [(r.source or "", r.lang or "", (1 - r.p_low) * (1 - r.p_toxic)) for r in out]
    n, mean = len(good), sum(g for *_, g in good) / len(good)

    def sites(key):
        of = {}
        for h, p, g in good:
            of.setdefault(key(h, p), []).append(g)
        return of

    hosts, paths = sites(lambda h, p: h), sites(lambda h, p: (h, p))
    avg = lambda x: sum(x) / len(x)

    def strength(of, center, groups, squares):
        inside = sum((g - avg(x)) ** 2 for x in of.values() for g in x) / (n - len(of))
        between = (sum(len(x) * (avg(x) - center(k)) ** 2 for k, x in of.items()) - (len(of) - groups) * inside) / squares
        return 1000.0 if between <= 0 else min(max(inside / between, 1.0), 1000.0)

    k_host = strength(hosts, lambda k: mean, 1, n - sum(len(x) ** 2 for x in hosts.values()) / n)
    k_path = strength(paths, lambda k: avg(hosts[k[0]]), len(hosts), n - sum(len(x) ** 2 / len(hosts[k[0]]) for k, x in paths.items()))
    logit = lambda p: np.log(p / (1 - p))
    for r, (h, p, g) in zip(out, good, strict=True):
        host = (sum(hosts[h]) + mean * k_host) / (len(hosts[h]) + k_host)
        path = (sum(paths[h, p]) + host * k_path) / (len(paths[h, p]) + k_path)
        clip = min(max(g, 1e-6), 1 - 1e-6)
        post = 1 / (1 + np.exp(-(logit(clip) + logit(path) - logit(mean))))
        assert np.allclose([r.host_rate, r.path_rate, r.posterior], [host, path, post], atol=1e-6) and r.kept == (r.posterior >= 0.5)


def test_pipeline_of_repeated_ids(spark, tmp_path):
    """Rows that share an id, or have none, are judged each by its own text; odd rows and clashing names pass through every stage."""
    rng = random.Random(12)
    a, b, c = (". ".join(" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 10**5)}" for _ in range(12)) for _ in range(8)) for _ in range(3))
    rows = [(1, a), (7, a), (7, b), (None, a), (None, c), (8, None), (9, ""), (7, b)]
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "length(text) as n_chars", "1 as _cut", "2 as th", "3 as cid", "4 as _runs", "5 as stays")
    near = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in near.collect()) == sorted([(1, a), (7, b), (0, c), (8, ""), (9, "")])
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect()) == sorted([(1, a), (7, b), (0, c)])
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = spark.createDataFrame(stage(spark, before, SF_SMALL).collect(), docs.schema)
        assert kept.columns == docs.columns
        ids, rest = {r.doc_id for r in kept.collect()}, {r.doc_id: r.text for r in before.collect()}
        if name == "line dedup":
            most, _ = lines_brute(sorted(rest.items()))
            want = {(r.doc_id, k) for r in line_dedup.deduplicated(before).collect() for k in r._cut or []}
            assert want <= most and len(want) >= 0.97 * len(most)
            for d, text in rest.items():
                left = "\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in want)
                touched = left != text or any(p[0] == d for p in want)
                assert (d in ids) == (not touched or bool(left.strip())), d
            assert all(r.text == "\n".join(x for k, x in enumerate(rest[r.doc_id].split("\n")) if (r.doc_id, k) not in want) and r.n_chars == len(r.text) for r in kept.collect())
        elif name == "MinHash near-dedup":
            want = near_brute(sorted(rest.items()))
            assert ids == {d for d, c in want.items() if d == c}
        elif name == "quality rules":
            bad = {r.doc_id for r in before.collect() if len(re.findall(r"[^ \t-\r]+", r.text or "")) < 50}
            assert not ids & bad
        elif name == "benchmark decontamination":
            gone = {r.doc_id for r in decontaminate.contamination(before, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).collect() if r.contaminated}
            assert ids == set(rest) - gone
    out = corpus_pipeline.STAGES[-1][1](spark, kept, SF_SMALL)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in kept.collect()}


def plain_links(parts, scope=400):
    """Weak parts that disjoint complementary ones are near, by looking at all pairs and triples."""
    names, values = [p for p in parts if p[0] in ("access", "ident")], [p for p in parts if p[0] in ("assign", "hex", "value")]

    def near(a, b):
        return (a[2] <= b[1] and b[1] - a[2] <= scope) or (b[2] <= a[1] and a[1] - b[2] <= scope)

    for p in parts:
        if (
            (p[0] == "ident" and any(near(p, v) for v in values))
            or (p[0] == "value" and any(near(p, n) for n in names))
            or (p[0] == "endpoint" and any(near(p, n) and near(p, v) and near(n, v) for n in names for v in values))
        ):
            yield p


def test_links_of_disjoint_parts(spark):
    kinds = list(secrets.KINDS)
    random.seed(11)
    texts = {t: sorted({(kinds[(k := random.randrange(6))], s := random.randrange(60), s + random.randint(1, 12)) for _ in range(random.randint(2, 9))}) for t in range(300)}
    rows = spark.createDataFrame([(t, s, kinds.index(k), e, k) for t, parts in texts.items() for k, s, e in parts], "place long, s int, o int, e int, k string")
    got = {}
    for r in secrets._linked(rows, 6).collect():
        got.setdefault(r.place, set()).add((r.k, r.s, r.e))
    assert got == {t: found for t, parts in texts.items() if (found := set(plain_links(parts, 6)))}


def test_a_string_does_not_support_itself(spark):
    texts = ["AKIA" + "ABCDEFGHIJKLMNOPQRSTUVWX0123456789ABCDEFGHIJKLMN", "login = " + "Abcdefgh" * 5, "https://h.example.com/" + "Abcdefgh" * 6 + "?account=joe", "login = joe password = abcdef12 https://x.example.com"]
    out = [secrets.secret_spans(spark.createDataFrame([(0, t)], "doc_id long, text string")).first() for t in texts]
    assert [r.n_linked for r in out] == [0, 0, 2, 2] and "endpoint" not in out[2].spans and [r.n_access for r in out] == [1, 0, 0, 0]


def test_very_many_matches_in_one_text(spark):
    import time

    text = "".join(f"login = user{i} and then password = secret{i:06d} at https://h{i}.example.com ; " for i in range(5_000))
    began = time.perf_counter()
    r = secrets.secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_assign, r.n_linked) == (5_000, 10_000) and time.perf_counter() - began < 30
