from __future__ import annotations

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import near_duplicates as N
from quern.llm.text import banded_distance, search, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


symbols = st.lists(st.integers(0, 3), max_size=14)


@settings(max_examples=300, deadline=None)
@given(symbols, symbols, st.integers(0, 16))
def test_banded_distance(a, b, limit):
    assert banded_distance(a, b, limit) == min(distance(a, b), limit + 1)


@settings(max_examples=200, deadline=None)
@given(symbols, symbols)
def test_search(pattern, text):
    least = min(distance(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    d, first, end = search(pattern, text)
    assert d == least == distance(pattern, text[first:end])


def test_sketches_follow_order():
    x = np.arange(1, 200, dtype=np.uint64)
    assert (N.sketches(x) == N.sketches(x.copy())).all()
    moved = np.concatenate((x[100:], x[:100]))
    same = (N.sketches(x) == N.sketches(moved)).mean()
    assert 0.2 < same < 0.9  # equal bags of k-mers, but for the seam, in another order


def test_occurrences_are_told_apart():
    x = N.labelled_kmers(np.array([7] * 12, np.uint64))
    assert len(set(x.tolist())) == len(x) == 8
    once, twice = np.arange(50, dtype=np.uint64), np.concatenate((np.arange(50, dtype=np.uint64), np.arange(9, dtype=np.uint64)))
    assert set(N.labelled_kmers(once).tolist()) <= set(N.labelled_kmers(twice).tolist())  # a repeat changes no other k-mer


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    random.seed(3)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [tuple(sorted(random.sample(range(300, 400), 2))) for _ in range(70)]
    found = {r.node: r.root for r in N.components(spark.createDataFrame(pairs, "pivot long, node long")).collect()}
    wanted = union_find(pairs, {x for p in pairs for x in p})
    assert {n: found.get(n, n) for n in wanted} == wanted
    assert N.components(spark.createDataFrame([], "pivot long, node long")).count() == 0


def _partition(rows):
    out = defaultdict(set)
    for key, c in rows:
        out[c].add(key)
    return {frozenset(v) for v in out.values()}


def test_classes_against_brute_force(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, passage = [], [random.choice(vocabulary) for _ in range(60)]
    for _ in range(60):
        base = [random.choice(vocabulary) for _ in range(random.randint(20, 200))]
        if random.random() < 0.4:
            base[5:5] = passage  # a passage that many share makes no duplicates by itself
        docs.append(base)
        for _ in range(random.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(max(1, len(copy) // random.choice([25, 40, 100]))):
                at = random.randrange(len(copy))
                copy[at : at + 1] = random.choice([[], [random.choice(vocabulary)], [copy[at], "extra"]])
            docs.append(copy)
    random.shuffle(docs)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(5)
    pairs = [(i, j) for j in range(len(docs)) for i in range(j) if N.similarity(docs[i], docs[j])]
    wanted = union_find(pairs, range(len(docs)))
    rows = N.classes(df).collect()
    assert {r.doc_id: r.class_id for r in rows} == wanted
    kept = N.one_of_each(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(wanted.values()))
    assert kept.columns == df.columns


def test_hard_rows(hard):
    rows = N.classes(hard).collect()
    assert len(rows) == hard.count()
    by = defaultdict(list)
    for r in rows:
        by[r.class_id].append(r.doc_id)
    assert sorted(by[1]) == [1, 1, 2, 3]
    assert sorted(by[4], key=str) == sorted([4, 5, None], key=str)  # null and empty texts are copies
    kept = N.one_of_each(hard)
    assert kept.schema == hard.schema
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 4, 6, 7, 8, 9, None], key=str)
    beyond = N.one_of_each(hard, broadcast_rows=0)
    assert sorted((r.doc_id for r in beyond.collect()), key=str) == sorted(ids, key=str)


def test_empty_and_single_tables(hard, none):
    assert N.classes(none).count() == 0
    assert N.one_of_each(none).count() == 0
    one = hard.where("doc_id = 6")
    assert [(r.class_id, r.class_size) for r in N.classes(one).collect()] == [(6, 1)]
    assert N.one_of_each(one).count() == 1


def test_digest_of_words_is_no_prefix():
    assert words("Ab, c") == [b"ab", b"c"] and words(None) == [] and words("—…") == []
    assert N.similarity(["a"] * 10, ["a"] * 9 + ["b"]) == 0.9
    assert N.similarity(["a"] * 10, ["b"] * 3 + ["a"] * 7) == 0.0


def test_large_group_stays_small(spark):
    """Pairs grow with the members, not with their square."""
    text = " ".join(f"w{i % 90}x{i}" for i in range(120))
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.lit(" z"), F.col("id")).alias("text"))
    table = N.signed(df.select(F.col("doc_id").alias("k"), F.col("text").alias("t")), N.FUNCTIONS)
    pairs = N._linear(N._shared(table.select(F.col("row_no").alias("node"), F.explode("sketch").alias("bucket"))))
    assert pairs.count() < 400 * 8
    assert {r.class_id for r in N.classes(df).collect()} == {0}


def _edited(words, share, rng, tag):
    out = list(words)
    for n, at in enumerate(rng.sample(range(len(out)), round(share * len(out)))):
        out[at] = f"{tag}n{n}"
    return out


def test_hub_of_many_copies(spark):
    """Copies are near their hub alone, which is the least row of no bucket."""
    rng = random.Random(8)
    hub = [f"h{i}" for i in range(200)]
    docs = [(i, " ".join(_edited(hub, 0.12, rng, f"c{i}"))) for i in range(300)] + [(300, " ".join(hub))]
    passage = [f"p{i}" for i in range(80)]  # a hot passage in texts that are near nothing, and in a hub and its copies
    own = [f"o{i}" for i in range(120)]
    docs += [(400 + i, " ".join(passage + [f"u{i}x{k}" for k in range(120)])) for i in range(150)]
    docs += [(600 + i, " ".join(passage + _edited(own, 0.2, rng, f"d{i}"))) for i in range(60)] + [(700, " ".join(passage + own))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    split = {i: t.split() for i, t in docs}
    similar = [(i, j) for i in split for j in split if i < j and len(set(split[i]) & set(split[j])) > 60 and N.similarity(split[i], split[j])]
    wanted = union_find(similar, split)
    assert len({wanted[i] for i in range(301)}) == 1 and len({wanted[i] for i in range(400, 550)}) == 150
    assert {r.doc_id: r.class_id for r in N.classes(df).collect()} == wanted


def test_links_found_by_similarity():
    """The share of pairs that meet in a bucket, at every similarity from the least one on; shorter texts are searched
    exactly."""
    rng = random.Random(11)
    for n in (100, 150, 400):
        for share in (0.2, 0.17, 0.15):
            met = 0
            for _ in range(100):
                a = [rng.getrandbits(60) for _ in range(n)]
                b = list(a)
                for at in rng.sample(range(n), int(share * n)):
                    b[at] = rng.getrandbits(60)
                x, y = (N.sketches(np.array(w, np.uint64)) for w in (a, b))
                met += bool((x == y).any())
            assert met >= 85 if share == 0.2 else met >= 90


def test_short_texts_link_without_common_shingles(spark):
    """Nine words whose middle one differs share no five of them in a row."""
    base = [f"s{i}" for i in range(9)]
    docs = [(0, " ".join(base)), (1, " ".join([*base[:4], "odd", *base[5:]])), (2, " ".join([*base[:4], *base[5:]])), (3, " ".join(base[:5])), (4, "t1 t2 t3 t4 t5"), (5, "t1 t2 zz t4 t5")]
    rows = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 2), st.integers(0, 12)), max_size=8), st.randoms())
def test_similar_texts_share_a_rare_pair(a, edits, rng):
    b = list(a)
    for at, kind, x in edits:
        at %= len(b) + 1
        b[at : at + (kind != 1)] = [] if kind == 0 else [x]
    spread = np.array([rng.randrange(5) for _ in range(8)])
    x, y = (N.rare_pairs(np.array(w, np.uint32), spread, 0.8) for w in (a, b or [99]))
    assert not N.similarity(a, b) or set(x.tolist()) & set(y.tolist())


def test_rare_pairs_are_few_and_outlast_edits_aimed_at_them():
    """Under a third of a text's pairs, where counting two pairs an edit took two fifths; edits that break as many of
    the taken pairs as they can, by changed or inserted words, leave one."""
    rng = random.Random(13)
    for n in (20, 60, 120, 250):
        for _ in range(20):
            spread = np.array([rng.randrange(50) for _ in range(1 << 12)])
            a = np.array([rng.getrandbits(32) for _ in range(n)], np.uint32)
            taken = N.rare_pairs(a, spread, 0.8)
            assert len(taken) <= 0.33 * n + 2
            of = {int(N._mixed(p[None])[0].astype(np.int64)): i for i, p in enumerate(N.word_pairs(a))}
            places = {of[int(x)] for x in taken}
            changed, left = a.copy(), set(places)
            for _ in range(int(0.2 * n + 1e-9)):
                at = max(range(n), key=lambda i: (i in left) + (i + 1 in left))
                changed[at], left = rng.getrandbits(32), left - {at, at + 1}
            added = list(a)
            for at in sorted(rng.sample(sorted(places), min(len(places), n // 4)), reverse=True):
                added[at:at] = [rng.getrandbits(32)]
            for b in (changed, np.array(added, np.uint32)):
                assert N.similarity(a.tolist(), b.tolist()) and set(taken.tolist()) & set(N.rare_pairs(b, spread, 0.8).tolist())


def test_candidates_are_compared_by_all_their_words(spark):
    """Long texts that share three quarters of their words, and one that is near another: bags of 256 bins let all pass."""
    rng = random.Random(14)
    passage = [rng.getrandbits(32) for _ in range(600)]
    texts = [passage + [rng.getrandbits(32) for _ in range(200)] for _ in range(40)]
    texts.append(texts[0][:700] + [rng.getrandbits(32) for _ in range(100)])
    rows = [(i, i, len(w), bytearray(N.bag(np.array(w, np.uint64))), bytearray(np.array(w, "<u4").tobytes())) for i, w in enumerate(texts)]
    df = spark.createDataFrame(rows, "node long, root long, size int, bag binary, words binary")
    none = spark.createDataFrame([], "place long, node long, root long")
    buckets = df.selectExpr("7L AS place", "node", "root")
    pairs = N._by_rare_pairs(df, 0.8)
    assert [(r.a, r.b) for r in N._candidates(pairs, buckets, df, 0.8).collect()] == [(0, 40)]
    assert [(r.a, r.b) for r in N._candidates(pairs, none, df, 0.8).collect()] == [(0, 40)]


def test_outlines_bring_texts_nearer():
    """Of either kind, they never say more edits than there are."""
    rng = random.Random(15)
    for n in (30, 2040, 2060):
        for _ in range(6):
            a = [rng.randrange(n // 3) for _ in range(n)]
            b = [x if rng.random() > 0.1 else rng.randrange(n) for x in a] + [rng.randrange(n) for _ in range(rng.randint(0, n // 10))]
            sizes = np.array([len(a), len(b)])
            apart = N._apart([N.outline(np.array(w, np.uint64)) for w in (a, b)], sizes, np.array([0]), np.array([1]))[0]
            assert 0 <= apart <= 2 * banded_distance(a, b, len(b))


def test_candidates_in_blocks(spark):
    """Every pair of two classes within reach is found once, however the texts of a place are cut."""
    rng = random.Random(6)
    common = [rng.getrandbits(32) for _ in range(30)]
    rows = []
    for i in range(60):
        words = np.array(common[: 30 - i % 4] + [rng.getrandbits(32) for _ in range(i % 5)], np.uint32)
        rows.append((i, 0 if i % 3 else i, len(words), bytearray(N.bag(words.astype(np.uint64))), bytearray(words.astype("<u4").tobytes())))
    df = spark.createDataFrame(rows, "node long, root long, size int, bag binary, words binary").repartition(3)
    wanted = set()
    for i, a in enumerate(rows):
        for b in rows[:i]:
            x, y = sorted((a, b), key=lambda r: r[2])
            bags = np.stack([np.frombuffer(r[3], np.uint8) for r in (x, y)]).astype(np.int16)
            if len(N.within_reach(np.array([x[1], y[1]]), np.array([x[2], y[2]]), bags, 0.8)[0]):
                wanted.add((min(a[0], b[0]), max(a[0], b[0])))
    for block in (3, 1000):
        found = [(r.a, r.b) for r in N._candidates(N._by_rare_pairs(df, 0.8), spark.createDataFrame([], "place long, node long, root long"), df, 0.8, block).collect()]
        similar = {(i, j) for i, j in wanted if N.similarity(*(np.frombuffer(rows[k][4], "<u4").tolist() for k in (i, j)))}
        assert len(found) == len(set(found)) and similar <= set(found) <= wanted


def test_reach_drops_no_pair():
    rng = random.Random(9)
    for _ in range(300):
        a = [rng.randrange(60) for _ in range(rng.randint(5, 60))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 4)):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice([[], [rng.randrange(60)], [b[at], rng.randrange(60)]])
        a, b = sorted((a, b), key=len)
        bags = np.stack([np.frombuffer(N.bag(np.array(x, np.uint64)), np.uint8) for x in (a, b)]).astype(np.int16)
        found = len(N.within_reach(np.array([0, 1]), np.array([len(a), len(b)]), bags, 0.8)[0])
        assert found or not N.similarity(a, b)


def test_texts_are_written_once(spark, monkeypatch):
    """The work folder never holds a second copy of all texts' words and sketches."""
    rng = random.Random(16)
    vocabulary = [f"v{i}" for i in range(60_000)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(vocabulary, k=300))) for i in range(300)], "doc_id long, text string").coalesce(1)
    held, peak = {}, []

    def written(table, tag, write=N.written):
        out = write(table, tag)
        held[out._quern_path] = sum(p.stat().st_size for p in Path(out._quern_path.removeprefix("file:")).glob("*.parquet"))
        peak.append(sum(held.values()))
        return out

    def discard(*tables, drop=N.discard):
        drop(*tables)
        for t in tables:
            del held[t._quern_path]

    monkeypatch.setattr(N, "written", written)
    monkeypatch.setattr(N, "discard", discard)
    assert {r.class_size for r in N.classes(df).collect()} == {1}
    assert max(peak) < 1.3 * 300 * (4 * 300 + 8 * N.FUNCTIONS)
    held.clear()
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)  # sketches of those kept are then written once more, words are not
    peak.clear()
    assert {r.class_size for r in N.classes(df).collect()} == {1}
    assert max(peak) < 1.3 * 300 * (4 * 300 + 2 * 8 * N.FUNCTIONS)


def test_pairs_of_unlike_lengths_are_not_looked_up(spark, monkeypatch):
    """A passage of 120 words with nothing else, twice, and amid 10 or 400 words of others' own."""
    passage = " ".join(f"p{i}" for i in range(120))
    sizes = [0, 10, *[400] * 20]
    df = spark.createDataFrame([(i, passage + "".join(f" u{i}x{k}" for k in range(n))) for i, n in enumerate(sizes)], "doc_id long, text string").coalesce(1)
    asked = []

    def verified(pairs, *rest, verify=N._verified):
        asked.extend((r.pivot, r.node) for r in pairs.collect())
        return verify(pairs, *rest)

    monkeypatch.setattr(N, "_verified", verified)
    rows = {r.doc_id: r.class_id for r in N.classes(df).collect()}
    assert rows == {i: 0 if i < 2 else i for i in range(len(sizes))}
    assert (0, 1) in asked and all(b == 1 or a > 1 for a, b in asked)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 1), (2, 3)], "pivot long, node long")
    lengths = spark.createDataFrame([(1, 100), (2, 125), (3, 126), (4, 80)], "node long, size int")
    assert sorted(tuple(r) for r in N._alike_in_length(pairs, lengths, 0.8).collect()) == [(1, 2), (2, 3), (4, 1)]
