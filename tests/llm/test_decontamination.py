from __future__ import annotations

import random

from quern.llm import decontamination as D
from quern.llm.text import search, words


def brute(docs, items, rate=0.15):
    out = {}
    for d, text in docs:
        w = words(text)
        for i, t in items:
            p = words(t)
            if not p or not w:
                continue
            k = int(rate * len(p))
            dist = search(p, w)[0]
            if dist <= k:
                out[d, i] = dist
    return out


def test_against_brute_force(spark):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(80)]
    pick = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(pick(random.randint(1, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "?!"), (None, "w1 w2 w3 w4 w5 w6 w7")]
    docs = []
    for d in range(120):
        w = pick(random.randint(0, 120))
        for _ in range(random.choice([0, 1, 1, 2])):
            part = random.choice(items[:40])[1].split()
            for _ in range(random.randint(0, max(1, len(part) // 6))):
                if part:
                    at = random.randrange(len(part))
                    part[at : at + 1] = random.choice([[], ["new"], [part[at], "new"]])
            at = random.randint(0, len(w))
            w[at:at] = part
        docs.append((d, ", ".join(w).title()))
    docs += [(500, items[0][1]), (501, None), (502, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    tests = spark.createDataFrame(items, "item_id long, text string")
    wanted = brute(docs, items)
    for block in (4 << 20, 500):
        found = {(r.doc_id, r.item_id): r.distance for r in D.find_items(df, tests, block_bytes=block).collect()}
        assert found == wanted
    assert sum(d > 0 for d in wanted.values()) > 5
    kept = sorted(r.doc_id for r in D.without_items(df, tests).collect())
    assert kept == sorted({d for d, _ in docs} - {d for d, _ in wanted})


def test_hard_rows_and_empty_tables(spark, hard, none):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the old river")], "item_id long, text string")
    found = [r.doc_id for r in D.find_items(hard, items).collect()]
    assert sorted(found) == [1, 1, 2, 3]
    assert D.without_items(hard, items).schema == hard.schema
    assert D.without_items(hard, items).count() == hard.count() - 4
    assert D.find_items(none, items).count() == 0
    nothing = items.limit(0)
    assert D.find_items(hard, nothing).count() == 0
    assert D.without_items(hard, nothing).count() == hard.count()


def test_pieces_cover_the_item():
    for n in range(1, 70):
        k = D.budget(n, 0.15)
        assert k == n * 15 // 100
        parts = D.pieces(n, k)
        assert parts[0][0] == 0 and parts[-1][1] == n and len(parts) == k + 1
        assert all(a[1] == b[0] and b[1] > b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_one_law_for_all_lengths(spark):
    """Items of one word to forty, whole and with as many errors as the rate gives and one more."""
    rng = random.Random(3)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(1, 41)]
    docs = []
    for n, t in items:
        for errors in (0, n * 15 // 100, n * 15 // 100 + 1):
            w = t.split()
            for at in rng.sample(range(n), min(errors, n)):
                w[at] = "odd"
            docs.append((1000 * errors + n, " ".join(["before", *w, "after"])))
    found = {(r.doc_id, r.item_id, r.distance) for r in D.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items * 2, "item_id long, text string")).collect()}
    assert found == {(d, d % 1000, d // 1000) for d, _ in docs if d // 1000 <= d % 1000 * 15 // 100}


def test_copies_of_an_item_are_spread(spark):
    """Many keys with one text don't meet in one block; equal rows count once."""
    text = " ".join(f"w{i}" for i in range(40))
    items = spark.range(300).selectExpr("id AS item_id", f"'{text}' AS text")
    blocks = list(D._blocks(items.unionByName(items), 2000, "item_id", "text"))
    assert sum(map(len, blocks)) == 300 and max(map(len, blocks)) < 40
