from __future__ import annotations

import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import toxicity as T


def test_learns_and_generalises_to_misspellings():
    rng = np.random.default_rng(0)
    vocabulary = [f"{a}{b}" for a in ("mor", "tal", "ven", "qui", "rosp", "lind") for b in ("a", "en", "ith", "oku", "ers")]
    texts, labels = [], []
    for i in range(600):
        w = rng.choice(vocabulary, rng.integers(20, 120)).tolist()
        if i % 4 == 0:
            w[int(rng.integers(len(w)))] = str(rng.choice(["wretchface", "gutterscum", "vileheart"]))
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    m = T.train(texts[:400], labels[:400], epochs=100)
    s = np.array([m.score(t) for t in texts[400:]])
    assert ((s >= 0.3) == np.array(labels[400:])).mean() > 0.97
    assert m.score("talen venith wretchfacce quien") > 0.5 > m.score("talen venith quien")


def _grams_by_hand(word):
    """N-grams of a word as code points, border marks at either end, and their buckets' hashes one at a time."""
    m32, out = (1 << 32) - 1, []
    c = [1, *map(ord, word), 1]
    for n in T.GRAMS:
        for at in range(len(c) - n + 1):
            h = c[at]
            for x in c[at + 1 : at + n]:
                h = (h * 0x01000193 + x) & m32
            h ^= n * 0x9E3779B9 & m32
            h = (h ^ h >> 16) * 0x7FEB352D & m32
            h = (h ^ h >> 15) * 0x846CA68B & m32
            out.append(h >> 14)
    return out


def _own_by_hand(word):
    m64 = (1 << 64) - 1

    def mixed(h):
        h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & m64
        h = (h ^ h >> 27) * 0x94D049BB133111EB & m64
        return h ^ h >> 31

    total, power = 0, 1
    for x in word:
        power = power * 0x9E3779B97F4A7C15 & m64
        total = total + mixed(ord(x)) * power & m64
    return mixed(total) >> 46


def _score_by_hand(model, text):
    words, values = re.findall(r"[^\W_]+", (text or "").lower()), []
    for w in words:
        found = [*_grams_by_hand(w), _own_by_hand(w)]
        values.append(sum(float(model.weights[b]) for b in found) / len(found))
    z = [np.mean(values[a : a + model.window]) for a in range(0, max(1, len(values) - model.window // 2), model.window // 2)] if values else [0.0]
    return 1 / (1 + np.exp(-(max(z) + model.bias)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=200), st.lists(st.sampled_from(["a", "Éa", "ab", "wörter", "x9", "ﬁn", "日本", "İ", "Σας", "_", "-"]), max_size=60).map(" ".join)), max_size=6), st.integers(1, 60))
def test_scores_against_brute_force(texts, size):
    model = T.Model(np.random.default_rng(2).normal(0, 1, 1 << 18), -0.5, 12)
    wanted = [_score_by_hand(model, t) for t in texts]
    assert np.allclose(model.scores(texts), wanted, atol=1e-4)
    assert [("".join(p for i, p in zip(*[sum(x, []) for x in zip(*T.chunks(texts, size))], strict=True) if i == j) if any(texts) else "") for j in range(len(texts))] == [t or "" for t in texts]
    bags = T.Bags(texts, 1 << 18)
    for i, t in enumerate(texts):
        mine = [sorted(bags.flat[bags.heads[k] : bags.heads[k] + bags.sizes[k]].tolist()) for k in bags.tokens[bags.ends[i] : bags.ends[i + 1]]]
        assert mine == [sorted([*_grams_by_hand(w), _own_by_hand(w)]) for w in re.findall(r"[^\W_]+", (t or "").lower())]


def test_long_texts_are_cut_between_words():
    rng = np.random.default_rng(4)
    text = " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(3000))
    model = T.Model(rng.normal(0, 1, 1 << 18), 0.0, 12)
    whole = model.scores([text, "b"])
    small = [p for _, pieces in T.chunks([text], 100) for p in pieces]
    assert len(small) > 50 and "".join(small) == text and all(p[0] == " " for p in small[1:])
    assert np.allclose(whole, [_score_by_hand(model, text), _score_by_hand(model, "b")], atol=1e-4)


def test_stretches():
    for window in (1, 2, 7, 12):
        ends = np.cumsum([0, 0, 1, 5, 12, 13, 30, 100])
        lo, hi, of = T.stretches(ends, window)
        half = max(1, window // 2)
        wanted = [(ends[d] + a, min(ends[d] + a + window, ends[d + 1]), d) for d in range(len(ends) - 1) for n in [ends[d + 1] - ends[d]] for a in (range(0, max(1, n - half), half) if n else ())]
        assert list(zip(lo.tolist(), hi.tolist(), of.tolist(), strict=True)) == [tuple(map(int, w)) for w in wanted]


def test_one_label_gives_its_base_rate():
    m = T.train(["a b", "c"], [0, 0])
    assert m.score("anything") == m.score("") < 0.3
    assert 0 < T.train([], []).score(None) < 1


def test_held_out_rows_and_their_labels_are_not_learnt(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = {r.doc_id for r in docs.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    rows = T.training_sample(docs, labels)
    flipped = labels.withColumn("toxic", F.when(T.is_held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(rows.collect()) == sorted(T.training_sample(docs, flipped).collect())
    rows = T.scored(docs, T.trained(rows, epochs=3)).collect()
    assert {r.doc_id for r in rows if r.held_out} == held
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    mine = docs.join(labels.where(T.is_held_out()), "doc_id").select("text", "toxic").collect()
    m = T.trained(T.training_sample(docs, labels))
    s = m.scores([r.text for r in mine])
    t = np.array([r.toxic == 1 for r in mine])  # some 15 % of these are noise: no text tells them apart
    pairs = (s[t][:, None] > s[~t][None, :]).mean()
    assert pairs > 0.88 and t[s >= 0.3].mean() > 0.8 and (s >= 0.3)[t].mean() > 0.6


def test_hard_rows(hard, none):
    m = T.train(["bad thing", "good thing"] * 5, [1, 0] * 5, epochs=5)
    rows = T.scored(hard, m).collect()
    assert len(rows) == hard.count() and all(0 <= r.score <= 1 for r in rows)
    assert T.scored(none, m).count() == 0
    kept = T.without_toxic(hard, m, threshold=2.0)
    assert kept.schema == hard.schema and kept.count() == hard.count()
    assert T.without_toxic(hard, m, threshold=0.0).count() == 0


def test_sample_is_bounded_and_survives_odd_labels(spark, hard, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 7), (4, 0), (5, 1)], "doc_id long, toxic int")
    few = T.training_sample(hard, labels, sample=2).collect()
    assert len(few) <= 2 and {r.y for r in few} <= {0, 1}
    every = {r.k: (r.y, r.t) for r in T.training_sample(hard, labels).collect()}
    assert set(every) == {k for k in (1, 4, 5) if zlib.crc32(str(k).encode()) % 4 != 2}
    assert every.get(1, (1, ""))[0] == 1 and every.get(5, (1, ""))[1] == ""  # of conflicting labels the greatest; a null text is empty
    assert T.training_sample(none, labels).count() == T.training_sample(hard, labels.limit(0)).count() == 0
    assert abs(T.trained(T.training_sample(none, labels)).score("x") - T.PRIOR) < 1e-6
    rows = spark.createDataFrame([(i, i, i % 2, f"word{i} " * 50) for i in range(40)], "k long, h long, y int, t string").repartition(7)
    assert T.trained(rows, epochs=2).score("") == T.trained(rows.repartition(3), epochs=2).score("")
    one = T.trained(rows, sample_bytes=1, epochs=2)  # the first row alone
    assert one.score("word1") == T.train(["word0 " * 50], [0]).score("word1")
