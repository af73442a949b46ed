from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quern.llm import quality as Q


def brute(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    random.seed(8)
    parts = ["a", "b", "c d", "a b c d e", "\n", "\n\n", "\t", "#x", "é🙂", "\x0b", "\xa0", "|", "", "ab"]
    texts = [" ".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(500)] + [None, "", " ", "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", Q.base_statistics(F.col("t")).alias("x")).select("i", "x.*")
    for r in df.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.i]), repr(texts[r.i])


def drawn(n, mean, cov, prior):
    return (n * mean + Q.PRIOR * prior[0]) / (n + Q.PRIOR), (n * cov + Q.PRIOR * prior[1]) / (n + Q.PRIOR)


def moments(x):
    return len(x), x.mean(0), np.cov(x.T, bias=True).reshape(x.shape[1], x.shape[1])


def mcd(groups, support=Q.SUPPORT):
    """The same estimate in numpy: ``groups`` maps (language, source) to its rows; squared distances of each."""
    floors, dets, places = np.array(list(Q.FLOORS.values())), {}, {}

    def estimate(chosen, factor):
        whole = moments(np.concatenate(list(chosen.values())))[1:]
        of_language = {g: drawn(*moments(np.concatenate([x for (h, _), x in chosen.items() if h == g])), whole) for g, _ in chosen}
        return {k: (m, factor * c + np.diag(floors**2)) for k, x in chosen.items() for m, c in [drawn(*moments(x), of_language[k[0]])]}

    def distance(x, m, c):
        return np.einsum("ij,ij->i", x - m, np.linalg.solve(c, (x - m).T).T)

    for start, width in enumerate(Q.WIDTHS):
        chosen = {}
        for k, x in groups.items():
            q1, q3 = (np.quantile(x, q, axis=0, method="inverted_cdf") for q in (0.25, 0.75))
            inside = x[(np.abs(x - (q1 + q3) / 2) / np.maximum(q3 - q1, floors)).max(1) <= width]
            if len(inside):
                chosen[k] = inside
        found = estimate(chosen, 1.0)
        for _ in range(40):
            chosen = {}
            for k, (m, c) in found.items():
                d2 = distance(groups[k], m, c)
                chosen[k] = groups[k][d2 <= np.quantile(d2, support, method="inverted_cdf")]
            found = estimate(chosen, Q.consistency(len(floors), support))
        for k, (m, c) in found.items():
            dets[k, start], places[k, start] = np.linalg.slogdet(c)[1], (m, c)
    return {k: distance(x, *places[min((d, k, i) for (j, i), d in dets.items() if j == k)[1:]]) for k, x in groups.items()}


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(4)
    d, groups, frames = len(Q.NAMES), {}, []
    for key, n in ((("a", "x"), 500), (("a", "y"), 900), (("b", "x"), 300), (("b", "z"), 7), (("c", "x"), 1)):
        x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.3 + rng.normal(size=d)
        x[: n // 10] += 15
        groups[key] = x
        frames.append(pd.DataFrame(x, columns=list(Q.NAMES)).assign(g=key[0], s=key[1], i=range(n)))
    found = Q.outliers(spark.createDataFrame(pd.concat(frames)), ["g", "s"]).toPandas()
    wanted = mcd(groups)
    for (g, s), x in groups.items():
        got = found[(found.g == g) & (found.s == s)].sort_values("i").d2.to_numpy()
        assert np.allclose(got, wanted[g, s], rtol=0.02, atol=0.05)
        if len(x) >= 300:
            assert (got[: len(x) // 10] > Q.chi_square_bound(d)).all() and (got[len(x) // 10 :] > Q.chi_square_bound(d)).mean() < 0.01


def test_consistency_factor():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200_000, 5))
    d2 = (x**2).sum(1)
    inner = x[d2 <= np.quantile(d2, 0.75)]
    assert abs(Q.consistency(5, 0.75) * inner.var() - 1) < 0.01


def test_junk_goes_and_clean_stays(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choice(["river", "stone", "window", "garden", "morning", "letter", "quiet", "and", "the"]) + rng.choice(["", ".", ","]) for _ in range(rng.randint(12, 900))) for _ in range(600)]
    junk = [" ".join(f"{w}###&&&" for w in t.split()) for t in clean[:20]]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean + junk)]
    found = {r.doc_id: r for r in Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i].kept == (not found[i].base_failed) for i in range(600))
    assert not any(found[600 + i].kept for i in range(20))


def test_joint_distance_alone_decides(spark):
    """Rows that no single statistic gives away, long clean texts, and a source of one row."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 1)) * 0.5
    rows = [(float(a + e), float(2 * a - e), 0.0, 0.0, "en", "s") for a, e in zip(x[:, 0], rng.normal(size=2000) * 0.01, strict=True)]
    rows += [(4.0, -8.0, 3.0, 3.0, "en", "s"), (0.1, 0.2, 0.0, 0.0, "en", "lone"), (9.0, -30.0, 3.0, 3.0, "en", "other")]
    df = spark.createDataFrame(rows, [*Q.NAMES, "g", "s"])
    far = [r.d2 > Q.chi_square_bound(len(Q.NAMES)) for r in Q.outliers(df, ["g", "s"]).orderBy("s", "word_size").collect()]
    assert far[0] is False and far[1] is True and far[-1] is True and sum(far[2:-1]) <= 2


def test_rejects_junk_and_keeps_the_rest(spark):
    d = "/root/testdata/sf0.1"
    rows = Q.judged(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").select("kept", "quality").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert good.kept.mean() > 0.995 and bad.kept.mean() < 0.75


def test_hard_rows(hard, none):
    rows = Q.judged(hard).collect()
    wanted = sorted(((r.doc_id, *brute(r.text)) for r in hard.collect()), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=str) == wanted
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.distance**2 <= Q.chi_square_bound(len(Q.NAMES)))
    assert all((r.distance is None) == r.base_failed for r in rows)
    assert Q.judged(none).count() == 0


def test_no_python_in_the_plan(hard):
    plan = Q.judged(hard)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
