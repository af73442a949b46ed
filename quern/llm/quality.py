"""Robust multivariate outliers among text statistics, in DataFrame functions alone.

Each text has a vector of transformed statistics. For every language and source the minimum covariance determinant
is approached by concentration steps: a mean and covariance, the distance of every row, the fraction ``support`` of
rows of least distance, their mean and covariance, and so on until no group's determinant falls any more. Steps begin
from three subsets, middle boxes of different width, and each group takes the result of least determinant. Steps are
plain aggregates over all rows: sums of products are combined before the shuffle and the distance that cuts off the
fraction is a mergeable quantile, so a source with a third of all rows is no task's burden.

A group's moments are drawn towards its language's, and those towards the whole table's, as if by ``PRIOR`` rows. So
groups of any size are judged by one law: one of a single row has nearly its language's estimate, one of thousands
its own.

Rows beyond the chi-square bound are rejected, by their distance alone. The statistics are rates, bounded below by
what clean text has; a text's length isn't among them, since long texts are no junk. The bound is far out (see
``Z``): rules should drop junk, not tails.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import columns_for, discard, written

#: Least standard deviation per statistic: what is nearly constant in clean text must not make small changes outliers.
FLOORS = {"word_size": 0.1, "symbols": 0.3, "lines": 0.35, "repeats": 0.35}
NAMES = tuple(FLOORS)
SUPPORT, PRIOR = 0.75, 20.0
#: Half widths of the boxes that steps begin from, in ranges between quartiles about their middle.
WIDTHS = (0.75, 1.5, math.inf)
#: Steps end when no determinant's logarithm falls by more than ``SETTLED``, which a falling sequence must reach; the
#: quantiles are approximate, so there is an upper bound as well.
SETTLED, MOST_STEPS = 1e-3, 30
#: Standard deviations of a normal with the rejection's tail probability (2.9e-7).
Z = 5.0
GROUPS_BROADCAST = 100_000
#: Of the mergeable quantiles: ranks are exact to one part in so many.
ACCURACY = 10_000


def chi_square_bound(d: int, z: float = Z) -> float:
    """The chi-square quantile at normal quantile ``z`` (Wilson and Hilferty)."""
    return d * (1 - 2 / (9 * d) + z * math.sqrt(2 / (9 * d))) ** 3


def consistency(d: int, support: float) -> float:
    """Factor that makes the covariance of the central part of a normal sample that of the whole."""
    from statistics import NormalDist

    q = chi_square_bound(d, NormalDist().inv_cdf(support))
    # P(chi2_{d+2} <= q) by its series.
    a, x = (d + 2) / 2, q / 2
    term = total = 1 / a
    for k in range(1, 200):
        term *= x / (a + k)
        total += term
    return support / (total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def _bound(value: Column, body) -> Column:
    """``body`` of a value computed once: as the only element of an array it is a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def base_statistics(text: Column) -> Column:
    """Struct of the exact counts of a text; words lie between the white space of ASCII."""
    white = r"[\x20\x09-\x0D]+"
    full = F.coalesce(text, F.lit(""))

    def repeats(ws: Column) -> Column:
        """Words that lie in a five-word window found twice or more."""
        hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 5), lambda i: F.xxhash64(ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]))

        def covered(hs: Column) -> Column:
            at = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

            def ends(pairs: Column) -> Column:
                n = F.size(pairs)
                double = F.filter(pairs, lambda p, j: ((j > 0) & (pairs[F.greatest(j - 1, F.lit(0))]["h"] == p["h"])) | ((j < n - 1) & (pairs[F.least(j + 1, n - 1)]["h"] == p["h"])))
                starts = F.array_sort(F.transform(double, lambda p: p["i"]))
                return _bound(starts, lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(5), F.when(j < F.size(s) - 1, s[F.least(j + 1, F.size(s) - 1)] - x).otherwise(5))), F.lit(0), lambda acc, x: acc + x))

            return _bound(at, ends)

        return F.when(F.size(ws) < 6, 0).otherwise(_bound(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(covered(hs))))

    def of(ws: Column) -> Column:
        lines = F.filter(F.split(full, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(full, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            repeats(ws).cast("long").alias("n_repeat_words"),
        )

    return _bound(F.filter(F.split(full, white), lambda w: w != ""), of)


def vector() -> dict[str, Column]:
    """The transformed statistics of a row of counts."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "word_size": F.log(F.greatest(F.col("word_chars") / n, F.lit(0.5))),
        "symbols": F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "lines": F.log1p(10 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": F.log1p(10 * F.col("n_repeat_words") / n),
    }


_D = range(len(NAMES))
_PAIRS = [(i, j) for i in _D for j in range(i + 1)]
_MOMENTS = [f"m{i}" for i in _D] + [f"c{i}{j}" for i, j in _PAIRS]


def _moments(sums: DataFrame, key: list[str]) -> DataFrame:
    """key, n, means and covariances of the sums (n, s_i, p_ij) of each key."""
    total = sums.groupBy(*key).agg(*(F.sum(c).alias(c) for c in ["n", *(f"s{i}" for i in _D), *(f"p{i}{j}" for i, j in _PAIRS)]))
    mean = {i: F.col(f"s{i}") / F.col("n") for i in _D}
    return total.select(*key, "n", *(mean[i].alias(f"m{i}") for i in _D), *((F.col(f"p{i}{j}") / F.col("n") - mean[i] * mean[j]).alias(f"c{i}{j}") for i, j in _PAIRS))


def _drawn(own: DataFrame, prior: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """``own`` moments drawn towards ``prior`` ones as if those came from PRIOR more rows."""
    both = own.join(prior.select(*on, *(F.col(c).alias(f"_{c}") for c in _MOMENTS)), on)
    return both.select(*keep, "n", *(((F.col("n") * F.col(c) + PRIOR * F.col(f"_{c}")) / (F.col("n") + PRIOR)).alias(c) for c in _MOMENTS))


def _estimate(rows: DataFrame, key: list[str], factor: float) -> DataFrame:
    """One row per group and start: mean m_i, Cholesky factor l_i_j of the covariance times ``factor``, floors added,
    and the logarithm of its determinant. ``key`` goes from the language to the group."""
    sums = rows.groupBy(*key, "start").agg(F.count("*").alias("n"), *(F.sum(NAMES[i]).alias(f"s{i}") for i in _D), *(F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}{j}") for i, j in _PAIRS))
    sums = written(sums, "sums")
    out = _moments(sums, ["start"])
    for depth in range(1, len(key) + 1):
        on = [*key[: depth - 1], "start"]
        out = _drawn(_moments(sums, [*key[:depth], "start"]), out, on, [*key[:depth], "start"])
    out = out.withColumns({f"c{i}{j}": factor * (F.greatest(F.col(f"c{i}{j}"), F.lit(0.0)) if i == j else F.col(f"c{i}{j}")) + (FLOORS[NAMES[i]] ** 2 if i == j else 0.0) for i, j in _PAIRS})
    for j in _D:  # a column of the factor at a time
        cut = reduce(add, (F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - cut, F.lit(FLOORS[NAMES[j]] ** 2 / 100))))
        below = {f"l{i}{j}": (F.col(f"c{i}{j}") - reduce(add, (F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, len(NAMES))}
        out = out.withColumns(below) if below else out
    logs = reduce(add, (2 * F.log(f"l{i}{i}") for i in _D))
    out = written(out.select(*key, "start", *(f"m{i}" for i in _D), *(f"l{i}{j}" for i, j in _PAIRS), logs.alias("log_det")), "mcd")
    discard(sums)
    return out


def _distances(rows: DataFrame, estimates: DataFrame, key: list[str], few: bool, more: list[str]) -> DataFrame:
    """``rows`` with the columns ``more`` of the estimates and ``d2``, the squared Mahalanobis distance, by forward
    substitution."""
    out = rows.join(F.broadcast(estimates) if few else estimates, key)
    for i in _D:
        out = out.withColumn(f"y{i}", (F.col(NAMES[i]) - F.col(f"m{i}") - reduce(add, (F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    d2 = reduce(add, (F.col(f"y{i}") ** 2 for i in _D))
    return out.select(*rows.columns, *more, d2.alias("d2"))


def outliers(rows: DataFrame, key: list[str], support: float = SUPPORT) -> DataFrame:
    """``rows`` (with the statistics NAMES and the group columns ``key``) with their ``d2``."""
    quart = written(rows.groupBy(*key).agg(*(F.percentile_approx(c, [0.25, 0.75], ACCURACY).alias(f"_q_{c}") for c in NAMES)), "quartiles")
    groups = quart.count()
    few = groups * len(WIDTHS) <= GROUPS_BROADCAST  # a row of some 15 numbers each: 15 MB at most
    near = rows.join(F.broadcast(quart) if few else quart, key)
    off = [F.abs(F.col(c) - (F.col(f"_q_{c}")[0] + F.col(f"_q_{c}")[1]) / 2) / F.greatest(F.col(f"_q_{c}")[1] - F.col(f"_q_{c}")[0], F.lit(FLOORS[c])) for c in NAMES]
    inside = F.filter(F.array(*(F.when(F.greatest(*off) <= w, F.lit(i)) for i, w in enumerate(WIDTHS))), lambda x: x.isNotNull())
    table = _estimate(near.select(*key, *NAMES, F.explode(inside).alias("start")), key, 1.0)
    scale, plain = consistency(len(NAMES), support), rows.select(*key, *NAMES)
    for step in range(MOST_STEPS):
        held = _distances(plain, table, key, few, ["start"])
        cut = held.groupBy(*key, "start").agg(F.percentile_approx("d2", support, ACCURACY).alias("_cut"))
        central = held.join(F.broadcast(cut) if few else cut, [*key, "start"]).where(F.col("d2") <= F.col("_cut"))
        new = _estimate(central, key, scale)
        fall = new.join(table.select(*key, "start", F.col("log_det").alias("_last")), [*key, "start"]).agg(F.max(F.col("_last") - F.col("log_det"))).first()[0]
        discard(table)
        table = new
        if step and (fall is None or fall <= SETTLED):  # the first step changes the scale
            break
    best = written(table.groupBy(*key).agg(F.min_by(F.struct(*(c for c in table.columns if c not in key)), F.struct("log_det", "start")).alias("x")).select(*key, "x.*"), "best")
    discard(table, quart)
    return _distances(rows, best, key, few, [])


def judged(docs: DataFrame, z: float = Z, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: its counts, base_failed, distance and kept.

    ``kept`` is false where base_failed (under 10 words, or over a fifth of the words in repeated five-word windows)
    or where the vector's distance is beyond the bound. Estimates are made from rows that pass the base rule, for
    groups of a language and a source of any size. Null texts are empty, null languages and sources are groups of
    their own, repeated rows are each judged, an empty table gives no rows and other columns are not looked at. Texts
    are read once and never shuffled.
    """
    source_rows = columns_for(docs, k=key, t=text, g=lang, s=source)
    stats = source_rows.select(F.col("k").alias("doc_id"), F.coalesce("g", F.lit("\0")).alias("g"), F.coalesce("s", F.lit("\0")).alias("s"), base_statistics(F.col("t")).alias("x")).select("doc_id", "g", "s", "x.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = written(stats.withColumn("base_failed", failed).withColumns(vector()), "statistics")
    measured = outliers(rows.where(~F.col("base_failed")), ["g", "s"])
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    verdict = F.col("d2") <= chi_square_bound(len(NAMES), z)
    return measured.select(*columns, verdict.alias("kept"), F.sqrt("d2").alias("distance")).unionByName(
        rows.where("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    )
