"""Stripe pruning: from a predicate to the stripes that can hold a matching row.

Each predicate becomes a Column over the manifest that is true where a stripe must be kept. It may keep too much,
never too little: what isn't understood keeps all, and Spark filters the rows again.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.dataset import STRIPE, Dataset
from quern.operators import statistics as S
from quern.plans import catalyst as C

_FLIP = {"LessThan": "GreaterThan", "GreaterThan": "LessThan", "LessThanOrEqual": "GreaterThanOrEqual", "GreaterThanOrEqual": "LessThanOrEqual", "EqualTo": "EqualTo", "EqualNullSafe": "EqualNullSafe"}
_THRESHOLD = "spark.sql.optimizer.inSetConversionThreshold"


def range_test(s: Column, op: str, v: Column) -> Column:
    """Whether a stripe with statistics ``s`` may hold ``value op v``; missing bounds keep it."""
    tests = {"EqualTo": (s["lo"] <= v) & (s["hi"].isNull() | (s["hi"] >= v)), "LessThan": s["lo"] < v, "LessThanOrEqual": s["lo"] <= v, "GreaterThan": s["hi"].isNull() | (s["hi"] > v), "GreaterThanOrEqual": s["hi"].isNull() | (s["hi"] >= v)}
    known = s["lo"].isNotNull()
    return (s["nulls"] < s["n"]) & (s["nonfinite"] | ~known | F.coalesce(tests[op], F.lit(True)))


class Planner:
    def __init__(self, dataset: Dataset) -> None:
        self.leaves = {p: (i, t) for i, (p, t) in enumerate(dataset.leaves)}
        self.filters = bool(dataset.options.get("filters"))

    def _leaf(self, e: Any) -> tuple[Column, Column | None, T.DataType] | None:
        if (path := C.attribute(e)) not in self.leaves:
            return None
        i, t = self.leaves[path]
        return F.col(f"s{i}"), F.col(f"f{i}") if self.filters else None, t

    @staticmethod
    def _literal(e: Any) -> Column | None:
        return F.expr(e.sql()) if C.kind(e) == "Literal" and e.value() is not None else None

    def _equal(self, leaf: tuple, v: Column) -> Column:
        s, f, t = leaf
        keep = range_test(s, "EqualTo", v)
        return keep if f is None else keep & S.might_contain(S.value_hash(v.cast(t), t), f)

    def keep(self, e: Any) -> Column:
        k = C.kind(e)
        parts = C.children(e)
        if k == "And":
            return self.keep(parts[0]) & self.keep(parts[1])
        if k == "Or":
            return self.keep(parts[0]) | self.keep(parts[1])
        if k == "Literal":
            return F.lit(e.value() is not None and str(e.value()).lower() == "true")
        if k in ("IsNull", "IsNotNull") and (leaf := self._leaf(parts[0])):
            return leaf[0]["nulls"] > 0 if k == "IsNull" else leaf[0]["nulls"] < leaf[0]["n"]
        if k in _FLIP:
            left, right = parts
            if (leaf := self._leaf(left)) and (v := self._literal(right)) is not None:
                op = k
            elif (leaf := self._leaf(right)) and (v := self._literal(left)) is not None:
                op = _FLIP[k]
            else:
                return F.lit(True)
            return self._equal(leaf, v) if op.startswith("Equal") else range_test(leaf[0], op, v)
        if k == "In" and (leaf := self._leaf(parts[0])):
            values = [self._literal(x) for x in parts[1:]]
            if all(v is not None for v in values):
                out = F.lit(False)
                for v in values:
                    out = out | self._equal(leaf, v)
                return out
        if k == "StartsWith" and (leaf := self._leaf(parts[0])) and (v := self._literal(parts[1])) is not None:
            s, n = leaf[0], F.char_length(v)
            fits = (F.substring(s["lo"], F.lit(1), n) <= v) & (s["hi"].isNull() | (F.substring(s["hi"], F.lit(1), n) >= v))
            return (s["nulls"] < s["n"]) & F.coalesce(fits, F.lit(True))
        if k == "Not":
            inner = parts[0]
            if C.kind(inner) in ("EqualTo", "In") and (leaf := self._leaf(C.children(inner)[0])):
                values = [self._literal(x) for x in C.children(inner)[1:]]
                if all(v is not None for v in values):
                    # None matches only where all rows are one known value, and that is excluded.
                    s = leaf[0]
                    one = s["lo_exact"] & s["hi_exact"] & (s["lo"] == s["hi"]) & ~s["nonfinite"]
                    hit = F.lit(False)
                    for v in values:
                        hit = hit | (s["lo"] == v)
                    return (s["nulls"] < s["n"]) & ~F.coalesce(one & hit, F.lit(False))
        return F.lit(True)


def kept_stripes(dataset: Dataset, conditions: list[Any]) -> list[int]:
    """Stripes that may hold a row meeting all conditions (Catalyst expressions over the dataset's columns)."""
    conditions = [c for c in conditions if not C.only_about(c, STRIPE)]  # a whole dataset has one on its stripes
    table = dataset.stats() if conditions else None
    if table is None:
        return list(range(dataset.n_stripes))
    planner = Planner(dataset)
    keep = F.lit(True)
    for c in conditions:
        keep = keep & planner.keep(c)
    return sorted(r[STRIPE] for r in table.where(F.coalesce(keep, F.lit(True))).select(STRIPE).collect())


def prune(dataset: Dataset, predicate: str) -> list[int]:
    """Stripes kept for a SQL predicate over the dataset's columns."""
    spark = dataset.spark
    before = spark.conf.get(_THRESHOLD)
    spark.conf.set(_THRESHOLD, "10000")  # long IN lists stay lists of literals
    try:
        plan = C.optimised(dataset.frame().where(predicate))
    finally:
        spark.conf.set(_THRESHOLD, before)
    found = C.filters(plan)
    if not found:  # Catalyst itself found that nothing matches
        return []
    return kept_stripes(dataset, found[0][1])


def keep_mask(dataset: Dataset, predicate: str) -> list[bool]:
    kept = set(prune(dataset, predicate))
    return [k in kept for k in range(dataset.n_stripes)]


def scan(dataset: Dataset, columns: list[str] | None = None, predicate: str | None = None, limit: int | None = None):
    """Projection, filter and limit over the stripes that can match.

    Without a predicate, no column needs no file (the head knows how many rows there are), and a limit needs the first
    stripes only that hold as many rows.
    """
    if predicate is None and columns == []:
        n = dataset.n_rows if limit is None else min(limit, dataset.n_rows)
        return dataset.spark.range(n).select()
    kept = prune(dataset, predicate) if predicate else None
    if predicate is None and limit is not None:
        ends = list(accumulate(dataset.stripe_row_counts()))
        kept = list(range(min(dataset.n_stripes, bisect_left(ends, limit) + 1)))
    df = dataset.frame(kept)
    df = df.where(predicate) if predicate and kept else df
    if columns is not None:
        df = df.select(*(F.col(f"`{c}`") for c in dataset.schema.project(columns).names)) if columns else df.select()
    return df if limit is None else df.limit(limit)
