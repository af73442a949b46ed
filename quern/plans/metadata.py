"""Answers of count, min and max from the manifest, where they are exact."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.dataset import STRIPE, Dataset
from quern.plans import catalyst as C


def _function(e: Any) -> tuple[str, Any, str] | None:
    """(count, min or max; its column or nothing; output name) of an aggregate expression."""
    if C.kind(e) != "Alias" or C.kind(e.child()) != "AggregateExpression":
        return None
    call = e.child()
    if call.isDistinct() or call.filter().isDefined():
        return None
    f = call.aggregateFunction()
    if C.kind(f) not in ("Count", "Min", "Max") or len(C.children(f)) != 1:
        return None
    return C.kind(f).lower(), C.children(f)[0], e.name()


def answer(plan: Any, datasets: dict[str, Dataset]) -> DataFrame | None:
    """The result of an optimised plan that is one ungrouped aggregate of count, min and max over a whole dataset;
    nothing where the plan is another or a bound isn't exact. ``datasets`` are by their data folder."""
    if C.kind(plan) != "Aggregate" or plan.groupingExpressions().size():
        return None
    relation = plan.child()
    while (C.kind(relation) == "Project" and all(C.attribute(x) for x in C.seq(relation.projectList()))) or (C.kind(relation) == "Filter" and C.only_about(relation.condition(), STRIPE)):
        relation = relation.child()
    at = C.roots(relation)
    dataset = datasets.get(C.plain(at[0])) if len(at) == 1 else None
    calls = [_function(e) for e in C.seq(plan.aggregateExpressions())]
    if dataset is None or dataset.stats() is None or not calls or None in calls:
        return None
    places = {p: (i, t) for i, (p, t) in enumerate(dataset.leaves)}
    keys: list[tuple[str, str]] = []
    fields: list[T.StructField] = []
    for f, e, name in calls:
        whole = f == "count" and C.kind(e) == "Literal" and e.value() is not None
        path = "" if whole else C.attribute(e)
        if not whole and path not in places:
            return None
        keys.append((f, path))
        fields.append(T.StructField(name, T.LongType() if f == "count" else places[path][1], f != "count"))
    known = dataset.answers
    known["count", ""] = dataset.n_rows
    if missing := sorted(set(keys) - set(known)):
        values: list[Column] = []
        exact: list[Column] = []
        for i, (f, path) in enumerate(missing):
            s = F.col(f"s{places[path][0]}")
            if f == "count":
                values.append(F.coalesce(F.sum(s["n"] - s["nulls"]), F.lit(0)).cast("long").alias(f"v{i}"))
                exact.append(F.lit(True).alias(f"e{i}"))
            else:
                side = "lo" if f == "min" else "hi"
                values.append((F.min if f == "min" else F.max)(s[side]).alias(f"v{i}"))
                exact.append(F.coalesce(F.bool_and(s[f"{side}_exact"]), F.lit(False)).alias(f"e{i}"))
        row = dataset.stats().agg(*values, *exact).first()  # a job over the manifest; its one row is the answer
        known |= {k: row[f"v{i}"] for i, k in enumerate(missing) if row[f"e{i}"]}
    if set(keys) - set(known):
        return None
    return dataset.spark.createDataFrame([tuple(known[k] for k in keys)], T.StructType(fields))
