"""Reading Catalyst's optimised plans."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame


def kind(node: Any) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def seq(s: Any) -> list:
    return [s.apply(i) for i in range(s.size())]


def children(node: Any) -> list:
    return seq(node.children())


def optimised(df: DataFrame) -> Any:
    return df._jdf.queryExecution().optimizedPlan()


def roots(node: Any) -> list[str]:
    """Root paths of a file relation; none for other nodes."""
    if kind(node) != "LogicalRelation" or kind(node.relation()) != "HadoopFsRelation":
        return []
    return [p.toString() for p in seq(node.relation().location().rootPaths())]


def plain(path: str) -> str:
    """A path without the ways to write a local scheme."""
    return path.replace("file://", "").replace("file:", "").rstrip("/")


def attribute(e: Any) -> str | None:
    """Dotted path of a column or struct field; none for anything else."""
    if kind(e) == "AttributeReference":
        return e.name()
    if kind(e) == "GetStructField" and (base := attribute(e.child())) is not None:
        return f"{base}.{e.extractFieldName()}"
    return None


def only_about(condition: Any, name: str) -> bool:
    """Whether a condition refers to the column ``name`` and to no other."""
    return {x.name() for x in seq(condition.references().toSeq())} == {name}


def filters(plan: Any) -> list[tuple[Any, list[Any]]]:
    """(relation, conditions that all its rows must meet) of each file relation in a plan."""
    out: list[tuple[Any, list[Any]]] = []

    def walk(node: Any, above: list[Any]) -> None:
        if roots(node):
            out.append((node, above))
            return
        k = kind(node)
        if k == "Filter":
            walk(node.child(), [*above, node.condition()])
        elif k == "Project" and all(kind(x) in ("AttributeReference", "GetStructField") for x in seq(node.projectList())):
            walk(node.child(), above)
        else:
            for c in children(node):
                walk(c, [])

    walk(plan, [])
    for e in subqueries(plan):
        out += filters(e)
    return out


def subqueries(plan: Any) -> list[Any]:
    """Plans inside expressions, such as scalar subqueries, of all nodes."""
    found = []

    def walk(node: Any) -> None:
        found.extend(seq(node.subqueries()))
        for c in children(node):
            walk(c)

    walk(plan)
    return found
