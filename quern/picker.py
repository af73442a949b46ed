"""Measured choice of encodings: candidates for a leaf are tried on a sample and the smallest wins."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

import numpy as np

from quern.coders import Pipeline, Registry
from quern.coders.base import is_float, is_int
from quern.errors import QuernError
from quern.schema import Schema
from quern.types import LogicalType, Stage, dictionary

SAMPLE_ROWS = 200_000
#: Dictionary promotion: at least so many rows, and at most this many or half as many distinct values as rows.
LEAST_ROWS, MOST_DISTINCT = 64, 65_536
TERMINALS = ("zstd", "lz4", "snappy")


def candidates(physical: str, role: str, zstd_level: int = 3) -> list[list[Stage]]:
    """Pipelines to try, in order: of equal sizes the first wins."""
    ends = [Stage("zstd", {"level": zstd_level} if zstd_level != 3 else {}), *(Stage(t) for t in TERMINALS[1:])]
    if physical == "bytes":
        return [[e] for e in ends]
    last = role.rsplit(".", 1)[-1]
    if last in ("offsets", "present", "tag", "indices"):  # structure: cumulative, flags or small numbers
        heads = [["delta", "leb128"], ["leb128"], ["rle", "leb128"], ["bitpack_auto"]]
    elif is_int(physical):
        heads = [["delta", "leb128"], ["delta_of_delta", "leb128"], ["leb128"], ["rle", "leb128"], ["bitpack_auto"]]
    else:
        heads = [["gorilla"]]
    out = [[*(Stage(i) for i in h), e] for h in heads for e in ends]
    if is_int(physical) and last == "values":
        out.append([Stage("for_bitpack_zstd", {"level": zstd_level})])
        if physical in ("u32", "u64"):
            out.append([Stage("elias_fano")])
    if is_float(physical):
        out.append([Stage("for_bitpack_zstd", {"level": zstd_level})])
    return out


def measure(stages: list[Stage], physical: str, values: Any, registry: Registry | None = None) -> int | None:
    """Encoded bytes, or null where the pipeline can't take the values."""
    try:
        pipeline = Pipeline.build(physical, stages, registry)
        out = pipeline.encode(values)
        return len(out) if pipeline.output_type == "bytes" else None
    except (QuernError, ValueError, OverflowError):
        return None


def pick(physical: str, role: str, values: Any, zstd_level: int = 3, registry: Registry | None = None) -> tuple[list[Stage], int]:
    found = [(size, i, c) for i, c in enumerate(candidates(physical, role, zstd_level)) if (size := measure(c, physical, values, registry)) is not None]
    if not found:
        raise QuernError(f"no pipeline can take the values of leaf {role!r}")
    size, _, best = min(found, key=lambda x: x[:2])
    return best, size


def promotable(t: LogicalType, n_rows: int, distinct: int) -> bool:
    inner = t.inner if t.kind == "nullable" else t
    plain = inner.kind in ("utf8", "binary") or (inner.kind == "primitive" and is_int(inner.arg("type")))
    return plain and n_rows >= LEAST_ROWS and distinct <= min(n_rows // 2, MOST_DISTINCT)


def optimise(schema: Schema, values: dict[str, list], zstd_level: int = 3, registry: Registry | None = None) -> tuple[Schema, dict[str, int]]:
    """The schema with the smallest measured encodings, dictionaries where they are smaller, and bytes by column.

    ``values`` are Python rows of each column, a bounded sample.
    """
    from quern.operators.shred import decompose

    out, sizes = [], {}
    for c in schema.columns:
        rows = values[c.name]

        def best(t: LogicalType, rows: list = rows) -> tuple[list[list[Stage]], int]:
            picked = [pick(physical, role, leaf, zstd_level, registry) for (role, physical), leaf in zip(t.leaves(), decompose(t, rows), strict=True)]
            return [p for p, _ in picked], sum(s for _, s in picked)

        stages, size = best(c.type)
        kind = c.type
        plain = [r for r in rows if r is not None]
        if plain and all(isinstance(r, (str, bytes, int, np.integer)) for r in plain) and promotable(c.type, len(rows), len(set(plain))):
            t = LogicalType("nullable", (), (("inner", dictionary(c.type.inner)),)) if c.type.kind == "nullable" else dictionary(c.type)
            other, smaller = best(t)
            if smaller < size:
                stages, size, kind = other, smaller, t
        out.append(replace(c, type=kind, encodings=stages))
        sizes[c.name] = size
    return Schema(out).validate(), sizes
