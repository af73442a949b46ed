"""Self-describing buffers of one column: type, pipeline, count, payload."""

from __future__ import annotations

import json
from typing import Any

import numpy as np

from quern.coders.base import DTYPES, Pipeline, Registry, default_registry
from quern.coders.builtin import from_varints, varints
from quern.errors import FormatError
from quern.types import PHYSICAL, Stage

MAGIC = b"QRN1"

#: Pipelines by what a column holds.
PRESETS = {
    "timestamps_uniform": ("i64", ["delta_of_delta", "leb128", "zstd"]),
    "timestamps_jittered": ("i64", ["delta", "leb128", "zstd"]),
    "gauges": ("f64", ["gorilla", "zstd"]),
    "numbers": (None, ["for_bitpack_zstd"]),
    "low_cardinality_indices": ("u32", ["bitpack_auto", "zstd"]),
    "sorted_unique": ("u32", ["elias_fano"]),
}


def default_stages(physical: str) -> list[Stage]:
    """For a column of which nothing else is known."""
    if physical == "bytes":
        return [Stage("zstd")]
    return [Stage(i) for i in (["gorilla", "zstd"] if physical[0] == "f" else ["delta", "leb128", "zstd"])]


def _type_of(values: Any) -> str:
    if isinstance(values, (bytes, bytearray, memoryview)):
        return "bytes"
    for name, d in DTYPES.items():
        if values.dtype == d:
            return name
    raise FormatError(f"no physical type for {values.dtype}")


def compress(values: Any, preset: str | None = None) -> bytes:
    """A buffer that ``decompress`` reads without being told anything."""
    values = values if isinstance(values, (bytes, bytearray, memoryview, np.ndarray)) else np.asarray(values)
    physical = _type_of(values)
    stages = [Stage(i) for i in PRESETS[preset][1]] if preset else default_stages(physical)
    return compress_with(values, stages, physical)


def compress_with(values: Any, stages: list[Stage], physical: str | None = None, registry: Registry | None = None, bare: bool = False) -> bytes:
    """``bare``: only the payload, for those who keep type and pipeline themselves."""
    physical = physical or _type_of(values)
    pipeline = Pipeline.build(physical, stages, registry or default_registry())
    if pipeline.output_type != "bytes":
        raise FormatError("the pipeline must end in bytes")
    body = pipeline.encode(values)
    if bare:
        return body
    head = json.dumps([s.to_json() for s in stages], separators=(",", ":")).encode()
    return MAGIC + bytes([PHYSICAL.index(physical)]) + varints(np.array([len(head)])) + head + varints(np.array([len(values)])) + body


def _number(data: bytes, at: int) -> tuple[int, int]:
    end = at
    while end < len(data) and data[end] >= 0x80:
        end += 1
    return int(from_varints(data[at : end + 1])[0]) if end < len(data) else _cut(), end + 1


def _cut() -> int:
    raise FormatError("the buffer is cut off")


def decompress(data: bytes, registry: Registry | None = None) -> Any:
    if data[:4] != MAGIC or len(data) < 6 or data[4] >= len(PHYSICAL):
        raise FormatError("not a buffer of this kind")
    size, at = _number(data, 5)
    try:
        stages = [Stage.from_json(s) for s in json.loads(data[at : at + size])]
    except (ValueError, KeyError, TypeError) as e:
        raise FormatError(f"no pipeline: {e}") from e
    count, at = _number(data, at + size)
    out = decompress_bare(data[at:], stages, PHYSICAL[data[4]], registry)
    if len(out) != count:
        raise FormatError(f"{len(out)} values where {count} are named")
    return out


def decompress_bare(body: bytes, stages: list[Stage], physical: str, registry: Registry | None = None) -> Any:
    return Pipeline.build(physical, stages, registry or default_registry()).decode(body)
