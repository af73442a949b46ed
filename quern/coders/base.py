"""Coder contract, registry and pipelines.

A value between stages is a numpy array of the stage's type, or bytes. Stages that need a whole buffer (blocks)
come after those that don't.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np

from quern.errors import CoderError, CorruptedError, PipelineError, UnknownCoderError
from quern.types import FLOATS, INTS, Stage

DTYPES = {**{t: np.dtype({"i": "int", "u": "uint"}[t[0]] + t[1:]) for t in INTS}, "f32": np.dtype("float32"), "f64": np.dtype("float64")}


@dataclass
class Coder:
    """``encode`` and ``decode`` are inverse; ``random_access`` says that a value can be found without the others."""

    id: str
    accepts: str
    produces: str
    block: bool
    encode: Callable[[Any], Any]
    decode: Callable[[Any], Any]
    random_access: bool = False


#: Builds a coder for an input type from its parameters.
Factory = Callable[[dict[str, Any], str], Coder]


class Registry:
    def __init__(self, factories: dict[str, Factory] | None = None) -> None:
        self._factories = dict(factories or {})

    def register(self, coder_id: str, factory: Factory) -> None:
        self._factories[coder_id] = factory

    @property
    def ids(self) -> list[str]:
        return sorted(self._factories)

    def build(self, stage: Stage, input_type: str) -> Coder:
        if stage.id not in self._factories:
            raise UnknownCoderError(stage.id)
        return self._factories[stage.id](stage.params, input_type)


@lru_cache(maxsize=1)
def default_registry() -> Registry:
    from quern.coders.builtin import BUILTIN

    return Registry(BUILTIN)


class Pipeline:
    """Stages checked for order and types; encoding runs forward, decoding backward."""

    def __init__(self, input_type: str, coders: list[Coder]) -> None:
        self.input_type, self.coders = input_type, coders
        at, block = input_type, None
        for c in coders:
            if c.accepts != at:
                raise PipelineError(f"{c.id!r} takes {c.accepts}, but gets {at}")
            if block and not c.block:
                raise PipelineError(f"{c.id!r} can't come after the block coder {block!r}")
            block = c.id if c.block else block
            at = c.produces
        self.output_type = at

    @staticmethod
    def build(input_type: str, stages: list[Stage], registry: Registry | None = None) -> Pipeline:
        registry, at, coders = registry or default_registry(), input_type, []
        for s in stages:
            coders.append(registry.build(s, at))
            at = coders[-1].produces
        return Pipeline(input_type, coders)

    @property
    def random_access(self) -> bool:
        return all(c.random_access for c in self.coders)

    def encode(self, values: Any) -> Any:
        out = self.check(values)
        for c in self.coders:
            out = c.encode(out)
        return out

    def decode(self, data: Any) -> Any:
        for c in reversed(self.coders):
            try:
                data = c.decode(data)
            except CoderError:
                raise
            except (ValueError, IndexError, OverflowError, TypeError) as e:
                raise CorruptedError(c.id, str(e)) from e
        return data

    def check(self, values: Any) -> Any:
        """The values in the pipeline's type; another array type is an error, lists are converted if they fit."""
        if self.input_type == "bytes":
            if not isinstance(values, (bytes, bytearray, memoryview)):
                raise PipelineError(f"bytes are needed, not {type(values).__name__}")
            return bytes(values)
        dtype = DTYPES[self.input_type]
        if isinstance(values, np.ndarray):
            if values.dtype != dtype:
                raise PipelineError(f"{self.input_type} is needed, not {values.dtype}")
            return values
        return np.array(list(values), dtype)


def is_int(t: str) -> bool:
    return t in INTS


def is_float(t: str) -> bool:
    return t in FLOATS
