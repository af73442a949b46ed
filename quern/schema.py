"""Schemas: ordered, named, typed columns with an encoding for each physical leaf."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from quern.errors import SchemaError
from quern.types import LogicalType, Stage, from_spark

VERSION = 1

#: Default encodings by what a leaf holds.
OFFSETS = ("delta", "leb128", "zstd")
FLAGS = ("leb128", "zstd")
DATA = ("zstd",)
NUMBERS = ("for_bitpack_zstd",)
FLOATING = ("gorilla", "zstd")


def default_encodings(t: LogicalType) -> list[list[Stage]]:
    """One pipeline for each leaf of the type, in the order of its leaves."""

    def of(role: str, physical: str) -> tuple[str, ...]:
        last = role.rsplit(".", 1)[-1]
        if physical == "bytes":
            return DATA
        if last in ("offsets", "indices"):
            return OFFSETS
        if physical == "u8":
            return FLAGS
        return FLOATING if physical in ("f32", "f64") else NUMBERS

    return [[Stage(i) for i in of(role, physical)] for role, physical in t.leaves()]


@dataclass
class Column:
    name: str
    type: LogicalType
    encodings: list[list[Stage]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.encodings = self.encodings or default_encodings(self.type)


@dataclass
class Schema:
    columns: list[Column]

    # -- lookup and projection

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise SchemaError("no such column", name)

    def project(self, names: list[str]) -> Schema:
        """The named columns in the given order; a missing or repeated name, or none at all, is an error."""
        if not names:
            raise SchemaError("a projection needs a column")
        for n in names:
            if names.count(n) > 1:
                raise SchemaError("named twice", n)
        return Schema([self.column(n) for n in names])

    # -- checks

    def validate(self) -> Schema:
        if not self.columns:
            raise SchemaError("a schema needs a column")
        for c in self.columns:
            if not c.name or self.names.count(c.name) > 1:
                raise SchemaError("names must be distinct and not empty", c.name)
            c.type.validate(c.name)
            if len(c.encodings) != len(c.type.leaves()):
                raise SchemaError(f"{len(c.encodings)} encodings for {len(c.type.leaves())} leaves", c.name)
        return self

    def pipelines(self, registry=None) -> dict[tuple[str, str], Any]:
        """The pipeline of each (column, leaf role)."""
        from quern.coders import Pipeline, default_registry

        registry = registry or default_registry()
        return {(c.name, role): Pipeline.build(physical, stages, registry) for c in self.columns for (role, physical), stages in zip(c.type.leaves(), c.encodings, strict=True)}

    # -- JSON, canonical form and hash

    def to_json(self) -> dict:
        return {"version": VERSION, "columns": [{"name": c.name, "type": c.type.to_json(), "encodings": [[s.to_json() for s in p] for p in c.encodings]} for c in self.columns]}

    @staticmethod
    def from_json(x: Any) -> Schema:
        if isinstance(x, (str, bytes)):
            x = json.loads(x)
        if not isinstance(x, dict) or x.get("version") != VERSION:
            raise SchemaError(f"a schema of version {VERSION} is needed")
        return Schema([Column(c["name"], LogicalType.from_json(c["type"]), [[Stage.from_json(s) for s in p] for p in c.get("encodings", [])]) for c in x.get("columns", [])]).validate()

    def canonical(self) -> bytes:
        return canonical_json(self.to_json())

    def hash(self) -> str:
        return hashlib.sha256(self.canonical()).hexdigest()

    # -- Spark

    def to_spark(self) -> T.StructType:
        """Fields with their exact logical type in the metadata."""
        return T.StructType([T.StructField(c.name, c.type.to_spark(), True, {"logical": json.dumps(c.type.to_json())}) for c in self.columns])

    @staticmethod
    def from_spark(schema: T.StructType) -> Schema:
        return Schema([Column(f.name, from_spark(f.dataType, f.nullable, f.metadata)) for f in schema]).validate()


def canonical_json(x: Any) -> bytes:
    """UTF-8 JSON without white space, keys and texts in normal form C, keys sorted."""

    def norm(v: Any) -> Any:
        if isinstance(v, dict):
            return {unicodedata.normalize("NFC", k): norm(w) for k, w in v.items()}
        if isinstance(v, (list, tuple)):
            return [norm(w) for w in v]
        return unicodedata.normalize("NFC", v) if isinstance(v, str) else v

    return json.dumps(norm(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
