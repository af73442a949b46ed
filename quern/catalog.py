"""A folder of schemas by the hash of their canonical form."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from quern.errors import FormatError
from quern.schema import Schema
from quern.storage import Files


class Catalog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.files, self.path = Files(spark), path.rstrip("/")

    def add(self, schema: Schema) -> str:
        """Stores a schema and returns its hash; adding it again changes nothing."""
        key = schema.hash()
        if not self.files.exists(f"{self.path}/{key}.json"):
            self.files.write(f"{self.path}/{key}.json", schema.canonical())
        return key

    def lookup(self, key: str) -> Schema | None:
        at = f"{self.path}/{key}.json"
        return Schema.from_json(self.files.read(at)) if re.fullmatch(r"[0-9a-f]{64}", key) and self.files.exists(at) else None

    def resolve(self, key: str) -> Schema:
        """The schema of a hash; an unknown one, or content of another hash, is an error."""
        schema = self.lookup(key)
        if schema is None:
            raise FormatError(f"no schema {key} in {self.path}")
        if schema.hash() != key:
            raise FormatError(f"schema {key} in {self.path} has the hash {schema.hash()}")
        return schema

    def list(self) -> list[str]:
        return sorted(m[1] for n in self.files.names(self.path) if (m := re.fullmatch(r"([0-9a-f]{64})\.json", n)))

    def verify(self) -> dict[str, str]:
        """What is wrong, by hash; nothing where all is well."""
        bad = {}
        for key in self.list():
            try:
                self.resolve(key)
            except Exception as e:  # any malformed content is reported, not raised
                bad[key] = str(e)
        return bad
