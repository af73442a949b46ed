"""SQL over striped datasets, with stripe pruning and metadata-only answers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quern.catalog import Catalog
from quern.dataset import Dataset
from quern.errors import FormatError
from quern.plans import catalyst as C
from quern.plans import metadata, pruning

_THRESHOLD = "spark.sql.optimizer.inSetConversionThreshold"


class Session:
    """Tables by name over datasets; identifiers keep their case.

    A query is planned by Catalyst. Its optimised plan tells which conditions reach which dataset; datasets are then
    read with only the stripes that can match, or not at all where the manifest answers exactly. Pruning changes
    what is read, never what is returned.
    """

    def __init__(self, spark: SparkSession, case_sensitive: bool = True) -> None:
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.caseSensitive", str(case_sensitive).lower())
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark.conf.set(_THRESHOLD, "10000")
        self.tables: dict[str, Dataset] = {}
        self.last: dict[str, list[int] | str] = {}

    def register(self, name: str, path: str, catalog: Catalog | None = None) -> Dataset:
        """Opens a dataset under a name; a name that is taken is an error."""
        if name in self.tables:
            raise FormatError(f"table {name!r} is already registered")
        dataset = Dataset.open(self.spark, path, catalog)
        self.tables[name] = dataset
        self._view(name, dataset.frame())
        return dataset

    def register_argument(self, argument: str, catalog: Catalog | None = None) -> Dataset:
        """``name=path``, or a path whose last part without extension is the name."""
        name, eq, path = argument.partition("=")
        if not eq:
            name, path = re.sub(r"\.[^.]*$", "", argument.rstrip("/").rsplit("/", 1)[-1]), argument
        if not name or not path:
            raise FormatError(f"{argument!r} is no name=path")
        return self.register(name, path, catalog)

    def _view(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(f"`{name}`")

    def table(self, name: str) -> DataFrame:
        return self.tables[name].frame()

    def sql(self, query: str) -> DataFrame:
        df = self.spark.sql(query)
        plan = C.optimised(df)
        by_path: dict[str, list[str]] = {}  # a dataset may have several names
        for n, d in self.tables.items():
            by_path.setdefault(C.plain(f"{d.path}/data"), []).append(n)
        self.last = {}
        if (quick := metadata.answer(plan, {p: self.tables[n[0]] for p, n in by_path.items()})) is not None:
            self.last = {"*": "metadata"}
            return quick
        needed: dict[str, set[int]] = {}
        for relation, conditions in C.filters(plan):
            if len(at := C.roots(relation)) == 1 and (names := by_path.get(C.plain(at[0]))):
                kept = pruning.kept_stripes(self.tables[names[0]], conditions)
                for name in names:
                    needed.setdefault(name, set()).update(kept)
        fewer = {n: sorted(k) for n, k in needed.items() if len(k) < self.tables[n].n_stripes}
        self.last = {n: sorted(k) for n, k in needed.items()}
        if not fewer:
            return df
        try:
            for n, k in fewer.items():
                self._view(n, self.tables[n].frame(k))
            return self.spark.sql(query)
        finally:
            for n in fewer:
                self._view(n, self.tables[n].frame())

    def explain_pruning(self, query: str) -> dict[str, list[int] | str]:
        """Stripes that a query would read, by table, or {"*": "metadata"} if none."""
        self.sql(query)
        return self.last
