"""Striped datasets: Parquet stripes with a schema, row positions and a manifest of statistics.

    <path>/_dataset.json      schema or its hash, rows, stripes, options
    <path>/data/stripe_id=K/  the rows of stripe K with their position ``_row_pos``
    <path>/stats/first=K/     one row per stripe from K on that was written at once, see operators.statistics
    <path>/counts/first=K/    the rows of each such stripe, where they were appended

Stripes are runs of the input's order. Writing rows shuffles nothing: tasks know their first position from the counts
of the tasks before, and put each row into its stripe's folder. The head is the last thing written, and says how many
stripes there are: folders beyond belong to an append that goes on or broke off, and no reader looks at them.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from itertools import accumulate
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.catalog import Catalog
from quern.errors import FormatError, SchemaError
from quern.operators import statistics as S
from quern.plans import catalyst as C
from quern.schema import Schema
from quern.storage import Files, written

POS, STRIPE = "_row_pos", "stripe_id"
VERSION = 1
KNOWN_FLAGS = ("stats", "filters")
#: A manifest of at most so many bytes is held by the driver, where Catalyst evaluates predicates without a job.
LOCAL_BYTES = 8 << 20


def _repeats(plan: Any) -> bool:
    """Whether a plan gives the same rows in the same tasks each time it runs: deterministic projections and filters of
    files or local rows."""
    if C.kind(plan) in ("LogicalRelation", "LocalRelation"):
        return True
    return C.kind(plan) in ("Project", "Filter") and all(e.deterministic() for e in C.seq(plan.expressions())) and all(_repeats(c) for c in C.children(plan))


def positioned(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """``df`` with ``_row_pos`` 0, 1, ...: by the given columns, else in the order of reading.

    Positions come from counts of tasks and places within them. The counts take a pass over the input's smallest
    columns; no row moves unless an order is asked for, which range-sorts.
    """
    if order_by:
        df = df.orderBy(*order_by)
    spark = df.sparkSession
    marked = df.withColumn("_at", F.monotonically_increasing_id())
    if not _repeats(C.optimised(df)):  # another run may deal otherwise: keep what this one dealt
        marked = written(marked, "dealt")
    task, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = marked.select(task.alias("_task")).groupBy("_task").count().orderBy("_task").collect()  # one row per task
    first, total = [], 0
    for r in counts:
        first.append((r["_task"], total))
        total += r["count"]
    heads = F.broadcast(spark.createDataFrame(first, "_task long, _first long"))
    return marked.withColumn("_task", task).join(heads, "_task").withColumn(POS, F.col("_first") + place).drop("_at", "_task", "_first")


@dataclass
class Dataset:
    """An open dataset. Opening reads the small JSON file only."""

    spark: SparkSession
    path: str
    schema: Schema
    n_rows: int
    n_stripes: int
    options: dict[str, Any] = field(default_factory=dict)
    schema_hash: str | None = None
    _manifest: DataFrame | None = field(default=None, repr=False)
    #: Exact answers of the manifest found so far: (function, leaf) -> value. A dataset object is one snapshot.
    answers: dict[tuple[str, str], Any] = field(default_factory=dict, repr=False)

    # -- opening

    @staticmethod
    def open(spark: SparkSession, path: str, catalog: Catalog | None = None) -> Dataset:
        files = Files(spark)
        path = path.rstrip("/")
        if not files.exists(f"{path}/_dataset.json"):
            raise FormatError(f"{path} is no dataset")
        try:
            head = json.loads(files.read(f"{path}/_dataset.json"))
        except ValueError as e:
            raise FormatError(f"{path}: malformed head: {e}") from e
        if head.get("version") != VERSION:
            raise FormatError(f"{path}: version {head.get('version')!r}, not {VERSION}")
        if unknown := set(head.get("required", [])) - set(KNOWN_FLAGS):
            raise FormatError(f"{path}: needs unknown features {sorted(unknown)}")
        if "schema" in head:
            schema = Schema.from_json(head["schema"])
        elif catalog is None:
            raise FormatError(f"{path}: its schema {head['schema_hash']} is in a catalog, and none is given")
        else:
            schema = catalog.resolve(head["schema_hash"])
        return Dataset(spark, path, schema, head["n_rows"], head["n_stripes"], head.get("options", {}), schema_hash=head.get("schema_hash"))

    # -- reading

    @property
    def fields(self) -> T.StructType:
        return self.schema.to_spark()

    @property
    def _stored(self) -> T.StructType:
        return T.StructType([*self.fields, T.StructField(POS, T.LongType()), T.StructField(STRIPE, T.LongType())])

    def frame(self, stripes: list[int] | None = None, positions: bool = False) -> DataFrame:
        """The rows of the given stripes (of all that the head counts where none are given). Other stripes' folders
        aren't read, and no files at all where there is no stripe to read."""
        columns = [F.col(f"`{n}`") for n in self.schema.names] + ([F.col(POS), F.col(STRIPE)] if positions else [])
        kept = range(self.n_stripes) if stripes is None else stripes
        if self.n_rows == 0 or not len(kept):
            nothing = self.spark.range(1).where(F.lit(False))  # an empty local relation to the optimiser
            return nothing.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self._stored)).select(columns)
        reader = self.spark.read.schema(self._stored)
        if stripes is None:
            return reader.parquet(f"{self.path}/data").where(F.col(STRIPE) < self.n_stripes).select(columns)
        return reader.option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/{STRIPE}={k}" for k in kept)).select(columns)

    def stripe(self, k: int, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """One stripe in row order."""
        self._check_stripe(k)
        df = self.frame([k], positions=True).orderBy(POS)
        df = df.select(*(F.col(f"`{c}`") for c in self.schema.project(columns or self.schema.names).names))
        return df if limit is None else df.limit(limit)

    def stripes(self, start: int, stop: int, columns: list[str] | None = None) -> DataFrame:
        """Stripes ``start`` up to ``stop``, in row order; beyond the dataset is an error."""
        if not 0 <= start <= stop <= self.n_stripes:
            raise FormatError(f"stripes {start} to {stop} of {self.n_stripes}")
        names = self.schema.project(columns or self.schema.names).names
        return self.frame(list(range(start, stop)), positions=True).orderBy(POS).select(*(F.col(f"`{c}`") for c in names))

    def column(self, name: str, stripe: int | None = None) -> DataFrame:
        """One column in row order, of all stripes or of one. Dictionaries are per stripe in storage only."""
        self.schema.column(name)
        return self.stripe(stripe, [name]) if stripe is not None else self.frame(positions=True).orderBy(POS).select(F.col(f"`{name}`"))

    def rows(self, start: int, length: int) -> DataFrame:
        """Rows by position; beyond the dataset is an error."""
        from quern.operators.shred import slice_rows

        ends = list(accumulate(self.stripe_row_counts()))
        kept = list(range(bisect_right(ends, start), min(self.n_stripes, bisect_left(ends, start + length) + 1))) if 0 <= start and length > 0 else []
        return slice_rows(self.frame(kept, positions=True), start, length, POS, self.n_rows).orderBy(POS).drop(POS, STRIPE)

    def _check_stripe(self, k: int) -> None:
        if not 0 <= k < self.n_stripes:
            raise FormatError(f"stripe {k} of {self.n_stripes}")

    # -- statistics

    @property
    def leaves(self) -> list[tuple[str, T.DataType]]:
        return S.leaves(self.fields)

    def stats(self) -> DataFrame | None:
        """The manifest, one row per stripe, or nothing for datasets without statistics."""
        if self._manifest is None and self.options.get("stats"):
            table = _part_rows(self.spark, f"{self.path}/stats", self.n_stripes)
            if Files(self.spark).size(f"{self.path}/stats") <= LOCAL_BYTES:
                table = self.spark.createDataFrame(table.toArrow(), table.schema)
            self._manifest = table
        return self._manifest

    def stripe_row_counts(self) -> list[int]:
        size, base = self.options.get("stripe_rows") or self.n_rows, self.options.get("written", [self.n_rows, self.n_stripes])
        counts = [min(size, base[0] - k * size) for k in range(base[1])] if base[0] else [0] * base[1]
        if self.n_stripes > base[1]:  # stripes were appended; one number each
            added = _part_rows(self.spark, f"{self.path}/counts", self.n_stripes).collect()
            counts = counts[: base[1]] + [n for _, n in sorted((r[STRIPE], r["n"]) for r in added)]
        return counts

    def column_stats(self, stripe: int, name: str) -> dict | None:
        """Bounds and counts of one leaf in one stripe."""
        return self._leaf(stripe, name, "s")

    def column_filter(self, stripe: int, name: str) -> dict | None:
        return self._leaf(stripe, name, "f") if self.options.get("filters") else None

    def _leaf(self, stripe: int, name: str, kind: str) -> dict | None:
        self._check_stripe(stripe)
        table = self.stats()
        paths = [p for p, _ in self.leaves]
        if table is None or name not in paths or f"{kind}{paths.index(name)}" not in table.columns:
            return None
        row = table.where(F.col(STRIPE) == stripe).select(f"{kind}{paths.index(name)}").first()
        return row[0].asDict() if row and row[0] is not None else None

    def region_sizes(self) -> dict[str, int]:
        files = Files(self.spark)
        return {"head": files.sizes(self.path)["_dataset.json"], "body": files.size(f"{self.path}/data"), "stats": files.size(f"{self.path}/stats")}

    def column_byte_sizes(self) -> dict[str, int]:
        """Stored bytes by column, from the Parquet footers."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        out = dict.fromkeys(self.schema.names, 0)
        files = Files(self.spark)
        for folder in files.names(f"{self.path}/data"):
            for name in files.names(f"{self.path}/data/{folder}") if folder.startswith(STRIPE) else []:
                if name.endswith(".parquet"):
                    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{folder}/{name}"), conf)
                    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
                    for block in reader.getFooter().getBlocks():
                        for column in block.getColumns():
                            top = column.getPath().toArray()[0]
                            if top in out:
                                out[top] += column.getTotalSize()
                    reader.close()
        return out

    def verify(self) -> dict[str, int]:
        """Reads every column and compares counts and checksums with the manifest; raises FormatError at the first
        stripe and column that differ."""
        table = self.stats()
        data = self.frame(positions=True)
        if self.n_rows != data.count():
            raise FormatError(f"{self.path}: {data.count()} rows where {self.n_rows} are named")
        if table is not None and self.n_rows:
            now = S.stripe_bounds(data, self.fields, POS)
            pairs = [(f"s{i}", p) for i, (p, _) in enumerate(self.leaves)]
            both = table.alias("a").join(now.alias("b"), STRIPE, "full_outer")
            bad = F.array_compact(F.array(F.when(~F.col("a.n_rows").eqNullSafe(F.col("b.n_rows")), "rows"), *(F.when(~F.col(f"a.{s}.checksum").eqNullSafe(F.col(f"b.{s}.checksum")), p) for s, p in pairs)))
            first = both.select(STRIPE, bad.alias("bad")).where(F.size("bad") > 0).orderBy(STRIPE).first()
            if first:
                raise FormatError(f"{self.path}: stripe {first[STRIPE]}: {', '.join(first['bad'])} differ from the manifest")
        return {"columns": len(self.schema.columns), "rows": self.n_rows, "stripes": self.n_stripes}

    # -- more stripes

    def append(self, df: DataFrame, mark: Any = None) -> Dataset:
        """Adds the rows of ``df`` as stripes after the last, as many rows each as the dataset's stripes have (one
        stripe for datasets of one). Nothing that is written changes and its cost is that of the new rows; readers see
        the new stripes and their statistics when the head is renamed into place, and what an append that broke off
        left belongs to no stripe and is replaced by the next one. ``mark`` is kept in the head. One append at a time."""
        if df.columns != self.schema.names:
            raise SchemaError(f"the dataset's columns {self.schema.names} aren't the frame's {df.columns}")
        size, first = self.options.get("stripe_rows"), self.n_stripes if self.n_rows else 0
        batch, files = f"{self.path}/_append", Files(self.spark)
        placed = positioned(df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.fields)))
        stripe = F.lit(first) + (F.floor(F.col(POS) / size) if size else F.lit(0))
        rows = placed.withColumn(STRIPE, stripe.cast("long")).withColumn(POS, F.col(POS) + self.n_rows)
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy(STRIPE).parquet(batch)
        new = sorted(int(n.split("=")[1]) for n in files.names(batch) if n.startswith(f"{STRIPE}="))
        for k in new:
            files.delete(f"{self.path}/data/{STRIPE}={k}")
            files.move(f"{batch}/{STRIPE}={k}", f"{self.path}/data/{STRIPE}={k}")
        files.delete(batch)
        options = dict(self.options) | ({"mark": mark} if mark is not None else {})
        if not new:
            return _finish(self.spark, self.path, self.schema, self.n_rows, self.n_stripes, options, None, self.schema_hash)
        stored = self.spark.read.schema(self._stored).option("basePath", f"{self.path}/data")
        added = stored.parquet(*(f"{self.path}/data/{STRIPE}={k}" for k in new))
        if self.options.get("stats") or not self.n_rows:
            options["stats"] = True
            options["filters"] = bool(self.options.get("filters") or not self.n_rows)
            _statistics(added, self.fields, options["filters"]).write.mode("overwrite").parquet(f"{self.path}/stats/first={first}")
        added.groupBy(STRIPE).agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts/first={first}")
        more = self.spark.read.parquet(f"{self.path}/counts/first={first}").agg(F.sum("n")).first()[0]
        options.setdefault("written", [self.n_rows, first])
        return _finish(self.spark, self.path, self.schema, self.n_rows + more, first + len(new), options, None, self.schema_hash)

    # -- column slice

    def project_to(self, path: str, columns: list[str]) -> Dataset:
        """A dataset of some columns, in the given order, stripes and statistics kept; see ``Schema.project``."""
        schema = self.schema.project(columns)
        self.verify()
        data = self.frame(positions=True).select(*(F.col(f"`{c}`") for c in columns), POS, STRIPE)
        if self.n_rows:
            data.write.mode("overwrite").option("compression", "zstd").partitionBy(STRIPE).parquet(f"{path}/data")
        table, old = self.stats(), [p for p, _ in self.leaves]
        if table is not None:
            new = [p for p, _ in S.leaves(schema.to_spark())]
            kinds = ["s", "f"] if self.options.get("filters") else ["s"]
            table.select(STRIPE, "n_rows", *(F.col(f"{k}{old.index(p)}").alias(f"{k}{i}") for i, p in enumerate(new) for k in kinds)).write.mode("overwrite").parquet(f"{path}/stats/first=0")
        if self.n_stripes > self.options.get("written", [0, self.n_stripes])[1]:
            _part_rows(self.spark, f"{self.path}/counts", self.n_stripes).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/first=0")
        return _finish(self.spark, path, schema, self.n_rows, self.n_stripes, self.options, None)


def _part_rows(spark: SparkSession, path: str, n_stripes: int) -> DataFrame:
    """The rows of a folder of parts ``first=K`` that belong to the first ``n_stripes`` stripes."""
    parts = sorted(int(n.split("=")[1]) for n in Files(spark).names(path) if n.startswith("first="))
    return spark.read.parquet(*(f"{path}/first={k}" for k in parts if k < n_stripes))


def _statistics(rows: DataFrame, fields: T.StructType, filters: bool) -> DataFrame:
    """The manifest rows of stripes, sorted by stripe, so that a stripe's row is found by its bounds."""
    table = S.stripe_bounds(rows, fields, POS)
    if filters:
        table = S.with_filters(table, S.stripe_filters(rows, fields), len(S.leaves(fields)))
    return table.sortWithinPartitions(STRIPE)


def write(df: DataFrame, path: str, stripe_rows: int | None = None, schema: Schema | None = None, stats: bool = True, filters: bool = True, catalog: Catalog | None = None, order_by: list[str] | None = None, overwrite: bool = True) -> Dataset:
    """Writes ``df`` as a dataset; with a ``catalog`` the schema goes there and the dataset names its hash.

    ``stripe_rows`` of none or 0 makes one stripe; an empty ``df`` makes one empty stripe.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    schema = (schema or Schema.from_spark(df.schema)).validate()
    if schema.names != df.columns:
        raise SchemaError(f"the schema's columns {schema.names} aren't the frame's {df.columns}")
    if taken := {POS, STRIPE} & set(df.columns):
        raise SchemaError(f"reserved names: {sorted(taken)}")
    schema.pipelines()
    files = Files(spark)
    if files.exists(path):
        if not overwrite:
            raise FormatError(f"{path} exists")
        files.delete(path)
    placed = positioned(df, order_by).withColumn(STRIPE, F.floor(F.col(POS) / stripe_rows).cast("long") if stripe_rows else F.lit(0).cast("long"))
    placed.write.option("compression", "zstd").partitionBy(STRIPE).parquet(f"{path}/data")
    data = spark.read.schema(T.StructType([*schema.to_spark(), T.StructField(POS, T.LongType()), T.StructField(STRIPE, T.LongType())]))
    has_rows = any(n.startswith(f"{STRIPE}=") for n in files.names(f"{path}/data"))
    n_rows = 0
    if has_rows:
        rows = data.parquet(f"{path}/data")
        if stats:
            _statistics(rows, schema.to_spark(), filters).write.parquet(f"{path}/stats/first=0")
            n_rows = spark.read.parquet(f"{path}/stats/first=0").agg(F.sum("n_rows")).first()[0]
        else:
            n_rows = rows.count()
    n_stripes = max(1, -(-n_rows // stripe_rows)) if stripe_rows else 1
    options = {"stripe_rows": stripe_rows or 0, "stats": bool(stats and has_rows), "filters": bool(stats and filters and has_rows)}
    return _finish(spark, path, schema, n_rows, n_stripes, options, catalog)


def _finish(spark: SparkSession, path: str, schema: Schema, n_rows: int, n_stripes: int, options: dict, catalog: Catalog | None, schema_hash: str | None = None) -> Dataset:
    head: dict[str, Any] = {"version": VERSION, "n_rows": n_rows, "n_stripes": n_stripes, "options": options}
    if schema_hash is not None:
        head["schema_hash"] = schema_hash
    elif catalog is None:
        head["schema"] = schema.to_json()
    else:
        head["schema_hash"] = catalog.add(schema)
    Files(spark).write(f"{path}/_dataset.json", json.dumps(head).encode())
    return Dataset(spark, path, schema, n_rows, n_stripes, options, schema_hash=head.get("schema_hash"))
