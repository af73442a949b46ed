"""Command line: python -m quern.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import SparkSession

from quern import convert, picker, sinks, sources
from quern.catalog import Catalog
from quern.dataset import Dataset
from quern.errors import QuernError
from quern.operators import statistics as S
from quern.schema import Schema
from quern.session import Session
from quern.storage import Files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern", description="Striped columnar datasets on Spark.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *args: tuple[tuple, dict]) -> None:
        c = sub.add_parser(name, help=text, description=text)
        for a, k in args:
            c.add_argument(*a, **k)

    arg = lambda *a, **k: (a, k)
    catalog, fmt = arg("--catalog"), arg("--from", dest="from_")
    command("convert", "Convert between a dataset and CSV, JSON, Parquet or Avro.", arg("input"), arg("-o", "--output", required=True), arg("--schema"), fmt, arg("--to"), catalog, arg("--csv-strict", action="store_true"), arg("--stripe-rows", type=int, default=0), arg("--delimiter", default=","))
    command("infer-schema", "Print or write the schema that a file has.", arg("input"), arg("-o", "--output"), fmt, arg("--delimiter", default=","))
    command("optimize-schema", "Measure encodings on a sample and print or write the schema with the smallest.", arg("input"), arg("-o", "--output"), fmt, arg("--sample-rows", type=int, default=picker.SAMPLE_ROWS), arg("--zstd-level", type=int, default=3))
    command("compare", "Table of codecs, bytes and ratios.", arg("input"), fmt, arg("--codecs", default="zstd,lz4,snappy"))
    command("slice", "Write a dataset of some columns.", arg("input"), arg("-o", "--output", required=True), arg("--columns", required=True), catalog)
    command("verify", "Read every column and check it against the manifest.", arg("input"), catalog)
    command("stats", "Sizes, bounds and counts.", arg("input"), arg("--no-values", action="store_true"), arg("--json", action="store_true"), catalog)
    command("catalog", "List or check the schemas of a catalog.", arg("action", choices=["list", "verify"]), arg("path"))
    command("sql", "Run a query over datasets given as name=path or path.", arg("query"), arg("tables", nargs="+"), catalog, arg("--limit", type=int, default=1000))
    return p


def statistics(dataset: Dataset, values: bool = True) -> dict[str, Any]:
    """What ``stats`` shows: sizes, and with ``values`` the merged bounds of each leaf as exact text."""
    sizes = dataset.column_byte_sizes()
    total = sum(sizes.values()) or 1
    out: dict[str, Any] = {"path": dataset.path, "rows": dataset.n_rows, "stripes": dataset.n_stripes, "regions": dataset.region_sizes(), "columns": [{"name": n, "bytes": b, "percent": round(100 * b / total, 2)} for n, b in sizes.items()]}
    if values and (table := dataset.stats()) is not None:
        out["leaves"] = [{"leaf": r.leaf, "non_null": r.n - r.nulls, "min": r.lo if r.lo_exact else None, "max": r.hi if r.hi_exact else None} for r in S.merged(table, dataset.fields).collect()]
    return out


def _emit(schema: Schema, output: str | None, files: Files) -> str:
    text = json.dumps(schema.to_json(), indent=2)
    if output is None:
        return text
    files.write(output, text.encode())
    return f"wrote {output}"


def run(args: argparse.Namespace, spark: SparkSession) -> str:
    files = Files(spark)
    catalog = Catalog(spark, args.catalog) if getattr(args, "catalog", None) else None
    if args.command == "convert":
        schema = Schema.from_json(files.read(args.schema)) if args.schema else None
        n = convert.convert(spark, args.input, args.output, args.from_, args.to, schema, catalog, args.stripe_rows or None, args.csv_strict, args.delimiter)
        return f"{n} rows"
    if args.command == "infer-schema":
        return _emit(sources.infer(spark, args.input, args.from_, **({"delimiter": args.delimiter} if sources.format_of(args.input, args.from_) == "csv" else {})), args.output, files)
    if args.command == "optimize-schema":
        return _emit(convert.optimise_schema(spark, args.input, args.from_, args.sample_rows, args.zstd_level)[0], args.output, files)
    if args.command == "compare":
        return convert.compare(spark, args.input, args.from_, tuple(args.codecs.split(",")))
    if args.command == "slice":
        made = Dataset.open(spark, args.input, catalog).project_to(args.output, args.columns.split(","))
        return f"{len(made.schema.columns)} columns × {made.n_rows} rows"
    if args.command == "verify":
        v = Dataset.open(spark, args.input, catalog).verify()
        return f"OK: {v['columns']} column(s) × {v['rows']} rows ({v['stripes']} stripes)"
    if args.command == "stats":
        found = statistics(Dataset.open(spark, args.input, catalog), not args.no_values)
        if args.json:
            return json.dumps(found)
        lines = [f"{found['path']}: {found['rows']} rows, {found['stripes']} stripes", *(f"  {k}: {v} bytes" for k, v in found["regions"].items())]
        lines += [f"  {c['name']}: {c['bytes']} bytes, {c['percent']} %" for c in found["columns"]]
        return "\n".join(lines + [f"  {x['leaf']}: {x['non_null']} values, {x['min']} to {x['max']}" for x in found.get("leaves", [])])
    if args.command == "catalog":
        c = Catalog(spark, args.path)
        if args.action == "list":
            return "\n".join(c.list())
        if bad := c.verify():
            raise QuernError("; ".join(f"{k}: {v}" for k, v in bad.items()))
        return f"OK: {len(c.list())} schemas"
    session = Session(spark)
    for t in args.tables:
        session.register_argument(t, catalog)
    return sinks.table_text(session.sql(args.query), args.limit)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        print(run(args, spark))
        return 0
    except QuernError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
