"""Queries by name, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import sinks, sources
from quern.catalog import Catalog
from quern.dataset import POS, STRIPE, Dataset, write
from quern.functions import transforms as X
from quern.operators import shred
from quern.operators import statistics as S
from quern.plans import pruning
from quern.session import Session
from quern.storage import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Stripes of the example datasets.
ROWS = {"orders": 1000, "lineitem": 5000, "events": 1000, "documents": 100, "customer": 500, "embeddings": 100}
ORDER = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "events": ["event_id"], "documents": ["doc_id"], "customer": ["c_custkey"], "embeddings": ["vec_id"]}
_MADE: dict[tuple[str, str, str], Dataset] = {}
_OPEN: dict[tuple, Session] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def same(name: str, sql: str, other: str | None = None) -> None:
    """A query whose text both engines take (``other``: DuckDB's where it differs)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return session(spark, sf_dir, sql).sql(sql)

    query(name, other or sql)(run)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    """The table as a striped dataset in its key's order, written once for each application."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _MADE:
        _MADE[at] = write(table(spark, sf_dir, name), scratch(spark, name), stripe_rows=ROWS[name], order_by=ORDER[name])
    return _MADE[at]


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(spark: SparkSession, sf_dir: str, sql: str = "") -> Session:
    """A session with the tables that the text names: datasets where the table has one here, else views of files."""
    names = tuple(n for n in TABLES if re.search(rf"\b{n}\b", sql))
    at = (spark.sparkContext.applicationId, sf_dir, "all", names)
    if at not in _OPEN:
        _OPEN[at] = s = Session(spark)
        for name in names:
            if name in ROWS:
                s.register(name, dataset(spark, sf_dir, name).path)
            else:
                s.spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return _OPEN[at]


def striped(spark: SparkSession, sf_dir: str, *names: str) -> Session:
    """A session over the datasets, opened once for each application."""
    at = (spark.sparkContext.applicationId, sf_dir, names)
    if at not in _OPEN:
        _OPEN[at] = s = Session(spark)
        for n in names:
            s.register(n, dataset(spark, sf_dir, n).path)
    return _OPEN[at]


# -- sources

_SCAN = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 120 AND 480"


@query("scan_projection_filter", _SCAN)
def _(spark, sf):
    return pruning.scan(dataset(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"], "o_orderkey BETWEEN 120 AND 480")


@query("scan_stripe_batch", "SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p < 1000")
def _(spark, sf):
    return dataset(spark, sf, "orders").stripe(0, ["o_orderkey", "o_orderstatus"])


@query("scan_zero_columns", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders")
def _(spark, sf):
    return pruning.scan(dataset(spark, sf, "orders"), []).agg(F.count("*").alias("n"))


@query("scan_pruned_partitions", "SELECT CAST(count(*) AS BIGINT) AS n, 0 AS stripes FROM orders WHERE o_orderkey > 99999999999")
def _(spark, sf):
    d = dataset(spark, sf, "orders")
    kept = len(pruning.prune(d, "o_orderkey > 99999999999"))
    return pruning.scan(d, ["o_orderkey"], "o_orderkey > 99999999999").agg(F.count("*").alias("n"), F.lit(kept).alias("stripes"))


@query("open_table_view", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
def _(spark, sf):
    return striped(spark, sf, "orders").sql("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")


@query("open_table_catalog", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(r_regionkey) AS BIGINT) AS s FROM region")
def _(spark, sf):
    catalog, path = Catalog(spark, scratch(spark, "catalog")), scratch(spark, "region")
    write(table(spark, sf, "region"), path, catalog=catalog)
    return Dataset.open(spark, path, catalog).frame().agg(F.count("*").alias("n"), F.sum("r_regionkey").cast("long").alias("s"))


@query("read_column_all_stripes", "SELECT o_orderpriority FROM orders")
def _(spark, sf):
    return dataset(spark, sf, "orders").column("o_orderpriority")


@query("read_column_at_stripe", "SELECT o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p < 1000")
def _(spark, sf):
    return dataset(spark, sf, "orders").column("o_totalprice", 0)


@query("read_all", "SELECT * FROM customer")
def _(spark, sf):
    return dataset(spark, sf, "customer").frame()


@query("read_table_stripe_range", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) WHERE p < 1000")
def _(spark, sf):
    return dataset(spark, sf, "events").stripes(0, 1, ["event_id", "event_type"])


@query("table_function", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM events")
def _(spark, sf):
    from quern.sources.table import table_from

    return table_from(spark, dataset(spark, sf, "events").path, ["event_id"]).agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))


def _through(spark: SparkSession, df: DataFrame, fmt: str) -> DataFrame:
    """Written in a format and read back with an inferred schema."""
    path = scratch(spark, fmt)
    sinks.export(df, path, fmt)
    return sources.read(spark, path, fmt)


_NATIONS = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


@query("csv_round_trip", _NATIONS)
def _(spark, sf):
    return _through(spark, table(spark, sf, "nation"), "csv")


@query("ndjson_round_trip", _NATIONS)
def _(spark, sf):
    return _through(spark, table(spark, sf, "nation"), "ndjson")


@query("parquet_round_trip", "SELECT * FROM supplier")
def _(spark, sf):
    return _through(spark, table(spark, sf, "supplier"), "parquet")


@query("avro_round_trip", "SELECT * FROM orders")
def _(spark, sf):
    return _through(spark, table(spark, sf, "orders"), "avro")


@query("avro_nested_round_trip", "SELECT vec_id, len(embedding) AS n, round(list_sum(embedding), 4) AS s FROM embeddings")
def _(spark, sf):
    return _through(spark, table(spark, sf, "embeddings"), "avro").select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("s"))


@query("csv_inferred_types", "SELECT * FROM (VALUES ('o_custkey', 'i64'), ('o_orderdate', 'utf8'), ('o_orderkey', 'i64'), ('o_orderpriority', 'utf8'), ('o_orderstatus', 'utf8'), ('o_totalprice', 'f64')) AS t(name, type)")
def _(spark, sf):
    path = scratch(spark, "csv")
    sinks.to_csv(table(spark, sf, "orders"), path)
    schema = sources.infer(spark, path, "csv")
    return spark.createDataFrame([(c.name, c.type.arg("type") or c.type.kind) for c in schema.columns], "name string, type string")


@query("json_union_kinds", "SELECT event_id, CAST(event_id % 3 AS INTEGER) AS kind FROM events")
def _(spark, sf):
    v = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.lit("[1, 2]"))
    lines = table(spark, sf, "events").select(F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "v": '), v, F.lit("}")).alias("value"))
    path = scratch(spark, "json")
    lines.write.text(path)
    return sources.read(spark, path, "ndjson").select("event_id", F.col("v._tag").cast("int").alias("kind"))


# -- sinks and administration


@query("striped_write", "SELECT CAST(p // 1000 AS BIGINT) AS stripe_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) GROUP BY 1")
def _(spark, sf):
    return dataset(spark, sf, "orders").frame(positions=True).groupBy(STRIPE).agg(F.count("*").alias("n"))


@query("column_slice", "SELECT o_custkey, o_orderkey FROM orders")
def _(spark, sf):
    return dataset(spark, sf, "orders").project_to(scratch(spark, "slice"), ["o_custkey", "o_orderkey"]).frame()


@query("write_without_stats", "SELECT CAST(count(*) AS BIGINT) AS n FROM nation WHERE n_nationkey > 3")
def _(spark, sf):
    path = scratch(spark, "plain")
    write(table(spark, sf, "nation"), path, stats=False)
    s = Session(spark)
    s.register("nation", path)
    return s.sql("SELECT count(*) AS n FROM nation WHERE n_nationkey > 3")


@query("verify", "SELECT 6 AS columns, CAST(count(*) AS BIGINT) AS rows FROM orders")
def _(spark, sf):
    v = dataset(spark, sf, "orders").verify()
    return spark.createDataFrame([(v["columns"], v["rows"])], "columns int, rows long")


@query("compare_codecs")
def _(spark, sf):
    from quern.convert import compare

    rows = [x.split("|")[1:4] for x in compare(spark, f"{sf}/nation.parquet").split("\n")[4:]]
    return spark.createDataFrame([(a.strip(), int(b), float(c)) for a, b, c in rows], "codec string, bytes long, ratio double")


@query("optimise_schema")
def _(spark, sf):
    from quern.convert import optimise_schema

    schema, sizes = optimise_schema(spark, f"{sf}/supplier.parquet")
    return spark.createDataFrame([(c.name, c.type.kind, sizes[c.name]) for c in schema.columns], "name string, kind string, bytes long")


# -- row and column structure

_POSITIONED = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)"


@query("row_slice", f"SELECT o_orderkey FROM {_POSITIONED} WHERE p >= 250 AND p < 350")
def _(spark, sf):
    return dataset(spark, sf, "orders").rows(250, 100).select("o_orderkey")


def _at(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return dataset(spark, sf, name).frame(positions=True)


@query("dictionary_encode", f"SELECT stripe_id, CAST(row_number() OVER (PARTITION BY stripe_id ORDER BY first) - 1 AS BIGINT) AS index, value FROM (SELECT CAST(p // 1000 AS BIGINT) AS stripe_id, o_orderpriority AS value, min(p) AS first FROM {_POSITIONED} GROUP BY 1, 2)")
def _(spark, sf):
    return shred.dictionary_encoded(_at(spark, sf, "orders"), "o_orderpriority", [STRIPE], POS)[0].select(STRIPE, "index", "value")


@query("dictionary_round_trip", "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    pair = shred.dictionary_encoded(_at(spark, sf, "orders"), "o_orderpriority", [STRIPE], POS)
    return shred.dictionary_decoded(*pair, [STRIPE], "o_orderpriority").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


_NULLED = "(SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events)"


@query("nullable_compaction", f"SELECT CAST(p // 1000 AS BIGINT) AS stripe_id, CAST(row_number() OVER (PARTITION BY p // 1000 ORDER BY p) - 1 AS BIGINT) AS item_pos, v AS value FROM {_NULLED} WHERE v IS NOT NULL")
def _(spark, sf):
    df = _at(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return shred.compacted(df, "v", [STRIPE], POS)[1]


@query("nullable_expansion", f"SELECT CAST(p AS BIGINT) AS _row_pos, v FROM {_NULLED}")
def _(spark, sf):
    df = _at(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return shred.expanded(*shred.compacted(df, "v", [STRIPE], POS), [STRIPE], POS, "v").select(POS, "v")


@query("list_offsets", "SELECT vec_id, CAST(sum(len(embedding)) OVER (PARTITION BY p // 100 ORDER BY p) AS BIGINT) AS \"offset\" FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS p FROM embeddings)")
def _(spark, sf):
    df = _at(spark, sf, "embeddings")
    return shred.offsets(df, "embedding", [STRIPE], POS).join(df.select(POS, "vec_id"), POS).select("vec_id", "offset")


@query("list_shred_assemble", "SELECT vec_id, round(list_sum(embedding), 4) AS s, len(embedding) AS n FROM embeddings")
def _(spark, sf):
    df = _at(spark, sf, "embeddings")
    back = shred.lists_from(shred.items_of(df, "embedding", [STRIPE], POS), df, [STRIPE], POS, "embedding")
    return back.join(df.select(POS, "vec_id"), POS).select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("s"), F.size("embedding").cast("long").alias("n"))


@query("union_variants", "SELECT 'a' AS variant, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'b', CAST(count(*) AS BIGINT), CAST(sum(length(event_type)) AS BIGINT) FROM events WHERE event_id % 2 = 1")
def _(spark, sf):
    even = F.col("event_id") % 2 == 0
    df = _at(spark, sf, "events").withColumn("u", F.struct((F.col("event_id") % 2).cast("short").alias("_tag"), F.when(even, F.col("event_id")).alias("a"), F.when(~even, F.col("event_type")).alias("b")))
    parts = shred.union_variants(df, "u", [STRIPE], POS)
    return parts["a"].agg(F.lit("a").alias("variant"), F.count("*").alias("n"), F.sum("value").alias("s")).unionByName(parts["b"].agg(F.lit("b").alias("variant"), F.count("*").alias("n"), F.sum(F.length("value")).cast("long").alias("s")))


@query("decimal_halves", "SELECT o_orderkey, CAST(o_orderkey * 100 AS BIGINT) AS d_low FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("decimal(38,2)").alias("d"))
    return shred.decimal_halves(df, "d").select("o_orderkey", "d_low")


# -- coders as dataflow

_LAG = "lag({c}) OVER (PARTITION BY p // 1000 ORDER BY p)"
_EVENTS = "(SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events)"


@query("coder_delta", f"SELECT event_id, CAST(user_id - coalesce({_LAG.format(c='user_id')}, 0) AS BIGINT) AS user_id FROM {_EVENTS}")
def _(spark, sf):
    return X.delta(_at(spark, sf, "events"), "user_id", [STRIPE], POS).select("event_id", "user_id")


@query("coder_delta_round_trip", "SELECT event_id, user_id FROM events")
def _(spark, sf):
    return X.undelta(X.delta(_at(spark, sf, "events"), "user_id", [STRIPE], POS), "user_id", [STRIPE], POS).select("event_id", "user_id")


@query("coder_delta_of_delta", f"SELECT event_id, CAST(d - coalesce(lag(d) OVER (PARTITION BY p // 1000 ORDER BY p), 0) AS BIGINT) AS user_id FROM (SELECT *, user_id - coalesce({_LAG.format(c='user_id')}, 0) AS d FROM {_EVENTS})")
def _(spark, sf):
    return X.delta_of_delta(_at(spark, sf, "events"), "user_id", [STRIPE], POS).select("event_id", "user_id")


@query("coder_deltamin", "SELECT event_id, CAST(user_id - min(user_id) OVER (PARTITION BY (row_number - 1) // 1000) AS BIGINT) AS user_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS row_number FROM events)")
def _(spark, sf):
    return X.deltamin(_at(spark, sf, "events"), "user_id", [STRIPE]).select("event_id", "user_id")


@query("coder_rle", f"SELECT stripe_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS value, CAST(count(*) AS BIGINT) AS n FROM (SELECT stripe_id, event_type, sum(new) OVER (PARTITION BY stripe_id ORDER BY p) - 1 AS run FROM (SELECT CAST(p // 1000 AS BIGINT) AS stripe_id, p, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY p // 1000 ORDER BY p) THEN 0 ELSE 1 END AS new FROM {_EVENTS})) GROUP BY 1, 2")
def _(spark, sf):
    return X.rle(_at(spark, sf, "events"), "event_type", [STRIPE], POS)


@query("coder_bit_width", "SELECT CAST((row_number - 1) // 1000 AS BIGINT) AS stripe_id, CAST(ceil(log2(max(user_id) - min(user_id) + 1)) AS INTEGER) AS width FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS row_number FROM events) GROUP BY 1")
def _(spark, sf):
    return X.bit_width(_at(spark, sf, "events"), "user_id", [STRIPE])


@query("coder_pages")
def _(spark, sf):
    """Pages encoded and decoded again by executors: rows whose values came back."""
    from quern.types import Stage

    stages = {"user_id": [Stage("delta"), Stage("leb128"), Stage("zstd")], "value": [Stage("gorilla"), Stage("zstd")]}
    return X.encoded_pages(table(spark, sf, "events").select("user_id", "value"), stages).groupBy("column").agg(F.sum("n").alias("n"), F.sum("raw").alias("raw"), F.sum(F.length("data")).alias("bytes"), F.bool_and("same").alias("same"))


# -- statistics, pruning, metadata


@query("stripe_stats", "SELECT CAST(p // 1000 AS BIGINT) AS stripe_id, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(o_totalprice) AS BIGINT) AS nulls FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) GROUP BY 1")
def _(spark, sf):
    d = dataset(spark, sf, "orders")
    s = F.col(f"s{[p for p, _ in d.leaves].index('o_totalprice')}")
    return d.stats().select(STRIPE, s["lo"].alias("lo"), s["hi"].alias("hi"), s["n"].alias("n"), s["nulls"].alias("nulls"))


@query("stats_merged", "SELECT 'o_orderkey' AS leaf, CAST(count(*) AS BIGINT) AS n, CAST(min(o_orderkey) AS VARCHAR) AS lo, CAST(max(o_orderkey) AS VARCHAR) AS hi FROM orders UNION ALL SELECT 'o_orderstatus', CAST(count(*) AS BIGINT), min(o_orderstatus), max(o_orderstatus) FROM orders")
def _(spark, sf):
    d = dataset(spark, sf, "orders")
    return S.merged(d.stats(), d.fields).where(F.col("leaf").isin("o_orderkey", "o_orderstatus")).select("leaf", "n", "lo", "hi")


@query("long_text_bounds", "SELECT CAST((row_number - 1) // 100 AS BIGINT) AS stripe_id, substr(min(text), 1, 256) AS lo, length(max(text)) <= 256 AS hi_kept FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS row_number FROM documents) GROUP BY 1")
def _(spark, sf):
    d = dataset(spark, sf, "documents")
    s = F.col(f"s{[p for p, _ in d.leaves].index('text')}")
    return d.stats().select(STRIPE, s["lo"].alias("lo"), s["hi_exact"].alias("hi_kept"))


@query("distinct_sets", "SELECT CAST((row_number - 1) // 1000 AS BIGINT) AS stripe_id, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_number FROM orders) GROUP BY 1")
def _(spark, sf):
    d = dataset(spark, sf, "orders")
    f = F.col(f"f{[p for p, _ in d.leaves].index('o_orderstatus')}")
    return d.stats().select(STRIPE, F.size(f["hashes"]).cast("long").alias("n"))


def _pruned(name: str, table_name: str, predicate: str) -> None:
    sql = f"SELECT CAST(count(*) AS BIGINT) AS n FROM {table_name} WHERE {predicate}"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return striped(spark, sf, table_name).sql(f"SELECT count(*) AS n FROM {table_name} WHERE {predicate}")

    query(name, sql)(run)


_pruned("prune_greater", "orders", "o_orderkey > 900")
_pruned("prune_less_or_equal", "orders", "o_orderkey <= 37")
_pruned("prune_equal", "orders", "o_orderkey = 77")
_pruned("prune_between", "orders", "o_orderkey BETWEEN 100 AND 130")
_pruned("prune_in", "orders", "o_orderkey IN (1, 5, 900, 123456789)")
_pruned("prune_or_list", "orders", "o_orderkey = 1 OR o_orderkey = 999")
_pruned("prune_and_mixed", "orders", "o_orderstatus = 'F' AND o_totalprice > 100000")
_pruned("prune_not_equal", "orders", "o_orderstatus <> 'F'")
_pruned("prune_not_in", "orders", "o_orderstatus NOT IN ('F', 'O')")
_pruned("prune_is_null", "orders", "o_orderstatus IS NULL")
_pruned("prune_is_not_null", "orders", "o_orderstatus IS NOT NULL")
_pruned("prune_text_equal", "events", "event_type = 'no such type'")
_pruned("prune_like_prefix", "orders", "o_orderpriority LIKE '1-%'")
_pruned("prune_float_range", "lineitem", "l_extendedprice > 90000.0")
_pruned("prune_timestamp", "orders", "o_orderdate >= TIMESTAMP '1998-01-01'")
_pruned("prune_none_left", "lineitem", "l_orderkey < 0")


@query("meta_agg", "SELECT CAST(count(*) AS BIGINT) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem")
def _(spark, sf):
    return striped(spark, sf, "lineitem").sql("SELECT count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem")


@query("meta_agg_fallback", "SELECT max(text) AS hi FROM documents")
def _(spark, sf):
    return striped(spark, sf, "documents").sql("SELECT max(text) AS hi FROM documents")


# -- the SQL surface

same("select_star", "SELECT * FROM nation")
same("select_reorder", "SELECT n_name, n_nationkey FROM nation")
same("computed_alias", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
same("where_and_or", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice < 50000) OR o_orderkey < 10")
same("between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12")
same("in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
same("is_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL")
same("like", "SELECT CAST(count(*) AS BIGINT) AS n FROM part WHERE p_type LIKE '%BRASS%' OR p_name LIKE 'a%'")
same("case_sensitive_equality", "SELECT CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_mktsegment = 'building'")
same("null_comparison", "SELECT CAST(count(*) AS BIGINT) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality > 0")
same("struct_field", "SELECT o.k AS k FROM (SELECT named_struct('k', o_orderkey) AS o FROM orders)", "SELECT o_orderkey AS k FROM orders")
same("map_access", "SELECT o_orderkey, try_element_at(map('status', o_orderstatus), 'status') AS s, try_element_at(map('status', o_orderstatus), 'none') AS x FROM orders", "SELECT o_orderkey, o_orderstatus AS s, CAST(NULL AS VARCHAR) AS x FROM orders")
same("count_star", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
same("count_where", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity > 25")
same("count_distinct", "SELECT CAST(count(DISTINCT l_partkey) AS BIGINT) AS n FROM lineitem")
same("sum_int", "SELECT CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem")
same("avg_float", "SELECT round(avg(l_extendedprice), 4) AS a, round(avg(CASE WHEN l_quantity > 10 THEN l_quantity END), 4) AS b FROM lineitem")
same("min_max", "SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, min(l_returnflag) AS f, max(l_shipdate) AS d FROM lineitem")
same("min_slice", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_orderkey > 100 GROUP BY l_returnflag ORDER BY l_returnflag")
same("group_sum_order", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority")
same("group_count_avg_limit", "SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS a FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
same("null_aggregates", "SELECT CAST(count(v) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS s FROM (SELECT CASE WHEN event_id % 3 = 0 THEN event_id END AS v FROM events)")
same("having", "SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 2")
same("rollup", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
same("cube", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
same("grouping_sets", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
same("order_desc", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
same("limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
same("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
same("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
same("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
same("join_full", "SELECT d.doc_id AS a, l.doc_id AS b FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) d FULL JOIN (SELECT doc_id FROM labels WHERE doc_id % 3 = 0) l ON d.doc_id = l.doc_id")
same("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", "SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey")
same("join_anti", "SELECT doc_id FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
same("join_three", "SELECT n_name, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
same("exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
same("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
same("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 250000) SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM big GROUP BY o_orderstatus")
same("union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
same("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
same("intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
same("except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
same("window_rank", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders")
same("window_running_sum", "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS s FROM events")
same("functions_string", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, length(n_name) AS n, substring(n_name, 2, 3) AS s, concat(n_name, '-', n_name) AS c, replace(n_name, 'A', '#') AS r, lpad(n_name, 12, '.') AS p, trim(concat(' ', n_name, ' ')) AS t FROM nation", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, CAST(length(n_name) AS INTEGER) AS n, substring(n_name, 2, 3) AS s, concat(n_name, '-', n_name) AS c, replace(n_name, 'A', '#') AS r, lpad(n_name, 12, '.') AS p, trim(concat(' ', n_name, ' ')) AS t FROM nation")
same("functions_datetime", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS t FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t FROM orders")
same("functions_encoding", "SELECT n_nationkey, base64(CAST(n_name AS BINARY)) AS b, hex(CAST(n_name AS BINARY)) AS h FROM nation", "SELECT n_nationkey, base64(encode(n_name)) AS b, hex(encode(n_name)) AS h FROM nation")
same("functions_regex", "SELECT p_partkey, regexp_extract(p_type, '([A-Z]+) ([A-Z]+)', 2) AS e, regexp_replace(p_type, '[AEIOU]', '') AS r FROM part", "SELECT p_partkey, regexp_extract(p_type, '([A-Z]+) ([A-Z]+)', 2) AS e, regexp_replace(p_type, '[AEIOU]', '', 'g') AS r FROM part")
same("functions_crypto", "SELECT n_nationkey, md5(n_name) AS m, sha2(n_name, 256) AS s FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s FROM nation")
same("functions_unicode", "SELECT doc_id, char_length(text) AS n, left(text, 5) AS l, right(text, 5) AS r, octet_length(text) AS b, reverse(left(text, 9)) AS v FROM documents", "SELECT doc_id, CAST(length(text) AS INTEGER) AS n, left(text, 5) AS l, right(text, 5) AS r, CAST(strlen(text) AS INTEGER) AS b, reverse(left(text, 9)) AS v FROM documents")
same("functions_nested", "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, element_at(embedding, 1) AS first, array_contains(array(label, -1), -1) AS c FROM embeddings", "SELECT vec_id, len(embedding) AS n, embedding[1] AS first, true AS c FROM embeddings")
same("functions_math", "SELECT o_orderkey, round(sqrt(o_totalprice), 4) AS s, floor(o_totalprice / 1000) AS f, o_orderkey % 7 AS m FROM orders", "SELECT o_orderkey, round(sqrt(o_totalprice), 4) AS s, CAST(floor(o_totalprice / 1000) AS BIGINT) AS f, o_orderkey % 7 AS m FROM orders")
same("explode_lateral", "SELECT vec_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT vec_id, explode(embedding) AS x FROM embeddings) GROUP BY vec_id", "SELECT vec_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
same("approx_distinct_gate", "SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")


@query("join_two_datasets", "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey < 300")
def _(spark, sf):
    return striped(spark, sf, "orders", "lineitem").sql("SELECT count(*) AS n, round(sum(l_quantity), 2) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey < 300")


@query("case_preserving", "SELECT CAST(1 AS INTEGER) AS \"Id\", CAST(2 AS INTEGER) AS \"iD2\"")
def _(spark, sf):
    path = scratch(spark, "case")
    s = Session(spark)
    write(s.spark.sql("SELECT 1 AS Id, 2 AS iD2"), path)
    s.register("T", path)
    return s.sql("SELECT Id, iD2 FROM T")


@query("distinct_gate", "SELECT 'o_orderstatus' AS name, true AS low")
def _(spark, sf):
    """Approximate count first; the exact count only where it can matter."""
    df = table(spark, sf, "orders")
    n = df.agg(F.approx_count_distinct("o_orderstatus")).first()[0]
    low = n <= 1.1 * 65536 and df.select("o_orderstatus").distinct().limit(65537).count() <= 65536
    return spark.createDataFrame([("o_orderstatus", bool(low))], "name string, low boolean")


@query("tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("stripe_concatenation", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders")
def _(spark, sf):
    d = dataset(spark, sf, "orders")
    parts = [d.frame([k]) for k in range(min(3, d.n_stripes))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rest = d.frame(list(range(min(3, d.n_stripes), d.n_stripes)))
    return out.unionByName(rest).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))




# -- joins, windows and functions beside the common ones

same("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 400000")
same("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
same("join_range", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND b.n_nationkey <= a.n_nationkey + 3")
same("functions_json", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
same("functions_split", "SELECT p_partkey, split_part(p_type, ' ', 2) AS s, CAST(instr(p_type, 'E') AS BIGINT) AS i, translate(p_type, 'AE', 'xy') AS t FROM part", "SELECT p_partkey, split_part(p_type, ' ', 2) AS s, CAST(instr(p_type, 'E') AS BIGINT) AS i, translate(p_type, 'AE', 'xy') AS t FROM part")
same("functions_dates", "SELECT o_orderkey, CAST(date_add(CAST(o_orderdate AS DATE), 30) AS STRING) AS a, date_format(o_orderdate, 'yyyy-MM-dd') AS f, CAST(to_timestamp('2024-02-29 01:02:03') AS STRING) AS d FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS a, strftime(o_orderdate, '%Y-%m-%d') AS f, '2024-02-29 01:02:03' AS d FROM orders")
same("functions_regexp_like", "SELECT p_partkey, p_type RLIKE '^[A-M].*S$' AS m, CAST(regexp_count(p_type, '[AEIOU]') AS BIGINT) AS n FROM part", "SELECT p_partkey, regexp_matches(p_type, '^[A-M].*S$') AS m, CAST(len(regexp_extract_all(p_type, '[AEIOU]')) AS BIGINT) AS n FROM part")
same("functions_sha1", "SELECT n_nationkey, sha1(n_name) AS s, CAST(unbase64(base64(CAST(n_name AS BINARY))) AS STRING) AS b, CAST(unhex(hex(CAST(n_name AS BINARY))) AS STRING) AS h FROM nation", "SELECT n_nationkey, sha1(n_name) AS s, decode(from_base64(base64(encode(n_name)))) AS b, decode(unhex(hex(encode(n_name)))) AS h FROM nation")


@query("sliding_window", "SELECT s AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts)]) AS s FROM events) GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


# -- appended stripes, limits, accessors


@query("appended_stripes", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    """A dataset made by one write and two appends."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    d = write(rows.where("o_orderkey % 3 = 0"), scratch(spark, "appended"), stripe_rows=1000)
    for k in (1, 2):
        d = d.append(rows.where(F.col("o_orderkey") % 3 == k))
    return Dataset.open(spark, d.path).frame()


@query("appended_stripes_pruned", "SELECT CAST(count(*) AS BIGINT) AS n, max(o_totalprice) AS hi FROM orders WHERE o_orderkey < 500")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    d = write(rows.where("o_orderkey < 500"), scratch(spark, "appended"), stripe_rows=1000)
    d.append(rows.where("o_orderkey >= 500"))
    s = Session(spark)
    s.register("t", d.path)
    return s.sql("SELECT count(*) AS n, max(o_totalprice) AS hi FROM t WHERE o_orderkey < 500")


@query("limit_by_stripes", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders) WHERE p <= 1000")
def _(spark, sf):
    return pruning.scan(dataset(spark, sf, "orders"), ["o_orderkey"], limit=1000)


@query("limit_within_a_stripe", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders) WHERE p <= 10")
def _(spark, sf):
    return dataset(spark, sf, "orders").stripe(0, ["o_orderkey"], limit=10)


@query("keep_mask", "SELECT CAST((p - 1) // 1000 AS BIGINT) AS stripe_id, max(o_orderkey) > 600 AS kept FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders) GROUP BY 1")
def _(spark, sf):
    return spark.createDataFrame(list(enumerate(pruning.keep_mask(dataset(spark, sf, "orders"), "o_orderkey > 600"))), "stripe_id long, kept boolean")


@query("column_stats_accessor", "SELECT CAST((p - 1) // 500 AS BIGINT) AS stripe_id, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS nulls, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS p FROM customer) GROUP BY 1 HAVING stripe_id < 3")
def _(spark, sf):
    d = dataset(spark, sf, "customer")
    found = [(k, d.column_stats(k, "c_acctbal")) for k in range(min(3, d.n_stripes))]
    return spark.createDataFrame([(k, s["n"], s["nulls"], s["lo"], s["hi"]) for k, s in found], "stripe_id long, n long, nulls long, lo double, hi double")


@query("stripe_row_counts", "SELECT CAST((p - 1) // 500 AS BIGINT) AS stripe_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS p FROM customer) GROUP BY 1")
def _(spark, sf):
    return spark.createDataFrame(list(enumerate(dataset(spark, sf, "customer").stripe_row_counts())), "stripe_id long, n long")


@query("schema_projected", "SELECT n_regionkey, n_name FROM nation")
def _(spark, sf):
    d = write(table(spark, sf, "nation"), scratch(spark, "nation"))
    return d.project_to(scratch(spark, "projected"), ["n_regionkey", "n_name"]).frame()


@query("schema_by_hash", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf):
    """A dataset whose schema lies in a catalog, found by its hash after the catalog was verified."""
    catalog, path = Catalog(spark, scratch(spark, "catalog")), scratch(spark, "nation")
    key = write(table(spark, sf, "nation"), path, catalog=catalog).schema_hash
    found = Dataset.open(spark, path, catalog)
    if catalog.resolve(key).hash() != key or catalog.list() != [key] or catalog.verify() or found.schema.hash() != key:
        raise RuntimeError("the catalog holds another schema")
    return found.frame()


@query("flat_arrays", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf):
    from quern import api

    rows = table(spark, sf, "nation").toPandas()
    path = scratch(spark, "arrays")
    api.write_arrays(spark, path, {"n_nationkey": rows["n_nationkey"].to_numpy(), "n_name": rows["n_name"].tolist()})
    back = api.read_arrays(spark, path)
    return spark.createDataFrame([(int(a), b) for a, b in zip(back["n_nationkey"], back["n_name"], strict=True)], "n_nationkey int, n_name string")


@query("arrow_write", "SELECT * FROM nation")
def _(spark, sf):
    from quern import api

    path = scratch(spark, "arrow")
    api.write_table(spark, path, table(spark, sf, "nation").toArrow(), stripe_rows=10)
    return api.read_table(spark, path)


@query("arrow_stripe_range", "SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS p FROM nation) WHERE p > 10 AND p <= 20")
def _(spark, sf):
    from quern import api

    path = scratch(spark, "arrow")
    api.write_table(spark, path, table(spark, sf, "nation").orderBy("n_nationkey").toPandas(), stripe_rows=10)
    return api.read_table(spark, path, ["n_nationkey", "n_name"], (1, 2))


# -- coders: a column's pages encoded and decoded by executors


def _coded(name: str, coders: list[str], table_name: str, column: str, kind: str, cast: str, wide: str | None = None) -> None:
    """Every page of a column through a pipeline of coders and back. ``kind`` is the physical type, ``cast`` the type
    that both engines name for the result."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        import numpy as np
        import pyarrow as pa

        from quern.coders.base import DTYPES
        from quern.coders.codec import compress_with, decompress
        from quern.types import Stage

        stages = [Stage(c, {"width": 32}) if c == "bitpack_fixed" else Stage(c) for c in coders]

        def through(batches):
            for batch in batches:
                x = batch.column(0).to_numpy(zero_copy_only=False).astype(DTYPES[kind]) if kind != "bytes" else "\n".join(batch.column(0).to_pylist()).encode()
                back = decompress(compress_with(x if kind == "bytes" else np.ascontiguousarray(x), stages, kind))
                yield pa.RecordBatch.from_arrays([pa.array(back.decode().split("\n") if kind == "bytes" else back).cast(batch.schema.field(0).type)], names=["v"])

        rows = table(spark, sf, table_name).select(F.col(column).cast(wide or cast).alias("v"))
        rows = rows.orderBy("v") if "elias_fano" in coders else rows
        return rows.mapInArrow(through, rows.schema).select(F.col("v").cast(cast))

    query(f"coder_{name}", f"SELECT CAST({column} AS {'VARCHAR' if cast == 'string' else cast}) AS v FROM {table_name}")(run)


_coded("leb128", ["leb128"], "events", "user_id", "i64", "bigint")
_coded("bitpack_fixed", ["bitpack_fixed", "zstd"], "orders", "o_custkey", "u32", "bigint")
_coded("bitpack_auto", ["bitpack_auto", "zstd"], "lineitem", "l_linenumber", "u32", "int", "bigint")
_coded("elias_fano", ["elias_fano"], "events", "event_id", "u32", "bigint")
_coded("gorilla", ["gorilla", "zstd"], "events", "value", "f64", "double")
_coded("for_bitpack", ["for_bitpack_zstd"], "orders", "o_totalprice", "f64", "double")
_coded("zstd", ["zstd"], "customer", "c_name", "bytes", "string")
_coded("lz4", ["lz4"], "customer", "c_name", "bytes", "string")
_coded("snappy", ["snappy"], "customer", "c_name", "bytes", "string")
_coded("default_numbers", ["delta", "leb128", "zstd"], "lineitem", "l_partkey", "i64", "bigint")
_coded("delta_of_delta_pages", ["delta_of_delta", "leb128", "zstd"], "events", "event_id", "i64", "bigint")


@query("coder_rle_round_trip", "SELECT CAST((p - 1) // 1000 AS BIGINT) AS stripe_id, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders)")
def _(spark, sf):
    d = dataset(spark, sf, "orders").frame(positions=True)
    return X.unrle(X.rle(d, "o_orderstatus", [STRIPE], POS), [STRIPE], "o_orderstatus").select(STRIPE, "o_orderstatus")


@query("coder_delta_of_delta_round_trip", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, sf):
    d = dataset(spark, sf, "orders").frame(positions=True)
    return X.undelta_of_delta(X.delta_of_delta(d, "o_custkey", [STRIPE], POS), "o_custkey", [STRIPE], POS).select("o_orderkey", "o_custkey")


# -- inference and typed reading of small files


def _file(spark: SparkSession, name: str, text: str) -> str:
    from quern.storage import Files

    path = f"{scratch(spark, 'file')}/{name}"
    Files(spark).write(path, text.encode())
    return path


@query("csv_null_tokens", "SELECT * FROM (VALUES (1, 1.5, 'x'), (NULL, NULL, NULL), (3, -2.0, 'y'), (NULL, 4.0, NULL)) t(i, f, s)", )
def _(spark, sf):
    df = sources.read(spark, _file(spark, "a.csv", "i,f,s\n1,1.5,x\nNULL,NA,null\n3,-2.0,y\n,4e0,\n"))
    return df.select(F.col("i").cast("int").alias("i"), F.round("f", 1).cast("decimal(2,1)").alias("f"), "s")


@query("csv_blank_lines", "SELECT * FROM (VALUES ('a', CAST(1 AS BIGINT)), ('b', 2)) t(k, v)")
def _(spark, sf):
    return sources.read(spark, _file(spark, "a.csv", "k,v\na,1\n\nb,2\n\n"))


@query("csv_without_header", "SELECT * FROM (VALUES ('a', CAST(1 AS BIGINT)), ('b, c', 2), (chr(10), 3)) t(col_0, col_1)")
def _(spark, sf):
    return sources.read(spark, _file(spark, "a.csv", 'a,1\n"b, c",2\n"\n",3\n'), header=False)


@query("csv_dates", "SELECT CAST(d AS VARCHAR) AS d, t FROM (VALUES (DATE '2024-02-29', TIMESTAMP '2024-02-29 12:30:00'), (DATE '1970-01-11', TIMESTAMP '1999-12-31 23:59:59.5')) x(d, t)")
def _(spark, sf):
    from quern.schema import Schema

    kinds = T.StructType([T.StructField("d", T.DateType()), T.StructField("t", T.TimestampNTZType())])
    return sources.read(spark, _file(spark, "a.csv", "d,t\n2024-02-29,2024-02-29 12:30:00\n10,1999-12-31T23:59:59.5\n"), schema=Schema.from_spark(kinds)).withColumn("d", F.col("d").cast("string"))


@query("csv_sample_prefix", "SELECT * FROM (VALUES (CAST(0 AS BIGINT)), (1), (2)) t(x)")
def _(spark, sf):
    return sources.read(spark, _file(spark, "a.csv", "x\n" + "\n".join(map(str, range(50))) + "\n"), limit=3)


@query("json_promotions", "SELECT * FROM (VALUES (CAST(1 AS DOUBLE), CAST(1 AS BIGINT), 'x'), (2.5, 7, NULL)) t(f, i, s)")
def _(spark, sf):
    return sources.read(spark, _file(spark, "a.ndjson", '{"f": 1, "i": true, "s": "x"}\n{"f": 2.5, "i": 7}\n'))


@query("json_array_root", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, NULL)) t(a, b)")
def _(spark, sf):
    return sources.read(spark, _file(spark, "a.json", '[{"a": 1, "b": "a"},\n {"a": 2, "b": null}]'))


@query("json_binary_as_hex", "SELECT * FROM (VALUES ('00ff'), ('6162')) t(h)")
def _(spark, sf):
    from quern.schema import Schema

    df = sources.read(spark, _file(spark, "a.ndjson", '{"b": "00ff"}\n{"b": "6162"}\n'), schema=Schema.from_spark(T.StructType([T.StructField("b", T.BinaryType(), False)])))
    return df.select(F.lower(F.hex("b")).alias("h"))


@query("avsc_schema", "SELECT * FROM (VALUES ('id', 'bigint'), ('name', 'string'), ('score', 'double'), ('day', 'date')) t(name, type)")
def _(spark, sf):
    text = '{"type": "record", "name": "R", "fields": [{"name": "id", "type": "long"}, {"name": "name", "type": ["null", "string"]}, {"name": "score", "type": "double"}, {"name": "day", "type": {"type": "int", "logicalType": "date"}}]}'
    schema = sources.infer(spark, _file(spark, "a.avsc", text))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema.to_spark()], "name string, type string")


@query("stdout_table", "SELECT CAST(count(*) AS BIGINT) AS n FROM nation")
def _(spark, sf):
    """Rows of the printed table that name a nation."""
    rows = table(spark, sf, "nation")
    text = sinks.table_text(rows)
    return spark.createDataFrame([(sum(text.count(r.n_name) > 0 for r in rows.collect()),)], "n long")


@query("converted_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf):
    """Parquet to a dataset, that to CSV, and that to a dataset again, as the command does."""
    from quern import convert

    folder = scratch(spark, "convert")
    sinks.to_parquet(table(spark, sf, "nation"), f"{folder}/a.parquet")
    convert.convert(spark, f"{folder}/a.parquet", f"{folder}/b")
    convert.convert(spark, f"{folder}/b", f"{folder}/c.csv")
    convert.convert(spark, f"{folder}/c.csv", f"{folder}/d", stripe_rows=10)
    return Dataset.open(spark, f"{folder}/d").frame().select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))
