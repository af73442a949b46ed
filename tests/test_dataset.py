from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quern import types as T
from quern.catalog import Catalog
from quern.dataset import POS, STRIPE, Dataset, write
from quern.errors import FormatError, SchemaError
from quern.operators import shred
from quern.operators import statistics as S
from quern.plans import catalyst as C
from quern.plans.pruning import keep_mask, prune, scan
from quern.schema import Column, Schema
from quern.session import Session
from quern.storage import Files, scratch


@pytest.fixture(scope="module")
def ranges(spark):
    """Three stripes: 0..99, 500..599, 5000..5999 (100 rows each), with texts, nulls and odd floats."""
    rows = [(v, f"row_{v}", "ab"[i // 50 % 2] if i < 100 else ("cd"[i % 2] if i < 200 else "ef"[i % 2]), None if i < 100 else i, [math.nan, math.inf, 1.5, -0.0][i % 4] if i < 100 else float(i), "same" if i < 100 else f"t{i}") for i, v in enumerate([*range(100), *range(500, 600), *range(5000, 6000, 10)])]
    df = spark.createDataFrame(rows, "val long, label string, s string, n long, f double, one string").coalesce(1)
    path = scratch(spark, "ranges")
    return write(df, path, stripe_rows=100)


@pytest.mark.parametrize(
    ("predicate", "kept"),
    [
        ("val > 1000", [2]),
        ("val > 1000000", []),
        ("val < 0", []),
        ("val >= 99 AND val <= 500", [0, 1]),
        ("val BETWEEN 100 AND 499", []),
        ("1000 < val", [2]),
        ("val = 550", [1]),
        ("val IN (5, 5010)", [0, 2]),
        ("val = 5 OR val = 5010", [0, 2]),
        ("s = 'b'", [0]),
        ("s IN ('a', 'f')", [0, 2]),
        ("s = 'x' AND val > 10", []),
        ("s = 'c' AND val > 1000", []),
        ("s <> 'c'", [0, 1, 2]),
        ("one <> 'same'", [1, 2]),
        ("one NOT IN ('same', 'x')", [1, 2]),
        ("n IS NULL", [0]),
        ("n IS NOT NULL", [1, 2]),
        ("n > 0", [1, 2]),
        ("label LIKE 'row_5%'", [0, 1, 2]),
        ("s LIKE 'e%'", [2]),
        ("f > 1e300", [0]),
        ("f < -1e300", [0]),
        ("f = 150.0", [1]),
        ("val + 1 > 100000", [0, 1, 2]),
        ("false", []),
        ("val > 1000 OR label = 'row_3'", [0, 2]),
    ],
)
def test_pruning_keeps_what_is_needed_and_little_else(ranges, predicate, kept):
    got = prune(ranges, predicate)
    true = {r[STRIPE] for r in ranges.frame(positions=True).where(predicate).select(STRIPE).distinct().collect()}
    assert true <= set(got)  # never too little
    assert got == kept
    assert scan(ranges, predicate=predicate).count() == ranges.frame().where(predicate).count()


def test_bloom_filter_prunes(spark):
    rows = [("foo" if i == 5 else f"v{i}",) for i in range(11)] + [(f"x{i}",) for i in range(989)] + [(f"y{i}",) for i in range(1000)]
    d = write(spark.createDataFrame(rows, "s string").coalesce(1), scratch(spark, "bloom"), stripe_rows=1000)
    assert d.column_filter(0, "s")["words"] and d.column_filter(0, "s")["hashes"] is None
    assert keep_mask(d, "s = 'foo'") == [True, False]
    assert all(0 in prune(d, f"s = 'x{i}'") for i in range(0, 989, 97))
    wrong = sum(len(prune(d, f"s = 'v{i}x'")) for i in range(0, 40))
    assert wrong <= 6  # about one in a hundred for each of two stripes


def test_float_and_int_equality_through_filters(spark):
    d = write(spark.sql("SELECT CAST(id AS FLOAT) * -0.0f AS z, CAST(id AS SMALLINT) AS k FROM range(10)"), scratch(spark, "z"))
    assert prune(d, "z = 0.0") == [0] and prune(d, "k = 3") == [0] and prune(d, "k = 30") == []


def test_nested_fields_have_statistics(spark):
    df = spark.sql("SELECT named_struct('name', concat('p', id), 'age', id) AS person, array(id) AS xs FROM range(0, 40, 1, 1)")
    d = write(df, scratch(spark, "nested"), stripe_rows=10)
    assert [p for p, _ in d.leaves] == ["person.name", "person.age"]
    assert prune(d, "person.age = 25") == [2] and prune(d, "person.name = 'p7'") == [0]
    assert prune(d, "xs[0] = 1") == [0, 1, 2, 3]
    assert d.frame().where("person.age = 25").select("xs").first().xs == [25]


def test_statistics(ranges):
    s = ranges.column_stats(0, "val")
    assert (s["n"], s["nulls"], s["lo"], s["hi"], s["lo_exact"]) == (100, 0, 0, 99, True)
    f = ranges.column_stats(0, "f")
    assert f["nonfinite"] and not f["hi_exact"] and f["hi"] == 1.5
    assert ranges.column_stats(0, "n")["nulls"] == 100 and ranges.column_stats(0, "n")["lo"] is None
    with pytest.raises(FormatError):
        ranges.column_stats(3, "val")
    merged = {r.leaf: r for r in S.merged(ranges.stats(), ranges.fields).collect()}
    assert (merged["val"].lo, merged["val"].hi, merged["val"].hi_exact) == ("0", "5990", True)
    assert not merged["f"].hi_exact and merged["n"].nulls == 100


def test_long_texts_are_cut_safely(spark):
    texts = ["a" * 300 + "z", "b" * 300]
    d = write(spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1), scratch(spark, "long"))
    s = d.column_stats(0, "t")
    assert s["lo"] == "a" * 256 and not s["lo_exact"] and s["hi"] is None and not s["hi_exact"]
    for op in ("=", "<", "<=", ">", ">="):
        for t in [*texts, "b" * 256, "b" * 400]:
            p = f"t {op} '{t}'"
            assert scan(d, predicate=p).count() == d.frame().where(p).count()
    s = Session(spark)
    s.register("d", d.path)
    assert s.sql("SELECT max(t) AS m FROM d").first().m == texts[1] and s.last != {"*": "metadata"}


def test_metadata_answers(spark, ranges):
    s = Session(spark)
    s.register("r", ranges.path)
    q = "SELECT count(*) AS n, count(n) AS k, min(val) AS lo, max(label) AS hi FROM r"
    df = s.sql(q)
    assert s.last == {"*": "metadata"}
    assert tuple(df.first()) == tuple(s.spark.sql(q).first()) and df.schema == s.spark.sql(q).schema
    assert "/data" not in " ".join(x for r in C.filters(C.optimised(df)) for x in C.roots(r[0]))
    assert math.isnan(s.sql("SELECT max(f) AS m FROM r").first().m) and s.last != {"*": "metadata"}
    for q in ("SELECT count(*) AS n FROM r WHERE val > 3", "SELECT s, count(*) AS n FROM r GROUP BY s", "SELECT count(DISTINCT s) AS n FROM r", "SELECT sum(val) AS n FROM r"):
        s.sql(q)
        assert s.last != {"*": "metadata"}


def test_session(spark, ranges):
    s = Session(spark)
    s.register("a", ranges.path)
    s.register("b", ranges.path)
    with pytest.raises(FormatError):
        s.register("a", ranges.path)
    assert s.sql("SELECT count(*) AS n FROM a JOIN b ON a.val = b.val WHERE a.val > 5900 AND b.val < 5950").first().n == 4
    assert s.last["a"] == s.last["b"] == [2]
    assert s.sql("SELECT count(*) AS n FROM a WHERE val > (SELECT avg(val) FROM b)").first().n == 100
    assert s.sql("SELECT max(label) AS m FROM a WHERE val < 50").first().m == "row_9"
    assert s.sql("SELECT count(*) AS n, 1 AS one FROM a").first().n == 300  # the views are whole again
    assert s.explain_pruning("SELECT * FROM a WHERE val = 3")["a"] == [0]
    assert s.register_argument(f"t={ranges.path}").n_rows == 300
    with pytest.raises(FormatError):
        s.register_argument("=x")


def test_identifiers_keep_their_case(spark):
    path = scratch(spark, "case")
    s = Session(spark)
    write(s.spark.sql("SELECT 1 AS a, 2 AS A"), path)
    s.register("T", path)
    assert tuple(s.sql("SELECT A, a FROM T").first()) == (2, 1)


def test_reading(spark, ranges):
    assert [r.val for r in ranges.stripe(1, ["val"]).collect()] == list(range(500, 600))
    assert ranges.stripe(1, ["val"], limit=3).count() == 3
    assert [r.val for r in ranges.column("val").collect()][98:102] == [98, 99, 500, 501]
    assert [r.val for r in ranges.rows(95, 10).collect()] == [95, 96, 97, 98, 99, 500, 501, 502, 503, 504]
    assert ranges.stripes(1, 1).count() == 0 and ranges.stripes(0, 3, ["s", "val"]).columns == ["s", "val"]
    assert ranges.stripe_row_counts() == [100, 100, 100]
    for bad in (lambda: ranges.stripe(3), lambda: ranges.stripes(2, 1), lambda: ranges.stripes(0, 4), lambda: ranges.rows(295, 10), lambda: ranges.rows(-1, 2)):
        with pytest.raises(FormatError):
            bad()
    for bad in (lambda: ranges.column("x"), lambda: ranges.stripe(0, ["val", "val"])):
        with pytest.raises(SchemaError):
            bad()


def test_pruned_stripes_are_not_listed(ranges):
    plan = C.optimised(scan(ranges, ["val"], "val = 550"))
    (relation, _), = C.filters(plan)
    assert [p.rsplit("/", 1)[-1] for p in C.roots(relation)] == ["stripe_id=1"]


def test_empty_and_single_stripe(spark):
    d = write(spark.createDataFrame([], "a long, b string"), scratch(spark, "empty"), stripe_rows=5)
    assert (d.n_rows, d.n_stripes) == (0, 1) and d.frame().count() == 0 and d.verify()["rows"] == 0
    assert d.frame().schema.names == ["a", "b"] and d.stripe_row_counts() == [0]
    assert Dataset.open(spark, d.path).project_to(scratch(spark, "e2"), ["b"]).frame().count() == 0
    assert write(spark.range(7).toDF("x"), scratch(spark, "one")).n_stripes == 1
    s = Session(spark)
    s.register("e", d.path)
    assert s.sql("SELECT count(*) AS n, max(a) AS m FROM e").first() == (0, None)


def test_row_order_after_a_shuffle(spark):
    df = spark.range(1000).repartition(7).select(F.col("id").alias("x"))
    d = write(df, scratch(spark, "shuffled"), stripe_rows=64)
    rows = d.frame(positions=True).collect()
    assert sorted(r[POS] for r in rows) == list(range(1000)) and sorted(r.x for r in rows) == list(range(1000))
    assert all(r[STRIPE] == r[POS] // 64 for r in rows)
    o = write(df, scratch(spark, "ordered"), stripe_rows=64, order_by=["x"])
    assert all(r.x == r[POS] for r in o.frame(positions=True).collect())


def test_slices(spark, ranges):
    p = ranges.project_to(scratch(spark, "slice"), ["s", "val"])
    assert p.frame().columns == ["s", "val"] and p.n_stripes == 3 and p.verify()["columns"] == 2
    assert keep_mask(p, "val = 550") == keep_mask(ranges, "val = 550")
    assert p.column_stats(1, "val") == ranges.column_stats(1, "val")
    for bad in ([], ["val", "val"], ["nope"]):
        with pytest.raises(SchemaError):
            ranges.project_to(scratch(spark, "bad"), bad)


def test_verify_finds_changed_rows(spark):
    d = write(spark.range(100).select(F.col("id").alias("x"), F.lit("t").alias("y")).coalesce(1), scratch(spark, "v"), stripe_rows=50)
    assert d.verify() == {"columns": 2, "rows": 100, "stripes": 2}
    changed = d.frame([1], positions=True).withColumn("x", F.when(F.col("x") == 60, 61).otherwise(F.col("x"))).drop(STRIPE)
    rows = spark.createDataFrame(changed.collect(), changed.schema)
    rows.write.mode("overwrite").parquet(f"{d.path}/data/{STRIPE}=1")
    with pytest.raises(FormatError, match="stripe 1: x"):
        d.verify()
    rows.limit(10).write.mode("overwrite").parquet(f"{d.path}/data/{STRIPE}=1")
    with pytest.raises(FormatError, match="60 rows"):
        d.verify()


def test_heads_that_are_refused(spark):
    path = scratch(spark, "head")
    with pytest.raises(FormatError):
        Dataset.open(spark, path)
    write(spark.range(3).toDF("x"), path)
    files = Files(spark)
    good = files.read(f"{path}/_dataset.json")
    for bad in (b"{", good.replace(b'"version": 1', b'"version": 9', 1), good[:-1] + b', "required": ["new"]}'):
        files.write(f"{path}/_dataset.json", bad)
        with pytest.raises(FormatError):
            Dataset.open(spark, path)


def test_catalog_mode(spark):
    catalog, path = Catalog(spark, scratch(spark, "cat")), scratch(spark, "by-hash")
    write(spark.range(3).toDF("x"), path, catalog=catalog)
    with pytest.raises(FormatError):
        Dataset.open(spark, path)
    assert Dataset.open(spark, path, catalog).frame().count() == 3
    with pytest.raises(FormatError):
        Dataset.open(spark, path, Catalog(spark, scratch(spark, "other")))


def test_options(spark):
    d = write(spark.range(30).toDF("x").coalesce(1), scratch(spark, "plain"), stripe_rows=10, stats=False)
    assert d.stats() is None and prune(d, "x = 5") == [0, 1, 2] and d.verify()["rows"] == 30
    d = write(spark.range(30).toDF("x").coalesce(1), scratch(spark, "plain"), stripe_rows=10, filters=False)
    assert d.column_filter(0, "x") is None and prune(d, "x = 15") == [1]
    with pytest.raises(SchemaError):
        write(spark.range(3).toDF("stripe_id"), scratch(spark, "bad"))
    with pytest.raises(SchemaError):
        write(spark.range(3).toDF("x"), scratch(spark, "bad"), schema=Schema([Column("y", T.primitive("i64"))]))


def test_all_types_survive(spark):
    df = spark.sql("""SELECT * FROM VALUES
      (CAST(-128 AS TINYINT), CAST(32767 AS SMALLINT), 2147483647, -9223372036854775808L, CAST('NaN' AS FLOAT), CAST('-Infinity' AS DOUBLE), 'é🙂\n,"', X'00FF', DATE'1900-01-01', TIMESTAMP'2020-01-01 00:00:00.123456', TIMESTAMP_NTZ'2020-01-01 00:00:00', CAST('-12345678901234567890.123456' AS DECIMAL(38,6)), array(1, NULL), map('k', 1.5D), named_struct('a', 1, 'b', array('x'))),
      (NULL, NULL, NULL, NULL, NULL, -0.0D, '', X'', NULL, NULL, NULL, NULL, array(), map(), NULL)
      AS t(i8, i16, i32, i64, f32, f64, s, b, d, ts, ntz, dec, l, m, st)""").coalesce(1)
    d = write(df, scratch(spark, "types"))
    back = d.frame()
    assert [f.dataType.simpleString() for f in back.schema] == [f.dataType.simpleString() for f in df.schema]
    assert [repr(r) for r in d.stripe(0).collect()] == [repr(r) for r in df.collect()]
    assert isinstance(back.schema["ntz"].dataType, ST.TimestampNTZType)


def test_frame_shredding(spark):
    d = write(spark.sql("SELECT id, IF(id % 3 = 0, NULL, id * 10) AS v, array_repeat(id, CAST(id % 4 AS INT)) AS l, CAST(id * -1234567.89 AS DECIMAL(38,2)) AS x FROM range(0, 50, 1, 1)"), scratch(spark, "shred"), stripe_rows=20)
    df = d.frame(positions=True)
    flags, items = shred.compacted(df, "v", [STRIPE], POS)
    assert {r[POS]: r.v for r in shred.expanded(flags, items, [STRIPE], POS, "v").collect()} == {r[POS]: r.v for r in df.collect()}
    back = shred.lists_from(shred.items_of(df, "l", [STRIPE], POS), df, [STRIPE], POS, "l")
    assert {r[POS]: r.l for r in back.collect()} == {r[POS]: r.l for r in df.collect()}
    ends = {r[POS]: r.offset for r in shred.offsets(df, "l", [STRIPE], POS).collect()}
    assert ends[19] == sum(i % 4 for i in range(20)) and ends[20] == 0
    for r in shred.decimal_halves(df, "x").collect():
        assert (r.x_high << 64) + (r.x_low & (1 << 64) - 1) == int(r.x.scaleb(2))
    table, rows = shred.dictionary_encoded(df.withColumn("k", F.col("id") % 3), "k", [STRIPE], POS)
    assert {(r[STRIPE], r["index"]): r.value for r in table.collect() if r[STRIPE] == 1} == {(1, 0): 2, (1, 1): 0, (1, 2): 1}
    with pytest.raises(Exception, match="beyond the dictionary"):
        shred.dictionary_decoded(table.where("index > 0"), rows, [STRIPE], "k").collect()
    with pytest.raises(Exception, match="floats"):
        shred.dictionary_encoded(df.withColumn("k", F.lit(1.5)), "k", [STRIPE], POS)
