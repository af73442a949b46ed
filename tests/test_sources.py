from __future__ import annotations

import datetime as dt
import decimal
import json

import pytest
from pyspark.sql import functions as F

from quern import sinks, sources
from quern import types as T
from quern.cli import main
from quern.convert import convert, direction
from quern.dataset import Dataset
from quern.errors import ConversionError, FormatError, QuernError, SchemaError
from quern.schema import Column, Schema
from quern.sources import avro
from quern.storage import Files, scratch


@pytest.fixture
def put(spark):
    def write(text, ext):
        path = f"{scratch(spark, 'in')}.{ext}"
        Files(spark).write(path, text.encode() if isinstance(text, str) else text)
        return path

    return write


def kinds(schema):
    def one(t):
        return f"{one(t.inner)}?" if t.kind == "nullable" else t.arg("type") or (f"[{one(t.inner)}]" if t.kind == "list" else "|".join(n for n, _ in t.parts) if t.kind == "union" else "{" + ",".join(f"{n}:{one(p)}" for n, p in t.parts) + "}" if t.kind == "struct" else t.kind)

    return {c.name: one(c.type) for c in schema.columns}


def test_csv_ladder(spark, put):
    p = put('i,f,s,n,z,b\n1,1.5,x,1,NA,true\n-2,2,1x,NULL,,false\n+3,1e3,"a ""q"", b",null,NULL,true\n', "csv")
    schema = sources.infer(spark, p)
    assert kinds(schema) == {"i": "i64", "f": "f64", "s": "utf8", "n": "i64?", "z": "utf8?", "b": "utf8"}
    rows = sources.read(spark, p).collect()
    assert [(r.i, r.f, r.s, r.n, r.z) for r in rows] == [(1, 1.5, "x", 1, None), (-2, 2.0, "1x", None, None), (3, 1000.0, 'a "q", b', None, None)]


def test_csv_edges(spark, put):
    p = put("1;2\n3;4\n", "csv")
    assert kinds(sources.infer(spark, p, header=False, delimiter=";")) == {"col_0": "i64", "col_1": "i64"}
    ragged = put("a,b\n1,x\n2\n", "csv")
    assert kinds(sources.infer(spark, ragged)) == {"a": "i64", "b": "utf8?"}
    late = put("a\n" + "1\n" * 1200 + "NULL\n", "csv")
    assert kinds(sources.infer(spark, late)) == {"a": "i64?"}  # nullability is the whole file's
    broken = put("a\n" + "1\n" * 1200 + "x\n", "csv")
    assert kinds(sources.infer(spark, broken)) == {"a": "i64"} and kinds(sources.infer(spark, broken, full_scan=True)) == {"a": "utf8"}
    with pytest.raises(Exception, match="column 'a'"):
        sources.read(spark, broken).collect()
    blank = put("a,b\n1,2\n\n3,4\n", "csv")
    assert sources.read(spark, blank).count() == 2
    assert kinds(sources.infer(spark, blank, blank_lines_null=True)) == {"a": "i64?", "b": "i64?"}
    assert kinds(sources.infer(spark, put("a,b\n99999999999999999999,1_0\n", "csv"))) == {"a": "f64", "b": "utf8"}
    with pytest.raises(FormatError):
        sources.infer(spark, put("", "csv"))


def test_csv_typed_cells(spark, put):
    p = put("d,t,n,x,b,m\n2020-01-02,2020-01-02T03:04:05.123Z,2020-01-02T03:04:05.123456789Z,1.50,00ff,\"[1, 2]\"\n1,1000,7,2,,[]\n", "csv")
    schema = Schema([Column("d", T.date()), Column("t", T.datetime("ms")), Column("n", T.datetime("ns")), Column("x", T.decimal(10, 2)), Column("b", T.nullable(T.BINARY)), Column("m", T.list_of(T.primitive("i64"))), Column("gone", T.UTF8)])
    a, b = sources.read(spark, p, schema=schema).collect()
    assert (a.d, a.t, a.x, bytes(a.b), a.m, a.gone) == (dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3, 4, 5, 123000), decimal.Decimal("1.50"), b"\x00\xff", [1, 2], "")
    assert a.n == 1577934245123456789 and (b.d, b.t, b.n, b.b) == (dt.date(1970, 1, 2), dt.datetime(1970, 1, 1, 0, 0, 1), 7, None)


def test_json_kinds(spark, put):
    lines = [{"a": True, "b": 1, "c": 1, "d": None, "e": {"x": 1}, "f": [1, None], "u": 1}, {"a": False, "b": 2.5, "c": True, "e": {"y": "q"}, "f": [], "u": "t", "w": 1}, {"a": True, "b": 3, "c": 0, "d": None, "e": {"x": 2, "y": "r"}, "f": [2], "u": [1], "w": "x"}]
    for text, ext in (("\n".join(map(json.dumps, lines)) + "\n\n", "ndjson"), (json.dumps(lines, indent=1), "json")):
        p = put(text, ext)
        assert kinds(sources.infer(spark, p)) == {"a": "u8", "b": "f64", "c": "i64", "d": "utf8?", "e": "{x:i64?,y:utf8?}", "f": "[i64?]", "u": "int|string|array", "w": "int|string?"}
        rows = sources.read(spark, p).collect()
        assert [(r.a, r.b, r.c, r.d) for r in rows] == [(1, 1.0, 1, None), (0, 2.5, 1, None), (1, 3.0, 0, None)]
        assert [r.u._tag for r in rows] == [0, 1, 2] and rows[0].u.int == 1 and rows[1].u.string == "t" and rows[2].u.array == [1]
        assert [r.f for r in rows] == [[1, None], [], [2]] and rows[1].e.x is None and rows[0].w is None and rows[2].w.string == "x"
    four = put('{"a": 1}\n{"a": "x"}\n{"a": []}\n{"a": {}}\n', "ndjson")
    assert kinds(sources.infer(spark, four)) == {"a": "utf8"}
    assert [r.a for r in sources.read(spark, four).collect()] == ["1", "x", "[]", "{}"]


def test_json_errors(spark, put):
    for text in ("[1, 2]", '"x"', "{", "[]"):
        with pytest.raises(Exception):  # noqa: B017
            sources.read(spark, put(text, "json")).collect()
    late = put("\n".join(['{"a": 1}'] * 1001 + ['{"a": null}']), "ndjson")
    with pytest.raises(Exception, match="column 'a'"):
        sources.read(spark, late).collect()
    schema = Schema([Column("h", T.BINARY), Column("m", T.map_of(T.UTF8, T.primitive("f64")))])
    assert sources.read(spark, put('{"h": "00ff", "m": {"k": 1}}', "ndjson"), schema=schema).first() == (bytearray(b"\x00\xff"), {"k": 1.0})


def test_parquet_keeps_empty_texts(spark):
    path = scratch(spark, "p") + ".parquet"
    spark.createDataFrame([("",), (None,)], "s string").coalesce(1).write.parquet(path)
    assert [r.s for r in sources.read(spark, path).collect()] == ["", None]


RECORD = {
    "type": "record",
    "name": "r",
    "namespace": "n.s",
    "fields": [
        {"name": "i", "type": "int"},
        {"name": "s", "type": ["null", "string"]},
        {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A", "B"]}},
        {"name": "f", "type": {"type": "fixed", "name": "F", "size": 2}},
        {"name": "again", "type": "F"},
        {"name": "d", "type": {"type": "int", "logicalType": "date"}},
        {"name": "t", "type": {"type": "long", "logicalType": "timestamp-millis"}},
        {"name": "x", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}},
        {"name": "u", "type": ["null", "long", "string"]},
        {"name": "l", "type": {"type": "array", "items": "double"}},
        {"name": "m", "type": {"type": "map", "values": "boolean"}},
    ],
}


def test_avro_schema(spark, put):
    schema = sources.infer(spark, put(json.dumps(RECORD), "avsc"))
    assert kinds(schema) == {"i": "i32", "s": "utf8?", "e": "utf8", "f": "binary", "again": "binary", "d": "date", "t": "datetime", "x": "decimal", "u": "long|string?", "l": "[f64]", "m": "map"}
    with pytest.raises(FormatError):
        sources.read(spark, put(json.dumps(RECORD), "avsc"))
    for bad in ({"type": "record", "name": "R", "fields": [{"name": "r", "type": ["null", "R"]}]}, {"type": "error", "name": "x"}, "int", {"type": "record", "name": "R", "fields": [{"name": "a", "type": [["int"], "null"]}]}):
        with pytest.raises(SchemaError):
            avro.to_schema(bad)


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro_round_trip(spark, codec):
    df = spark.sql("""SELECT * FROM VALUES
      (1, 'é', X'00ff', DATE'1969-12-31', TIMESTAMP'2020-01-01 00:00:00.001', CAST('-1.05' AS DECIMAL(20,2)), array(1.5D, NULL), map('k', 1L), named_struct('a', 1, 'b', CAST(NULL AS STRING)), CAST('NaN' AS FLOAT), 9223372036854775807L, CAST(7 AS TINYINT)),
      (NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL) AS t(i, s, b, d, t, x, l, m, st, f, g, y)""").coalesce(1)
    path = scratch(spark, "avro")
    avro.write(df, path, Schema.from_spark(df.schema), codec=codec)
    back = sources.read(spark, path, "avro")
    assert [repr(r) for r in back.collect()] == [repr(r) for r in df.withColumn("y", F.col("y").cast("int")).collect()]


def test_avro_unions_and_damage(spark):
    schema = Schema([Column("u", T.nullable(T.union(a=T.primitive("i64"), b=T.UTF8)))])
    df = spark.sql("SELECT IF(id = 2, NULL, named_struct('_tag', CAST(id AS SMALLINT), 'a', IF(id = 0, 5L, NULL), 'b', IF(id = 1, 'q', NULL))) AS u FROM range(0, 3, 1, 1)")
    path = scratch(spark, "avro")
    avro.write(df, path, schema)
    assert [None if r.u is None else (r.u._tag, (r.u[1] or r.u[2]).value) for r in sources.read(spark, path, "avro").collect()] == [(0, 5), (1, "q"), None]
    name = next(n for n in Files(spark).names(path) if n.startswith("part"))
    data = bytearray(Files(spark).read(f"{path}/{name}"))
    assert sum(1 for _ in avro.records(bytes(data))) == 3
    data[-3] ^= 1
    with pytest.raises(QuernError):
        list(avro.records(bytes(data)))
    with pytest.raises(FormatError):
        list(avro.records(b"nope"))


def test_csv_sink(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b', named_struct('c', 'x,y')) AS s, array(1, NULL) AS l, X'00FF' AS b, CAST(NULL AS STRING) AS n, '' AS e")
    path = scratch(spark, "csv")
    sinks.to_csv(df, path)
    assert [r.value for r in spark.read.text(path).collect()] == ["s.a,s.b.c,l,b,n,e", '1,"x,y","[1,null]",00ff,,""']
    with pytest.raises(ConversionError):
        sinks.to_csv(df, path, strict=True)


def test_ndjson_sink(spark):
    df = spark.sql("SELECT CAST('NaN' AS DOUBLE) AS d, CAST('Infinity' AS FLOAT) AS f, X'00FF' AS b, map(1, X'0A') AS m, CAST(NULL AS INT) AS n, named_struct('_tag', CAST(1 AS SMALLINT), 'a', CAST(NULL AS INT), 'b', 'q') AS u")
    path = scratch(spark, "json")
    sinks.to_ndjson(df, path)
    assert json.loads(spark.read.text(path).first().value) == {"d": None, "f": None, "b": "00ff", "m": {"1": "0a"}, "n": None, "u": {"b": "q"}}


def test_directions():
    assert direction("a.csv", "b") == ("csv", "quern") and direction("a", "b.avro") == ("quern", "avro") and direction("x", "y", "json") == ("json", "quern")
    for bad in (("a.csv", "b.json"), ("a", "b"), ("a", "b.avsc")):
        with pytest.raises(FormatError):
            direction(*bad)


def test_conversion(spark, put):
    p = put("k,v\n" + "".join(f"{i},{i * 1.5}\n" for i in range(25)), "csv")
    target = scratch(spark, "made")
    assert convert(spark, p, target, stripe_rows=10) == 25
    d = Dataset.open(spark, target)
    assert d.n_stripes == 3 and kinds(d.schema) == {"k": "i64", "v": "f64"}
    for ext in ("csv", "ndjson", "parquet", "avro"):
        out = f"{scratch(spark, 'out')}.{ext}"
        assert convert(spark, target, out) == 25
        assert sorted(tuple(r) for r in sources.read(spark, out).collect()) == [(i, i * 1.5) for i in range(25)]
    assert convert(spark, p, target, schema=Schema([Column("k", T.UTF8), Column("v", T.decimal(9, 1))])) == 25
    assert Dataset.open(spark, target).stripe(0).first() == ("0", decimal.Decimal("0.0"))
    empty = put("a,b\n", "csv")
    assert convert(spark, empty, target, stripe_rows=5) == 0 and Dataset.open(spark, target).n_stripes == 1


def test_command_line(spark, put, capsys):
    def run(*argv):
        code = main(list(argv), spark)
        got = capsys.readouterr()
        return code, got.out.strip(), got.err.strip()

    p = put("k,v\n" + "".join(f"{i},t{i % 3}\n" for i in range(30)), "csv")
    made, cat = scratch(spark, "cli"), scratch(spark, "cat")
    assert run("convert", p, "-o", made, "--stripe-rows", "10") == (0, "30 rows", "")
    assert run("verify", made) == (0, "OK: 2 column(s) × 30 rows (3 stripes)", "")
    code, out, _ = run("sql", "SELECT v, count(*) AS n FROM t WHERE k < 12 GROUP BY v ORDER BY v", f"t={made}")
    assert code == 0 and out.splitlines()[3] == "| t0 | 4 |"
    for bad in (["sql", "SELECT 1", "nothing"], ["convert", p, "-o", "x.csv"], ["slice", made, "-o", "x", "--columns", "nope"], ["verify", "/no/such"], ["compare", p, "--codecs", "nope"]):
        code, out, err = run(*bad)
        assert code == 1 and err.startswith("error: ")
    assert json.loads(run("infer-schema", p)[1])["columns"][0]["name"] == "k"
    best = scratch(spark, "s") + ".json"
    assert run("optimize-schema", p, "-o", best)[0] == 0
    assert run("convert", p, "-o", made, "--schema", best, "--catalog", cat)[0] == 0
    assert run("verify", made)[0] == 1 and run("verify", made, "--catalog", cat)[0] == 0
    assert len(run("catalog", "list", cat)[1]) == 64 and run("catalog", "verify", cat)[1] == "OK: 1 schemas"
    assert run("slice", made, "-o", scratch(spark, "sl"), "--columns", "v", "--catalog", cat)[1] == "1 columns × 30 rows"
    stats = json.loads(run("stats", made, "--json", "--catalog", cat)[1])
    assert stats["rows"] == 30 and stats["leaves"][0]["min"] == "0" and stats["leaves"][0]["max"] == "29"
    assert "leaves" not in json.loads(run("stats", made, "--json", "--no-values", "--catalog", cat)[1])
    assert run("stats", made, "--catalog", cat)[1].startswith(made)
    assert "| zstd |" in run("compare", p)[1] and "| schema |" in run("compare", p)[1]
    assert run("convert", made, "-o", scratch(spark, "o") + ".ndjson", "--catalog", cat) == (0, "30 rows", "")


def test_python_surface(spark):
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from quern import api

    path = scratch(spark, "api")
    table = pa.table({"a": list(range(100)), "s": ["x", None] * 50, "l": [[1, 2]] * 100})
    assert api.write_table(spark, path, table, stripe_rows=30).n_stripes == 4
    assert api.read_table(spark, path, ["s", "a"], (1, 2)).toArrow().column("a").to_pylist() == list(range(30, 60))
    with pytest.raises(FormatError):
        api.read_table(spark, path, stripe_range=(0, 9))
    with pytest.raises(FormatError):
        api.read_arrays(spark, path)
    api.write_table(spark, path, pd.DataFrame({"k": [1.5, 2.5]}), optimize=False)
    assert api.read_arrays(spark, path)["k"].tolist() == [1.5, 2.5]
    assert api.write_table(spark, path, table.slice(0, 0)).n_rows == 0
    arrays = {"u8": np.array([1, 255], np.uint8), "u64": np.array([0, 2**64 - 1], np.uint64), "f": np.array([0.5, np.nan]), "s": ["a", "b"], "b": [b"\x00", b""]}
    api.write_arrays(spark, path, arrays)
    back = api.read_arrays(spark, path)
    assert back["u8"].tolist() == [1, 255] and [int(x) for x in back["u64"]] == [0, 2**64 - 1] and back["s"] == ["a", "b"] and list(map(bytes, back["b"])) == [b"\x00", b""]
    assert api.decompress(api.compress(np.arange(9))).tolist() == list(range(9))


def test_parquet_types_of_the_footer(spark):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = scratch(spark, "pq").removeprefix("file://") + ".parquet"
    import os

    os.makedirs(os.path.dirname(path), exist_ok=True)
    fields = [pa.field("a", pa.uint8(), nullable=False), pa.field("b", pa.uint64()), pa.field("c", pa.timestamp("ns")), pa.field("d", pa.list_(pa.int32())), pa.field("e", pa.struct([("x", pa.string())])), pa.field("f", pa.float32())]
    pq.write_table(pa.table([pa.array([1, 255], pa.uint8()), pa.array([0, 2**64 - 1], pa.uint64()), pa.array(np.array([1, 1_700_000_000_123_456_789], "datetime64[ns]")), [[1], None], [{"x": "q"}, None], pa.array([0.5, None], pa.float32())], schema=pa.schema(fields)), path)
    schema = sources.infer(spark, path)
    assert kinds(schema) == {"a": "u8", "b": "u64?", "c": "datetime?", "d": "[i32?]?", "e": "{x:utf8?}?", "f": "f32?"}
    rows = sources.read(spark, path).collect()
    assert rows[1].a == 255 and rows[1].b == 2**64 - 1 and rows[1].c == 1_700_000_000_123_456_789 and rows[0].e.x == "q"
    assert convert(spark, path, scratch(spark, "made")) == 2
