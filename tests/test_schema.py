from __future__ import annotations

import datetime as dt
import decimal as d

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern import types as T
from quern.catalog import Catalog
from quern.errors import FormatError, SchemaError
from quern.operators.shred import checked_offsets, compose, decompose
from quern.picker import candidates, optimise, pick
from quern.schema import Column, Schema, canonical_json
from quern.storage import Files, scratch

leaf = st.sampled_from([T.UTF8, T.BINARY, T.date(), T.decimal(38, 6), T.datetime("ms"), *(T.primitive(p) for p in (*T.INTS, *T.FLOATS))])
names = st.lists(st.sampled_from("abcdef"), min_size=1, max_size=3, unique=True)


def grow(t):
    return st.one_of(t.map(T.nullable), t.map(T.list_of), t.map(lambda x: T.map_of(T.UTF8, x)), st.tuples(names, t).map(lambda p: T.struct(**dict.fromkeys(*p))), st.tuples(names, t).map(lambda p: T.union(**dict.fromkeys(*p))))


trees = st.recursive(leaf, grow, max_leaves=5)


def values(t):
    k = t.kind
    if k == "primitive":
        p = t.arg("type")
        if p in T.FLOATS:
            return st.floats(width=int(p[1:]), allow_nan=False)
        return st.integers(np.iinfo(f"{'u' if p[0] == 'u' else ''}int{p[1:]}").min, np.iinfo(f"{'u' if p[0] == 'u' else ''}int{p[1:]}").max)
    simple = {"utf8": st.text(max_size=5), "binary": st.binary(max_size=5), "date": st.dates(), "decimal": st.decimals(-(10**20), 10**20, places=6), "datetime": st.datetimes(dt.datetime(1900, 1, 1), dt.datetime(2100, 1, 1)).map(lambda x: x.replace(microsecond=x.microsecond // 1000 * 1000))}
    if k in simple:
        return simple[k]
    if k == "nullable":
        return st.none() | values(t.inner)
    if k == "list":
        return st.lists(values(t.inner), max_size=3)
    if k == "map":
        return st.dictionaries(st.text(max_size=3), values(t.part("value")), max_size=3)
    if k == "struct":
        return st.fixed_dictionaries({n: values(p) for n, p in t.parts})
    return st.one_of(*(st.tuples(st.just(n), values(p)) for n, p in t.parts))


@settings(max_examples=200, deadline=None)
@given(trees.flatmap(lambda t: st.tuples(st.just(t), st.lists(values(t), max_size=6))))
def test_shredding_round_trip(pair):
    t, rows = pair
    leaves = decompose(t, rows)
    assert len(leaves) == len(t.leaves())
    assert compose(t, leaves) == rows
    assert T.LogicalType.from_json(t.to_json()) == t
    schema = Schema([Column("c", t)]).validate()
    assert Schema.from_json(schema.to_json()).hash() == schema.hash()
    assert Schema.from_spark(schema.to_spark()).column("c").type == t
    for (role, physical), stages, x in zip(t.leaves(), schema.column("c").encodings, leaves, strict=True):
        line = schema.pipelines()[("c", role)]
        assert line.output_type == "bytes" and line.input_type == physical and stages
        y = line.decode(line.encode(x))
        assert bytes(y) == bytes(x) if physical == "bytes" else y.tobytes() == x.tobytes()


def test_leaf_order():
    t = T.struct(a=T.nullable(T.UTF8), b=T.map_of(T.UTF8, T.list_of(T.primitive("f32"))), u=T.union(x=T.primitive("i64"), y=T.BINARY), d=T.dictionary(T.UTF8), n=T.decimal(10, 2))
    assert [r for r, _ in t.leaves()] == ["a.present", "a.item.offsets", "a.item.data", "b.offsets", "b.key.offsets", "b.key.data", "b.value.offsets", "b.value.item.values", "u.tag", "u.v_x.values", "u.v_y.offsets", "u.v_y.data", "d.offsets", "d.data", "d.indices", "n.high", "n.low"]


def test_dictionary_is_in_order_of_appearance():
    leaves = decompose(T.dictionary(T.UTF8), ["cat", "dog", "cat", "fish", "dog"])
    assert compose(T.UTF8, leaves[:2]) == ["cat", "dog", "fish"] and leaves[2].tolist() == [0, 1, 0, 2, 1]


@pytest.mark.parametrize(
    "bad",
    [
        Schema([]),
        Schema([Column("a", T.UTF8), Column("a", T.UTF8)]),
        Schema([Column("", T.UTF8)]),
        Schema([Column("a", T.UTF8, [[T.Stage("zstd")]])]),
        Schema([Column("a", T.map_of(T.list_of(T.UTF8), T.UTF8))]),
        Schema([Column("a", T.LogicalType("union"))]),
        Schema([Column("a", T.union(**{f"v{i}": T.UTF8 for i in range(256)}))]),
        Schema([Column("a", T.decimal(39, 0))]),
        Schema([Column("a", T.decimal(5, 6))]),
        Schema([Column("a", T.datetime("min"))]),
        Schema([Column("a", T.primitive("i128"), [[T.Stage("zstd")]])]),
    ],
)
def test_schemas_that_are_refused(bad):
    with pytest.raises(SchemaError):
        bad.validate()


def test_depth_is_bounded():
    t = T.UTF8
    for _ in range(T.MAX_DEPTH):
        t = T.list_of(t)
    Schema([Column("a", t)]).validate()
    with pytest.raises(SchemaError):
        Schema([Column("a", T.list_of(t))]).validate()


def test_projection_and_json():
    s = Schema([Column("a", T.UTF8), Column("b", T.primitive("i64"))])
    assert s.project(["b", "a"]).names == ["b", "a"]
    for names_ in ([], ["a", "a"], ["c"]):
        with pytest.raises(SchemaError):
            s.project(names_)
    with pytest.raises(SchemaError):
        Schema.from_json({"version": 2, "columns": []})
    assert canonical_json({"b": "é", "a": [1, None]}) == '{"a":[1,null],"b":"é"}'.encode()


@pytest.mark.parametrize("offsets", [[], [1, 2], [0, 2, 1], [0, 1]])
def test_malformed_offsets(offsets):
    with pytest.raises(FormatError):
        checked_offsets(np.array(offsets, np.uint32), 2)


def test_malformed_leaves():
    for t, leaves in (
        (T.nullable(T.primitive("i64")), [np.array([1, 1], np.uint8), np.array([5])]),
        (T.dictionary(T.primitive("i64")), [np.array([5]), np.array([1], np.uint32)]),
        (T.union(a=T.primitive("i64")), [np.array([1], np.uint8), np.array([5])]),
        (T.union(a=T.primitive("i64")), [np.array([0, 0], np.uint8), np.array([5])]),
        (T.struct(a=T.primitive("i64"), b=T.primitive("i64")), [np.array([5]), np.array([5, 6])]),
        (T.primitive("i64"), [np.array([5]), np.array([5])]),
    ):
        with pytest.raises(FormatError):
            compose(t, leaves)


def test_decimals_and_times():
    assert [x.tolist() for x in decompose(T.decimal(38, 2), [d.Decimal("-0.01"), d.Decimal("184467440737095516.16")])] == [[-1, 1], [-1, 0]]
    assert decompose(T.datetime("ns"), [dt.datetime(1970, 1, 1, 0, 0, 1, 5)])[0].tolist() == [1_000_005_000]
    assert decompose(T.datetime("s"), [dt.datetime(1969, 12, 31, 23, 59, 59)])[0].tolist() == [-1]


def test_catalog(spark):
    c = Catalog(spark, scratch(spark, "catalog"))
    s = Schema([Column("a", T.UTF8)])
    key = c.add(s)
    assert c.add(s) == key and c.list() == [key] and c.resolve(key).hash() == key and c.verify() == {}
    assert c.lookup("0" * 64) is None
    with pytest.raises(FormatError):
        c.resolve("0" * 64)
    Files(spark).write(f"{c.path}/{'1' * 64}.json", s.canonical())
    assert list(c.verify()) == ["1" * 64]


def test_picker():
    x = np.arange(5000)
    best, size = pick("i64", "values", x)
    assert size == min(len(T_line(c, x)) for c in candidates("i64", "values") if T_line(c, x) is not None) and best
    s = Schema([Column("k", T.UTF8), Column("f", T.primitive("f64"))])
    rows = {"k": ["north", "south", "east", "west", "centre"] * 400, "f": [0.5, 1.5] * 1000}
    made, sizes = optimise(s, rows)
    assert made.column("f").type.kind == "primitive" and sizes["k"] > 0
    again, _ = optimise(s, rows)
    assert made.to_json() == again.to_json()


def T_line(stages, x):
    from quern.coders import Pipeline
    from quern.errors import QuernError

    try:
        return Pipeline.build("i64", stages).encode(x)
    except QuernError:
        return None
