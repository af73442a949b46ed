from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from quern.coders import PRESETS, Coder, Pipeline, Registry, compress, compress_with, decompress, decompress_bare, default_registry
from quern.coders.base import DTYPES
from quern.errors import CoderError, CorruptedError, FormatError, ParameterError, PipelineError, UnknownCoderError
from quern.types import FLOATS, INTS, Stage


def stages(*ids):
    return [Stage(i) if isinstance(i, str) else Stage(*i) for i in ids]


INT_LINES = [("delta",), ("delta_of_delta",), ("deltamin",), ("rle",), ("leb128",), ("delta", "leb128", "zstd"), ("rle", "leb128", "lz4"), ("delta", "rle", "leb128", "snappy"), ("for_bitpack_zstd",)]


@pytest.mark.parametrize("t", INTS)
@settings(max_examples=40, deadline=None)
@given(data=st.data())
def test_integers_round_trip(t, data):
    x = data.draw(hnp.arrays(DTYPES[t], st.integers(0, 200)))
    for line in INT_LINES:
        p = Pipeline.build(t, stages(*line))
        y = p.decode(p.encode(x))
        assert y.dtype == x.dtype and (y == x).all(), line
    if not len(x) or x.min() >= 0:
        for line in (("bitpack_auto",), (("bitpack_fixed", {"width": DTYPES[t].itemsize * 8}), "zstd")):
            p = Pipeline.build(t, stages(*line))
            assert (p.decode(p.encode(x)) == x).all()
    assert (decompress(compress(x)) == x).all()


@pytest.mark.parametrize("t", FLOATS)
@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_floats_round_trip_bit_for_bit(t, data):
    x = data.draw(hnp.arrays(DTYPES[t], st.integers(0, 200), elements=st.floats(width=int(t[1:]))))
    for line in (("gorilla",), ("gorilla", "zstd"), ("for_bitpack_zstd",)):
        p = Pipeline.build(t, stages(*line))
        assert p.decode(p.encode(x)).tobytes() == x.tobytes()
    assert decompress(compress(x)).tobytes() == x.tobytes()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=120))
def test_elias_fano(values):
    x = np.array(sorted(values), np.uint64)
    p = Pipeline.build("u64", stages("elias_fano"))
    assert (p.decode(p.encode(x)) == x).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_bytes(data):
    for c in ("zstd", "lz4", "snappy"):
        assert decompress(compress_with(data, stages(c))) == data
    assert decompress(compress(data)) == data


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=80), st.sampled_from(["leb128", "bitpack_auto", "gorilla", "elias_fano", "zstd", "lz4", "snappy", "for_bitpack_zstd"]))
def test_rubbish_is_an_error_and_nothing_else(data, coder):
    kind = {"gorilla": "f64", "zstd": "bytes", "lz4": "bytes", "snappy": "bytes"}.get(coder, "u32")
    try:
        Pipeline.build(kind, stages(coder)).decode(data)
    except CoderError:
        pass
    try:
        decompress(b"QRN1" + data)
    except (FormatError, CoderError, PipelineError):
        pass


def test_wrapping():
    x = np.array([-(2**63), 2**63 - 1, 0, -1], np.int64)
    p = Pipeline.build("i64", stages("delta"))
    assert p.encode(x).tolist() == [-(2**63), -1, -(2**63) + 1, -1]
    assert (p.decode(p.encode(x)) == x).all()


def test_known_outputs():
    assert Pipeline.build("i32", stages("rle")).encode([5, 5, 5, 7]).tolist() == [5, 3, 7, 1]
    assert Pipeline.build("i8", stages("rle")).encode(np.full(300, 4, np.int8)).tolist() == [4, 127, 4, 127, 4, 46]
    assert Pipeline.build("i64", stages("deltamin")).encode([10, 12, 11]).tolist() == [10, 0, 2, 1]
    assert Pipeline.build("i64", stages("leb128")).encode([0, -1, 1, 300]) == bytes([0, 1, 2, 0xD8, 4])
    assert Pipeline.build("u8", stages("bitpack_auto")).encode([1, 2, 3]) == bytes([2]) + (3).to_bytes(8, "little") + bytes([0b111001])


def test_rules():
    with pytest.raises(PipelineError):
        Pipeline.build("i64", stages("bitpack_auto", "leb128"))
    with pytest.raises(PipelineError):
        Pipeline.build("i64", stages("deltamin", "delta"))  # a block before one that isn't
    with pytest.raises(PipelineError):
        Pipeline.build("f64", stages("delta"))
    with pytest.raises(UnknownCoderError):
        Pipeline.build("i64", stages("no_such"))
    with pytest.raises(ParameterError):
        Pipeline.build("i64", stages(("bitpack_fixed", {"width": 65})))
    with pytest.raises(ParameterError):
        Pipeline.build("bytes", stages(("zstd", {"level": 99})))
    with pytest.raises(CoderError):
        Pipeline.build("i64", stages("bitpack_auto")).encode([-1])
    with pytest.raises(CoderError):
        Pipeline.build("u32", stages("elias_fano")).encode([2, 2])
    with pytest.raises(PipelineError):
        Pipeline.build("i64", stages("delta")).encode(np.zeros(3, np.int32))
    with pytest.raises(CorruptedError):
        Pipeline.build("i64", stages("rle")).decode(np.array([1, 0]))
    with pytest.raises(CorruptedError):
        Pipeline.build("u8", stages("leb128")).decode(bytes([0xFF, 3]))
    with pytest.raises(FormatError):
        compress_with(np.arange(3), stages("delta"))
    assert Pipeline.build("u32", stages("elias_fano")).random_access
    assert not Pipeline.build("u32", stages("leb128")).random_access


def test_presets_and_bare():
    x = np.arange(10_000) * 30 + 1_700_000_000
    assert x.nbytes / len(compress(x, "timestamps_uniform")) > 20
    assert len(compress(np.round(np.sin(np.arange(1000)), 1), "gauges")) < 8000
    for name, (t, ids) in PRESETS.items():
        y = np.arange(50).astype(DTYPES[t or "i64"])
        assert (decompress(compress(y, name)) == y).all()
        assert (decompress_bare(compress_with(y, stages(*ids), bare=True), stages(*ids), t or "i64") == y).all()


def test_own_coder():
    r = Registry({i: default_registry()._factories[i] for i in default_registry().ids})
    r.register("flip", lambda params, t: Coder("flip", "bytes", "bytes", True, lambda b: bytes(x ^ 255 for x in b), lambda b: bytes(x ^ 255 for x in b)))
    data = compress_with(b"abc", stages("flip"), registry=r)
    assert decompress(data, r) == b"abc"
    with pytest.raises(UnknownCoderError):
        decompress(data)
