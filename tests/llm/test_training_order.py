from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import training_order as O
from quern.llm.common import new_path
from quern.llm.tokens import default_tokenizer, encoder


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 40))
def test_permutation_is_a_bijection(n, key):
    p = O.Permutation(n, key)
    slots = p.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (p.numbers(slots) == np.arange(n)).all()


def test_keys_give_other_orders():
    a, b = (O.Permutation(5000, k).slots(np.arange(5000)) for k in (1, 2))
    assert (a != b).mean() > 0.99
    assert abs(np.corrcoef(a, np.arange(5000))[0, 1]) < 0.05


def test_round_trip(spark, hard):
    df = spark.createDataFrame(hard.collect(), hard.schema).coalesce(1)  # in one order
    options = {"length": 16, "per_shard": 10, "rounds": 3}
    path = new_path(spark, "test-shards")
    order = O.materialise(df, path, **options)
    rows = order.collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == sorted(r.number for r in rows) == list(range(n)) and n > 30
    back = {r.slot: np.frombuffer(r.record, "<u2") for r in O.read_shards(spark, path, rows[0].stride, 10).collect()}
    assert sorted(back) == list(range(n))
    encode = encoder(default_tokenizer())
    end = encode.vocab_size - 1
    stream = np.concatenate([np.append(encode(r.text), end) for r in df.collect()])
    by_number = sorted(rows, key=lambda r: r.number)
    joined = np.concatenate([back[r.slot][:-1][: r.n_tokens] for r in by_number])
    assert (joined == stream).all()
    assert all(back[s][-1] == 0 for s in back)
    rest = O.read_shards(spark, path, rows[0].stride, 10, from_slot=25).collect()
    assert sorted(r.slot for r in rest) == list(range(25, n))
    for r in rows:
        assert (r.shard, r.byte_offset) == (r.slot // 10, r.slot % 10 * r.stride)
    assert all(r.intact for r in O.round_trip(df, **options).collect())


def test_documents_of_each_sequence(spark):
    df = spark.createDataFrame([(i, "word " * (3 * i)) for i in range(12)], "doc_id long, text string").coalesce(1)
    rows = sorted(O.round_trip(df, length=16, per_shard=4).collect(), key=lambda r: r.number)
    assert [d for r in rows for d in r.doc_ids] == sorted(d for r in rows for d in r.doc_ids)
    assert {d for r in rows for d in r.doc_ids} == set(range(12))


def test_empty_table(spark, none):
    assert O.round_trip(none).count() == 0


def test_one_sequence(hard):
    rows = O.round_trip(hard.where("doc_id = 9")).collect()
    assert len(rows) == 1 and rows[0].slot == 0 and rows[0].intact


def test_cut_shards_are_noticed(spark, hard):
    path = new_path(spark, "test-shards")
    stride = O.materialise(hard.coalesce(1), path, length=16, per_shard=10).first().stride
    with pytest.raises(Exception, match="whole records"):
        O.read_shards(spark, path, stride + 2, 10).count()
