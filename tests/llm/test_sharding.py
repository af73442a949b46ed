from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import sharding as S


def test_law_and_slots(hard, none):
    rows = S.assign(hard).collect()
    assert len(rows) == hard.count() and S.assign(none).count() == 0
    texts = [(r.doc_id, (r.text or "").encode()) for r in hard.collect()]
    assert Counter((k, len(b) + 1, zlib.crc32(b)) for k, b in texts) == Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1 == len({r.shard for r in rows if r.doc_id is None})


def test_growth_moves_rows_into_the_new_shard_only(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = S.assign(df).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {8}
    assert abs(len(moved) / len(rows) - 1 / 9) < 0.01
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) < 1.08 * 20_000 / 8
    again = {r.doc_id: (r.shard, r.slot) for r in S.assign(df).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_weights(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    counts = Counter(r.shard for r in S.assign(df, weights=(1.0, 2.0, 3.0)).collect())
    for shard, weight in enumerate((1, 2, 3)):
        assert abs(counts[shard] / 30_000 - weight / 6) < 0.015
    before = {r.doc_id: r.shard for r in S.assign(df, weights=(1.0, 2.0, 3.0)).collect()}
    after = {r.doc_id: r.shard for r in S.assign(df, weights=(1.0, 2.0, 4.0)).collect()}
    assert {after[k] for k in before if before[k] != after[k]} == {2}
    with pytest.raises(ValueError):
        S.assign(df, weights=(1.0, 0.0))


def test_a_repeated_key_has_distinct_slots(spark):
    df = spark.range(5000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    rows = S.assign(df, weights=(1.0, 1.0)).collect()
    for shard in (0, 1):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_no_python_in_the_plan(hard):
    plan = S.assign(hard)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
