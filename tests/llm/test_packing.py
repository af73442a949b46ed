from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import packing
from quern.llm.packing import Plan, cut
from quern.llm.tokens import default_tokenizer, encoder


def best_fit(lengths, capacity):
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        opened += gap == capacity
        if gap > n:
            bisect.insort(gaps, gap - n)
    return opened


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.data())
def test_plan_is_best_fit_decreasing(capacity, data):
    lengths = np.array(sorted(data.draw(st.lists(st.integers(1, capacity), min_size=1, max_size=200))))
    kinds, counts = np.unique(lengths, return_counts=True)
    plan = Plan(dict(zip(kinds.tolist(), counts.tolist(), strict=True)), capacity)
    seq, off = plan.place(lengths, np.arange(len(lengths)) - np.searchsorted(lengths, lengths))
    filled = defaultdict(int)
    for s, o, n in sorted(zip(seq.tolist(), off.tolist(), lengths.tolist(), strict=True)):
        assert filled[s] == o
        filled[s] += n
        assert filled[s] <= capacity
    assert len(filled) == plan.sequences == best_fit(lengths.tolist(), capacity)


def test_only_long_documents_are_cut():
    assert cut(1, 10) == [(0, 1)]
    assert cut(10, 10) == [(0, 10)]
    assert cut(25, 10) == [(0, 5), (5, 10), (15, 10)]


def test_fast_ids_are_the_reference_ids():
    e = encoder(default_tokenizer())
    for t in ["plain words, it's 2024!", "Été où ça", "tabs\tand\n\nlines  ", "日本語 🙂", "a\x1cb\x85c\xa0d", "<|endoftext|>", "  lead", "ſK" * 5, "x" * 5000]:
        assert e(t).tolist() == e.slow.encode(t, add_special_tokens=False).ids


def _checked(rows, capacity):
    filled = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert filled[r.sequence_id] == r.offset
        filled[r.sequence_id] += r.length
        assert filled[r.sequence_id] <= capacity
    return filled


def test_hard_rows(hard):
    rows = packing.pack(hard, 64).collect()
    _checked(rows, 64)
    encode = encoder(default_tokenizer())
    wanted = []
    for key, text in hard.select("doc_id", "text").collect():
        ids = np.append(encode(text), np.uint32(0)).astype("<u4")
        wanted += [(key, p, s, n, zlib.crc32(ids[s : s + n])) for p, (s, n) in enumerate(cut(len(ids), 64))]
    assert sorted(wanted, key=str) == sorted([tuple(r)[:5] for r in rows], key=str)


def test_empty_table(none):
    assert packing.pack(none).count() == 0


def test_sequences_are_near_the_least(spark, sf):
    rows = packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    filled = _checked(rows, 2048)
    assert len(filled) <= 1.03 * sum(filled.values()) / 2048 + 1


@pytest.mark.parametrize("capacity", [1, 2])
def test_tiny_capacity(hard, capacity):
    _checked(packing.pack(hard.where("doc_id in (1, 4, 9)"), capacity).collect(), capacity)
