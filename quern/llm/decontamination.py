"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may differ from a stretch of a document in k = rate * n words (inserted, dropped or changed),
whatever its length. Cut into k + 1 pieces, at least one piece of it then stands unchanged in the document. All pieces go into one Aho-Corasick
automaton; around each exact hit Myers' bit-parallel search settles the distance.

The item set is fixed and small against the corpus, but its size is checked: its distinct rows are dealt by hash into
blocks of about ``block_bytes``, each a pass over all documents. Documents are scanned where they lie; nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import columns_for, rows_mapped
from quern.llm.text import search, words

HITS = "doc_id long, item_id long, distance long, n_words long, first_word long, end_word long, n_hits long"


def budget(n_words: int, rate: float) -> int:
    """Errors allowed: ``rate`` of the words, rounded down."""
    return int(rate * n_words + 1e-9)


def pieces(n_words: int, k: int) -> list[tuple[int, int]]:
    return [(i * n_words // (k + 1), (i + 1) * n_words // (k + 1)) for i in range(k + 1)]


class Matcher:
    """Finds the items of one block in a text."""

    def __init__(self, items: list[tuple], rate: float) -> None:
        import ahocorasick

        ids: dict[tuple[bytes, ...], list] = {}
        for key, text in items:
            if w := tuple(words(text)):
                ids.setdefault(w, []).append(key)
        self.items = [(w, keys, budget(len(w), rate)) for w, keys in ids.items()]
        parts: dict[str, list[tuple[int, int]]] = {}
        for i, (w, _, k) in enumerate(self.items):
            for lo, hi in pieces(len(w), k):
                parts.setdefault(_joined(w[lo:hi]), []).append((i, lo))
        self.automaton = ahocorasick.Automaton()
        for part, owners in parts.items():
            self.automaton.add_word(part, (len(part), owners))
        if parts:
            self.automaton.make_automaton()
        self.empty = not parts

    def __call__(self, text: str | None) -> Iterator[tuple]:
        """(item, distance, words of the item, first word, end word, exact piece hits) for each item found, at its
        best place, the first of equal ones."""
        w = words(text)
        if not w or self.empty:
            return
        joined = _joined(w)
        places: dict[int, list[int]] = {}
        starts: list[int] = []
        for end, (size, owners) in self.automaton.iter(joined):
            if not starts:
                at = 0
                for x in joined.split(" ")[1:-1]:
                    starts.append(at)
                    at += len(x) + 1
            word = bisect_left(starts, end - size + 1)
            for i, lo in owners:
                places.setdefault(i, []).append(word - lo)
        for i, found in places.items():
            item, keys, k = self.items[i]
            n, best = len(item), None
            found.sort()
            at = 0
            while at < len(found):  # one search for each run of overlapping windows
                lo, hi = found[at] - k, found[at] + n + k
                while at + 1 < len(found) and found[at + 1] - k <= hi:
                    at += 1
                    hi = found[at] + n + k
                at += 1
                lo = max(lo, 0)
                d, first, end = search(item, w[lo:hi])
                if d <= k and (best is None or d < best[0]):
                    best = d, lo + first, lo + end
            if best:
                for key in keys:
                    yield key, best[0], n, best[1], best[2], len(found)


def _joined(w) -> str:
    return f" {b' '.join(w).decode('utf-8', 'replace')} "


def find_items(docs: DataFrame, items: DataFrame, rate: float = 0.15, block_bytes: int = 4 << 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document, item) where the item stands in the document within its error budget.

    Words are compared lower-cased and without punctuation. Null and empty texts hold nothing and null or wordless
    items are nowhere. One law holds for items of all lengths: those with too few words for an error are found exactly,
    anywhere, be it a single word. Items of equal words are each reported; repeated rows of ``items`` count once.
    Repeated documents and null keys are reported like any others, an empty table on either side gives no rows, and
    other columns are not looked at.
    """
    source = columns_for(docs, k=key, t=text)
    names = [x.split()[0] for x in HITS.split(", ")]

    def one(held: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = Matcher(held, rate)
            for batch in batches:
                rows = [(doc, *hit) for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in match(t.as_py())]
                cols = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        return source.mapInArrow(run, HITS)

    return reduce(DataFrame.unionByName, map(one, _blocks(items, block_bytes, item_key, item_text)))


def without_items(docs: DataFrame, items: DataFrame, rate: float = 0.15, block_bytes: int = 4 << 20, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns; see ``find_items``."""
    at = docs.columns.index(text)
    for held in _blocks(items, block_bytes, item_key, item_text):

        def run(batches: Iterator[pa.RecordBatch], held: list[tuple] = held) -> Iterator[pa.RecordBatch]:
            match = Matcher(held, rate)
            for batch in batches:
                yield batch.filter(pa.array([next(match(t.as_py()), None) is None for t in batch.column(at)], pa.bool_()))

        docs = rows_mapped(docs, run)
    return docs


def _blocks(items: DataFrame, block_bytes: int, key: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_bytes``, collected one at a time; one empty block if there are none."""
    tests = columns_for(items, k=key, t=text).distinct()
    size = tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    numbered = tests.withColumn("b", F.pmod(F.xxhash64("k", "t"), F.lit(blocks)))
    for block in range(blocks):
        yield [tuple(r) for r in numbered.where(F.col("b") == block).select("k", "t").collect()]
