"""Best-fit packing of documents into fixed-length training sequences.

Lengths are whole numbers of at most ``capacity``, so the range-sorted documents and gaps are kept run-length
encoded: a class for each length, with its documents numbered by rank. A bulk-synchronous step sweeps the gaps
from the successor of the length upwards, gives a run of ranks to a run of equal gaps at once (the rank settles
which document gets which gap), updates those gaps, and repeats for the next shorter class. That is exactly
best-fit decreasing over all rows, while rows themselves are only counted and later look their place up.

Executors tokenise, count each (task, length) class and look places up. The driver holds only counts: at most
``capacity`` classes whatever the input's size.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import columns_for, written
from quern.llm.tokens import default_tokenizer, encoder

END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the remainder first."""
    first = total % capacity or capacity
    return [(0, min(first, total))] + [(at, capacity) for at in range(first, total, capacity)]


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str) -> DataFrame:
    """One row per piece, without its ids: length, checksum, and its rank among its task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((key, piece, start, length, zlib.crc32(ids[start : start + length]), task, seen[length]))
                    seen[length] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank"])

    return docs.mapInArrow(run, PIECES)


class Plan:
    """Runs of ranks: ranks [rank, ...) of a length go to sequences ``first``, ``first + 1``, ... at ``offset``,
    ``each`` of them side by side in every sequence."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        runs: list[tuple[int, int, int, int, int]] = []
        sizes: list[int] = []  # sorted sizes of open gaps
        gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs of (first sequence, count)
        opened = 0

        def leave(size: int, first: int, count: int) -> None:
            if size and count:
                if size not in gaps:
                    bisect.insort(sizes, size)
                    gaps[size] = []
                gaps[size].append((first, count))

        for length in sorted(counts, reverse=True):
            rank, left = 0, counts[length]
            while left and (at := bisect.bisect_left(sizes, length)) < len(sizes):
                size = sizes[at]
                first, count = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], sizes[at]
                each = size // length
                used = min(count, -(-left // each))
                whole = min(left // each, used)
                if whole:
                    runs.append((length, rank, first, capacity - size, each))
                    leave(size - each * length, first, whole)
                rest = min(left - whole * each, (used - whole) * each)
                if rest:
                    runs.append((length, rank + whole * each, first + whole, capacity - size, each))
                    leave(size - rest * length, first + whole, 1)
                leave(size, first + used, count - used)
                rank, left = rank + whole * each + rest, left - whole * each - rest
            if left:
                each = capacity // length
                whole, rest = divmod(left, each)
                runs.append((length, rank, opened, 0, each))
                leave(capacity - each * length, opened, whole)
                if rest:
                    leave(capacity - rest * length, opened + whole, 1)
                opened += whole + bool(rest)
        self.sequences = opened
        order = sorted(runs)
        self.length, self.rank, self.first, self.offset, self.each = (np.array([r[i] for r in order], np.int64) for i in range(5))
        self.start = {int(k): (int(np.searchsorted(self.length, k)), int(np.searchsorted(self.length, k, "right"))) for k in np.unique(self.length)}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each (length, rank)."""
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for k in np.unique(length):
            lo, hi = self.start[int(k)]
            mine = length == k
            at = lo + np.searchsorted(self.rank[lo:hi], rank[mine], "right") - 1
            nth = rank[mine] - self.rank[at]
            sequence[mine] = self.first[at] + nth // self.each[at]
            offset[mine] = self.offset[at] + nth % self.each[at] * k
        return sequence, offset


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and place there.

    A null or empty text is one end token. Documents over ``capacity`` tokens are cut, the shorter piece first; no
    other is. Repeated rows and null keys are packed like any other row; other columns are not looked at. An empty
    table gives no rows. Equal lengths are told apart by rank (task, then order in the task), so ties have one result
    for a given split of the input.
    """
    pieces = written(token_pieces(columns_for(docs, k=key, t=text), capacity, tokenizer or default_tokenizer()), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    classes = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = Plan(classes, capacity)
    base = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    ranked = pieces.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, off = plan.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
