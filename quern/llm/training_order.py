"""Training-order materialisation of token sequences into fixed-stride binary shards.

Documents' tokens, an end token after each, run on through a task's documents and are cut into sequences of
``length``. Sequences are numbered 0..N-1; a keyed Feistel network over the least even-bit domain that holds N,
walked in cycles until it lands under N, gives each its global slot. It is a bijection: no shuffle table exists, and
slot and number are found from each other anywhere.

Shard s holds slots s * per_shard and on, each record ``stride`` bytes: the ids, little-endian, and a zero id. So a
reader seeks to (slot % per_shard) * stride and goes on from there. Spark's own text writer writes the files: the
zero id is its line separator, so any Hadoop file system and the commit protocol for lost executors are served.

Tokens are written once as a table and dealt to their shards in ``rounds`` ranges of slots, each of which frees its
shuffle files at its end, to bound scratch space.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import columns_for, discard, new_path, written
from quern.llm.tokens import default_tokenizer, encoder

LENGTH, PER_SHARD, ROUNDS, KEY = 2048, 4096, 4, 0x5EED
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Permutation:
    """A keyed bijection of 0..n-1, computed on arrays."""

    def __init__(self, n: int, key: int, steps: int = 6) -> None:
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [np.uint64(zlib.crc32(f"{key}:{i}".encode()) << 32 | zlib.crc32(f"{i}/{key}".encode())) for i in range(steps)]

    def _round(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x ^ k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _walk(self, x: np.ndarray, once) -> np.ndarray:
        out = once(np.asarray(x).astype(np.uint64))
        while (over := out >= np.uint64(self.n)).any():
            out[over] = once(out[over])
        return out.astype(np.int64)

    def slots(self, numbers) -> np.ndarray:
        def once(x: np.ndarray) -> np.ndarray:
            h = np.uint64(self.half)
            left, right = x >> h, x & np.uint64((1 << self.half) - 1)
            for k in self.keys:
                left, right = right, left ^ self._round(right, k)
            return left << h | right

        return self._walk(numbers, once)

    def numbers(self, slots) -> np.ndarray:
        def once(x: np.ndarray) -> np.ndarray:
            h = np.uint64(self.half)
            left, right = x >> h, x & np.uint64((1 << self.half) - 1)
            for k in reversed(self.keys):
                left, right = right ^ self._round(left, k), left
            return left << h | right

        return self._walk(slots, once)


CUT = "task int, local_no long, n_tokens int, doc_ids array<long>, ids_crc32 long, ids binary"


def sequences(docs: DataFrame, length: int, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """Token sequences of each task in reading order; the last one of a task is filled up with end ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        kind = id_type(encode.vocab_size)
        end = encode.vocab_size - 1 if end_id is None else end_id
        rest, owners = np.empty(0, kind), []  # what is left over, and (document, tokens) in it
        rows: list[tuple] = []

        def emit(ids: np.ndarray, n: int, keys: list) -> None:
            nonlocal number
            body = ids.tobytes()
            rows.append((task, number, n, keys, zlib.crc32(body), body))
            number += 1

        def full() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in CUT.split(", ")])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(end)).astype(kind)
                rest = np.concatenate((rest, ids))
                owners.append([key, len(ids)])
                at = 0
                while len(rest) - at >= length:
                    keys, need = [], length
                    while need:
                        keys.append(owners[0][0])
                        took = min(need, owners[0][1])
                        owners[0][1] -= took
                        need -= took
                        if not owners[0][1]:
                            owners.pop(0)
                    emit(rest[at : at + length], length, keys)
                    at += length
                rest = rest[at:]
                if len(rows) >= 1000:
                    yield full()
        if len(rest):
            emit(np.concatenate((rest, np.full(length - len(rest), end, kind))), len(rest), [k for k, _ in owners])
        yield full()

    return docs.mapInArrow(run, CUT)


def id_type(vocab_size: int) -> str:
    return "<u2" if vocab_size <= 1 << 16 else "<u4"


def materialise(docs: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, rounds: int = ROUNDS, seed: int = KEY, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards under ``path`` and returns one row per sequence: number, slot, shard, byte_offset, stride,
    n_tokens, doc_ids, ids_crc32.

    Null and empty texts are one end token; repeated rows and null keys are tokens like any others; other columns are
    not looked at; an empty table writes no shard and gives no rows. The order of documents before the permutation is
    that of reading. A sequence's slot depends on its number, the count of all and ``seed`` alone.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    stride = (length + 1) * int(id_type(encoder(tokenizer).vocab_size)[-1])
    table = written(sequences(columns_for(docs, k=key, t=text), length, tokenizer), "tokens")
    # One number per task, as many as Spark's scheduler itself keeps.
    counts = {r.task: r.n for r in table.groupBy("task").agg(F.count("*").alias("n")).collect()}
    size = np.array([counts.get(t, 0) for t in range(max(counts, default=-1) + 1)], np.int64)
    first, total = np.cumsum(size) - size, int(size.sum())
    permute = Permutation(total, seed)

    def placed(lo: int, hi: int):
        """Rows whose slot is from ``lo`` up to ``hi``, with number and slot."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number = first[batch.column("task").to_numpy()] + batch.column("local_no").to_numpy()
                slot = permute.slots(number)
                out = batch.drop_columns(["task", "local_no"]).append_column("number", pa.array(number)).append_column("slot", pa.array(slot))
                yield out if hi - lo == total else out.filter(pa.array((slot >= lo) & (slot < hi)))

        return run

    meta = table.drop("ids").mapInArrow(placed(0, total), "n_tokens int, doc_ids array<long>, ids_crc32 long, number long, slot long")
    shards = -(-total // per_shard)
    before = spark.conf.get(_CLEAN, None)
    separator = "\0" * (stride // (length + 1))
    for r in range(rounds):
        lo, hi = shards * r // rounds, shards * (r + 1) // rounds
        if lo == hi:
            continue
        ids = table.select("task", "local_no", "ids").mapInArrow(placed(lo * per_shard, min(hi * per_shard, total)), "ids binary, number long, slot long")
        mine = ids.select((F.floor(F.col("slot") / per_shard) - lo).cast("int").alias("shard"), "slot", "ids")
        dealt = mine.repartitionById(hi - lo, F.col("shard")).sortWithinPartitions("slot")
        spark.conf.set(_CLEAN, "true")
        try:
            dealt.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", separator).text(f"{path}/first={lo}")
        finally:
            spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = written(meta.select("number", "slot", F.floor(F.col("slot") / per_shard).cast("int").alias("shard"), (F.col("slot") % per_shard * stride).alias("byte_offset"), F.lit(stride).alias("stride"), "n_tokens", "doc_ids", "ids_crc32"), "order")
    discard(table)
    return out


def read_shards(spark: SparkSession, path: str, stride: int, per_shard: int = PER_SHARD, from_slot: int = 0) -> DataFrame:
    """(slot, ids) of the records from ``from_slot`` on. A shard is a file of at most per_shard * stride bytes, and
    one task's row; shards before ``from_slot`` aren't opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    number = F.regexp_extract("path", r"first=(\d+)", 1).cast("long") + F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    kept = files.select("path", "length", "content", number.alias("shard")).where((F.col("shard") + 1) * per_shard > from_slot)
    kept = kept.where(F.col("length") > 0).select("shard", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body, first = content.as_buffer(), shard * per_shard
                if body.size % stride:
                    raise ValueError(f"shard {shard}: {body.size} bytes are no whole records of {stride}")
                view = memoryview(body)
                for at in range(max(0, from_slot - first), body.size // stride, 256):
                    end = min(at + 256, body.size // stride)
                    yield pa.RecordBatch.from_arrays([pa.array(range(first + at, first + end), pa.int64()), pa.array([bytes(view[i * stride : (i + 1) * stride]) for i in range(at, end)], pa.binary())], names=["slot", "record"])

    return kept.mapInArrow(run, "slot long, record binary")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Materialises the documents, reads the shards back, and returns ``materialise``'s rows with ``read_crc32`` and
    ``intact`` from the bytes read at each slot."""
    spark = docs.sparkSession
    path = new_path(spark, "shards")
    order = materialise(docs, path, **options)
    head = order.select("stride").first()
    if head is None:
        return order.withColumns({"read_crc32": F.col("ids_crc32"), "intact": F.lit(True)})
    per_shard = options.get("per_shard", PER_SHARD)
    width = head.stride // (options.get("length", LENGTH) + 1)
    back = read_shards(spark, path, head.stride, per_shard).select("slot", F.crc32(F.expr(f"substring(record, 1, {head.stride - width})")).alias("read_crc32"), (F.expr(f"substring(record, {head.stride - width + 1})") == F.lit(b"\0" * width)).alias("ended"))
    return order.join(back, "slot", "left").withColumn("intact", F.coalesce((F.col("read_crc32") == F.col("ids_crc32")) & F.col("ended"), F.lit(False))).drop("ended")
