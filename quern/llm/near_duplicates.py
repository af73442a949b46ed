"""Near-duplicates by order MinHash, verified by banded alignment.

A text's k-mers are its stretches of five words, each labelled with how often it stood before. One order MinHash
takes the two k-mers of least hash and keeps them in the order of the text, so that it agrees for texts with small
edit distance and not merely with a common bag of k-mers. Every function is a band of its own.

Work stays in proportion to the input whatever the groups' sizes:

1. Every text gets a row number, a digest, its sketches and its word hashes, written once; no later table holds them
   for all texts again. Exact copies meet by digest; one of each stands for them.
2. Each band's bucket is aggregated to its least member, the pivot, and every other member is paired with that
   alone: a bucket of n gives n - 1 pairs, never n * n. Pairs of all bands are made distinct, those too unlike in
   length go before texts join, and those whose edit similarity over words reaches the threshold are links.
3. Links are contracted to classes by alternating large-star and small-star steps, each written to the shared
   folder.
4. Buckets that still hold several classes, and texts too short for sketches, are searched whole. Members of large
   buckets and short texts meet by rare pairs of neighbouring words, since similar texts share one of the rarest ones
   that their edits can't all break; members of other buckets meet there. They meet in blocks of bounded size; pairs
   of one class, and those whose lengths or bags of words are too far apart, end there. Of what is left, the nearest
   pairs of two classes are verified first, and others only while their classes stay apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import columns_for, discard, plain_names, written
from quern.llm.text import banded_distance, words

SHINGLE, FUNCTIONS, MINIMA, SIMILARITY, SHORT = 5, 80, 2, 0.8, 100
BINS, WIDE, KEYS, BROADCAST_ROWS = 256, 4096, 2048, 1_000_000
#: Larger buckets of several classes are searched by rare pairs.
LARGE = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        v = self[w] = xxhash.xxh64_intdigest(w)
        return v


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labelled_kmers(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-mers in text order, each with its occurrence number; a shorter text is one k-mer."""
    n = max(1, len(hashes) - size + 1)
    x = np.zeros(n, np.uint64)
    for i in range(min(size, len(hashes))):
        x = _mixed(x + hashes[i : i + n] + _MIX)
    order = np.argsort(x, kind="stable")
    s = x[order]
    run = np.r_[True, s[1:] != s[:-1]]
    if not run.all():
        first = np.maximum.accumulate(np.where(run, np.arange(n), 0))
        label = np.empty(n, np.uint64)
        label[order] = (np.arange(n) - first).astype(np.uint64)
        x = np.where(label > 0, _mixed(x + label * _MIX), x)  # a first occurrence keeps its hash
    return x


def sketches(hashes: np.ndarray, functions: int = FUNCTIONS, minima: int = MINIMA) -> np.ndarray:
    """One value per function: its ``minima`` least labelled k-mers, in text order."""
    x = labelled_kmers(hashes)
    order = (x >> np.uint64(32)).astype(np.uint32)  # orders need no more bits, and these multiply faster
    seeds = _mixed(np.arange(1, functions + 1, dtype=np.uint64) * _MIX)
    masks, n, out = seeds.astype(np.uint32), len(x), np.empty(functions, np.uint64)
    odd, step = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1), max(1, 65_536 // n)
    for at in range(0, functions, step):
        v = (order[None, :] ^ masks[at : at + step, None]) * odd[at : at + step, None]
        rows, places = np.arange(len(v)), []
        for _ in range(min(minima, n)):
            places.append(v.argmin(1))
            v[rows, places[-1]] = np.uint32(0xFFFFFFFF)
        h = seeds[at : at + step].copy()
        for p in np.sort(np.stack(places), 0):
            h = _mixed(h * _MIX + x[p])
        out[at : at + step] = h
    return out.view(np.int64)


def similarity(a, b, least: float = SIMILARITY) -> float:
    """Edit similarity over words, 1 - distance / longer length, or 0 where it is under ``least``."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    limit = int((1 - least) * longer + 1e-9)
    d = banded_distance(a, b, limit)
    return 1 - d / longer if d <= limit else 0.0


def _common_words(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((np.sort(a), np.sort(b)))
    u, inverse = np.unique(both, return_inverse=True)
    return int(np.minimum(np.bincount(inverse[: len(a)], minlength=len(u)), np.bincount(inverse[len(a) :], minlength=len(u))).sum())


def bag(hashes: np.ndarray, bins: int = BINS) -> bytes:
    """Counts of words per bin, cut at 255, which brings bags nearer and never apart."""
    return np.minimum(np.bincount((hashes % np.uint64(bins)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def outline(hashes: np.ndarray) -> bytes:
    """What candidates are compared by: up to ``KEYS`` words the sorted 16-bit ends of their hashes, else a wide bag."""
    return np.sort(hashes.astype("<u2")).tobytes() if len(hashes) <= KEYS else bag(hashes, WIDE)


def bag_of(shape: bytes, size: int, bins: int) -> np.ndarray:
    """The bag of ``bins`` bins of a text's outline."""
    if size <= KEYS:
        return np.minimum(np.bincount(np.frombuffer(shape, "<u2") % bins, minlength=bins), 255).astype(np.int16)
    return np.minimum(np.frombuffer(shape, np.uint8).reshape(-1, bins).sum(0, dtype=np.int64), 255).astype(np.int16)


def _apart(shapes: list[bytes], sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Twice the least edits between each pair of outlines by the words that the longer has alone; ``j`` ascends and are
    the longer ones."""
    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    heads = np.flatnonzero(np.r_[True, j[1:] != j[:-1]])
    used = {int(k): np.unique(np.frombuffer(shapes[k], "<u2"), return_counts=True) for k in np.unique(np.r_[i, j]) if sizes[k] <= KEYS}
    wide: dict[int, np.ndarray] = {}
    dense = np.zeros(1 << 16, np.int64)
    for lo, hi in zip(heads, np.r_[heads[1:], len(j)], strict=True):
        k, others = int(j[lo]), i[lo:hi].tolist()
        if k in used:  # and so are all that are shorter
            keys, n = used[k]
            dense[keys] = n
            ends = np.cumsum([0, *(len(used[x][0]) for x in others)])[:-1]
            common = np.minimum(dense[np.concatenate([used[x][0] for x in others])], np.concatenate([used[x][1] for x in others]))
            out[lo:hi] = 2 * (sizes[k] - np.add.reduceat(common, ends))
            dense[keys] = 0
        else:
            for x in (k, *others):
                if x not in wide:
                    wide[x] = bag_of(shapes[x], int(sizes[x]), WIDE)
            out[lo:hi] = [np.abs(wide[x] - wide[k]).sum() + sizes[k] - sizes[x] for x in others]
    return out


def within_reach(roots: np.ndarray, sizes: np.ndarray, bags: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of different classes whose lengths and bags allow a similarity of ``least``, and
    twice the edits that their bags make sure of; ``sizes`` ascend."""
    none = np.zeros(0, np.int64)
    first, second, apart = [none], [none], [none]
    for j in range(1, len(sizes)):
        lo = int(np.searchsorted(sizes, least * sizes[j] - 1e-9))
        i = lo + np.flatnonzero(roots[lo:j] != roots[j])
        if len(i):
            gap = np.abs(bags[i] - bags[j]).sum(1) + (sizes[j] - sizes[i])  # twice the words that the longer has alone
            near = gap <= 2 * int((1 - least) * sizes[j] + 1e-9)
            first.append(i[near])
            second.append(np.full(int(near.sum()), j))
            apart.append(gap[near])
    return np.concatenate(first), np.concatenate(second), np.concatenate(apart)


def word_pairs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words, the first word's with the text's begin; as many as words."""
    w = hashes.astype(np.uint64)
    return _mixed(np.r_[np.uint64(1 << 40), w[:-1]] * _MIX + w)


@lru_cache(maxsize=1 << 16)
def _edits(n: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each length from n to the longest that a text of n words can be similar to: the edits that are allowed, and
    those of them that can break two of its word pairs (the others insert a word, which breaks one)."""
    longer = np.arange(n, int(n / least + 1e-9) + 1)
    allowed = ((1 - least) * longer + 1e-9).astype(np.int64)
    keep = allowed >= longer - n
    return allowed[keep], (allowed - (longer - n))[keep]


def rare_pairs(hashes: np.ndarray, spread: np.ndarray, least: float) -> np.ndarray:
    """Of a text's distinct word pairs those that stand first in an order of all pairs, rare ones first; as few as make
    sure that texts of a similarity of ``least`` share one.

    Of two texts that share none of them, the one whose last stands first in the order has pairs that the other lacks
    altogether, so that edits break each of their places. An edit breaks one place or, but for an insertion, two
    neighbouring ones. As many pairs are taken as the allowed edits can't break, whatever the other's length.
    """
    n = len(hashes)
    pairs = word_pairs(hashes)
    distinct, kind, times = np.unique(pairs, return_inverse=True, return_counts=True)
    order = np.lexsort((distinct, spread[(distinct % np.uint64(len(spread))).astype(np.int64)]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rank, places = rank[kind], np.cumsum(times[order])
    allowed, double = _edits(n, least)

    def enough(k: int) -> bool:
        taken = np.flatnonzero(rank < k)
        runs = np.diff(np.r_[0, np.flatnonzero(np.diff(taken) > 1) + 1, len(taken)])
        return len(taken) > int((allowed + np.minimum(double, int((runs // 2).sum()))).max())

    lo, hi = int(np.searchsorted(places, allowed.max(), "right")) + 1, len(order)  # all are enough
    while lo < hi:
        mid = min((lo + hi) // 2, lo + 4)
        lo, hi = (lo, mid) if enough(mid) else (mid + 1, hi)
    return _mixed(distinct[order[:lo]]).view(np.int64)


SIGNED = "row_no long, doc_id long, d1 long, d2 long, size int, sketch array<long>, words binary"


def signed(docs: DataFrame, functions: int) -> DataFrame:
    """A row number unique in the table, the digest, the number of words, the sketches and the word hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, at = _Hashes(), TaskContext.get().partitionId() << 36
        for batch in batches:
            rows: list[tuple] = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                digest = np.frombuffer(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest(), "<i8")
                ws = words(text)
                h = np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))
                rows.append((at, key, digest[0], digest[1], len(ws), sketches(h, functions) if ws else [], h.astype("<u4").tobytes()))
                at += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [*[pa.int64()] * 4, pa.int32(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SIGNED.split(", ")])

    return docs.mapInArrow(run, SIGNED)


def _semi(df: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """The rows of ``df`` whose node is in ``ids``, which are broadcast up to ``BROADCAST_ROWS`` of 8 bytes."""
    return df.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, "node", "left_semi")


def _shared(entries: DataFrame) -> DataFrame:
    """(bucket, pivot, node) of the buckets of two and more; the pivot is a bucket's least member. The pivots are
    written apart from their join, whose large buckets AQE can then split."""
    pivots = written(entries.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n"), "pivots")
    shared = written(entries.join(pivots.hint("merge"), "bucket").select("bucket", "pivot", "node"), "shared")
    discard(pivots)
    return shared


def _linear(shared: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's least member."""
    return shared.where("node > pivot").select("pivot", "node").distinct()


def _alike_in_length(pairs: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """The pairs (pivot, node) whose lengths allow a similarity of ``least``: no other has its words looked up."""
    both = pairs.join(sizes, "node").join(sizes.select(F.col("node").alias("pivot"), F.col("size").alias("other")), "pivot")
    return both.where(F.least("size", "other") >= least * F.greatest("size", "other") - 1e-9).select("pivot", "node")


def _mixed_rows(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, n, node) of the buckets whose n members besides the pivot, whose pairs are tried, are of several classes."""
    shared = shared.where("node > pivot")
    rooted = shared.join(roots, "node", "left").select("bucket", F.coalesce("root", "node").alias("root"))
    mixed = written(rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where("a < b").select("bucket", "n"), "mixed")
    rows = written(shared.join(mixed, "bucket").select("bucket", "n", "node"), "mixed")
    discard(mixed)
    return rows


def _pair_spread(some: DataFrame, bins: int = 1 << 18) -> np.ndarray:
    """How many texts hold a word pair of each of ``bins`` bins of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total[np.unique(word_pairs(np.frombuffer(value.as_buffer(), "<u4")) % np.uint64(bins)).astype(np.int64)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bin", "n"])

    counts = some.select("words").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # at most ``bins`` rows
    out = np.zeros(bins, np.int64)
    out[counts["bin"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out


def _by_rare_pairs(some: DataFrame, least: float) -> DataFrame:
    """(place, node, root, size) of the rare word pairs of ``some`` (node, root, words); see ``rare_pairs``."""
    spread = _pair_spread(some)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rare_pairs(np.frombuffer(v.as_buffer(), "<u4"), spread, least) for v in batch.column(2)]
            of = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), *(pa.array(batch.column(i).to_numpy()[of]) for i in (0, 1, 3))], names=["place", "node", "root", "size"])

    return some.select("node", "root", "words", "size").mapInArrow(rare, "place long, node long, root long, size int")


def _candidates(pairs_of: DataFrame, buckets_of: DataFrame, some: DataFrame, least: float, block: int = 1024) -> DataFrame:
    """(a, b, gap): the pairs of ``some`` (node, root, size, words) of different classes that share a place and can be
    similar by their lengths and bags. Rare pairs' places are (place, node, root, size), of any
    number of texts, buckets' (place, node, root), of at most ``LARGE``, which are compared as they are. A place of two
    texts whose lengths are too far apart is left out.

    A place's texts of its most frequent class are one side, all others the other; both are cut into blocks of some
    ``block`` texts and each pair of blocks is compared in memory, so that a place of many texts is many tasks' work.
    """

    def pairs(columns: list[np.ndarray]) -> pa.RecordBatch:
        groups, nodes, roots, sizes, shapes = columns
        heads = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]).any(1)])
        a, b, gap = [], [], []
        for lo, hi in zip(heads, np.r_[heads[1:], len(groups)], strict=True):
            own, size = shapes[lo:hi].tolist(), sizes[lo:hi].astype(np.int64)
            i, j, _ = within_reach(roots[lo:hi], size, np.stack([bag_of(x, n, BINS) for x, n in zip(own, size, strict=True)]), least)
            d = _apart(own, size, i, j)
            near = d <= 2 * ((1 - least) * size[j] + 1e-9).astype(np.int64)
            i, j, d = i[near], j[near], d[near]
            a.append(nodes[lo:hi][i])
            b.append(nodes[lo:hi][j])
            gap.append(d)
        x, y, d = np.concatenate(a), np.concatenate(b), np.concatenate(gap)
        both, first = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(d[first].astype(np.int64))], names=["a", "b", "gap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not len(batch):
                continue
            new = [np.stack([batch.column(i).to_numpy() for i in range(2)], 1), *(batch.column(i).to_numpy() for i in range(2, 5))]
            new.append(np.array(batch.column(5).to_pylist(), object))
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            whole = int(np.flatnonzero(np.r_[True, (held[0][1:] != held[0][:-1]).any(1)])[-1])  # the last group may go on
            if whole:
                yield pairs([x[:whole] for x in held])
                held = [x[whole:].copy() for x in held]
        if held:
            yield pairs(held)

    def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [outline(np.frombuffer(v.as_buffer(), "<u4")) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shapes, pa.binary())], names=["node", "size", "shape"])

    places = written(pairs_of, "places")
    held = places.groupBy("place").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    held = written(held.where((F.col("a") < F.col("b")) & ((F.col("n") > 2) | (F.col("lo") >= least * F.col("hi") - 1e-9))).select("place"), "held")
    rows = written(places.join(held, "place").select("place", "node", "root"), "rows")
    discard(places, held)
    by_root = rows.groupBy("place", "root").agg(F.count("*").alias("n"))
    groups = by_root.groupBy("place").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"))
    cut = lambda n: F.ceil(n / block).cast("int")
    groups = written(groups.select("place", F.col("most.root").alias("main"), cut(F.col("most.n")).alias("t_main"), cut(F.col("n") - F.col("most.n")).alias("t_rest")), "groups")
    placed = rows.join(groups, "place")
    salt = F.xxhash64("node")
    main, rest = F.pmod(salt, F.col("t_main")).cast("int"), F.pmod(salt, F.col("t_rest")).cast("int")
    number = lambda kind, x, y: F.lit(kind) * (1 << 60) + x.cast("long") * (1 << 30) + y
    every = lambda t, of: F.transform(F.sequence(F.lit(0), F.col(t) - 1), of)
    across = F.when(F.col("root") == F.col("main"), every("t_rest", lambda j: number(1, main, j))).otherwise(every("t_main", lambda j: number(1, j, rest)))
    inside = F.when((F.col("root") != F.col("main")) & (F.col("t_rest") > 1), every("t_rest", lambda j: number(0, F.least(rest, j), F.greatest(rest, j)))).otherwise(F.array().cast("array<bigint>"))
    dealt = placed.select("place", "node", "root", F.explode(F.concat(across, inside)).alias("part"))
    dealt = dealt.unionByName(buckets_of.select("place", "node", "root", F.lit(-1).cast("long").alias("part")))
    dealt = dealt.join(some.select("node", "size", "words").mapInArrow(outlined, "node long, size int, shape binary"), "node")
    found = dealt.select("place", "part", "node", "root", "size", "shape").repartition("place", "part").sortWithinPartitions("place", "part", "size").mapInArrow(run, "a long, b long, gap long")
    out = written(found.groupBy("a", "b").agg(F.min("gap").alias("gap")), "candidates")
    discard(rows, groups)
    return out


def _verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame | None:
    """(pivot, node, similarity) of the pairs, 0 where it is under ``least``; written. None if there are no pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), "<u4") for v in (a, b))
                longer = max(len(x), len(y))
                ok = bool(min(len(x), len(y)) >= least * longer and _common_words(x, y) >= least * longer - 1e-9)
                out.append(similarity(x.tolist(), y.tolist(), least) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["pivot", "node", "similarity"])

    pairs = written(pairs, "pairs")
    if not (rows := pairs.count()):
        return None
    of = lambda side: _semi(nodes.select("node", "words"), pairs.select(F.col(side).alias("node")).distinct(), rows)
    a, b = of("pivot").select(F.col("node").alias("pivot"), F.col("words").alias("a")), of("node").select("node", F.col("words").alias("b"))
    both = pairs.join(b, "node").join(a, "pivot").select("pivot", "node", "a", "b")
    out = written(both.mapInArrow(run, "pivot long, node long, similarity double"), "tried")
    discard(pairs)
    return out


def components(links: DataFrame, tag: str = "stars") -> DataFrame:
    """(node, root) of every node that has links (pivot, node): root is the least node it is connected with.

    Large-star and small-star steps. A step's minima are written apart from their join, whose hot nodes AQE can then
    split (or which broadcasts them while they are few)."""
    edges = written(links.select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct(), tag)
    while True:
        # Stars are what is wanted: no node with two neighbours, or with a neighbour and a member of its own.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("u"), F.lit(0).alias("v")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("u"), F.lit(1).alias("v")))
        if not ends.groupBy("x").agg(F.sum("u").alias("u"), F.max("v").alias("v")).where("u > 1 or u + v > 1").head(1):
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._quern_path = edges._quern_path
            return out
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), tag)
        first = written(large.where("v < u").groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.where("v < u").join(first, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        new = written(small, tag)
        discard(edges, least, large, first)
        edges = new


def _with_links(roots: DataFrame, tried: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots and tried pairs with those of ``new``; what they replace is deleted."""
    links = new.where("similarity > 0").select("pivot", "node")
    if links.head(1):
        old, roots = roots, components(roots.select(F.col("root").alias("pivot"), "node").unionByName(links))
        discard(old)
    both = written(tried.unionByName(new), "tried")
    discard(tried, new)
    return roots, both


def _linked(nodes: DataFrame, own: DataFrame, least: float, short: int) -> DataFrame:
    """(node, root) of the texts that links connect; see ``classes``. ``own`` (node, size) are the nodes that stand for
    their copies; ``nodes`` (node, size, sketch, words) may hold others, which nothing asks for."""
    n = own.count()
    sketched = _semi(nodes.select("node", "sketch"), own.select("node"), n)
    if n > BROADCAST_ROWS:  # else that join would be dealt out for each of the two reads
        sketched = written(sketched, "sketches")
    shared = _shared(sketched.select("node", F.explode("sketch").alias("bucket")))
    if n > BROADCAST_ROWS:
        discard(sketched)
    tried = _verified(_alike_in_length(_linear(shared), own.select("node", "size"), least), nodes, least)
    if tried is None:
        tried = written(nodes.sparkSession.createDataFrame([], "pivot long, node long, similarity double"), "tried")
    roots = components(tried.where("similarity > 0").select("pivot", "node"))
    mixed = _mixed_rows(shared, roots)
    discard(shared)
    # Members of large buckets and short texts are searched by rare pairs, those of other buckets by bucket.
    by_pair = written(own.where((F.col("size") > 0) & (F.col("size") < short / least)).select("node").union(mixed.where(F.col("n") > LARGE).select("node")).distinct(), "chosen")
    by_bucket = mixed.where(F.col("n") <= LARGE)
    every = written(by_pair.union(by_bucket.select("node")).distinct(), "chosen")
    if not (n := every.count()):
        discard(tried, mixed, by_pair, every)
        return roots
    known = _semi(nodes.select("node", "size", "words"), every, n).join(roots, "node", "left")
    some = written(known.select("node", F.coalesce("root", "node").alias("root"), "size", "words"), "some")
    of_bucket = by_bucket.join(roots, "node", "left").select(F.col("bucket").alias("place"), "node", F.coalesce("root", "node").alias("root"))
    left = _candidates(_by_rare_pairs(_semi(some, by_pair, n), least), of_bucket, some, least)
    discard(mixed, by_pair, every, some)
    # Two classes need one link: their nearest pairs first, a few and then more, at last all that are left.
    for slots in (4, 64, 0):
        rest = left.join(tried.select(F.col("pivot").alias("a"), F.col("node").alias("b")), ["a", "b"], "left_anti")
        r = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = rest.join(r, "b", "left").join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
        rest = rest.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}).where("ra != rb")
        if slots:
            one = [F.least("ra", "rb"), F.greatest("ra", "rb"), F.pmod(F.xxhash64("a", "b"), F.lit(slots))]
            rest = rest.groupBy(*one).agg(F.min(F.struct("gap", "a", "b")).alias("x")).select("x.a", "x.b")
        new = _verified(rest.select(F.col("a").alias("pivot"), F.col("b").alias("node")), nodes, least)
        if new is None:
            break
        roots, tried = _with_links(roots, tried, new)
    discard(tried, left)
    return roots


def classes(docs: DataFrame, least: float = SIMILARITY, functions: int = FUNCTIONS, short: int = SHORT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: class_id (the least doc_id of its class), class_size in documents, and row_no, d1, d2
    (row number and digest).

    Texts link when their edit similarity over lower-cased words is at least ``least`` (words count as equal where 32
    bits of their hashes are); a class is what links and exact copies connect. Every link between texts that share a
    bucket is found, whatever the bucket's size, and every one of texts under ``short`` words. Null and empty texts are
    copies of one another; texts without words otherwise link only to exact copies. Repeated rows are copies. Null
    keys are kept: a class of none but null keys has a null class_id. An empty table gives no rows; other columns are
    not looked at.
    """
    table = written(signed(columns_for(docs, k=key, t=text), functions), "signed")
    own = written(table.groupBy("d1", "d2").agg(F.min("row_no").alias("node"), F.max("size").alias("size")), "own")  # apart from the join, as "sizes" below
    members = written(table.select("row_no", "doc_id", "d1", "d2").join(own.drop("size"), ["d1", "d2"]), "members")
    roots = _linked(table.withColumnRenamed("row_no", "node"), own, least, short)
    discard(table, own)
    placed = written(members.join(roots, "node", "left").select("row_no", "doc_id", "d1", "d2", F.coalesce("root", "node").alias("root")), "placed")
    sizes = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_no")).alias("first"))
    sizes = written(sizes, "sizes")  # apart from the join below, whose large classes AQE can then split
    discard(members, roots)
    return placed.join(sizes, "root").select("doc_id", "class_id", "class_size", "row_no", "d1", "d2", (F.col("row_no") == F.col("first.row_no")).alias("stays"))


def _number(column: str, at: int) -> F.Column:
    """The signed number of eight bytes in hex from ``at``, least byte first, as ``signed`` reads digests."""
    return F.conv(F.concat(*[F.substring(column, at + 14 - 2 * i, 2) for i in range(8)]), 16, -10).cast("long")


def one_of_each(docs: DataFrame, broadcast_rows: int = 1_000_000, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with one of each class kept, the one of the least key; all columns stay.

    What goes is found by key and digest. It is broadcast while it has at most ``broadcast_rows`` rows of 32 bytes
    and joined by a shuffle beyond that.
    """
    found = classes(docs, key=key, text=text, **options)
    rows = written(found.select("doc_id", "d1", "d2", "stays"), "stays")
    going = rows.groupBy("doc_id", "d1", "d2").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1").select(F.col("doc_id").alias("_k"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("stays").alias("_stays"))
    if (n := going.count()) == 0:
        return docs
    lists = F.broadcast(going) if n <= broadcast_rows else going
    names, docs = docs.columns, plain_names(docs)
    key, text = (f"c{names.index(c)}" for c in (key, text))
    hexed = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    marked = docs.withColumn("_hex", hexed).withColumns({"_a": _number("_hex", 1), "_b": _number("_hex", 17)}).drop("_hex")
    on = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_a") == F.col("_d1")) & (F.col("_b") == F.col("_d2"))
    clean = marked.join(lists, on, "left_anti").select(docs.columns)
    repeated = going.where("_stays")
    if repeated.limit(1).count() == 0:
        return clean.toDF(*names)
    some = marked.join(F.broadcast(repeated) if n <= broadcast_rows else repeated, on, "left_semi").dropDuplicates([key, "_a", "_b"]).select(docs.columns)
    return clean.unionByName(some).toDF(*names)
