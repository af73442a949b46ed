"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams, so misspellings share most of theirs with the
word. A stretch of ``window`` words is the mean of its words and goes through a softmax over two classes. A
document is as toxic as its most toxic stretch, so that a few insults in a long text aren't averaged away; the
gradient of each document flows through that stretch into both the softmax and the n-gram vectors. (With one
average over the whole document, ``window`` beyond its length, short clean texts are rejected more often; the
README has both figures.)

N-grams are hashed for whole batches of texts at once, place by place, so that no table of words is kept and the
cost of a text depends on its length alone. Training takes at most ``sample`` labelled documents, whole, those with
the smallest hash of their id, and runs in one task; the driver sees the weights alone. Scoring folds the trained
model into one number per n-gram (the model is linear up to the softmax) and reads every text once, where it lies.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import columns_for, rows_mapped

SAMPLE, SAMPLE_BYTES, BUCKETS, DIMENSIONS, WINDOW, EPOCHS = 8192, 128 << 20, 1 << 18, 8, 12, 120
GRAMS = (3, 4, 5)
#: The rate that is assumed where nothing is labelled: such a model rejects nothing.
PRIOR = 0.1
#: Code points hashed at a time: bounds memory and keeps arrays in the processor's cache.
CHUNK = 1 << 18
_BORDER = 1
_OUTSIDE = re.compile(r"[\W_]")


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter or a digit."""
    return np.array([chr(i).isalnum() for i in range(0x110000)], bool)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _mixed32(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)


_STEP, _WORD_STEP = np.uint32(0x01000193), np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some pieces of text, lower-cased: places, hashes, and the buckets of their n-grams.

    A word's n-grams are those of its code points with a border mark at either end, and the word itself.
    """

    def __init__(self, pieces: list[str], buckets: int) -> None:
        low = [t.lower() for t in pieces]
        c = np.frombuffer(f" {' '.join(low)}{' ' * max(GRAMS)}".encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = _letters()[np.minimum(c, 0x10FFFF)]
        self.starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        self.sizes = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1 - self.starts
        heads = np.cumsum([1, *(len(t) + 1 for t in low)])
        self.ends = np.searchsorted(self.starts, heads)  # words before each piece, and all
        self.symbols, self.inside, self.bits = np.where(inside, c, np.uint32(_BORDER)), inside, buckets.bit_length() - 1

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, bucket, whether it lies in one word) of the n-gram that begins at each place."""
        c, n_all = self.symbols, len(self.symbols)
        h, whole = c, np.ones(n_all - 1, bool)
        for n in range(2, max(GRAMS) + 1):
            h = h[:-1] * _STEP + c[n - 1 :]
            if n > 2:  # all but the first and the last are letters
                whole = whole[: n_all - n + 1] & self.inside[n - 2 : n_all - 1]
            if n in GRAMS:
                yield n, _mixed32(h ^ np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) >> np.uint32(32 - self.bits), whole

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        at = np.arange(self.sizes.sum()) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        power = np.cumprod(np.full(int(self.sizes.max()), _WORD_STEP))
        letters = _mixed(self.symbols[self.inside].astype(np.uint64)) * power[at]
        return _mixed(np.add.reduceat(letters, np.cumsum(self.sizes) - self.sizes))

    def own(self) -> np.ndarray:
        """The bucket of each word itself."""
        return (self.hashes() >> np.uint64(64 - self.bits)).astype(np.int64)

    def counts(self) -> np.ndarray:
        """How many n-grams each word has, itself among them."""
        return 1 + sum(np.maximum(0, self.sizes + 3 - n) for n in GRAMS)

    def values(self, weights: np.ndarray) -> np.ndarray:
        """The mean weight of each word's n-grams."""
        if not len(self.starts):
            return np.zeros(0, np.float32)
        total = np.zeros(len(self.symbols), np.float32)
        for _, bucket, whole in self.grams():
            total[: len(bucket)] += weights[bucket] * whole
        return (np.add.reduceat(total, self.starts - 1) + weights[self.own()]) / self.counts()

    def flat(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the chosen words, one word after another, and how many each has."""
        parts, of = [self.own()[chosen]], [np.arange(len(chosen))]
        for n, bucket, _ in self.grams():
            size = np.maximum(0, self.sizes[chosen] + 3 - n)
            parts.append(bucket[_runs(self.starts[chosen] - 1, size)].astype(np.int64))
            of.append(np.repeat(np.arange(len(chosen)), size))
        order = np.argsort(np.concatenate(of), kind="stable")
        return np.concatenate(parts)[order].astype(np.int32), self.counts()[chosen].astype(np.int32)


def _runs(heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after another."""
    return np.repeat(heads - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def chunks(texts: Iterable[str | None], size: int = CHUNK) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers of texts and pieces of them, some ``size`` code points at a time: longer texts are cut between words."""
    numbers: list[int] = []
    pieces: list[str] = []
    held = 0
    for i, t in enumerate(texts):
        at, t = 0, t or ""
        while at < len(t):
            cut = len(t)
            if cut - at > size and (m := _OUTSIDE.search(t, at + size)):
                cut = m.start()
            numbers.append(i)
            pieces.append(t[at:cut])
            held += cut - at
            at = cut
            if held >= size:
                yield numbers, pieces
                numbers, pieces, held = [], [], 0
    if pieces:
        yield numbers, pieces


def stretches(ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and end of every stretch, and its document: documents end at ``ends`` (the first entry is the
    first one's start). Stretches overlap by half, so each neighbourhood of half a window lies whole in one."""
    n, half = np.diff(ends), max(1, window // 2)
    count = np.where(n > 0, np.maximum(1, -(-(n - half) // half)), 0)
    of = np.repeat(np.arange(len(n)), count)
    lo = ends[of] + half * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    return lo, np.minimum(lo + window, ends[of + 1]), of


class Model:
    """Weights per n-gram bucket and a bias: the log odds of a stretch is the mean of its words' plus the bias."""

    def __init__(self, weights: np.ndarray, bias: float, window: int) -> None:
        self.weights, self.bias, self.window = weights.astype(np.float32), float(bias), window

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        """That of each text's most toxic stretch; a text without words has the bias alone."""
        n, values = np.zeros(len(texts), np.int64), [np.zeros(0, np.float32)]
        for numbers, pieces in chunks(texts):
            w = Words(pieces, len(self.weights))
            np.add.at(n, numbers, np.diff(w.ends))
            values.append(w.values(self.weights))
        z = np.zeros(len(texts))
        lo, hi, of = stretches(np.concatenate(([0], np.cumsum(n))), self.window)
        if len(lo):
            total = np.concatenate(([0.0], np.cumsum(np.concatenate(values), dtype=np.float64)))
            heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            z[of[heads]] = np.maximum.reduceat((total[hi] - total[lo]) / (hi - lo), heads)
        return z + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.log_odds(texts), -40, 40)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


class Bags:
    """Documents as word numbers, one after another, and the words' n-gram buckets. Texts are read once and not kept."""

    def __init__(self, texts: Iterable[str | None], buckets: int) -> None:
        n: list[int] = []
        folds: list[int] = []

        def counted() -> Iterator[str | None]:
            for t in texts:
                n.append(0)
                folds.append(zlib.crc32((t or "").encode("utf-8", "surrogatepass")) % 5)  # copies stay together
                yield t

        none = np.zeros(0, np.int32)
        tokens, flat, sizes, known = [none], [none], [none], 0
        for numbers, pieces in chunks(counted(), 1 << 20):
            w = Words(pieces, buckets)
            for i, k in zip(numbers, np.diff(w.ends).tolist(), strict=True):
                n[i] += k
            _, first, which = np.unique(w.hashes(), return_index=True, return_inverse=True)  # words are numbered anew in each chunk
            tokens.append((which + known).astype(np.int32))
            known += len(first)
            buckets_of, size = w.flat(first)
            flat.append(buckets_of)
            sizes.append(size)
        self.tokens, self.flat, self.sizes = (np.concatenate(x) for x in (tokens, flat, sizes))
        self.ends, self.folds = np.cumsum([0, *n]), np.array(folds, np.int64)
        self.heads, self.buckets = np.cumsum(self.sizes) - self.sizes, buckets

    def spread(self, docs: np.ndarray) -> np.ndarray:
        """Number of the documents that hold each bucket."""
        out = np.zeros(self.buckets, np.int32)
        for d in docs:
            u = np.unique(self.tokens[self.ends[d] : self.ends[d + 1]])
            if len(u):
                out[np.unique(self.flat[_runs(self.heads[u], self.sizes[u])])] += 1
        return out

    def stretches(self, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and end of every stretch, and its document's place in ``docs``, which ascend."""
        lo, hi, of = stretches(self.ends, window)
        place = np.full(len(self.ends) - 1, -1)
        place[docs] = np.arange(len(docs))
        mine = place[of] >= 0
        return lo[mine], hi[mine], place[of[mine]]

    def means(self, weights: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Mean weight of each stretch's words; a word's is the mean of its n-grams'."""
        word, out = np.empty(len(self.sizes), np.float32), np.empty(len(lo))
        for at in range(0, len(word), 1 << 16):  # in parts, to bound memory
            heads = self.heads[at : at + (1 << 16)]
            end = heads[-1] + self.sizes[at + len(heads) - 1]
            word[at : at + len(heads)] = np.add.reduceat(weights[self.flat[heads[0] : end]], heads - heads[0]) / self.sizes[at : at + len(heads)]
        for at in range(0, len(lo), 1 << 16):
            a, b = lo[at : at + (1 << 16)], hi[at : at + (1 << 16)]
            total = np.concatenate(([0.0], np.cumsum(word[self.tokens[a[0] : b[-1]]], dtype=np.float64)))
            out[at : at + len(a)] = (total[b - a[0]] - total[a - a[0]]) / (b - a)
        return out


def fit(bags: Bags, docs: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, window: int = WINDOW, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 3e-5, least_documents: int = 8, seed: int = 7) -> Model:
    """Joint full-batch training of n-gram vectors and softmax by Adam. Without both labels: their base rate, with one
    more row of label PRIOR.

    ``decay`` and ``least_documents`` keep the vectors of what few documents hold from learning those by heart.
    """
    buckets, y = bags.buckets, labels.astype(np.float32)
    base = (y.sum() + PRIOR) / (len(y) + 1)
    bias0 = float(np.log(base / (1 - base)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(buckets), bias0, window)
    lo, hi, of = bags.stretches(docs, window)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    # N-grams of few documents stay at zero.
    common = (bags.spread(docs) >= least_documents).astype(np.float32)[:, None]
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (buckets, dimensions)).astype(np.float32) * common
    softmax = rng.normal(0, 0.1, (dimensions, 2)).astype(np.float32)
    bias = np.array([0, bias0], np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, softmax, bias)]
    for step in range(1, epochs + 1):
        delta = softmax[:, 1] - softmax[:, 0]
        mean = bags.means(vectors @ delta, lo, hi)
        z = np.zeros(len(docs))
        best = np.zeros(0, np.int64)
        if len(first):
            top = np.maximum.reduceat(mean, first)
            z[of[first]] = top
            where = np.flatnonzero(mean == np.repeat(top, np.diff(np.r_[first, len(of)])))
            best = where[np.r_[True, of[where[1:]] != of[where[:-1]]]]
        p = 1 / (1 + np.exp(-np.clip(z + bias[1] - bias[0], -40, 40)))
        g = (p - y) / len(y)
        # Through each document's chosen stretch into its words, their n-grams, and the softmax.
        per = (hi - lo)[best]
        seen = bags.tokens[_runs(lo[best], per)]
        some, which = np.unique(seen, return_inverse=True)
        on_word = np.bincount(which, np.repeat(g[of[best]] / per, per), len(some)) / bags.sizes[some]
        on_bucket = np.bincount(bags.flat[_runs(bags.heads[some], bags.sizes[some])], np.repeat(on_word, bags.sizes[some]), buckets).astype(np.float32)
        up = vectors.T @ on_bucket
        grads = ((on_bucket[:, None] * delta[None, :] + decay * vectors) * common, np.stack((-up, up), 1) + decay * softmax, np.array([-g.sum(), g.sum()], np.float32))
        for q, d, (m, v) in zip((vectors, softmax, bias), grads, state, strict=True):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    delta = softmax[:, 1] - softmax[:, 0]
    return Model(vectors @ delta, bias[1] - bias[0], window)


def calibrated(model: Model, bags: Bags, docs: np.ndarray, labels: np.ndarray) -> Model:
    """The model with its log odds scaled and shifted to fit documents it hasn't seen (logistic regression on them,
    drawn to no change by two pseudo-documents)."""
    y = labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        return model
    lo, hi, of = bags.stretches(docs, model.window)
    z = np.full(len(docs), -np.inf)
    np.maximum.at(z, of, bags.means(model.weights, lo, hi))
    x = np.stack((np.where(np.isinf(z), 0, z) + model.bias, np.ones(len(z))), 1)
    theta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        grad = x.T @ (p - y) + 2 * (theta - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    a, b = max(theta[0], 1e-3), theta[1]
    return Model(model.weights * np.float32(a), model.bias * a + b, model.window)


def train(texts: Iterable, labels: list[int], buckets: int = BUCKETS, **options) -> Model:
    """Fits on four fifths of the documents and calibrates on the others. Texts are read once and not kept."""
    bags, y = Bags(texts, buckets), np.array(labels, np.int64)
    learn, rest = np.flatnonzero(bags.folds != 0), np.flatnonzero(bags.folds == 0)
    return calibrated(fit(bags, learn, y[learn], **options), bags, rest, y[rest])


def is_held_out(key: str = "doc_id") -> F.Column:
    """Rows whose labels are never learnt: crc32 of the id's text leaves 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(k, h, t, y): at most ``sample`` labelled ids outside the held-out fold, those of the smallest hash h.

    An id that several rows label has the greatest of its labels; labels other than 0 and 1 count for nothing. An id
    with several texts trains on the least of them. Null ids are left out; ids without a row in ``docs`` give none.
    """
    valid = columns_for(labels, k=key, y=label).where(F.col("y").isin(0, 1) & F.col("k").isNotNull() & ~is_held_out("k"))
    of_id = valid.groupBy("k").agg(F.max("y").cast("int").alias("y")).withColumn("h", F.xxhash64("k"))
    chosen = of_id.orderBy("h", "k").limit(sample)
    rows = columns_for(docs, k=key, t=text).join(F.broadcast(chosen), "k")  # at most `sample` rows of three numbers
    return rows.groupBy("k", "h", "y").agg(F.min(F.coalesce("t", F.lit(""))).alias("t")).select("k", "h", "t", "y")


def trained(rows: DataFrame, sample_bytes: int = SAMPLE_BYTES, **options) -> Model:
    """The model of a training sample, fitted in one task: of the rows in the order of their hash, whole texts until
    they come to ``sample_bytes`` in UTF-8 (the first one in any case). An empty sample gives ``PRIOR`` to all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: list[int] = []

        def texts() -> Iterator[str]:
            held = 0
            for batch in batches:
                for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    held += t.as_buffer().size
                    if held <= sample_bytes or not labels:
                        labels.append(y)
                        yield t.as_py()

        model = train(texts(), labels, **options)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.window], pa.int32())], names=["weights", "bias", "window"])

    one = rows.coalesce(1).sortWithinPartitions("h", "k").select("t", "y").mapInArrow(run, "weights binary, bias double, window int").first()
    return Model(np.frombuffer(one.weights, np.float32), one.bias, one.window) if one else train([], [], **options)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: held_out, score, predicted. Nulls and texts without words get the base rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = columns_for(docs, k=key, t=text).select("k", is_held_out("k").alias("h"), "t")
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The documents scored under the threshold, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at).to_pylist()) < threshold))

    return rows_mapped(docs, run)
