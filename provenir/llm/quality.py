"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its words, of their character n-grams (with word borders)
and of one mark for each word that follows itself, all by hashed buckets; a softmax layer over the mean
gives the class. Vectors and layer are trained together by numpy stochastic gradient descent, with the
same number of passes whatever the sample. For two classes the trained model folds to one number for
each bucket, so that scoring sums numbers of words, kept in a table.

Training reads a bounded sample of the labelled rows (TRAIN_ROWS, the rows whose id hashes lowest);
scoring covers every row and whole texts. Defined results: a null text counts as empty; a text
without words gets the model's bias; repeated rows are scored alike; an empty table gives no rows, and
without labelled rows every score is 0.5; ids, labels, lang and source are never features. Only `keep` and
the text are read, so that other columns can't clash; a column in keep must not be called as `out`.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, field, held, labelled_sample

TRAIN_ROWS = 4000
BUCKETS = 1 << 17
DIM = 8
EPOCHS = 16
RATE = 4.0
NGRAMS = (3, 4)
#: Words that a worker's table holds, and their signs: a fuller table starts anew before the next text.
CACHE, CACHE_SIGNS = 300_000, 8 << 20
#: Signs of words that are hashed at once.
CHUNK = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * MIX
    return h ^ (h >> np.uint64(29))


def hashed(words: Sequence[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, numbers of them) of the words, one after another: of each word's character n-grams by size, and of the word itself."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    owners, places = [], []
    for n in NGRAMS:
        own = np.maximum(sizes - n + 1, 0)
        at = np.repeat(starts - (np.cumsum(own) - own), own) + np.arange(own.sum())
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = mixed(h ^ points[at + k])
        owners.append(np.repeat(np.arange(len(words)), own))
        places.append(h)
    owners.append(np.arange(len(words)))
    places.append(mixed(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)) ^ np.uint64(1 << 40)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (mixed(np.concatenate(places)) % np.uint64(buckets)).astype(np.int64)[order], np.bincount(owner, minlength=len(words))


def same_bucket(buckets: int = BUCKETS) -> int:
    """The bucket of the mark for a word that follows itself."""
    return int(hashed(["\x00same"], buckets)[0][-1])


class Model(NamedTuple):
    """Folded for inference: the logit is the mean of the features' weights plus bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str, known: WordSums) -> float:
        words = text.split()
        z = self.bias
        if words:
            ids = known.ids(words)
            same = int(np.count_nonzero(ids[1:] == ids[:-1]))
            z += (float(known.sums[ids].sum()) + same * known.same) / (int(known.counts[ids].sum()) + same)
        return float(1 / (1 + np.exp(-max(-500.0, min(500.0, z)))))


class WordSums:
    """A table of words with the sums of their features' weights and their numbers."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.same = weights, float(weights[same_bucket(len(weights))])
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.signs = 0
        self.sums, self.counts = np.empty(1024), np.empty(1024, np.int64)

    def ids(self, words: Sequence[str]) -> np.ndarray:
        """The words' places in the table."""
        if len(self.index) >= CACHE or self.signs >= CACHE_SIGNS:
            self.clear()
        if new := [w for w in dict.fromkeys(words) if w not in self.index]:
            self.add(new)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def add(self, new: Sequence[str]) -> None:
        first, n = len(self.index), len(self.index) + len(new)
        self.index.update(zip(new, range(first, n)))
        if n > len(self.sums):
            self.sums, self.counts = (np.resize(x, max(n, 2 * len(x))) for x in (self.sums, self.counts))
        a = 0
        while a < len(new):  # no more than CHUNK signs at once, or one word
            b, signs = a, 0
            while b < len(new) and (b == a or signs + len(new[b]) <= CHUNK):
                signs += len(new[b])
                b += 1
            own, counts = hashed(new[a:b], len(self.weights))
            self.sums[first + a : first + b] = np.bincount(np.repeat(np.arange(b - a), counts), self.weights[own], b - a)
            self.counts[first + a : first + b] = counts
            self.signs += signs
            a = b


def features(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's features."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    own, sizes = hashed(list(counts), buckets)
    times = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), sizes)
    same = sum(map(str.__eq__, words, words[1:]))
    ids, place = np.unique(np.append(own, same_bucket(buckets)) if same else own, return_inverse=True)
    return ids, np.bincount(place, np.append(times, same) if same else times)


def packed(texts: Sequence[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Features of all texts, one after another: buckets, counts, and where each text's begin and the last one's end.

    Two arrays of 32-bit numbers, which the process gives back as wholes; what thousands of small ones
    held would stay with the driver after training.
    """
    own, times, edges = array("i"), array("I"), [0]
    for t in texts:
        ids, counts = features(t, buckets)
        own.frombytes(ids.astype(np.int32).tobytes())
        times.frombytes(counts.astype(np.uint32).tobytes())
        edges.append(len(own))
    return np.frombuffer(own, np.int32), np.frombuffer(times, np.uint32), edges


def train(texts: Sequence[str], labels: Sequence[int], buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Stochastic gradient descent over single documents, with a rate that falls to nothing."""
    if not texts:
        return Model(np.zeros(buckets), 0.0)
    rng = np.random.default_rng(seed)
    table = (rng.random((buckets, dim), np.float32) - 0.5) / dim
    layer = np.zeros((2, dim))
    bias = np.zeros(2)
    own, times, edges = packed(texts, buckets)
    y = np.asarray(labels, int)
    step, steps = 0, epochs * len(texts)
    for _ in range(epochs):
        for k in rng.permutation(len(texts)):
            ids, counts = own[edges[k] : edges[k + 1]], times[edges[k] : edges[k + 1]].astype(np.float64)
            now = rate * (1 - step / steps) * 0.25
            step += 1
            share = counts / counts.sum() if len(counts) else counts
            mean = share @ table[ids] if len(ids) else np.zeros(dim)
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            pull = p @ layer
            layer -= now * np.outer(p, mean)
            bias -= now * 0.1 * p
            if len(ids):
                table[ids] -= (now * share[:, None] * pull[None, :]).astype(np.float32)
    v = layer[1] - layer[0]
    return Model(table.astype(np.float64) @ v, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """A model of at most `rows` labelled rows, those whose id hashes lowest; the same rows give the same model."""
    return train(*labelled_sample(docs, labels, id_col, text_col, label_col, rows))


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] = ("doc_id",), out: str = "score") -> DataFrame:
    """`keep` and the probability of label 1 for each row."""
    weights = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float64).tobytes())  # BUCKETS numbers, whatever the input
    bias = model.bias

    def start():
        known = held(("quality", weights.value), lambda: WordSums(np.frombuffer(weights.value, np.float64)))
        own = Model(known.weights, bias)
        return lambda column: [pa.array([own.score(x or "", known) for x in column.to_pylist()], pa.float64())]

    return append_columns(docs, [text_col], list(keep), [field(out, T.DoubleType())], start)
