"""Toxicity (operator 3): a character n-gram linear classifier whose features are scaled by naive
Bayes log-count ratios.

A document is the set of its distinct words (white-space split, lower case, "^" and "$" at the
ends); feature g counts the words of that set that hold n-gram g. Training takes a bounded sample
of labelled documents: log-count ratios r come from word counts per class, the n-grams whose ratio
differs most surely from zero stay, and a logistic regression is fitted on r-scaled counts. A word
then has one weight (the sum over its n-grams), so that scoring is one dictionary lookup a word.

Defined cases: null or empty text scores as the bias alone; labels that are null do not teach;
repeated labels of one document count as toxic if any says so; repeated rows are scored alike;
without any label of both classes every score is the share of toxic labels (0 if none). Other
columns are ignored. Words of any length are used whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, release, small_batches

#: Bound of the labelled sample that a fit may use, in documents.
MAX_TRAIN = 16_000
#: Most n-grams that the model keeps, and the least z-score of a kept log-count ratio.
MAX_GRAMS, LEAST_Z = 6_000, 3.5
#: A word teaches if at least so many documents of the sample have it. Every word is scored. Rare words
#: are mostly junk, which shifts the classes' totals: with 1 instead of 3, held-out results are the
#: same (983 and 982 of 990 right on 0.1), with ten times the features in a document.
LEAST_DOCS = 3
SIZES = (3, 4, 5, 6)
THRESHOLD = 0.3
#: Words whose weight a worker remembers.
_CACHED = 100_000


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def grams(word: str) -> set[str]:
    w = f"^{word}$"
    return {w[i : i + n] for n in SIZES for i in range(len(w) - n + 1)} or {w}


def finder(known: Iterable[str]) -> Callable[[str], set[str]]:
    """For a word, those of its n-grams that are known, by one pass of an automaton."""
    tree = ahocorasick.Automaton()
    for g in known:
        tree.add_word(g, g)
    if not len(tree):
        return lambda word: set()
    tree.make_automaton()
    return lambda word: {g for _, g in tree.iter(f"^{word}$")}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    _seen: dict[str, float] = field(default_factory=dict, repr=False)
    _old: dict[str, float] = field(default_factory=dict, repr=False)
    _find: Callable[[str], set[str]] | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "_seen": {}, "_old": {}, "_find": None}

    def word(self, w: str) -> float:
        x = self._seen.get(w)
        if x is None:
            x = self._old.get(w)
            if x is None:
                if self._find is None:
                    self._find = finder(self.weights)
                x = math.fsum(self.weights[g] for g in self._find(w))
            if len(w) <= 64:
                if len(self._seen) >= _CACHED:  # what is seen again comes back from the older half
                    self._old, self._seen = self._seen, {}
                self._seen[w] = x
        return x

    def score(self, text: str | None) -> float:
        words = words_of(text)
        known = list(map(self._seen.get, words))
        if None in known:
            known = [self.word(w) if x is None else x for w, x in zip(words, known)]
        z = self.bias + math.fsum(known)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _ratios(words: DataFrame, alpha: float = 1.0) -> dict[str, float]:
    """Log-count ratio of each n-gram that is kept, from documents per class of each word
    (w, p, q). Counted on the executors; only the kept ones come to the driver."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos: Counter = Counter()
            neg: Counter = Counter()
            for w, p, q in zip(*(c.to_pylist() for c in b.columns)):
                for g in grams(w):
                    pos[g] += p
                    neg[g] += q
            yield pa.RecordBatch.from_pydict(
                {"g": list(pos), "p": pa.array(pos.values(), pa.int64()), "q": pa.array(neg.values(), pa.int64())}
            )

    counts = cut(
        words.mapInArrow(spell, "g string, p long, q long")
        .groupBy("g")
        .agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    )
    total_p, total_q = counts.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("q"), F.lit(0))).first()
    p, q = F.col("p") + alpha, F.col("q") + alpha
    r = F.log(p / (total_p + alpha)) - F.log(q / (total_q + alpha))
    kept = counts.select("g", r.alias("r"), (F.abs(r) / F.sqrt(1 / p + 1 / q)).alias("z")).where(F.col("z") >= LEAST_Z)
    return {x.g: x.r for x in kept.orderBy(F.desc("z"), "g").limit(MAX_GRAMS).collect()}


#: Entries of the matrix that a step of the fit has in hand at once.
_BLOCK = 1 << 18


def _logistic(
    idx: np.ndarray, val: np.ndarray, ends: np.ndarray, r: np.ndarray, y: np.ndarray, l2: float = 1e-3,
    steps: int = 120
) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent with a fixed number of steps; deterministic. idx, val: the features of
    each row and their counts in small numbers, row by row; ends: where each row ends; r: the features'
    scales; y: labels. Rows are taken in blocks, so that no step holds them all in wider numbers."""
    n, size = len(r), np.diff(np.concatenate(([0], ends)))
    rows = np.flatnonzero(size)  # rows without a feature only see the bias
    starts = (ends - size)[rows]
    cuts = np.unique(np.searchsorted(starts, np.arange(0, int(ends[-1]), _BLOCK)))
    blocks = [
        (rows[lo:hi], slice(int(starts[lo]), int(ends[rows[hi - 1]])), starts[lo:hi] - starts[lo], size[rows[lo:hi]])
        for lo, hi in zip(cuts, [*cuts[1:], len(rows)])
        if hi > lo
    ]

    def forward(v: np.ndarray, c: float) -> np.ndarray:
        scaled, z = v * r, np.full(len(y), c)
        for own, part, begin, _ in blocks:
            z[own] += np.add.reduceat(val[part] * scaled[idx[part]], begin)
        return z

    def backward(e: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for own, part, _, times in blocks:
            out += np.bincount(idx[part], val[part] * np.repeat(e[own], times), n)
        return out * r / len(y)

    # Features are scaled by their own curvature; the step follows from the largest one left, found by
    # power iteration (bias included).
    square = np.zeros(n)
    for _, part, _, _ in blocks:
        square += np.bincount(idx[part], np.square(val[part]), n)
    scale = 1 / np.sqrt(square * r * r / len(y) / 4 + l2)
    u, bias, top = np.ones(n) / math.sqrt(n + 1), 1 / math.sqrt(n + 1), 1.0
    for _ in range(12):
        z = forward(u * scale, bias) / 4
        gu, gb = (backward(z) + l2 * u * scale) * scale, float(z.mean())
        top = math.sqrt(float(gu @ gu) + gb * gb) or 1.0
        u, bias = gu / top, gb / top
    step = 1 / (1.05 * top)
    w = v = np.zeros(n)
    b = c = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for k in range(steps):
        e = 1 / (1 + np.exp(-np.clip(forward(v, c), -30, 30))) - y
        gw, gb = backward(e) + l2 * v, float(e.mean())
        nw, nb = v - step * np.square(scale) * gw, c - step * gb
        m = k / (k + 3)
        v, c, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, float(b)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    max_train: int = MAX_TRAIN
) -> Model:
    """Learn from the labelled documents whose crc32(key) mod 4 is not 2, at most about max_train
    of them (by a hash of the key)."""
    small_batches(docs.sparkSession)
    known = (
        labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
        .where("k is not null and y is not null")
    )
    known = known.where(crc_mod(F.col("k"), 4) != 2).groupBy("k").agg(F.max("y").alias("y"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("y") > 0, 1)), F.lit(0))).first()
    if not n or not toxic or toxic == n:
        share = toxic / n if n else 0.0
        return Model({}, math.log((share + 1e-9) / (1 - share + 1e-9)))
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int((1 << 20) * max_train / n))
    # known holds max_train rows at most
    sample = (
        docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
        .join(F.broadcast(known), "k")
        .select("t", "y", F.xxhash64("k").alias("k"))
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos: Counter = Counter()
        neg: Counter = Counter()

        def taken() -> pa.RecordBatch:
            ws = sorted(pos.keys() | neg.keys())
            out = {"w": ws, "p": pa.array([pos[w] for w in ws], pa.int64()), "q": pa.array([neg[w] for w in ws], pa.int64())}
            pos.clear()
            neg.clear()
            return pa.RecordBatch.from_pydict(out)

        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (pos if y > 0 else neg).update(words_of(t))
                if len(pos) + len(neg) >= _CACHED:
                    yield taken()
        if pos or neg:
            yield taken()

    per_word = (
        sample.mapInArrow(count, "w string, p long, q long")
        .groupBy("w")
        .agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    )
    ratios = _ratios(per_word.where(F.col("p") + F.col("q") >= LEAST_DOCS))
    place = {g: i for i, g in enumerate(ratios)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        find = finder(place)
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                words = words_of(t)
                for w in words:
                    if w not in cache:
                        cache[w] = [place[g] for g in find(w)]
                out.append(Counter(chain.from_iterable(map(cache.__getitem__, words))))
                if len(cache) > _CACHED:
                    cache.clear()
            yield pa.RecordBatch.from_pydict(
                {
                    "k": b.column(2).cast(pa.int64()),
                    "i": pa.array([list(c) for c in out], pa.list_(pa.int16())),
                    "v": pa.array([list(c.values()) for c in out], pa.list_(pa.float32())),
                    "y": b.column(1).cast(pa.int32())
                }
            )

    got = sample.mapInArrow(vectors, "k long, i array<short>, v array<float>, y int").toArrow()  # MAX_TRAIN rows at most
    got = got.sort_by([("k", "ascending"), ("y", "ascending")]).combine_chunks()  # in order, whatever the order of arrival
    r = np.array(list(ratios.values()) or [0.0])
    ids = got.column("i").combine_chunks() if got.num_rows else None
    if ids is None or not len(ids.flatten()):
        return Model({}, math.log((toxic + 0.5) / (n - toxic + 0.5)))
    ends = ids.offsets.to_numpy()[1:].astype(np.int64) - int(ids.offsets[0].as_py())
    idx, val = (got.column(c).combine_chunks().flatten().to_numpy().copy() for c in ("i", "v"))
    y = (got.column("y").to_numpy() > 0).astype(float)
    del got, ids
    pa.default_memory_pool().release_unused()
    release(docs.sparkSession)  # the sample's vectors are out of both heaps before the fit begins
    w, b = _logistic(idx, val, ends, r, y)
    return Model({g: float(w[k] * r[k]) for g, k in place.items() if w[k]}, b)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column of the probability of label 1."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # MAX_GRAMS entries at most

    @F.pandas_udf("double")
    def of(texts):
        return texts.map(shared.value.score)

    return docs.withColumn(out, of(F.coalesce(F.col(text), F.lit(""))))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those whose score reaches the threshold; columns as before."""
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return score(docs, fit(docs, labels), out=name).where(F.col(name) < threshold).select(*docs.columns)
