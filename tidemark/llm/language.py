"""Language ID (operator 8): multilingual mixture inference.

Each language has a character model (trigrams backed off to bigrams and single characters) of the
words of its training documents. A document's words come from a mixture of languages; expectation
maximisation finds the proportions, and the set of languages is chosen by likelihood less a
penalty of half the logarithm of the word count for each language added.

Defined cases: a null text or one without a letter is "und" with score 0; documents with a null
language teach nothing; without any training document all are "und"; repeated rows are treated
alike; whole texts are read, whatever their length; extra columns are ignored. Ties go to the
language that sorts first.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_batches

#: Bound of the training sample, in documents a language.
MAX_TRAIN = 3_000
#: Letters that the model tells apart one by one, the most frequent of the sample; rarer ones are told
#: apart by script (the first word of their Unicode name), SCRIPTS of them, and then by "another letter".
MAX_LETTERS, SCRIPTS = 94, 30
UNKNOWN = "und"
_STEPS, _BACKOFF = 12, 8.0
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _script(c: int) -> str:
    return unicodedata.name(chr(c), "").split(" ")[0]


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of the texts with a zero before and after each one and for each
    character that is no letter; for each text the place of its first (one more entry)."""
    low = [(t or "").lower() for t in texts]
    at = np.concatenate(([1], 1 + np.cumsum([len(t) + 1 for t in low], dtype=np.int64)))
    c = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(_is_letter()[c], c, 0), at


def _triples(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class two before, class before, class, whether it counts) for every place but the first;
    a word has its letters and the mark after it, and what is before a word is class 0."""
    one = c[:-1]
    two = np.where(one == 0, 0, np.concatenate((c[:1], c[:-2])))
    here = c[1:]
    return two, one, here, (here != 0) | (one != 0)


class Model:
    """Character models from counts of triples of letters (0: none), by language."""

    def __init__(self, langs: list[str], triples: np.ndarray, counts: np.ndarray):
        """triples: n x 3 code points; counts: n x languages."""
        self.langs, n = langs, len(langs)
        if not n:
            return
        total: Counter = Counter()
        for c, k in zip(triples[:, 2].tolist(), counts.sum(axis=1).tolist()):
            total[c] += k
        known = [c for c, _ in sorted(total.items(), key=lambda x: (-x[1], x[0])) if c][:MAX_LETTERS]
        rare: Counter = Counter()
        for c in total.keys() - set(known) - {0}:
            rare[_script(c)] += total[c]
        scripts = {name: k + 2 for k, (name, _) in enumerate(sorted(rare.items(), key=lambda x: (-x[1], x[0]))[:SCRIPTS])}
        v = len(known) + len(scripts) + 2
        self.classes = np.where(_is_letter(), 1, 0).astype(np.int64)  # 0: no letter, 1: another letter
        if scripts:
            letters = np.flatnonzero(self.classes)
            self.classes[letters] = [scripts.get(_script(c), 1) for c in letters.tolist()]
        self.classes[known] = np.arange(v - len(known), v)
        tri = np.zeros((v, v, v, n))
        np.add.at(tri, tuple(self.classes[triples[:, k]] for k in range(3)), counts)
        one = tri.sum(axis=(0, 1)) + 0.1
        one /= one.sum(axis=0)
        pair = tri.sum(axis=0)
        two = (pair + _BACKOFF * one[None]) / (pair.sum(axis=1, keepdims=True) + _BACKOFF)
        three = (tri + _BACKOFF * two[None]) / (tri.sum(axis=2, keepdims=True) + _BACKOFF)
        self.v, self.table = v, np.log(three).reshape(-1, n).astype(np.float32)

    def infer(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """For each text its language and that language's proportion."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        c, at = code_points(texts)
        if not self.langs or not c.any():
            return langs, scores
        two, one, here, counts = _triples(self.classes[c])
        ll = self.table[(two * self.v + one) * self.v + here]
        ll[~counts] = 0
        starts = np.flatnonzero((here != 0) & (one == 0))
        ll = np.add.reduceat(ll, starts, axis=0)  # a row for each word
        first = np.searchsorted(starts, at - 1)
        size = np.diff(first)
        full = np.flatnonzero(size)
        share = mixtures(ll, first[:-1][full], size[full])
        best = share.argmax(axis=1)
        for k, b, p in zip(full.tolist(), best.tolist(), share.max(axis=1).tolist()):
            langs[k], scores[k] = self.langs[b], min(1.0, p)
        return langs, scores


def _em(like: np.ndarray, at: np.ndarray, size: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after the steps, and the log of each word's mixture likelihood summed by text.
    like: likelihoods of words over that word's largest; languages with share 0 stay out."""
    one = np.ones(like.shape[1], like.dtype)
    for _ in range(_STEPS):
        joint = like * np.repeat(share.astype(like.dtype), size, axis=0)
        joint *= (1 / (joint @ one))[:, None]
        share = np.add.reduceat(joint, at, axis=0) / size[:, None]
    total = np.log((like * np.repeat(share.astype(like.dtype), size, axis=0)) @ one)
    return share, np.add.reduceat(total, at, dtype=np.float64)


def mixtures(ll: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Proportions of languages by text. ll: log-likelihoods, a row for each word; at, size: where
    a text's words start and how many there are. Sets are tried from the one best language up, in
    order of the proportions under all languages; the set of largest penalised likelihood stays."""
    n = ll.shape[1]
    top = ll.max(axis=1)
    deficit = ll - top[:, None]
    like = np.exp(np.maximum(deficit, -60.0))
    single = np.add.reduceat(deficit, at, axis=0, dtype=np.float64)
    best = single.argmax(axis=1)
    out = np.zeros((len(size), n))
    out[np.arange(len(size)), best] = 1.0
    if n == 1:
        return out
    share, mixed = _em(like, at, size, np.full((len(size), n), 1.0 / n))
    value = single.max(axis=1)
    penalty = 0.5 * np.log(size + 1.0)
    open_ = np.flatnonzero(mixed - penalty > value)
    if not len(open_):
        return out
    rows = np.concatenate([np.arange(at[k], at[k] + size[k]) for k in open_])
    like, size, share, value, penalty = like[rows], size[open_], share[open_], value[open_], penalty[open_]
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    order = np.argsort(-share, axis=1, kind="stable")
    for k in range(2, n + 1):
        inside = np.zeros_like(share)
        np.put_along_axis(inside, order[:, :k], 1.0 / k, axis=1)
        p, mixed = _em(like, at, size, inside)
        better = mixed - (k - 1) * penalty > value
        value = np.where(better, mixed - (k - 1) * penalty, value)
        out[open_[better]] = p[better]
    return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_train: int = MAX_TRAIN) -> Model:
    """Learn from documents whose crc32(key) mod 5 is not 0, about max_train of each language at
    most (by a hash of the key)."""
    small_batches(docs.sparkSession)
    own = (
        docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
        .where("k is not null and t is not null and l is not null")
        .where(crc_mod(F.col("k"), 5) != 0)
    )
    sizes = {r[0]: r[1] for r in own.groupBy("l").count().collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 3), np.int64), np.zeros((0, 0)))
    span = 1 << 20
    keep = F.lit(span)
    for name, n in sizes.items():
        if n > max_train:
            keep = F.when(F.col("l") == name, int(span * max_train / n)).otherwise(keep)
    sample = own.where(F.pmod(F.xxhash64("k"), F.lit(span)) < keep).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: defaultdict[str, Counter] = defaultdict(Counter)
        for b in batches:
            rows = defaultdict(list)
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows[name].append(t)
            for name, texts in rows.items():
                two, one, here, counts = _triples(code_points(texts)[0])
                g, n = np.unique(((two << 42) | (one << 21) | here)[counts], return_counts=True)
                seen[name].update(dict(zip(g.tolist(), n.tolist())))
        for name, c in seen.items():
            yield pa.RecordBatch.from_pydict(
                {"l": [name] * len(c), "g": pa.array(c.keys(), pa.int64()), "n": pa.array(c.values(), pa.int64())}
            )

    got = sample.mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    name, g, n = (got.column(k).to_pylist() for k in range(3))
    kinds, place = np.unique(np.array(g, np.int64), return_inverse=True)
    counts = np.zeros((len(kinds), len(langs)))
    counts[place, [langs.index(x) for x in name]] = n
    return Model(langs, np.stack([kinds >> 42, (kinds >> 21) & 0x1FFFFF, kinds & 0x1FFFFF], axis=1), counts)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a column lang_mix of struct<lang_pred string, score double>."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # trigrams of a bounded sample

    @F.pandas_udf("lang_pred string, score double")
    def of(texts):
        import pandas as pd

        langs, scores, part, size = [], [], [], 0
        rows = texts.tolist()
        for i, t in enumerate(rows):
            part.append(t)
            size += len(t or "")
            if size > 300_000 or i == len(rows) - 1:
                got = shared.value.infer(part)
                langs += got[0]
                scores += got[1]
                part, size = [], 0
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn("lang_mix", of(F.col(text)))
