"""Benchmark decontamination (operator 2): rare n-gram seeds and Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. A first pass counts the benchmark's words over
the whole corpus. An n-gram of an item is a seed if words of those frequencies, drawn at random,
would form it at most CHANCE times in the corpus; the shortest n that is rare enough is taken at
every place, one word if it is, so that edits between seeds do no harm and a passage stays rare
even if a third of all documents hold it. That makes seeds longer as the corpus grows, so at every
place the shortest n-gram that chance forms at most WEAK times a word, whatever the corpus's size,
is kept as a weak seed, which counts with a second one near it. A second pass joins the documents
to the seeds, and every document and item that share one, or two weak ones, are aligned by words
around it: score = alignment score / score of the whole item.

The seed table is bounded: items are taken in blocks of BLOCK_ITEMS at most (and BLOCK_CHARS of
text), so each block's table can be broadcast, and any number of items is a matter of more passes.

Defined cases: null or empty texts and items match nothing; items shorter than three words are
their own seed and must be found whole; repeated rows are reported each; ties between places go to
the first; empty tables give no row; texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, hashed_rows, mix, rows_of, small_batches

BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16 << 20
SIZES = (1, 2, 3, 4, 6, 8)
#: Words from which on an item is found by parts.
SHORT = 3
CHANCE, WEAK = 4.0, 1e-6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Most ids that are broadcast; beyond it the join is shuffled.
BROADCAST = 500_000
#: Least share of the whole item's score, and least matched words, of a contaminated document.
LEAST_SCORE, LEAST_WORDS = 0.5, 6
_C = [
    np.uint64(x)
    for x in (
        0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
        0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F
    )
]


_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits; all characters beyond ASCII count as letters."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def words(column) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Texts of an Arrow column some at a time, their word hashes and where each one's begin."""
    texts, at = column.to_pylist(), 0
    for h, first in hashed_rows(map(words_of, texts)):
        yield texts[at : at + len(first) - 1], h, first
        at += len(first) - 1


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of word hashes, at each place where one starts."""
    k = max(0, len(ids) - n + 1)
    out = np.full(k, n, np.uint64)
    for i in range(n):
        out += ids[i : i + k] * _C[i]
    return mix(out)


def _rows(item: np.ndarray, text: np.ndarray, floor: bool) -> Iterator[np.ndarray]:
    """Rows of the alignment matrix, one for each word of item. floor: local alignment, whose cells are 0 at
    least; else global, from (0, 0). The gap recurrence along a row is a running maximum."""
    step = np.arange(len(text) + 1, dtype=np.int64) * -GAP
    up = np.zeros(len(text) + 1, np.int64) if floor else -step
    yield up
    for w in item:
        row = up + GAP
        row[1:] = np.maximum(row[1:], up[:-1] + np.where(text == w, MATCH, MISMATCH))
        if floor:
            row = np.maximum(row, 0)
        up = np.maximum.accumulate(row + step) - step
        yield up


def _last(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    row = None
    for row in _rows(item, text, False):
        pass
    return row


def _matched(item: np.ndarray, text: np.ndarray) -> int:
    """Matched words of a best global alignment, by halves (Hirschberg): memory is linear."""
    if not len(item) or not len(text):
        return 0
    if len(item) == 1:
        return int((text == item[0]).any())
    if len(item) * len(text) <= 1 << 20:
        return _matched_small(item, text)
    half = len(item) // 2
    left = _last(item[:half], text)
    right = _last(item[half:][::-1], text[::-1])[::-1]
    cut_ = int((left + right).argmax())
    return _matched(item[:half], text[:cut_]) + _matched(item[half:], text[cut_:])


def _matched_small(item: np.ndarray, text: np.ndarray) -> int:
    score = np.stack(list(_rows(item, text, False)))
    i, j, same = len(item), len(text), 0
    while i and j:
        hit = item[i - 1] == text[j - 1]
        if score[i, j] == score[i - 1, j - 1] + (MATCH if hit else MISMATCH):
            same += int(hit)
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return same


def _end(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, words of item, words of text) up to where the best local alignment ends, the first of equals."""
    best = (0, 0, 0)
    for i, row in enumerate(_rows(item, text, True)):
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i, j)
    return best


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman: (score, matched words, start, end) of the best local alignment, in words of
    text. One row is held at a time: the end comes of a pass forward, the start of one back from
    it, and the matches in between by halves."""
    best, m, end = _end(item, text)
    if not best:
        return 0, 0, 0, 0
    # Backwards from the end, the first cell that reaches the best score is the shortest such alignment.
    back, rows = None, _rows(item[:m][::-1], text[:end][::-1], False)
    for i, row in enumerate(rows):
        hit = np.flatnonzero(row == best)
        if len(hit):
            back = (i, int(hit[0]))
            break
    i, j = back
    return best, _matched(item[m - i : m], text[end - j : end]), end - j, end


class Seeds:
    """Items by word hashes, and where their seeds are."""

    def __init__(self, ids: list, texts: list[np.ndarray], vocabulary: np.ndarray, counts: np.ndarray, total: int):
        self.ids, self.texts, self.vocabulary = ids, texts, vocabulary
        share = np.log(np.maximum(counts, 1)) - np.log(max(total, 1))
        keys, items, places, strong, sizes = [], [], [], [], []
        for k, t in enumerate(texts):
            if not len(t):
                continue
            p = share[np.searchsorted(vocabulary, t)]
            taken, weak = np.zeros(len(t), bool), np.zeros(len(t), bool)
            for n in SIZES if len(t) >= SHORT else (len(t),):
                if len(t) < n:
                    break
                run = np.convolve(p, np.ones(n), "valid")
                rare = (
                    (run + np.log(max(total, 1)) <= np.log(CHANCE)) & ~taken[: len(run)]
                    if len(t) >= SHORT
                    else np.ones(1, bool)
                )
                half = (run <= np.log(WEAK)) & ~(weak | taken)[: len(run)] & ~rare
                g = grams(t, n)
                for i in np.flatnonzero(rare | half):
                    keys.append(g[i])
                    items.append(k)
                    places.append(i)
                    strong.append(rare[i])
                    sizes.append(n)
                taken[: len(run)] |= rare
                weak[: len(run)] |= half
            if not taken.any() and len(t) >= SHORT:  # nothing rare in it: its longest n-grams
                n = max(x for x in SIZES if x <= len(t))
                g = grams(t, n)
                keys += list(g)
                items += [k] * len(g)
                places += range(len(g))
                strong += [True] * len(g)
                sizes += [n] * len(g)
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys = np.array(keys, np.uint64)[order]
        self.items, self.places = np.array(items, np.int64)[order], np.array(places, np.int64)[order]
        self.strong, self.sizes = np.array(strong, bool)[order], np.array(sizes, np.int64)[order]

    def candidates(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position of a hit, seed); doc: the row of each word."""
        known = np.zeros(len(h), bool)
        if len(self.vocabulary) and len(h):
            i = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            known = self.vocabulary[i] == h
        out = []
        bad = np.concatenate(([0], np.cumsum(~known)))
        for n in SIZES:
            k = len(h) - n + 1
            if k <= 0:
                continue
            at = np.flatnonzero((bad[n : n + k] == bad[:k]) & (doc[:k] == doc[n - 1 : n - 1 + k]))
            if not len(at):
                break
            g = np.full(len(at), n, np.uint64)
            for i in range(n):
                g += h[at + i] * _C[i]
            g = mix(g)
            lo, hi = np.searchsorted(self.keys, g), np.searchsorted(self.keys, g, side="right")
            hit = np.flatnonzero(hi > lo)
            if len(hit):
                size = (hi - lo)[hit]
                pos = np.repeat(at[hit], size)
                which = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                out.append((pos, which))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z
        return tuple(np.concatenate(x) for x in zip(*out))

    def search(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(row, item, score, matched words, first word, word after the last) for every row and item
        that reach the least score; the best place of each."""
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        pos, seed = self.candidates(h, doc)
        if not len(pos):
            return
        order = np.lexsort((pos - self.places[seed], self.items[seed], doc[pos]))
        pos, seed = pos[order], seed[order]
        item, place = self.items[seed], self.places[seed]
        row, shift = doc[pos], pos - place
        slack = np.array([max(8, len(t) // 2) for t in self.texts])[item]
        new = np.concatenate(
            ([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (shift[1:] - shift[:-1] > slack[1:]))
        )
        starts = np.flatnonzero(new)
        # A strong seed, or two weak ones that don't overlap.
        enough = np.logical_or.reduceat(self.strong[seed], starts) | (
            np.maximum.reduceat(place, starts) >= np.minimum.reduceat(place + self.sizes[seed], starts)
        )
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for lo, hi, good in zip(starts.tolist(), [*starts[1:].tolist(), len(new)], enough.tolist()):
            if not good:
                continue
            d, k = int(row[lo]), int(item[lo])
            t = self.texts[k]
            m, whole = len(t), MATCH * len(t)
            a = int(shift[lo])
            if shift[hi - 1] == a and a >= first[d] and a + m <= first[d + 1] and np.array_equal(h[a : a + m], t):
                got = (1.0, m, a, a + m)
            else:
                a, b = max(int(first[d]), a - int(slack[lo])), min(
                    int(first[d + 1]), int(shift[hi - 1]) + m + int(slack[lo])
                )
                score, same, s, e = align(t, h[a:b])
                got = (score / whole, same, a + s, a + e)
            least = min(LEAST_WORDS, m) if m >= SHORT else m
            if got[0] >= LEAST_SCORE and got[1] >= least and (m >= SHORT or got[0] == 1.0):
                old = best.get((d, k))
                if old is None or (got[0], -got[2]) > (old[0], -old[2]):
                    best[d, k] = got
        for (d, k), got in best.items():
            yield d, k, *got


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and word hashes of the items, in blocks of about BLOCK_ITEMS items and BLOCK_CHARS of text. An item
    longer than a block is one by itself."""
    items = benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    size = F.length("t")
    long = size > BLOCK_CHARS
    n, chars = items.where(~long).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-2 * chars // BLOCK_CHARS))
    parts = [
        items.where(~long) if blocks == 1 else items.where(~long & (F.pmod(F.xxhash64("k"), F.lit(blocks)) == b))
        for b in range(blocks)
    ]
    for r in items.where(long).select("k").distinct().toLocalIterator():
        parts.append(items.where(long & (F.col("k") == r.k)))
    for part in parts:
        got = part.toArrow().sort_by("k")  # a block's items at most
        yield got.column("k").to_pylist(), [
            h[lo:hi] for _, h, first in words(got.column("t")) for lo, hi in zip(first[:-1], first[1:])
        ]


def matches(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, score, matched, start, end): contaminated documents by item, and the code
    points of the passage."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return reduce(
        DataFrame.unionByName,
        (
            _match_block(docs, ids, texts, benchmark.schema[item].dataType.simpleString())
            for ids, texts in _blocks(benchmark, item, item_text)
        )
    )


def _match_block(docs: DataFrame, ids: list, texts: list[np.ndarray], item_type: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint64)
    shared = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        counts, total = np.zeros(len(v) + 1, np.int64), 0
        for h in (h for b in batches for _, h, _ in words(b.column(0))):
            total += len(h)
            if len(v) and len(h):
                i = np.minimum(np.searchsorted(v, h), len(v) - 1)
                counts[: len(v)] += np.bincount(i[v[i] == h], minlength=len(v))
        counts[-1] = total
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int64()), "n": pa.array(counts[at], pa.int64())})

    # The block's words at most.
    got = docs.select("text").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(vocabulary) + 1, np.int64)
    counts[got.column("i").to_numpy()] = got.column("n").to_numpy()
    seeds = spark.sparkContext.broadcast(Seeds(ids, texts, vocabulary, counts[:-1], int(counts[-1])))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = seeds.value
        for b in batches:
            keys, done, out = b.column(0), 0, []
            for texts, h, first in words(b.column(1)):
                places: dict[int, list[re.Match]] = {}
                for d, k, score, same, lo, hi in s.search(h, first):
                    if d not in places:  # lower case moves no end of a word, so the text itself has the same ones
                        places[d] = list(_WORD.finditer(texts[d]))
                    own = places[d]
                    out.append(
                        (
                            keys[done + d].as_py(), s.ids[k], score, same, own[lo - first[d]].start(),
                            own[hi - 1 - first[d]].end()
                        )
                    )
                done += len(texts)
            if out:
                kinds = (keys.type, None, pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                    ["doc_id", "item_id", "score", "matched", "start", "end"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(find, f"doc_id {kind}, item_id {item_type}, score double, matched long, start long, end long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item; columns as before. Rows with a null id are
    judged each by itself, the others by id."""
    known = docs.where(F.col(key).isNotNull())
    bad = cut(matches(known, benchmark, key, text).select(F.col("doc_id").alias("_bad")).distinct())
    small = rows_of(bad) <= BROADCAST
    out = known.join(F.broadcast(bad) if small else bad, known[key] == bad["_bad"], "left_anti")
    # Rows without an id are told apart by a number of their own, written with them.
    number = free_name(docs, "_row")
    rest = cut(docs.where(F.col(key).isNull()).withColumn(number, F.monotonically_increasing_id()))
    if not rows_of(rest):
        return out.select(*docs.columns)
    found = cut(matches(rest, benchmark, number, text).select(F.col("doc_id").alias("_bad")).distinct())
    return (
        out.unionByName(rest.join(found, rest[number] == found["_bad"], "left_anti").select(*docs.columns))
        .select(*docs.columns)
    )
