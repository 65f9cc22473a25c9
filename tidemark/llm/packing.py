"""Best-fit packing (operator 9): bin completion branch-and-bound.

Documents become token pieces of at most `capacity` tokens. Packing depends only on how many
pieces there are of each length, a table of `capacity` rows at most, so the driver solves it on
that histogram whatever the size of the corpus: the largest remaining length opens a sequence, its
undominated fillings are enumerated, each is used as often as the counts allow, and branches whose
waste passes the bound of the best solution so far (at first the best-fit one) are pruned. Best
packing is NP-hard, so the search has a limit of steps; beyond it the best packing so far stands, which
holds every piece but may take more sequences than need be. The solution is a list of runs (a
pattern and how often it is used); a piece finds its place from its rank among the pieces of its
length, which window functions give.

Defined cases: a null or empty text is one piece (the end token alone); a document longer than the
capacity is cut so that all pieces but the first are full; repeated rows are packed each; an empty
table packs nothing; texts of any length are tokenised whole; an added token's content in a
text ('<|endoftext|>') is that token, as the vocabulary's own tokenizer has it; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches

CAPACITY, END = 1024, 2
#: Partial fillings that a whole search may look at, and those for one sequence of a large one.
STEPS, PARTIAL = 300_000, 200
#: Fillings of one sequence that a search by runs branches on.
FILLINGS = 4
#: Up to so many pieces sequences are decided one by one, so that the search is exact if it ends.
SINGLE = 60
#: Least number of rows aimed at for a group of pieces whose ranks one task gives; a group holds a
#: four-hundredth of all pieces at most, whatever their lengths.
GROUP, GROUPS = 100, 400


class Tokens:
    """Token ids by a vocabulary file of `tokenizers`, with a cache of words.

    Byte-level BPE merges inside pre-tokens only, and a space between two characters that are no
    white space always starts a pre-token. So the words of a text, each with the space before it,
    can be looked up one by one; unknown ones are encoded together by the faster tiktoken, from the
    same file's vocabulary. Texts with other white space around spaces, characters beyond U+00FF
    or the content of an added token go to `tokenizers` as they are, as does everything if the
    file's merges are not in the order of their ids.
    """

    MOST = 100_000
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    PLAIN = bytes([10, *range(32, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)])

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in letters} | {
            chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)
        }
        special = {t["content"] for t in spec.get("added_tokens", ())}
        self.added = tuple(special)
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        self.fast = None
        before = spec["pre_tokenizer"]
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not spec.get("normalizer")
        if plain and merged == sorted(merged):
            self.fast = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.size[i] = len(t)
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(words)), "<u4")
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        at = np.concatenate(([0], np.searchsorted(np.cumsum(self.size[ids]), ends) + 1)).tolist()
        raw = ids.tobytes()
        if len(self.known) > self.MOST:
            self.known.clear()
        for w, lo, hi in zip(words, at, at[1:]):
            self.known[w] = raw[4 * lo : 4 * hi]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        try:
            plain = (
                self.fast
                and not text.encode("latin-1").translate(None, self.PLAIN)
                and not any(x in text for x in self.added)
            )
        except UnicodeEncodeError:
            plain = False
        if not plain or not text or "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.split(" ")
        first = np.array(self.fast.encode_ordinary(words[0]), "<u4").tobytes()
        del words[0]
        got = list(map(self.known.get, words))
        if None in got:
            self._learn(list(dict.fromkeys(w for w, g in zip(words, got) if g is None)))
            own = self.known
            if not all(map(own.__contains__, words)):  # the cache was emptied
                self._learn(list(dict.fromkeys(w for w in words if w not in own)))
            got = map(own.__getitem__, words)
        return first + b"".join(got)


_tokens: dict[str, Tokens] = {}


def pieces(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end: int = END, with_ids: bool = False
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids binary]) of every document."""
    small_batches(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _tokens:
            _tokens[vocabulary] = Tokens(vocabulary)
        encode = _tokens[vocabulary].encode
        for b in batches:
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(t or "") + tail
                n = len(ids) // 4
                at, i = 0, 0
                while at < n:
                    size = (n % capacity or min(n, capacity)) if not i else capacity
                    own = ids[4 * at : 4 * (at + size)]
                    for col, x in zip(out, (k, i, at, size, zlib.crc32(own), own)):
                        col.append(x)
                    at, i = at + size, i + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)]
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    )


Run = tuple[tuple[int, ...], int]  # lengths of a sequence, largest first, and how often it is used


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best fit by decreasing length, by runs: the sequence is filled with the largest length that
    still fits, as long as one does, and repeated while the counts last."""
    left = {k: v for k, v in counts.items() if v}
    out: list[Run] = []
    while left:
        lengths, room, pattern = sorted(left), capacity, []
        i = len(lengths) - 1
        while i >= 0:
            n = min(room // lengths[i], left[lengths[i]])
            pattern += [lengths[i]] * n
            room -= n * lengths[i]
            i = min(i - 1, bisect_right(lengths, room) - 1)
        _use(left, pattern, out)
    return out


def _use(left: dict[int, int], pattern: list[int], out: list[Run]) -> int:
    need: dict[int, int] = {}
    for k in pattern:
        need[k] = need.get(k, 0) + 1
    times = min(left[k] // n for k, n in need.items())
    for k, n in need.items():
        left[k] -= n * times
        if not left[k]:
            del left[k]
    out.append((tuple(pattern), times))
    return times


class Search:
    """What a search has spent, and whether it has left anything out."""

    def __init__(self, steps: int, partial: int):
        self.steps, self.partial, self.spent, self.whole = steps, partial, 0, True


def fillings(left: dict[int, int], lengths: list[int], capacity: int, search: Search) -> Iterator[tuple[int, ...]]:
    """Undominated fillings around the largest length, larger lengths first: nothing that is left can be
    added, and no length but the first can be swapped for the next larger one that is left. lengths:
    those left, ascending. Once the search's steps for a sequence are spent, the filling at hand is
    completed by best fit and is the last."""
    stop = search.spent + search.partial

    def grow(top: int, room: int, used: dict[int, int]) -> Iterator[tuple[int, ...]]:
        # top: the largest index to go on with. Depth: the distinct lengths of one sequence.
        search.spent += 1
        i = _fitting(top, room, used, left, lengths)
        if i < 0:
            if not _swappable(used, left, lengths, room):
                yield _spelled(used)
            return
        while i >= 0:
            k = lengths[i]
            have = used.get(k, 0)
            for n in range(min(room // k, left[k] - have), 0, -1):
                if search.spent >= stop:
                    search.whole = False
                    yield _completed(i, room, used, left, lengths)
                    return
                yield from grow(i - 1, room - n * k, {**used, k: have + n})
                if search.spent >= stop:
                    search.whole = False
                    return
            i = _fitting(i - 1, room, used, left, lengths)

    yield from grow(len(lengths) - 1, capacity - lengths[-1], {lengths[-1]: 1})


def _fitting(top: int, room: int, used: dict[int, int], left: dict[int, int], lengths: list[int]) -> int:
    """The largest index up to top of a length that fits and is left; -1 if none is."""
    i = min(top, bisect_right(lengths, room) - 1)
    while i >= 0 and used.get(lengths[i], 0) >= left[lengths[i]]:
        i -= 1
    return i


def _completed(i: int, room: int, used: dict[int, int], left: dict[int, int], lengths: list[int]) -> tuple[int, ...]:
    used = dict(used)
    while i >= 0:
        k = lengths[i]
        n = min(room // k, left[k] - used.get(k, 0))
        if n > 0:
            used[k] = used.get(k, 0) + n
            room -= n * k
        i = min(i - 1, bisect_right(lengths, room) - 1)
    return _spelled(used)


def _spelled(used: dict[int, int]) -> tuple[int, ...]:
    return tuple(k for k in sorted(used, reverse=True) for _ in range(used[k]))


def _swappable(used: dict[int, int], left: dict[int, int], lengths: list[int], room: int) -> bool:
    """Whether something left can be added, or take the place of a smaller length (not the first)."""
    if room and any(used.get(k, 0) < left[k] for k in lengths[: bisect_right(lengths, room)]):
        return True
    first = lengths[-1]
    for k, n in used.items():
        if n - (k == first) > 0:
            j = bisect_right(lengths, k)
            while j < len(lengths) and lengths[j] - k <= room:
                if used.get(lengths[j], 0) < left[lengths[j]]:
                    return True
                j += 1
    return False


def _descend(
    left: dict[int, int], pattern: tuple[int, ...], runs: list[Run], single: bool
) -> tuple[dict[int, int], list[Run], int]:
    after, more = dict(left), list(runs)
    if single:
        for k in pattern:
            after[k] -= 1
            if not after[k]:
                del after[k]
        more.append((pattern, 1))
        return after, more, 1
    return after, more, _use(after, list(pattern), more)


def _options(left: dict[int, int], capacity: int, search: Search, single: bool) -> list[tuple[int, ...]]:
    """Fillings to branch on, fullest first. By runs, FILLINGS full ones are enough."""
    found: dict[tuple[int, ...], int] = {}
    full = 0
    for x in fillings(left, sorted(left), capacity, search):
        found[x] = capacity - sum(x)
        full += not found[x]
        if not single and full >= FILLINGS:
            search.whole = False
            break
    out = sorted(found, key=lambda x: (found[x], len(x), [-k for k in x]))
    if not single and len(out) > FILLINGS:
        search.whole = False
        del out[FILLINGS:]
    return out


def solve(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[Run]:
    """Runs that pack all pieces into as few sequences as search() finds."""
    return search(counts, capacity, steps)[0]


def search(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> tuple[list[Run], bool]:
    """(runs, proven): runs that pack all pieces into as few sequences as the search finds within its
    steps, and whether no packing can take fewer. Deterministic. Best fit is the first incumbent;
    a filling whose waste would bring the packing up to the incumbent's is not followed. With up to
    SINGLE pieces each sequence is decided by itself and a search that ends is exact; beyond, a
    filling is repeated as often as the counts allow, and only reaching the total length's bound is
    proof."""
    counts = {k: v for k, v in counts.items() if v}
    best = best_fit(counts, capacity)
    used = sum(n for _, n in best)
    total = sum(k * n for k, n in counts.items())
    bound = -(-total // capacity)
    if used <= bound:
        return best, True
    single = sum(counts.values()) <= SINGLE
    spending = Search(steps, steps if single else PARTIAL)
    # Depth first; every fork keeps its counts, and the steps bound how many there are.
    forks: list[tuple[dict[int, int], list[Run], int, int]] = [(counts, [], 0, 0)]
    descents = 0
    while forks and used > bound:
        if spending.spent >= steps and descents:  # the first descent is always finished
            spending.whole = False
            break
        left, runs, bins, waste = forks.pop()
        if not left:
            descents += 1
            if bins < used:
                best, used = runs, bins
            continue
        if total + waste > (used - 1) * capacity:  # can't beat the incumbent
            descents += 1
            continue
        options = _options(left, capacity, spending, single)
        for pattern in reversed(options):
            after, more, n = _descend(left, pattern, runs, single)
            lost = waste + n * (capacity - sum(pattern))
            if total + lost <= (used - 1) * capacity:
                forks.append((after, more, bins + n, lost))
            else:
                descents += 1
    return best, used <= bound or (single and spending.whole)


def pack(rows: DataFrame, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """rows of pieces with sequence_id and offset. rows must give the same rows when read again."""
    spark = rows.sparkSession
    key = [c for c in ("doc_id", "piece", "ids_crc32") if c in rows.columns]
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy("length").count().collect()}  # capacity rows at most
    most = max(GROUP, sum(counts.values()) // GROUPS)
    salts = spark.createDataFrame([(k, -(-n // most)) for k, n in counts.items()], "length long, _salts long")
    salted = rows.join(F.broadcast(salts), "length")  # a row for each length: capacity at most
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(*key), "_salts")).select(*rows.columns, "_salt")
    sizes = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    base = F.broadcast(base)  # GROUPS + capacity rows at most
    inside = Window.partitionBy("length", "_salt").orderBy(*key)
    ranked = (
        salted.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(base, ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    # For each length: from which rank on a run of a pattern holds, with its first sequence and place.
    starts: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in solve(counts, capacity, steps):
        place = 0
        for k in pattern:
            starts.setdefault(k, []).append((taken.get(k, 0), sequence, place))
            taken[k] = taken.get(k, 0) + times
            place += k
        sequence += times
    tables = {k: np.array(v, np.int64) for k, v in starts.items()}
    shared = spark.sparkContext.broadcast(tables)  # patterns of the histogram: not a matter of the corpus's size

    @F.pandas_udf("sequence_id long, offset long")
    def place_of(length, rank):
        import pandas as pd

        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for k in np.unique(n):
            own = n == k
            t = shared.value[int(k)]
            i = np.searchsorted(t[:, 0], r[own], side="right") - 1
            seq[own], off[own] = t[i, 1] + r[own] - t[i, 0], t[i, 2]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    out = ranked.withColumn("_place", place_of("length", "_rank"))
    return out.select(*rows.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """pieces() written to the shared folder, then pack()."""
    return pack(cut(pieces(docs, vocabulary, **options)), options.get("capacity", CAPACITY))
