"""Exact top-k search (operator 7) by inner product with multi-resolution segment statistics.

Every vector has the sum and the spread (square root of the summed squared differences from the
mean) of its segments at several resolutions. For one segment, the inner product is at most
mean * mean * length + spread * spread (Cauchy-Schwarz), so that the squared distance
|q|^2 + |x|^2 - 2<q, x> has a lower bound from means and deviations alone; as the norms are known,
the code compares the upper bounds of <q, x> themselves.

Candidates are dealt to regions around pivots, and a region to cells of CANDIDATES rows by a hash.
A query meets one cell of its own region first, which gives it a threshold, its k-th best score
there. Then it goes to the cells of every region whose statistics (least and largest mean and largest
spread of each segment) leave room for that score. Within a cell the same is asked of single
candidates, coarse to fine, and survivors get their exact score. Candidates are shuffled to their cells once
(one cell a region twice, for the thresholds), and queries once for each cell they may find something in; a cell's candidates are held by one task and
its queries stream past them. Pivots say where rows lie, never whether they are compared.

Rows equal in id and vector are counted first and go on k times at most, as no more can be among k.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part;
vectors of different lengths are compared over the shorter length; a query is never its own
candidate (rows that repeat its id are not candidates either); every row counts, so that repeated
rows of one id, of equal vectors or not, are candidates each, and those of a query's id share its k
places; components and scores beyond the range of a long count as its end; ties go to the smaller
id; fewer candidates give fewer rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches

#: Candidates of a cell and components they may have together: bounds of what one task holds.
CANDIDATES, COMPONENTS = 16_384, 1 << 22
#: Queries that are compared with a cell at once, and regions at most.
QUERIES, PIVOTS = 128, 1024
LEVELS = (4, 16)
_LOW, _HIGH = -(2.0**63), 2.0**63


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id long, v array<double>) with components floor(scale * x); those that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("double")).alias("v"))


def matrix(v: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows, filled up with zeros, which add nothing to a product."""
    sizes = np.asarray(v.value_lengths(), np.int64)
    out = np.zeros((len(v), width))
    out[np.arange(width) < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    return out


def segments(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means times root length, and spreads, of n segments of the rows of x."""
    at = np.unique(np.linspace(0, x.shape[1], n + 1).astype(int)[:-1])
    size = np.diff(np.append(at, x.shape[1]))
    total, squares = np.add.reduceat(x, at, axis=1), np.add.reduceat(x * x, at, axis=1)
    mean = total / np.sqrt(size)
    return mean, np.sqrt(np.maximum(squares - mean * mean, 0.0))


def levels_of(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [segments(x, n) for n in LEVELS if n < x.shape[1]] or [segments(x, 1)]


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def slack(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """More than rounding can do to a product or bound of rows with these norms."""
    return 1e-9 * np.multiply.outer(q, c) + 1e-6


def _long(x: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, x))


class Cell:
    """Candidates that queries are compared with, and their segment statistics."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.norms, self.levels = ids, x, norms(x), levels_of(x)
        self.top = float(np.abs(x).max(initial=0.0))

    def search(
        self, ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows of q, candidate ids, scores) of each query's k best candidates that reach least, and
        least raised to the k-th best score. Exact: integers below 2^53 in total are exact in
        doubles, others are multiplied as Python's."""
        exact = self.top * float(np.abs(q).max(initial=0.0)) * q.shape[1] < 2**53
        alive = ids[:, None] != self.ids
        qn = norms(q)
        columns = np.arange(len(self.ids))
        for (qm, qs), (cm, cs) in zip(levels_of(q), self.levels):
            bound = np.clip(qm @ cm[columns].T + qs @ cs[columns].T, _LOW, _HIGH)
            alive = alive & (bound + slack(qn, self.norms[columns]) >= least[:, None])
            kept = np.flatnonzero(alive.any(axis=0))
            alive, columns = alive[:, kept], columns[kept]
        near = np.clip(q @ self.x[columns].T, _LOW, _HIGH)
        off = 0.0 if exact else slack(qn, self.norms[columns]) + 4096.0  # doubles near 2^63 lie 2048 apart
        if len(columns) >= k:
            low = np.where(alive, near - off, -np.inf)
            least = np.maximum(least, np.partition(low, len(columns) - k, axis=1)[:, len(columns) - k])
        rows, at = np.nonzero(alive & (near + off >= least[:, None]))
        if exact:
            score = near[rows, at].astype(np.int64)
        else:
            whole = lambda v: [int(a) for a in v]
            score = np.array(
                [_long(sum(a * b for a, b in zip(whole(q[i]), whole(self.x[j])))) for i, j in zip(rows, columns[at])],
                np.int64
            )
        found = self.ids[columns[at]]
        order = np.lexsort((found, ~score, rows))  # ~score falls as score rises, and cannot overflow
        rows, found, score = rows[order], found[order], score[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return rows[best], found[best], score[best], least


def _batch(schema: str, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), [x.split(" ")[0] for x in schema.split(", ")])


class Regions:
    """Pivots and, once summarised, the cells and the segment statistics of the candidates around them."""

    def __init__(self, pivots: np.ndarray, width: int, rows: int):
        self.pivots, self.width, self.rows = pivots, width, rows
        self.half = (pivots * pivots).sum(axis=1) / 2

    def nearest(self, v: Column) -> Column:
        half, pivots, width = self.half, self.pivots, self.width

        @F.arrow_udf("int")
        def near(v: pa.Array) -> pa.Array:
            return pa.array(np.argmin(half - matrix(v, width) @ pivots.T, axis=1).astype(np.int32))

        return near(v)

    def summarise(self, candidates: DataFrame) -> None:
        """Count each region and bound its segments: one row a region and task, merged natively."""
        width = self.width
        schema = "pivot int, n long, norm double, low array<double>, high array<double>, spread array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, list] = {}
            for b in batches:
                x, pivot = matrix(b.column(1), width), np.asarray(b.column(0))
                mean, spread = (np.hstack(s) for s in zip(*levels_of(x)))
                norm = norms(x)
                for p in np.unique(pivot):
                    own = pivot == p
                    new = [
                        int(own.sum()), norm[own].max(), mean[own].min(axis=0), mean[own].max(axis=0),
                        spread[own].max(axis=0)
                    ]
                    old = seen.get(p)
                    merge = (int.__add__, max, np.minimum, np.maximum, np.maximum)
                    seen[p] = new if old is None else [f(a, b) for f, a, b in zip(merge, old, new)]
            if seen:
                n, norm, low, high, spread = zip(*seen.values())
                lists = [pa.array([list(map(float, r)) for r in x], pa.list_(pa.float64())) for x in (low, high, spread)]
                yield _batch(
                    schema,
                    pa.array(list(seen), pa.int32()),
                    pa.array(n, pa.int64()),
                    pa.array(map(float, norm), pa.float64()),
                    *lists
                )

        parts = candidates.select("pivot", "v").mapInArrow(run, schema)
        size = sum(m.shape[1] for m, _ in levels_of(np.zeros((1, width))))
        each = lambda f, name: F.array(*(f(F.col(name)[i]) for i in range(size))).alias(name)
        merged = parts.groupBy("pivot").agg(
            F.sum("n").alias("n"), F.max("norm").alias("norm"), each(F.min, "low"), each(F.max, "high"),
            each(F.max, "spread")
        )
        found = merged.orderBy("pivot").collect()  # a row a region
        self.at = np.array([r.pivot for r in found], np.int64)
        self.cells = {r.pivot: -(-r.n // self.rows) for r in found}
        self.norm, self.low, self.high, self.spread = (
            np.array([r[x] for r in found]) for x in ("norm", "low", "high", "spread")
        )

    def promising(self, q: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
        """For each query the regions that may hold a candidate of at least that score."""
        alive = np.ones((len(q), len(self.at)), bool)
        start, room = 0, slack(norms(q), self.norm)
        for mean, spread in levels_of(q):
            own = slice(start, start + mean.shape[1])
            bound = (
                np.maximum(mean, 0) @ self.high[:, own].T
                + np.minimum(mean, 0) @ self.low[:, own].T
                + spread @ self.spread[:, own].T
            )
            alive &= np.clip(bound, _LOW, _HIGH) + room >= least[:, None]
            start += mean.shape[1]
        return [self.at[row] for row in alive]


def meet(candidates: DataFrame, queries: DataFrame, width: int, k: int, schema: str, out) -> DataFrame:
    """Every cell's queries stream past its candidates; out(cell or None, ids, v, q, least) gives a batch."""
    lay = lambda df, kind, least: df.select(
        "pivot", "cell", F.lit(kind).alias("kind"), "vec_id", "v", least.alias("least")
    )
    both = lay(candidates, 0, F.lit(None).cast("double")).unionByName(lay(queries, 1, F.col("least")))
    both = both.repartition("pivot", "cell").sortWithinPartitions("pivot", "cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
            for b in batches:
                where = np.stack([np.asarray(b.column(i)) for i in range(3)])
                edges = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1
                for s, e in zip([0, *edges], [*edges, b.num_rows]):
                    if e > s:
                        yield (int(where[0, s]), int(where[1, s])), int(where[2, s]), b.slice(s, e - s)

        for _, own in groupby(pieces(), key=lambda x: x[0]):
            held, cell = [], None
            for _, kind, b in own:
                ids, x = np.asarray(b.column(3)), matrix(b.column(4), width)
                if kind == 0:
                    held.append((ids, x))
                    continue
                if held:
                    cell, held = Cell(*map(np.concatenate, zip(*held))), []
                for s in range(0, len(ids), QUERIES):
                    part = slice(s, s + QUERIES)
                    yield out(cell, ids[part], b.column(4)[part], x[part], np.asarray(b.column(5))[part])

    return both.mapInArrow(run, schema)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): both inputs as from quantised()."""
    spark = candidates.sparkSession
    small_batches(spark)
    sizes = [df.agg(F.count("*"), F.max(F.size("v"))).first() for df in (queries, candidates)]
    if not sizes[0][0] or not sizes[1][0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(s[1] for s in sizes)
    rows = max(1, min(CANDIDATES, COMPONENTS // width))
    some = min(PIVOTS, max(1, COMPONENTS // width), max(1, sizes[1][0] // rows))
    sample = candidates.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").select("v").limit(some).toArrow()
    regions = Regions(matrix(sample.column("v").combine_chunks(), width), width, rows)

    def placed(df: DataFrame) -> DataFrame:
        copies = F.array_repeat(F.lit(0), F.least("count", F.lit(k)).cast("int"))
        once = df.groupBy("vec_id", "v").count().select("vec_id", "v", F.explode(copies)).drop("col")
        return cut(once.withColumn("pivot", regions.nearest(F.col("v"))))

    queries, candidates = placed(queries), placed(candidates)
    regions.summarise(candidates)
    cells = F.broadcast(spark.createDataFrame(list(regions.cells.items()), "pivot int, cells long"))
    cell = F.pmod(F.xxhash64("vec_id", "v"), F.col("cells"))
    candidates = candidates.join(cells, "pivot").select("pivot", cell.alias("cell"), "vec_id", "v")
    doubles = lambda x: pa.array(x, pa.float64())
    longs = lambda x: pa.array(x, pa.int64())

    thresholds = "vec_id long, v array<double>, least double, near array<long>"

    def first(cell: Cell | None, ids, v, q, least) -> pa.RecordBatch:
        if cell is not None:
            least = cell.search(ids, q, least, k)[3]
        near = pa.array(regions.promising(q, least), pa.list_(pa.int64()))
        return _batch(thresholds, longs(ids), v, doubles(least), near)

    start = queries.select("pivot", F.lit(0).cast("long").alias("cell"), "vec_id", "v", F.lit(float("-inf")).alias("least"))
    known = meet(candidates.where("cell = 0"), start, width, k, thresholds, first)
    sent = (
        known.select("vec_id", "v", "least", F.explode("near").alias("pivot"))
        .withColumn("pivot", F.col("pivot").cast("int"))
    )
    sent = sent.join(cells, "pivot").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))

    hits = "query_id long, vec_id long, score long"

    def second(cell: Cell | None, ids, v, q, least) -> pa.RecordBatch:
        if cell is None:
            return _batch(hits, longs([]), longs([]), longs([]))
        at, found, score, _ = cell.search(ids, q, least, k)
        return _batch(hits, longs(ids[at]), longs(found), longs(score))

    found = meet(candidates, sent, width, k, hits, second)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
