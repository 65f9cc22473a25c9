"""N-gram Jaccard join (operator 5): exact links between documents whose sets of 5-word shingles have
a Jaccard similarity of at least 75 %, and the components of those links.

1. Every text's shingle hashes are written once, sorted. Documents with equal sets form a class (by
   size and two 64-bit sums of the hashes); one row stands for it, so copies cost one aggregation.
2. A pair of sizes a <= b with the similarity shares a shingle within the first
   b - ceil(3b/4) + 1 shingles of the larger set and the first a - ceil(6a/7) + 1 of the smaller
   one, in any total order of all shingles. The order is by hash, frequent shingles last. A
   shingle is frequent if more than HOT sets hold it among the shingles that were counted: at first
   about a third of each set, then all of those sets whose prefix reaches beyond that, until no
   prefix holds a shingle that was not counted. So only documents made of frequent
   shingles nearly whole have any in their prefixes.
3. Members of one prefix shingle meet in tiles: of neighbouring size bands (sizes in the ratio
   3:4), and of at most TILE x TILE members. A rare shingle's members are one tile, which
   the JVM expands. Members of a frequent shingle are first compared with its group's most central
   member; those that this leaves in different components meet in tiles by blocks.
4. Every pair of a tile is bounded from above by hashed parity bitmaps (sizes less the count of
   differing bits, halved); survivors are decided by exact intersection of sorted arrays,
   first one link a document and then only the pairs that would still join two components.

Words are hashed with keyed SipHash and shingles with a mix of five of those, 64 bits each. Sets are
compared by these hashes: with n distinct shingles in a corpus, about n * n / 2^65 pairs of them are
taken for one (0.7 for the 5e9 of 30 GB), and one such pair moves an intersection by one.

Defined cases: a null text or one without words has no shingle and links with nothing; one of fewer
than five words has its whole sequence as its shingle; repeated rows are copies of each other; rows
of one id with different texts are documents of their own; a row with a null id takes the component
of the documents of its set and is no link between others; texts of any length are taken whole; an
empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, ascii_words, cut, free_name, hashed_rows, many_to_one, mix, release, rows_of, small_batches

WORDS, NUM, DEN = 5, 75, 100
#: A shingle is frequent if more sets than this hold it among the counted shingles.
HOT = 32
TILE = 512
#: Most ids or shingles that are broadcast (8 bytes each); beyond it the same step is a shuffled join.
BROADCAST = 500_000
#: Most edges whose components one task finds; beyond it they are found by rounds of joins.
EDGES = 2_000_000
_A = [
    np.uint64(x)
    for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)
]

# Shingle sets


def shingle_sets(column) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of an Arrow column."""
    for h, first in hashed_rows(map(ascii_words, as_bytes(column))):
        n = max(0, len(h) - WORDS + 1)
        s = np.zeros(n, np.uint64)
        for k, a in enumerate(_A):
            s += h[k : k + n] * a
        s = mix(s)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= WORDS:
                yield np.unique(s[lo : hi - WORDS + 1])
            elif hi > lo:
                total = np.sum(h[lo:hi] * np.array(_A[: hi - lo]), dtype=np.uint64)
                yield mix(np.array([total + np.uint64(hi - lo)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _sets(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, d1, d2, shingles): every row's sorted set, its size and two sums of it."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column("text")))
            with np.errstate(over="ignore"):
                d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                d2 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            raw = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("row"),
                    b.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(d1),
                    pa.array(d2),
                    raw
                ],
                ["row", "doc_id", "n", "d1", "d2", "shingles"],
            )

    return docs.mapInArrow(run, "row long, doc_id long, n long, d1 long, d2 long, shingles binary")


def _prefix(n: int) -> int:
    return n + NUM * n // -DEN + 1 if n else 0


def _counted(n: int) -> int:
    """How many shingles of a set are counted at first: its prefix and some more."""
    k = _prefix(n)
    return min(n, k + max(8, k // 4))


def _late(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which members of a sorted set are in the sorted array hot."""
    if not len(hot):
        return np.zeros(len(s), bool)
    i = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    return hot[i] == s


def _reaches(s: np.ndarray, hot: np.ndarray) -> bool:
    """Whether a set's prefix, hot shingles last, reaches beyond the shingles counted at first."""
    k = _counted(len(s))
    return k < len(s) and k - int(_late(s[:k], hot).sum()) < _prefix(len(s))


def _tokens(own: DataFrame, pick, fields: str) -> DataFrame:
    """Rows that pick(node, set) gives as a dict of arrays, for every set."""
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [
                pick(k, np.frombuffer(raw, np.uint64))
                for k, raw in zip(b.column("node").to_pylist(), b.column("shingles").to_pylist())
            ]
            got = [x for x in got if x is not None]
            if got:
                yield pa.RecordBatch.from_pydict({c: pa.array(np.concatenate([x[c] for x in got])) for c in names})

    return own.select("node", "shingles").mapInArrow(run, fields)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _frequent(tokens: DataFrame) -> DataFrame:
    return cut(tokens.groupBy("token").count().where(F.col("count") > HOT).select("token"))


def _broadcast(hot: DataFrame) -> np.ndarray:
    """A checked number of frequent shingles, sorted."""
    return np.sort(hot.toArrow().column(0).to_numpy().view(np.uint64))


def _prefixes(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, node, n, lead) of the prefix of every set: rare shingles, and the frequent ones. lead marks
    the part that the smaller set of a pair needs."""
    spark = own.sparkSession
    hot = _frequent(_tokens(own, lambda _, s: {"token": _signed(s[: _counted(len(s))])}, "token long"))
    if rows_of(hot) > BROADCAST:
        return _prefixes_by_join(own)
    known, before = _broadcast(hot), np.zeros(0, np.uint64)
    while len(known) > len(before):
        shared = spark.sparkContext.broadcast((known, before))

        def rest(_, s, shared=shared):
            now, old = shared.value
            if _reaches(s, now) and not _reaches(s, old):
                return {"token": _signed(s[_counted(len(s)) :])}

        more = _frequent(_tokens(own, rest, "token long"))
        if rows_of(more) > BROADCAST:
            return _prefixes_by_join(own)
        before, known = known, np.union1d(known, _broadcast(more))
    shared = spark.sparkContext.broadcast(known)

    def pick(node, s, frequent):
        late = _late(s, shared.value)
        k, rare = _prefix(len(s)), np.flatnonzero(~late)
        take = np.flatnonzero(late)[: k - len(rare)] if frequent and len(rare) < k else rare[: 0 if frequent else k]
        if len(take):
            place = np.arange(len(take)) + (len(rare) if frequent else 0)
            return {
                "token": _signed(s[take]),
                "node": np.full(len(take), node, np.int64),
                "n": np.full(len(take), len(s), np.int64),
                "lead": place < len(s) // 7 + 1
            }

    fields = "token long, node long, n long, lead boolean"
    rare, frequent = (_tokens(own, lambda k, s, f=f: pick(k, s, f), fields) for f in (False, True))
    return rare, cut(frequent)


def _prefixes_by_join(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As _prefixes, with more frequent shingles than are broadcast: all shingles are counted."""
    every = _tokens(own, lambda k, s: {"token": _signed(s), "node": np.full(len(s), k, np.int64)}, "token long, node long")
    counts = every.groupBy("token").count().where(F.col("count") > HOT).select("token", F.lit(True).alias("hot"))
    rows = every.join(counts, "token", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    # Sorted like the unsigned hashes of the other way; any order would do.
    place = F.struct(F.col("hot"), (F.col("token") < 0).alias("high"), F.col("token"))
    sets = rows.groupBy("node").agg(F.array_sort(F.collect_list(place)).alias("s"))  # one set a row: a document's own
    n = F.size("s").cast("long")
    first = F.slice("s", F.lit(1), (n - F.ceil(n * NUM / DEN) + 1).cast("int"))
    flat = sets.select("node", n.alias("n"), F.posexplode(first).alias("pos", "x"))
    lead = (F.col("pos") < F.floor(F.col("n") / 7) + 1).alias("lead")
    out = cut(flat.select(F.col("x.token").alias("token"), "node", "n", lead, F.col("x.hot").alias("hot")))
    return out.where("not hot").drop("hot"), cut(out.where("hot").drop("hot"))


# Candidate pairs

_PAIR = "a long, b long"


def _pairs(rare: DataFrame) -> DataFrame:
    """Distinct (a, b) of the tiles of rare shingles. A group has few members: each count of
    _prefixes admits HOT of them at most. Dealt out as plain rows, as most shingles have one member."""
    groups = rare.repartition("token").groupBy("token").agg(F.collect_list(F.struct("n", "node", "lead")).alias("g"))
    groups = groups.where((F.size("g") > 1) & F.exists("g", lambda x: x["lead"]))

    def follows(x, y):
        return ((x["n"] < y["n"]) | ((x["n"] == y["n"]) & (x["node"] < y["node"]))) & (x["n"] * DEN >= y["n"] * NUM)

    def pairs_of(x):
        pair = lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"))
        return F.transform(F.filter("g", lambda y: follows(x, y)), pair)

    every = F.flatten(F.transform(F.filter("g", lambda x: x["lead"]), pairs_of))
    return groups.select(F.explode(every).alias("p")).select("p.*").distinct()


def _stars(hot: DataFrame) -> DataFrame:
    """Pairs of each member of a frequent shingle with the member that has the largest share of
    frequent shingles in its prefix."""
    share = hot.groupBy("node").agg((F.count("*") / F.max("n")).alias("share"))
    best = F.max(F.struct(F.col("share"), (-F.col("node")).alias("first"), F.col("n")))
    centre = (
        hot.join(share, "node")
        .groupBy("token")
        .agg(best.alias("c"))
        .select("token", (-F.col("c.first")).alias("b"), F.col("c.n").alias("nb"))
    )
    near = F.least("n", "nb") * DEN >= F.greatest("n", "nb") * NUM
    star = hot.join(_small(centre), "token").where((F.col("node") != F.col("b")) & near)
    swap = (F.col("n") > F.col("nb")) | ((F.col("n") == F.col("nb")) & (F.col("node") > F.col("b")))
    one = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    return star.select(one("node", "b", "a"), one("b", "node", "b")).distinct()


def _small(df: DataFrame) -> DataFrame:
    """df, written, with a broadcast hint if it is small enough."""
    df = cut(df)
    return F.broadcast(df) if rows_of(df) <= BROADCAST else df


def _tiles(own: DataFrame, hot: DataFrame, labels: DataFrame | None) -> DataFrame | None:
    """Pairs that the bitmaps leave possible among members of frequent shingles' groups that are in
    different components: tiles of at most about TILE x TILE members of neighbouring size
    bands. Groups with a member in common make one, so that a member is there once."""
    rows = hot
    if labels is not None:
        rows = rows.join(labels, "node", "left")
    else:
        rows = rows.withColumn("component", F.lit(None).cast("long"))
    rows = rows.withColumn("component", F.coalesce("component", "node"))
    mixed = (
        rows.groupBy("token")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("b"))
        .where("lo <> hi")
    )
    rows = cut(rows.join(_small(mixed.select("token", "b")), "token"))
    if not rows_of(rows):
        return None
    groups = components(rows.select(F.col("node").alias("a"), "b")).withColumnRenamed("component", "group")
    rows = rows.groupBy("node", "n", "component").agg(F.max("lead").alias("lead")).join(groups, "node")
    rows = cut(rows.join(_bitmaps(own), "node").withColumn("band", F.floor(F.log("n") / F.log(F.lit(4 / 3)))))
    sizes = rows.groupBy("group", "band").count().groupBy("group").agg(F.ceil(F.max("count") / TILE).alias("blocks"))
    rows = rows.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    # A member goes to the tiles of its block with every block of its own band and, as the smaller
    # set, of the two above (a ratio of 4/3 reaches no further).
    member = ["node", "n", "component", "bits"]
    every = F.explode(F.expr("sequence(0L, blocks - 1)"))
    low = rows.where("lead").withColumn("y", F.explode(F.expr("sequence(band, band + 2)"))).withColumn("j", every)
    low = low.select("group", F.col("band").alias("x"), "y", F.col("block").alias("i"), "j", *member)
    high = rows.withColumn("x", F.explode(F.expr("sequence(band - 2, band)"))).withColumn("i", every)
    high = high.select("group", "x", F.col("band").alias("y"), "i", F.col("block").alias("j"), *member)
    high = high.select(*(F.col(c).alias(c) for c in high.columns))  # columns of its own: both sides come from rows
    keys = ["group", "x", "y", "i", "j"]

    def run(p, q):
        import pandas as pd

        out = []
        if len(p) and len(q):
            qn, qc, qr = q.n.to_numpy(), q.component.to_numpy(), q.node.to_numpy()
            other = [_sized(x)[1] for x in q.bits]
            for r, n, c, raw in zip(p.node, p.n, p.component, p.bits):
                mine = _sized(raw)[1]
                for k in np.flatnonzero((qc != c) & (n * DEN >= qn * NUM) & ((qn > n) | ((qn == n) & (qr > r)))):
                    diff = differing(mine, other[k])
                    if _similar((n + qn[k] - diff) // 2, n, qn[k]):
                        out.append((r, qr[k], diff))
        return pd.DataFrame(out, columns=["a", "b", "diff"], dtype="int64")

    return cut(low.groupBy(*keys).cogroup(high.groupBy(*keys)).applyInPandas(run, _PAIR + ", diff long").distinct())


# Deciding pairs


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap of a set: bit h mod width is the parity of its members there. The width is a
    power of two of at least twice the set's size, so that a wide map folds onto a narrow one."""
    width = max(64, 1 << (2 * len(s) - 1).bit_length())
    bits = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """At most the size of the symmetric difference of the two sets (bitmaps as bytes)."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _bitmaps(own: DataFrame) -> DataFrame:
    """(node, bits): the set's size in eight bytes, then its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [
                (len(raw) // 8).to_bytes(8, "little") + bitmap(np.frombuffer(raw, np.uint64))
                for raw in b.column("shingles").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(bits, pa.binary())], ["node", "bits"])

    return own.select("node", "shingles").mapInArrow(run, "node long, bits binary")


def _sized(bits: bytes) -> tuple[int, np.ndarray]:
    return int.from_bytes(bits[:8], "little"), np.frombuffer(bits, np.uint8, offset=8)


def _similar(both: int, na: int, nb: int) -> bool:
    return both > 0 and DEN * both >= NUM * (na + nb - both)


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs (written) with the column of either end. Up to BROADCAST pairs are sent to the table, so that
    only the rows of their ends are shuffled."""
    few = rows_of(pairs) <= BROADCAST
    if few:
        keys = F.broadcast(pairs.select("a", "b"))
        a = table.join(keys, table["node"] == keys["a"]).select("a", "b", F.col(column).alias(f"{column}_a"))
        b = table.join(keys, table["node"] == keys["b"]).select("a", "b", F.col(column).alias(f"{column}_b"))
        return a.join(b, ["a", "b"])
    out = pairs.select("a", "b")
    for end in ("a", "b"):
        out = out.join(table.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}")), end)
    return out


def _bounded(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, diff) of the pairs that the bitmaps leave possible, with the least possible difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, diff = [], []
            for i, (x, y) in enumerate(zip(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist())):
                (nx, x), (ny, y) = _sized(x), _sized(y)
                d = differing(x, y)
                if _similar((nx + ny - d) // 2, nx, ny):
                    keep.append(i)
                    diff.append(d)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("a").take(rows), b.column("b").take(rows), pa.array(diff, pa.int64())], ["a", "b", "diff"]
            )

    both = _both(pairs, _bitmaps(own), "bits").select("a", "b", "bits_a", "bits_b")
    return cut(both.mapInArrow(run, _PAIR + ", diff long"))


def _exact(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links (a, b) among pairs, by intersection of sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (p, q) in enumerate(zip(b.column("shingles_a").to_pylist(), b.column("shingles_b").to_pylist())):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                if _similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], ["a", "b"])

    both = _both(pairs, own, "shingles").select("a", "b", "shingles_a", "shingles_b")
    return cut(both.mapInArrow(run, _PAIR))


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """pairs whose ends are in different components."""
    if labels is None:
        return pairs
    for end in ("a", "b"):
        mine = labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        pairs = pairs.join(mine, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs.where("ca <> cb").drop("ca", "cb")


def _links(own: DataFrame, pairs: DataFrame, links: DataFrame | None, labels: DataFrame | None):
    """More links, and the components, from pairs (a, b, diff) that may be similar: first, for each
    document, the pair that looks closest; then whatever still joins two components."""
    ends = (
        pairs.select(F.col("a").alias("end"), *pairs.columns)
        .unionByName(pairs.select(F.col("b").alias("end"), *pairs.columns))
    )
    first = cut(ends.groupBy("end").agg(F.min(F.struct("diff", "a", "b")).alias("p")).select("p.a", "p.b").distinct())
    for step in (0, 1):
        some = first if not step else cut(_apart(pairs.select("a", "b").join(first, ["a", "b"], "left_anti"), labels))
        if rows_of(some):
            found = _exact(own, some)
            links = found if links is None else links.unionByName(found)
            labels = cut(components(links))
    return links, labels


# Components


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of edges: labels pass along edges, and chains are halved."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return nodes, nodes[root]
        x, y = x[apart], y[apart]
        low, high = np.minimum(rx[apart], ry[apart]), np.maximum(rx[apart], ry[apart])
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component): the smallest node that (a, b) edges reach, for every node of an edge. Up to
    EDGES of them one task does it, beyond that rounds of large and small stars."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if rows_of(edges) > (EDGES if most is None else most):
        return _star_components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if got:
            nodes, labels = union_find(np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))
            for i in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_pydict({"node": nodes[i : i + (1 << 16)], "component": labels[i : i + (1 << 16)]})

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


def _star_components(edges: DataFrame) -> DataFrame:
    """Large and small stars in turn; every round is written, so that lineage stays short."""
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        before = now


# The join


def _representatives(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, shingles): the one row of each class that stands for it."""
    own = sets.where("n > 0 and doc_id is not null")
    spare = cut(own.select("row").join(classes.select(F.col("node").alias("row")), "row", "left_anti"))
    few = rows_of(spare) <= BROADCAST
    own = own.join(F.broadcast(spare) if few else spare, "row", "left_anti").select(F.col("row").alias("node"), "shingles")
    return own if few else cut(own)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for every row of docs."""
    spark, row = docs.sparkSession, F.monotonically_increasing_id().alias("row")
    sets = cut(_sets(docs.select(row, F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))))
    same = ["n", "d1", "d2"]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row")))
    classes = sets.where("n > 0").groupBy(*same).agg(first.alias("first"), F.count("*").alias("members"))
    classes = cut(
        classes.select(*same, "members", F.col("first.row").alias("node"), F.col("first.doc_id").alias("least"))
        .where("node is not null")
    )
    own = _representatives(sets, classes)
    rare, hot = _prefixes(own)
    links = labels = None
    some_hot = rows_of(hot) > 0
    pairs = _pairs(rare)
    release(spark)
    pairs = cut(pairs.unionByName(_stars(hot)).distinct() if some_hot else pairs)
    release(spark)
    if rows_of(pairs):
        links, labels = _links(own, _bounded(own, pairs), links, labels)
    if some_hot:
        pairs = _tiles(own, hot, labels)
        if pairs is not None:
            links, labels = _links(own, pairs, links, labels)
    total = rows_of(sets)
    if labels is None:
        names = classes.withColumn("component_id", F.col("least"))
    else:
        named = labels.join(classes.select("node", "least"), "node")
        least = cut(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")))
        named = many_to_one(labels, least, ["component"], "nodes", total).select("node", "component_id")
        names = classes.join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", "least"))
    names = cut(names.select(*same, "members", "component_id"))
    out = many_to_one(sets.select("doc_id", *same), names, same, "members", total)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: the one of the smallest id; of several rows of that
    id the one whose text sorts first. Documents without words and rows with a null id stay, and an id
    with several texts goes only if each is in a component of a smaller id."""
    found = cut(join(docs, key, text))
    release(docs.sparkSession)
    stays = F.max((F.col("component_id") == F.col("doc_id")).cast("int"))
    gone = cut(
        found.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(stays.alias("_stays"))
        .where("_stays = 0")
        .select(F.col("doc_id").alias("_gone"))
    )
    out = docs.join(
        F.broadcast(gone) if rows_of(gone) <= BROADCAST else gone,
        docs[key].cast("long") == gone["_gone"],
        "left_anti"
    )
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if twice.isEmpty():
        return out.select(*docs.columns)
    rank = free_name(docs, "_rank")
    order = Window.partitionBy(key).orderBy(F.col(text).asc_nulls_last(), F.xxhash64(*docs.columns))
    return (
        out.withColumn(rank, F.row_number().over(order))
        .where((F.col(rank) == 1) | F.col(key).isNull())
        .select(*docs.columns)
    )
