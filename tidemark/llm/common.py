"""What the text operators share: table reads, shared scratch tables, batch limits."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import observed


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where it is unset, one in the
    warehouse, never a temporary folder of one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor
    costs no more than one reread. rows_of() tells how many rows there were without a job. What
    discard() leaves is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch, out._rows = path, observed(seen)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return out


def rows_of(table: DataFrame) -> int:
    """How many rows a table that cut() wrote has."""
    return table._rows


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files and broadcasts of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


#: Bounds of the Arrow batches that Python workers get: long texts come in few at a time.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches. The same for every operator, so that the order in which
    queries are built does not matter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def crc_mod(key, n: int):
    """crc32 of the key as text, modulo n (native)."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(n))


_SPLIT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x + _SPLIT
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Key of the words' hash and the bytes of text that are hashed together.
_KEY, _CHUNK = "tidemark-words-1", 1 << 20


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit SipHash of each word: keyed, so that no family of words collides by construction."""
    import pandas as pd

    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), hash_key=_KEY, categorize=False)


def hashed_rows(rows: Iterable[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of texts given as their words, some texts at a time: the hashes, and for each text
    the index of its first word (one more entry than texts)."""
    words: list[bytes] = []
    first = [0]
    for own in rows:
        words += own
        first.append(len(words))
        if len(words) >= _CHUNK >> 3:
            yield hash_words(words), np.array(first)
            words, first = [], [0]
    if len(first) > 1:
        yield hash_words(words), np.array(first)


def ascii_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text between ASCII white space, with A-Z lower-cased."""
    return (text or b"").lower().split()


def as_bytes(column) -> list[bytes | None]:
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def free_name(df: DataFrame, name: str) -> str:
    """name, or the first of name_, name__, ... that df has no column of."""
    while name in df.columns:
        name += "_"
    return name


def many_to_one(many: DataFrame, one: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """many left join one, where one's column size says how many rows of many have its keys. Those of
    more than a thousandth of all rows are a thousand at most and are broadcast, so that no task
    of the shuffle gets a hot key."""
    big = F.broadcast(one.where(F.col(size) * 1000 > total))
    hot = many.join(big, keys)
    cold = many.join(big.select(*keys), keys, "left_anti").join(one.where(F.col(size) * 1000 <= total), keys, "left")
    return hot.unionByName(cold)
