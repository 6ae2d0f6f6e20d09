"""Helpers that the corpus operators share: words, hashes and shared work tables."""

from __future__ import annotations

import atexit
import ctypes
import re
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_root

GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: The six characters that separate words (the complement of a word's characters).
WHITE = " \t\n\x0b\x0c\r"
#: A worker remembers the hashes of so many different words; others are hashed each time.
REMEMBERED_WORDS = 300_000
#: Texts are taken apart in pieces of about so many characters, to bound Python's memory.
PIECE_CHARS = 1_000_000

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class WordHashes(dict):
    """64-bit hashes of words, remembered within a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED_WORDS:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def tidy(run):
    """A function on batches that gives its memory back to the machine when it is done, as
    Python workers stay for other tasks."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(32))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def pieces(column: pa.Array, limit: int = PIECE_CHARS):
    """(from, to, texts) of runs of texts with about ``limit`` bytes; one text is never cut.

    Only a run's texts are Python's strings at a time, not those of a whole batch."""
    start, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > start and size + n > limit:
            yield start, i, column.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if start < len(column):
        yield start, len(column), column.slice(start).to_pylist()


def segments(data: bytes, limit: int = PIECE_CHARS):
    """A long text in runs of about ``limit`` bytes, cut where words end."""
    at = 0
    while len(data) - at > limit:
        gap = GAP.search(data, at + limit)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def hashed_words(texts: list, hashes: WordHashes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words one after the other, and how many each text has.

    Texts of any length are taken apart in segments, so only hashes are held of all words."""
    flat, counts = [], []
    for t in texts:
        data = t.encode("utf-8", "surrogatepass") if t else b""
        n = 0
        for part in segments(data.lower() if lower else data):
            words = part.split()
            n += len(words)
            if words:
                flat.append(hashes.of(words))
        counts.append(n)
    return np.concatenate(flat) if flat else np.zeros(0, np.uint64), np.array(counts, np.int64)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode."""
    return shared_root(spark)


class Work:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    ``keep`` writes and rereads a table, ``drop`` deletes tables that nothing reads any
    more; what is left goes when the driver ends, as returned frames may be lazy.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the given tables, or without any the whole folder."""
        try:
            jvm = self.spark._jvm
            for where in [f.kept_at for f in frames] or [self.root]:
                path = jvm.org.apache.hadoop.fs.Path(where)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session has ended; the cluster clears the folder
            if frames:
                raise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession) -> int:
    """How many partitions a shuffle of the whole input should have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def components(edges: DataFrame, work: Work) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node it reaches.

    Alternates large-star and small-star steps, so a chain of n links takes about log n
    rounds; minima are combined before the shuffle and no neighbourhood is ever gathered.
    """
    edges = work.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima of nodes that have a smaller neighbour; written, so that a hub's links can be
        # split among tasks when they meet their minimum.
        least = work.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).where("m < node"), "minima")
        large = edges.join(least, F.col("b") == F.col("node"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.when(F.col("b") == F.col("m"), F.array(F.struct("a", F.col("m").alias("b")))).otherwise(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).alias("e")).select("e.*").where("a <> b").distinct()
        new = work.keep(small, "links")
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first()
        work.drop(edges, least)
        edges = new
        if seen == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = seen
