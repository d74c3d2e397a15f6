"""What the training-data operators share: word rules, hashing, and tables in the cluster's shared folder."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six ASCII blanks; ``bytes.split()`` in Python splits on the same six.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The same word pattern inside DuckDB SQL.
SQL_WORD = r"[^\x20\x09-\x0D]+"


def word_array(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. The session names it in spark.checkpoint.dir; only where that is unset and all runs on one machine, as in tests, a local one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="seriesmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def without_leftovers(spark: SparkSession):
    """Shuffle files of what is written meanwhile go when it is written: nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


class Tables:
    """Intermediate tables of one operator run, written under the shared folder.

    A written table cuts lineage, survives lost executors and, read again, is a
    plain scan, so that a join on it can be split where a key is hot.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        self.catalog: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.top}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with without_leftovers(self.spark):
            df.write.option("compression", "zstd").parquet(self.path(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def save_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """One sorted file a bucket: later joins and groupings on ``key`` read it without another shuffle."""
        table = f"t_{uuid.uuid4().hex}"
        with without_leftovers(self.spark):
            df.repartition(buckets, key).write.option("compression", "zstd").bucketBy(buckets, key).sortBy(key).option("path", self.path(name)).saveAsTable(table)
        self.catalog[name] = table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)
            if name in self.catalog:
                self.spark.sql(f"DROP TABLE {self.catalog.pop(name)}")

    def kept(self, *prefixes: str) -> list[str]:
        """The saved tables whose names begin so."""
        return [n for n in self.names if n.startswith(prefixes)]


def row_id(df: DataFrame) -> Column | None:
    """A number for each row of a table read from files, from its file and place in it: every scan gives the same, however the files are split and whatever executors are lost. None for other tables."""
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return None
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def bit_map(df: DataFrame, key: Column, bits: int) -> DataFrame:
    """(__cell, __bits): the places among ``bits`` that whole-number keys fall on; at most bits / 64 rows for any number of keys, so it can be broadcast."""
    place = F.pmod(key, F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    return df.select(F.floor(place / 64).cast("int").alias("__cell"), one.alias("__bits")).groupBy("__cell").agg(F.bit_or("__bits").alias("__bits"))


def with_mark(df: DataFrame, key: Column, cells: DataFrame, bits: int) -> DataFrame:
    """Adds ``__maybe``: false only where no key of the map is equal."""
    place = F.pmod(key, F.lit(bits))
    there = F.call_function("shiftrightunsigned", F.col("__bits"), F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
    marked = df.withColumn("__cell", F.floor(place / 64).cast("int")).join(F.broadcast(cells), "__cell", "left")
    return marked.withColumn("__maybe", F.coalesce(there, F.lit(False))).drop("__cell", "__bits")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_hash(word: bytes) -> int:
    """64-bit BLAKE2b."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class WordHashes(dict):
    """The hash of a word, remembered; forgets all when it holds ``limit`` words, so memory is bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = word_hash(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits: similar inputs get unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k consecutive values (wrapping arithmetic); doubling keeps it at about 2 log2 k passes."""
    if len(x) < k:
        return np.empty(0, np.uint64)
    done, out, out_len = x, None, 0
    span = 1
    while True:
        if k & span:
            if out is None:
                out, out_len = done, span
            else:  # what is gathered covers the first out_len values
                n = len(x) - out_len - span + 1
                out = out[:n] + done[out_len : out_len + n] * POWERS[out_len]
                out_len += span
        span *= 2
        if span > k:
            return mixed(out)
        n = len(done) - span // 2
        done = done[:n] + done[span // 2 : span // 2 + n] * POWERS[span // 2]


with np.errstate(over="ignore"):
    POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(1023, BASE, np.uint64))])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by doubling."""
    span, done = 1, x
    while span * 2 <= w:
        done = np.minimum(done[:-span], done[span:])
        span *= 2
    rest = w - span
    return np.minimum(done[: len(done) - rest], done[rest:]) if rest else done
