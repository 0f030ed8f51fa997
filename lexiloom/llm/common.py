"""Helpers shared by the training-data operators: scratch tables, words, hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Word n-grams and the similarity used where no contract says otherwise.
SHINGLE, SIMILAR = 5, 0.8

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a local one only if unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="lexiloom-"))
    return "file://" + _own_dir[0]


#: Bytes of an Arrow batch, so that a batch of very long texts stays small in Python too.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Set the session's bound on Arrow batches to ``size`` bytes unless it is lower already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int((spark.conf.get(key, None) or "0").rstrip("b") or 0) not in range(1, size + 1):
        spark.conf.set(key, str(size))


class Scratch:
    """Intermediate tables of one call, written to the shared folder so that no lineage needs recomputing
    when an executor is lost. Tables that the result doesn't read are dropped as soon as they are used up."""

    def __init__(self, spark: SparkSession, name: str, batch: int = BATCH_BYTES):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.held: list[str] = []
        bound_batches(spark, batch)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.held.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, df: DataFrame, name: str) -> DataFrame:
        """Append to a table of several parts."""
        df.write.mode("append").parquet(f"{self.root}/{name}")
        if name not in self.held:
            self.held.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str, tidy: bool = True) -> None:
        """Delete tables, and unless told otherwise the shuffle files of finished queries."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            self.held = [x for x in self.held if x != name]
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
        if tidy:
            self.tidy()

    def tidy(self) -> None:
        """Let go of the shuffle files of finished queries: Spark deletes them once their plans are garbage, and learns that by collecting."""
        gc.collect()
        self.spark._jvm.System.gc()


    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        self.drop(*[x for x in self.held if x not in names])


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgotten all at once when they grow many, so memory is bounded."""

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * _M2
    return (x ^ (x >> np.uint64(29))) * _M1


def ngrams(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the n-word shingles in order; a shorter sequence is one shingle, an empty one none."""
    k = min(n, len(h))
    if k == 0:
        return h
    m = len(h) - k + 1
    acc = mix(h[:m] + np.uint64(k))
    for j in range(1, k):
        acc = mix(acc * _M1 + h[j : j + m])
    return acc


def lower_words(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes.lower() and split() know ASCII only."""
    return (text or b"").lower().split()


def md5_fraction(*cols) -> F.Column:
    """A uniform number in (0, 1) from the text of the columns: the same on every run and engine."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
