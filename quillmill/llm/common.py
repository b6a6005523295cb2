"""What the corpus operators share: inputs, the shared scratch folder, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only word separators of the contracts.
SPACE = r"[\x20\x09-\x0D]"

_own_scratch: str | None = None


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset only a local master may go on (tests), in a temporary folder."""
    global _own_scratch
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_scratch is None:
        _own_scratch = tempfile.mkdtemp(prefix="quillmill-")
    return _own_scratch


class Tables:
    """The Parquet tables between the steps of one operator, in the shared folder: they cut the lineage and survive lost executors.

    A name that is written again replaces its table once the new one stands. What a returned frame reads stays.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{scratch(spark)}/quillmill-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, before = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}", self.paths.get(name)
        df.write.parquet(path)
        self.paths[name] = path
        if before:
            self._delete(before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            if path := self.paths.pop(name, None):
                self._delete(path)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*[n for n in self.paths if n not in names])
        if not self.paths:
            self._delete(self.folder)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table of its own in the shared folder."""
    return Tables(df.sparkSession).write(df, name)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds the rows of Arrow batches for what this session runs: texts can be very long, and a batch is held whole on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def gathered(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about most_bytes each; a larger row is a batch of its own with what stands before it."""
    held, size = [], 0
    for batch in batches:
        start = 0
        while start < len(batch):
            n = len(batch) - start
            while n > 1 and batch.slice(start, n).nbytes > most_bytes:
                n = -(-n // 2)
            part = batch.slice(start, n)
            held.append(part)
            size += part.nbytes
            start += n
            if size >= most_bytes:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for the words seen lately; at most `most` of them."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, by its first word; equal runs have equal hashes wherever they stand."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mixed(words) * _powers(_P, len(words)), out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * _powers(_P_INVERSE, len(words) - n + 1))
