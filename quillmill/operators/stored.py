"""Tables between the steps of iterative work, and tables laid out for look-ups by key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset only a local master goes on, in a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillmill-")
    return folder.rstrip("/")


class Steps:
    """Written tables that end the lineage; one written under a name takes the place of the one before it, which is deleted.

    Whoever still reads a table gives the next one another name.
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

    def keep_only(self, *names: str) -> None:
        for name in [n for n in self.paths if n not in names]:
            self._delete(self.paths.pop(name))

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def write_for_lookup(df: DataFrame, path: str, key: str, rows_a_group: int = 20_000) -> None:
    """df as Parquet for point look-ups: dealt out and sorted by range of the key, in small row groups with a Bloom filter each.

    The ranges' statistics leave one file's groups to look at, the filter none where the key is absent.
    """
    (
        df.repartitionByRange(key).sortWithinPartitions(key).write.option("parquet.bloom.filter.enabled#" + key, "true").option("parquet.bloom.filter.expected.ndv#" + key, str(rows_a_group))
        .option("parquet.block.row.count.limit", str(rows_a_group)).parquet(path)
    )


def looked_up(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """The rows whose key has the value, at most one if the key is unique; the equality reaches the scan."""
    return spark.read.parquet(path).where(F.col(key) == F.lit(value)).limit(1)
