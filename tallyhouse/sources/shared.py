"""Tables kept in the folder that every executor can reach."""

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F
from pyspark.sql.types import StructType


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
# Whether an execution's shuffle files go when it ends; otherwise they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Shares of a table are at least of this size.
SHARE_BYTES = 64 << 20


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of one write."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def share_count(most: int, *tables: DataFrame) -> int:
    """In how many shares to go through these tables, which must be of files; small ones in one."""
    size = sum(int(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for t in tables)
    return max(1, min(most, size // SHARE_BYTES))


def in_share(i: int, n: int, keys: Sequence[str]) -> Column:
    """Whether a row is in share ``i`` (from 0) of ``n``: rows of equal keys, NULLs included, are in the same."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)) == i


def shares(table: DataFrame, keys: Sequence[str], most: int = 2) -> list[DataFrame]:
    """``table``, which must be one of files, cut by a hash of ``keys``: together the shares are all its rows.

    What is shuffled for one share after the other never fills the disk with all rows at once, for some more
    reading; a small table is one share."""
    n = share_count(most, table)
    return [table.filter(in_share(i, n, keys)) for i in range(n)] if n > 1 else [table]


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only in local mode."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    return tempfile.mkdtemp(prefix="tallyhouse-")


class SharedFolder:
    """Writes intermediate results once, as parquet, so that lost executors cost no recompute.

    With ``lean`` it spares the disk: tables are compressed by zstd, and what was shuffled for a table is
    removed as soon as the table is complete."""

    def __init__(self, root: str, lean: bool = False):
        self.root = root
        self.lean = lean

    @classmethod
    def of(cls, spark: SparkSession) -> "SharedFolder":
        return cls(f"{shared_root(spark)}/tallyhouse-{uuid.uuid4().hex}")

    def fresh(self, label: str) -> str:
        """A path that nothing else uses."""
        return f"{self.root}/scratch/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        return self._write(df, self.fresh(label))

    def keep_bucketed(
        self, df: DataFrame, label: str, buckets: int, by: str, one_per_task: bool = False
    ) -> DataFrame:
        """Like ``keep``, as a table that Spark knows to be dealt by ``by``: joins and windows on that
        column read it without a shuffle. The catalog entry is the session's; the files are in the folder.

        With ``one_per_task`` every task holds rows of one bucket, so they are not sorted by bucket before
        they are written (the session's setting for that is put back afterwards)."""
        name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
        writer = self._writer(df).bucketBy(buckets, by).option("path", self.fresh(label))
        with _settings(df.sparkSession, self._sparing() | ({_WRITERS: "2"} if one_per_task else {})):
            writer.format("parquet").saveAsTable(name)
        return df.sparkSession.table(name)

    def close(self, spark: SparkSession) -> None:
        """Remove what ``keep`` has written; tables read from it are of no use afterwards."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/scratch")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def replace(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as table ``name``, overwriting an earlier build, and read it back."""
        return self.replace_by_parts([df], name)

    def replace_by_parts(self, parts: Sequence[DataFrame], name: str) -> DataFrame:
        """Like ``replace``, one part after the other."""
        path = f"{self.root}/{name}"
        for i, part in enumerate(parts):
            self._save(part, path, "append" if i else "overwrite")
        return parts[0].sparkSession.read.schema(parts[0].schema).parquet(path)

    def replace_partitioned(self, parts: Sequence[DataFrame], name: str, by: str, order: Sequence[str]) -> DataFrame:
        """Like ``replace_by_parts``, with a folder per value of ``by``, the last column, and files sorted by ``order``.

        Adaptive execution deals the rows by ``by`` and splits and merges what it dealt to even sizes, so a
        value that holds most rows is written by many tasks and a small one ends up in one file of each part."""
        for i, part in enumerate(parts):
            dealt = part.hint("rebalance", F.col(by)).sortWithinPartitions(by, *order)
            self._save(dealt, f"{self.root}/{name}", "append" if i else "overwrite", by)
        return self.read(parts[0].sparkSession, name, parts[0].schema)

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        self._save(df, path, "overwrite")
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _save(self, df: DataFrame, path: str, mode: str, *folders: str) -> None:
        with _settings(df.sparkSession, self._sparing()):
            self._writer(df).mode(mode).partitionBy(*folders).parquet(path)

    def _writer(self, df: DataFrame) -> DataFrameWriter:
        return df.write.option("compression", "zstd") if self.lean else df.write

    def _sparing(self) -> dict[str, str]:
        return {_CLEANUP: "true"} if self.lean else {}

    def read(self, spark: SparkSession, name: str, schema: StructType | None = None) -> DataFrame:
        """``schema`` is needed where a table with folders may have no row and so no file."""
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(f"{self.root}/{name}")
