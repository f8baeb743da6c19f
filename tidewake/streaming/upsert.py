"""A sink that keeps the newest row of each key, for ``foreachBatch``: a batch that comes twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.shared import discard, written


class UpsertSink:
    """Newest row per key in Parquet folders, one for each bucket of keys, under a log of committed batches.

    A batch rewrites only the buckets that its keys fall into, as folders of
    its own; a bucket that it does not touch keeps its folder. Then one commit,
    named by the batch, lists the folder of every bucket; it counts once Spark
    has closed it, so readers see all of a batch or nothing. A batch up to the
    last commit is skipped: a query that was killed between the commit and its
    checkpoint repeats the batch without effect, and one that was killed before
    the commit writes the batch's folders again.

    ``order`` says which row of a key is newest; equal ones are told apart by
    all other columns, so the result does not depend on the order of arrival.
    One query writes to a sink at a time. The last two commits and their
    folders are kept for readers.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: tuple[str, ...], schema: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.order, self.schema, self.buckets = spark, path.rstrip("/"), key, order, schema, buckets

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        commits = self.commits()
        if commits and batch_id <= commits[-1]:
            return
        folders = self._folders(commits[-1]) if commits else {}
        new = written(self._newest(batch), "upsert-batch")
        touched = [r["bucket"] for r in new.select(self._bucket().alias("bucket")).distinct().collect()]  # at most as many as there are buckets
        if touched:
            old = [folders[b] for b in touched if b in folders]
            rows = self._newest(new.unionByName(self.spark.read.schema(self.schema).parquet(*old))) if old else new
            to = f"{self.path}/data/batch={batch_id:012d}"
            rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(to)
            folders |= {b: f"{to}/bucket={b}" for b in touched}
        self._commit(batch_id, folders)
        discard(new)
        for n in commits[:-1]:
            self._drop(n, {*folders.values(), *self._folders(commits[-1]).values()})

    def read(self) -> DataFrame:
        """The newest rows as of the last commit."""
        commits = self.commits()
        folders = self._folders(commits[-1]) if commits else {}
        return self.spark.read.schema(self.schema).parquet(*folders.values()) if folders else self.spark.createDataFrame([], self.schema)

    def commits(self) -> list[int]:
        """Batches whose commit is complete, in order."""
        done = self._store().globStatus(self._at(f"{self.path}/commits/*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName()) for f in done or [])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _newest(self, rows: DataFrame) -> DataFrame:
        columns = self.spark.createDataFrame([], self.schema).columns
        rest = [c for c in columns if c != self.key and c not in self.order]
        best = rows.groupBy(self.key).agg(F.max(F.struct(*self.order, *rest)).alias("newest"))
        return best.select(self.key, "newest.*").select(*columns)

    def _commit(self, batch_id: int, folders: dict[int, str]) -> None:
        rows = self.spark.createDataFrame(sorted(folders.items()), "bucket int, folder string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{batch_id:012d}")

    def _folders(self, commit: int) -> dict[int, str]:
        rows = self.spark.read.schema("bucket int, folder string").parquet(f"{self.path}/commits/{commit:012d}")
        return {r["bucket"]: r["folder"] for r in rows.collect()}

    def _drop(self, commit: int, still: set[str]) -> None:
        for folder in set(self._folders(commit).values()) - still:
            self._store().delete(self._at(folder), True)
        self._store().delete(self._at(f"{self.path}/commits/{commit:012d}"), True)

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _store(self):
        return self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
