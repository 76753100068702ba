"""Sinks that write (S16 to S20, S22): a keyed state in hash buckets, of which a run rewrites those that it touches.

A table is a folder: `data/run=<run>/bucket=<n>` holds the bucket as that run left it, `manifest/<number>` which run each bucket is read from.  A run reads the
touched buckets, merges its rows and writes them beside the old ones; the manifest, written last, makes them count.  So a run that is repeated after a
success changes nothing, one that is repeated after a failure overwrites its own files, readers of an older manifest are not disturbed, and the
untouched buckets are neither read nor written.  All files go through Spark, so any store will do."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def first_writer(key: Sequence[str], seen: str) -> Merge:
    """Known rows keep all but their last-seen time."""
    return partial(delta.upsert_first_writer, key=key, seen=seen)


def fill_nulls(key: Sequence[str]) -> Merge:
    """Nulls of known rows are filled."""
    return partial(delta.upsert_fill_nulls, key=key)


def ignore(key: Sequence[str]) -> Merge:
    """Only unknown keys land."""
    return lambda old, new: old.unionByName(delta.insert_ignore(old, new, key).select(*old.columns))


def newest(key: Sequence[str]) -> Merge:
    """The values of the run count where it has them."""
    return lambda old, new: delta.upsert_flagged(old, new, key).select(*old.columns)


class BucketedTable:
    """Rows by a key in `buckets` hash buckets; the number is fixed when the table is begun."""

    def __init__(self, spark: SparkSession, at: str, schema: str, key: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.at, self.schema, self.key, self.buckets = spark, at, schema, list(key), buckets
        self.columns = spark.createDataFrame([], schema).columns

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> tuple[int, dict[int, str], set[str]]:
        """Number of the last complete manifest (0: none), the run of each bucket, and all runs so far: at most a row a bucket and one a run."""
        p, fs = self._fs(f"{self.at}/manifest")
        done = [int(s.getPath().getName()) for s in fs.listStatus(p) if fs.exists(self._fs(f"{self.at}/manifest/{s.getPath().getName()}/_SUCCESS")[0])] if fs.exists(p) else []
        if not done:
            return 0, {}, set()
        rows = self.spark.read.schema("bucket int, run string").parquet(f"{self.at}/manifest/{max(done)}").collect()
        return max(done), {r["bucket"]: r["run"] for r in rows if r["bucket"] is not None}, {r["run"] for r in rows}

    def _read(self, of: dict[int, str]) -> DataFrame:
        if not of:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.at}/data/run={r}/bucket={b}" for b, r in sorted(of.items())))

    def read(self) -> DataFrame:
        return self._read(self.manifest()[1])

    def write(self, rows: DataFrame, run: str, merge: Merge) -> bool:
        """Merges a run's rows, the first of a key counting; false if the run has been written before."""
        number, of, runs = self.manifest()
        if run in runs:
            return False
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        new = rows.select(*self.columns).dropDuplicates(self.key)
        touched = [r["b"] for r in rows.select(bucket.alias("b")).distinct().collect()]
        old = self._read({b: of[b] for b in touched if b in of})
        data = f"{self.at}/data/run={run}"
        out = merge(old, new).select(*self.columns).withColumn("bucket", bucket)
        # one file a bucket: the buckets are dealt out whole
        out.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        now = of | dict.fromkeys(touched, run)
        listed = [(b, r) for b, r in now.items()] + [(None, r) for r in sorted(runs | {run})]
        self.spark.createDataFrame(listed, "bucket int, run string").coalesce(1).write.mode("overwrite").parquet(f"{self.at}/manifest/{number + 1}")
        return True

    def clean(self) -> int:
        """Removes the bucket folders and manifests that the last manifest does not need; readers of older ones must have ended."""
        number, of, _ = self.manifest()
        p, fs = self._fs(f"{self.at}/data")
        gone = 0
        for run in fs.listStatus(p) if fs.exists(p) else []:
            for b in fs.listStatus(run.getPath()):
                name = b.getPath().getName()
                if name.startswith("bucket=") and of.get(int(name[7:])) != run.getPath().getName()[4:]:
                    gone += fs.delete(b.getPath(), True)
        p, fs = self._fs(f"{self.at}/manifest")
        for m in fs.listStatus(p) if fs.exists(p) else []:
            if m.getPath().getName().isdigit() and int(m.getPath().getName()) < number:
                fs.delete(m.getPath(), True)
        return gone
