"""Written intermediate tables and connected components (G1)."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Edges that a task of the first step of components() reads, and nodes that it holds.
EDGES, NODES = 100_000, 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).  Where none is set, a local session gets a temporary one."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stockloom-"))
    return sc.getCheckpointDir()


#: Spark's setting that removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are run in here go when the query ends, instead of when the driver's JVM happens to collect them; the setting is put back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Tables:
    """Intermediate tables written to the shared folder: they cut lineage and outlive lost executors.
    drop() removes those that no later plan reads, drop_but() all except those that one reads, drop_all() what is left once a result has been written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.at, self.paths, self.made = spark, f"{shared_dir(spark)}/stockloom-{uuid.uuid4().hex}", {}, 0

    def keep(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        """codec: the files' compression, where it is not to be the session's."""
        self.made += 1
        path = f"{self.at}/{name}-{self.made}"
        with tidied(self.spark):
            (df.write.option("compression", codec) if codec else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if found := self.paths.pop(id(t), None):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(found[1])
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_but(self, *tables: DataFrame) -> None:
        kept = {id(t) for t in tables}
        self.drop(*(t for t, _ in list(self.paths.values()) if id(t) not in kept))

    def drop_all(self) -> None:
        self.drop_but()


def clean(spark: SparkSession, hours: float = 24.0, where: str | None = None) -> int:
    """Removes what finished runs left in the shared folder (or another one): tables and streams' folders that nothing has written to for `hours`.  A query reads its tables
    when its result is written, so they cannot go sooner by themselves; the count of removed folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where or shared_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    before = time.time() * 1000 - hours * 3_600_000
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("stockloom-")] if fs.exists(path) else []

    def newest(p) -> int:
        return max([fs.getFileStatus(p).getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(p))])

    old = [p for p in found if newest(p) <= before]
    for p in old:
        fs.delete(p, True)
    return len(old)


def spread_join(rows: DataFrame, of: DataFrame, on: Column, spread: Column, how: str = "inner", ways: int = 16) -> DataFrame:
    """rows joined to `of` (at most one match a row) with every key of `rows` dealt over `ways` tasks by a hash of `spread`: a key
    that holds a third of all rows never meets in one task, at the price of `ways` copies of the rows of `of`."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(ways)).cast("int"))
    many = of.withColumn("_ways", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    # merged at every size: the copies of `of` grow with the input, and their size is easily underestimated
    return salted.join(many.hint("merge"), on & (F.col("_salt") == F.col("_ways")), how).drop("_salt", "_ways")


def forests(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: of the edges that a task holds, a spanning forest whose roots are the smallest nodes.
    At most `NODES` nodes are held at a time."""

    def run(batches):
        import pyarrow as pa

        up, kinds = {}, None

        def root(x):
            r = x
            while (p := up.get(r, r)) != r:
                r = p
            while (p := up.get(x, x)) != r:
                up[x], x = r, p
            return r

        def links():
            found = [(x, r) for x in up if (r := root(x)) != x]
            up.clear()
            return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["a", "b"])] if found else []

        for batch in batches:
            kinds = batch.schema.types
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > NODES:
                yield from links()
        yield from links()

    return edges.select("a", "b").mapInArrow(run, edges.select("a", "b").schema)


def components(edges: DataFrame, tables: Tables | None = None, near: str | None = None) -> DataFrame:
    """Connected components of edges (a, b) of any orderable type: rows (node, component), the component being its
    smallest node; nodes without an edge are not listed.  First every `EDGES` edges, dealt at random, become a spanning forest, so a dense
    group costs few edges a task.  Where edges stay inside the values of a column, `near` names it and they are dealt by it, so the forests are
    (nearly) the components.  Then large-star and small-star steps alternate until nothing changes; each keeps at most
    one edge for each edge it reads, and AQE can split a hub's rows."""
    tables, raw = tables or Tables(edges.sparkSession), None

    def keep(e: DataFrame) -> tuple[DataFrame, tuple]:
        """e written, with its count and checksum taken on the way."""
        seen = Observation()
        out = tables.keep(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        return out, (seen.get["n"], seen.get["sum"])

    if near:
        dealt = edges.where("a <> b").repartition(F.col(near))
    else:
        raw, (n, _) = keep(edges.where("a <> b").select("a", "b"))
        dealt = raw.repartition(max(1, -(-n // EDGES)))
    now, old = keep(forests(dealt).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tables.drop(raw)
    while old[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        pair = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(pair).alias("e")).select("e.*").where("a <> b").distinct()
        new, mark = keep(small)
        tables.drop(now)
        now, was, old = new, old, mark
        if was == old:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
