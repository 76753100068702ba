"""What the operators of this subpackage share: narrow reads, exact distributed prefix sums, and streaming over sorted
groups; written tables and connected components are the library's."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Tables, components, shared_dir, spread_join, tidied

__all__ = ["Tables", "Union", "bounded_batches", "components", "groups_of", "hot_join", "in_chunks", "narrow", "read_table", "running_totals", "shared_dir", "spread_join", "tidied"]

WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Rows of whole texts can be large: batches of 512 instead of Spark's default of 10,000 bound what a Python worker and its
    executor hold.  A setting that was changed already stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns.  They are taken by position, so extra columns whose names differ by case only,
    or repeat, do no harm; the first exact match counts."""
    bounded_batches(df.sparkSession)
    at = [df.columns.index(n) for n in names]
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*(F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)))


def running_totals(df: DataFrame, by: list[str], order: list[str], value: Column | str, tables: Tables, tasks: int | None = None) -> DataFrame:
    """df plus `start`: the exact sum of `value` over the rows before this one in its group, in the given order
    (which should be total).  Two levels: rows are range-partitioned by group and order, summed inside each range,
    and each range's carry is added.  A group that spans ranges is the first one of every range but one, so the
    carries are at most one row for each range; no group meets in one task.  Where the rows are known to be few, at most `tasks` tasks write the ranges."""
    part = df.withColumn("_v", F.coalesce(F.expr(value) if isinstance(value, str) else value, F.lit(0)).cast("long"))
    part = part.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_pid", F.spark_partition_id())
    part = tables.keep(part.coalesce(tasks) if tasks else part, "ranges")
    within = Window.partitionBy("_pid", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = part.groupBy("_pid", *by).agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_s")
    carry = sums.withColumn("_c", before).where("_c > 0").select(F.col("_pid").alias("_p"), F.col("_c"), *(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)))
    on = F.col("_pid") == F.col("_p")
    for i, c in enumerate(by):
        on &= F.col(c).eqNullSafe(F.col(f"_b{i}"))
    out = part.withColumn("_l", F.sum("_v").over(within) - F.col("_v")).join(F.broadcast(carry), on, "left")
    return out.withColumn("start", F.col("_l") + F.coalesce("_c", F.lit(0))).select(*df.columns, "start")


def hot_join(rows: DataFrame, of: DataFrame, keys: list[tuple[str, str]], spread: Column, total: int, ways: int = 16) -> DataFrame:
    """rows joined to `of` (at most one match a row) on pairs of columns, without null keys.  A key with more than a thousandth of the `total` rows
    is hot; there are at most a thousand such keys, so their list is broadcast.  A hot key's rows are dealt over `ways` tasks by a hash of
    `spread`, and only its row of `of` is copied as often."""
    mine, theirs = [k for k, _ in keys], [k for _, k in keys]
    hot = rows.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(mine))).agg(F.count("*").alias("_n")).where(F.col("_n") > max(total // 1000, 1000)).drop("_n").withColumn("_hot", F.lit(True))

    def marked(df: DataFrame, columns: list[str]) -> DataFrame:
        on = F.lit(True)
        for i, c in enumerate(columns):
            on &= F.col(c) == F.col(f"_k{i}")
        return df.join(F.broadcast(hot), on, "left").drop(*(f"_k{i}" for i in range(len(keys))))

    dealt = marked(rows, mine).withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(ways))).otherwise(0).cast("int")).drop("_hot")
    copied = marked(of, theirs).withColumn("_ways", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    on = F.col("_salt") == F.col("_ways")
    for a, b in keys:
        on &= F.col(a) == F.col(b)
    return dealt.join(copied, on).drop("_salt", "_ways")


def in_chunks(members: DataFrame, keys: list[str], id: str, most: int, tables: Tables) -> DataFrame:
    """Members of groups, dealt into cells (keys, i, j) of at most about 2 * `most` rows, so that every two members
    of a group meet in some cell: a group of k chunks has a cell for every pair of chunks i <= j.  role 0: chunk i,
    role 1: chunk j.  Chunks are drawn by a hash of the id; only groups above `most` are cut."""
    sizes = members.groupBy(*keys).agg(F.count("*").alias("_rows")).where(f"_rows > {most}")
    big = tables.keep(sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), F.ceil(F.col("_rows") / most).cast("int").alias("_chunks")), "big")
    if big.isEmpty():
        return members.withColumns({"i": F.lit(0), "j": F.lit(0), "role": F.lit(0)})
    on = F.lit(True)
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    at = members.join(big, on, "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64(id), F.col("_chunks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda x: F.struct(F.least(x, F.col("_own")).alias("i"), F.greatest(x, F.col("_own")).alias("j"), F.when(x < F.col("_own"), 1).otherwise(0).alias("role")))
    return at.withColumn("_cell", F.explode(cells)).select(*members.columns, "_cell.i", "_cell.j", "_cell.role")


def groups_of(batches: Iterable, keys: list[str]) -> Iterator[tuple[tuple, list]]:
    """(key, Arrow tables' slices) of each run of equal keys in sorted record batches; only one run is held."""
    import numpy as np
    import pyarrow as pa

    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        cut = np.zeros(batch.num_rows, bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            now = tuple(c[lo].item() for c in cols)
            if held and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


class Union:
    """Union-find over the ids of one bounded group."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def links(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.up if (r := self.root(x)) != x]
