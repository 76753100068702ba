"""Blocked pairs, set overlap, first-wins and canonical picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Tables

#: Rows of a table that one task groups or joins, so that its memory stays as the table grows.
TASK_ROWS = 250_000
#: Tasks that share the rows of one key at first.
SPREAD = 16


def tasks(rows: DataFrame) -> int:
    """Tasks over which a table's rows are grouped or joined: one for each `TASK_ROWS`, and no fewer than there are cores.  A table of files is counted
    by their footers."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def spread(rows: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """Rows dealt to n tasks by key and a number `_part` under `SPREAD`, which is the same for a key's rows of one input task: a key of many rows is first grouped in
    some tasks (by key and `_part`), then its partial rows in one."""
    return rows.withColumn("_part", F.spark_partition_id() % SPREAD).repartition(n, *key, "_part")


def pairs(rows: DataFrame, block: Sequence[str], id: str, keep: Sequence[str] = (), residual: str | None = None, most: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of rows that share the block key (null keys match nothing); kept columns appear as
    a_x and b_x, and the residual may use them.  `most` leaves out blocks above it, which is part of the operator's meaning."""
    own = rows.dropna(subset=list(block)).select(*block, id, *[k for k in keep if k not in block])
    if most is not None:
        own = own.join(own.groupBy(*block).count().where(F.col("count") <= most).drop("count"), list(block), "left_semi")
    side = lambda p: own.select(*block, *(F.col(c).alias(f"{p}_{c}") for c in own.columns if c not in block))
    out = side("a").join(side("b"), list(block)).where(f"a_{id} < b_{id}")
    return (out.where(residual) if residual else out).withColumnsRenamed({f"a_{id}": "a", f"b_{id}": "b"})


def keyed_pairs(rows: DataFrame, block: Sequence[str], id: str, keys: dict[str, str]) -> DataFrame:
    """(a, b, and a boolean for each key's name), a < b: ids that share a key inside a block, each pair once: the first key that the two share puts it out, so pairs
    need no shuffle to be made distinct.  Rows of one id count together."""
    sets = rows.dropna(subset=list(block)).groupBy(id).agg(*(F.collect_set(F.when(F.col(k).isNotNull(), F.struct(*block, F.col(k).alias("_value")))).alias(f"_{s}") for s, k in keys.items()))
    of = lambda n, s: F.transform(f"_{s}", lambda v: F.struct(F.lit(n).alias("nth"), v.alias("v")))
    each = F.concat(*(of(n, s) for n, s in enumerate(keys)))
    own = sets.select(id, *(f"_{s}" for s in keys), F.explode(each).alias("_key")).select(id, *(f"_{s}" for s in keys), "_key.nth", "_key.v")
    side = lambda p: own.select("nth", "v", F.col(id).alias(p), *(F.col(f"_{s}").alias(f"{p}_{s}") for s in keys))
    both = side("a").join(side("b"), ["nth", "v"]).where("a < b")
    plain = lambda s: (F.size(f"a_{s}") <= 1) & (F.size(f"b_{s}") <= 1)
    shared = {s: F.when(plain(s), F.coalesce(F.get(f"a_{s}", F.lit(0)) == F.get(f"b_{s}", F.lit(0)), F.lit(False))).otherwise(F.arrays_overlap(f"a_{s}", f"b_{s}")) for s in keys}
    first, before = F.lit(False), F.lit(False)
    for n, s in enumerate(keys):
        first = F.when(F.col("nth") == n, ~before & F.when(plain(s), True).otherwise(F.array_min(F.array_intersect(f"a_{s}", f"b_{s}")) == F.col("v"))).otherwise(first)
        before = before | shared[s]
    return both.where(first).select("a", "b", *(c.alias(s) for s, c in shared.items()))


def stars(rows: DataFrame, block: Sequence[str], id: str) -> DataFrame:
    """(a, b): each row of a block linked to the block's smallest id.  The components are those of all pairs (J6), the
    edges grow with the rows instead of their square."""
    own = rows.dropna(subset=list(block)).select(*block, id)
    return own.join(own.groupBy(*block).agg(F.min(id).alias("a")), list(block)).where(f"a <> {id}").select("a", F.col(id).alias("b"))


def keyed(rows: DataFrame, block: str, id: str, keys: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """(block, id, kept..., _key): a row for each key column that is not null; _key has the key's name and value."""
    each = F.array(*(F.when(F.col(k).isNotNull(), F.struct(F.lit(s).alias("kind"), F.col(k).alias("value"))) for s, k in keys.items()))
    return rows.dropna(subset=[block]).select(block, id, *keep, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("_key"))


def shared_items(sets: DataFrame, id: str, item: str) -> DataFrame:
    """For pairs of ids that share an item: n_both and the Jaccard similarity of their item sets."""
    own = sets.select(id, item).dropna().distinct()
    size = own.groupBy(id).agg(F.count("*").alias("n"))
    a, b = (own.select(F.col(id).alias(p), F.col(item).alias("_item")) for p in "ab")
    both = a.join(b, "_item").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_both"))
    na, nb = (size.select(F.col(id).alias(p), F.col("n").alias(f"n_{p}")) for p in "ab")
    return both.join(na, "a").join(nb, "b").withColumn("jaccard", F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")))


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in an explicit total order."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_nth = 1").drop("_nth")


def canonical_pick(rows: DataFrame, group: str, id: str, order: Sequence[Column]) -> DataFrame:
    """Each group's id with the smallest order tuple, by a partial aggregate instead of a sort."""
    return rows.groupBy(group).agg(F.min_by(F.col(id), F.struct(*order, F.col(id))).alias("canonical"))


def unambiguous(pairs_: DataFrame, key: str, code: str) -> DataFrame:
    """Keys that map to exactly one code."""
    return pairs_.dropna(subset=[key, code]).groupBy(key).agg(F.count_distinct(code).alias("_n"), F.min(code).alias(code)).where("_n = 1").drop("_n")


def richness(*columns: str) -> Column:
    """How many of the columns are not empty."""
    return sum((F.when(F.length(F.trim(F.col(c).cast("string"))) > 0, 1).otherwise(0) for c in columns), F.lit(0))


def pair_signals(one: DataFrame, two: DataFrame, first: str, second: str) -> DataFrame:
    """The union of two pair sets with the signal `both`, `first` or `second`."""
    a, b = one.select("a", "b", F.lit(1).alias("_x")).distinct(), two.select("a", "b", F.lit(1).alias("_y")).distinct()
    return a.join(b, ["a", "b"], "full").select("a", "b", F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), "both").when(F.col("_x").isNotNull(), first).otherwise(second).alias("signal"))


def fill_down(rows: DataFrame, column: str, order: str) -> DataFrame:
    """The last value above, where a sheet's header rows name their followers.  Rows are range-partitioned by the order and filled inside
    each range; what a range begins without comes from the ranges before it, one row each."""
    part = Tables(rows.sparkSession).keep(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = F.last(column, ignorenulls=True).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    ends = part.groupBy("_range").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("_end"))
    above = F.last("_end", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.withColumn("_above", above).select(F.col("_range").alias("_of"), "_above")
    out = part.withColumn(column, within).join(carried, F.col("_range") == F.col("_of"), "left")
    return out.withColumn(column, F.coalesce(column, "_above")).select(*rows.columns)


def sequential_codes(rows: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Two-digit codes of names in the order in which each group first has them."""
    first = rows.groupBy(group, name).agg(F.min(order).alias("_first"))
    return first.withColumn("code", F.lpad(F.dense_rank().over(Window.partitionBy(group).orderBy("_first")).cast("string"), 2, "0")).drop("_first")


def latest_verified(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of the newest verified run (runs: run_id, run_at, vam_verified)."""
    last = runs.where("vam_verified").agg(F.max_by("run_id", F.struct("run_at", "run_id")).alias("run_id"))
    return rows.join(F.broadcast(last), "run_id", "left_semi")  # one row
