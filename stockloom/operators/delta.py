"""Snapshot reconciliation and merge semantics of the sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocking import first_wins

TRACKED = (("price", "PRICE_CHANGE"), ("km", "KM_CHANGE"), ("photo_url", "PHOTO_CHANGE"))


def guard(harvested: Column, declared: Column, previous: Column) -> Column:
    """May missing rows be called gone?  Inclusive bounds: 95 % of the declared, else half of the previous count."""
    return (
        F.when(declared.isNotNull(), harvested >= F.lit(0.95) * declared)
        .when(previous.isNull() | (previous == 0), F.lit(True))
        .otherwise(harvested >= F.lit(0.5) * previous)
    )


def reconcile(old: DataFrame, new: DataFrame, key: Sequence[str], order: str, declared: int | None = None) -> DataFrame:
    """One row for each key with its events.

    new is deduplicated first (first in `order`).  Columns: key, event (NEW, GONE, GONE_SUPPRESSED, PRICE_CHANGE, KM_CHANGE,
    PHOTO_CHANGE or UNCHANGED), old_value, new_value.  A null new value never emits a change; a null old price or km never
    does either, but a null old photo does; a gone car that is seen again emits nothing.  With the guard closed,
    GONE becomes GONE_SUPPRESSED."""
    fields = [f for f, _ in TRACKED]
    new = first_wins(new, key, [order])
    counts = old.agg(F.count_if(F.col("status") == "available").alias("_prev")).crossJoin(new.agg(F.count("*").alias("_got")))  # one row each
    o = old.select(*key, F.col("status").alias("_status"), *(F.col(f).alias(f"o_{f}") for f in fields), F.lit(1).alias("_o"))
    n = new.select(*key, *(F.col(f).alias(f"n_{f}") for f in fields), F.lit(1).alias("_n"))
    both = o.join(n, list(key), "full").crossJoin(F.broadcast(counts))
    open_ = guard(F.col("_got"), F.lit(declared).cast("long"), F.col("_prev"))
    seen = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    text = lambda c: F.col(c).cast("string")
    event = lambda cond, kind, a, b: F.when(cond, F.struct(F.lit(kind).alias("event") if isinstance(kind, str) else kind.alias("event"), a.alias("old_value"), b.alias("new_value")))
    none = F.lit(None).cast("string")
    changed = [seen & F.col(f"n_{f}").isNotNull() & ~F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}")) & (F.lit(True) if f == "photo_url" else F.col(f"o_{f}").isNotNull()) for f in fields]
    events = [
        event(F.col("_o").isNull(), "NEW", none, text("n_price")),
        event(F.col("_n").isNull() & (F.col("_status") == "available"), F.when(open_, "GONE").otherwise("GONE_SUPPRESSED"), text("o_price"), none),
        *(event(c, kind, text(f"o_{f}"), text(f"n_{f}")) for c, (f, kind) in zip(changed, TRACKED, strict=True)),
        event(seen & ~(changed[0] | changed[1] | changed[2]), "UNCHANGED", none, none),
    ]
    found = F.filter(F.array(*events), lambda e: e.isNotNull())
    return both.select(*key, F.explode(found).alias("e")).select(*key, "e.event", "e.old_value", "e.new_value")


def apply_snapshot(old: DataFrame, new: DataFrame, key: Sequence[str], order: str, declared: int | None = None) -> DataFrame:
    """The snapshot after reconciliation: new values over old ones (nulls never overwrite), missing rows gone only
    if the guard is open, seen rows available."""
    fields = [f for f, _ in TRACKED]
    new = first_wins(new, key, [order])
    counts = old.agg(F.count_if(F.col("status") == "available").alias("_prev")).crossJoin(new.agg(F.count("*").alias("_got")))
    o = old.select(*key, "status", *(F.col(f).alias(f"o_{f}") for f in fields))
    n = new.select(*key, *(F.col(f).alias(f"n_{f}") for f in fields), F.lit(1).alias("_n"))
    both = o.join(n, list(key), "full").crossJoin(F.broadcast(counts))
    gone = guard(F.col("_got"), F.lit(declared).cast("long"), F.col("_prev"))
    status = F.when(F.col("_n").isNotNull(), "available").when(gone, "gone").otherwise(F.col("status"))
    return both.select(*key, status.alias("status"), *(F.coalesce(f"n_{f}", f"o_{f}").alias(f) for f in fields))


def upsert_first_writer(old: DataFrame, new: DataFrame, key: Sequence[str], seen: str) -> DataFrame:
    """Existing rows keep all but their last-seen time; unknown keys are added."""
    n = new.select(*key, F.col(seen).alias("_seen"))
    kept = old.join(n, list(key), "left").withColumn(seen, F.greatest(seen, "_seen")).drop("_seen")
    return kept.select(*old.columns).unionByName(new.join(old, list(key), "left_anti").select(*old.columns))


def upsert_fill_nulls(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Only nulls of existing rows are filled; unknown keys are added."""
    rest = [c for c in old.columns if c not in key]
    n = new.select(*key, *(F.col(c).alias(f"n_{c}") for c in rest))
    return old.join(n, list(key), "full").select(*key, *(F.coalesce(c, f"n_{c}").alias(c) for c in rest))


def insert_ignore(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The new rows that really land, one for each key."""
    return new.join(old, list(key), "left_anti")


def upsert_flagged(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows after the upsert, new values first, with is_new (inserted) and touched (in the batch)."""
    rest = [c for c in old.columns if c not in key]
    o = old.select(*key, *(F.col(c).alias(f"o_{c}") for c in rest), F.lit(True).alias("_o"))
    n = new.select(*key, *rest, F.lit(True).alias("_n"))
    both = o.join(n, list(key), "full")
    return both.select(*key, *(F.coalesce(c, f"o_{c}").alias(c) for c in rest), F.col("_o").isNull().alias("is_new"), F.col("_n").isNotNull().alias("touched"))


def append_events(events: DataFrame, path: str) -> None:
    """Append-only by construction."""
    events.write.mode("append").parquet(path)


def replace_run(rows: DataFrame, path: str, run: str = "run_id") -> None:
    """Overwrite the partitions of the runs (or keyed sources) at hand and no others; doing it again changes nothing."""
    rows.write.partitionBy(run).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def seed_positions(old: DataFrame, seed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows to update: a missing latitude or longitude, or one at least 1e-9 away from the seed's."""
    s = seed.select(*key, F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    differs = lambda c: F.col(c).isNull() | (F.abs(F.col(c) - F.col(f"s_{c}")) >= 1e-9)
    return old.join(s, list(key)).where(differs("lat") | differs("lon")).select(*key, F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon"))


def edge_price_events(before: DataFrame, now: DataFrame, key: Sequence[str]) -> DataFrame:
    """Price changes of listings known before."""
    b = before.select(*key, F.col("price").alias("old_price"))
    return now.join(b, list(key)).where("price is not null and old_price is not null and price <> old_price").select(*key, "old_price", F.col("price").alias("new_price"))


def aged_out(edges: DataFrame, seen: DataFrame, key: Sequence[str], clean: Column, previous: Column | None = None) -> DataFrame:
    """Edges that were not seen, removed only after a clean run with the guard open (one row of `clean` counts)."""
    counts = edges.agg(F.count("*").alias("_prev")).crossJoin(seen.select(*key).distinct().agg(F.count("*").alias("_got")))
    allowed = clean & guard(F.col("_got"), F.lit(None).cast("long"), F.col("_prev"))
    return edges.join(seen, list(key), "left_anti").crossJoin(F.broadcast(counts)).withColumn("removed", allowed).drop("_prev", "_got")
