"""Serving queries and views (V1-V4, Q1-Q10, L1): one DataFrame function each, and the response envelope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, order: Sequence[str | Column], number: int = 1, size: int = 50) -> DataFrame:
    """L1: page `number` (from 1) in a stable total order; size 1 to 200."""
    if not 1 <= size <= 200 or number < 1:
        raise ValueError("size is 1 to 200 and page numbers begin at 1")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(rows: DataFrame, key: str, last: object, size: int = 50) -> DataFrame:
    """L1 by key: the next `size` rows after a key, without reading those before."""
    return rows.where(F.col(key) > F.lit(last)).orderBy(key).limit(size)


def envelope(data: list, size: int, **meta: object) -> dict:
    """The contract of a response; has_more is that the page is full, so nothing is counted."""
    return {"ok": True, "data": data, "error": None, "meta": {**meta, "size": size, "has_more": len(data) == size}}


def platforms(entities: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """V1: entities of the given kinds or marked as like a platform (null counts as not)."""
    return entities.where(F.col("kind").isin(*kinds) | F.coalesce("is_platform_like", F.lit(False)))


def canonical_view(rows: DataFrame, overlay: DataFrame, id: str, canonical: str, show: str) -> DataFrame:
    """V2-V4: rows with the canonical row's shown column; rows outside the overlay are their own."""
    own = rows.join(overlay.select(id, canonical), id, "left").withColumn(canonical, F.coalesce(canonical, id))
    head = rows.select(F.col(id).alias(canonical), F.col(show).alias(f"canonical_{show}"))
    return own.join(head, canonical, "left")


def cluster_members(view: DataFrame, id: str, canonical: str, code: str, wanted: str) -> DataFrame:
    """Q2: all members of the cluster of the row with a code."""
    at = view.where(F.col(code) == wanted).select(canonical)
    return view.join(at, canonical, "left_semi").select(id, code, canonical, (F.col(id) == F.col(canonical)).alias("is_canonical"))


def province_tree(municipalities: DataFrame, entities: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Q7: municipalities with counts of kinds below their comarca, and each province's remainder without a municipality; groups without
    rows are left out, null comarcas and municipalities come last."""
    m = municipalities.select(F.col("code").alias("municipality_code"), F.col("name").alias("municipality"), "comarca")
    own = entities.dropna(subset=["province_code"]).join(m, "municipality_code", "left")
    g = own.groupBy("province_code", "comarca", "municipality_code", "municipality").agg(F.count("*").alias("n"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))
    return g.where("n > 0").orderBy("province_code", F.asc_nulls_last("comarca"), F.asc_nulls_last("municipality_code"))


def tree_nodes(tree: DataFrame) -> DataFrame:
    """Q7 nested: one row for each comarca with its municipalities in order."""
    return tree.groupBy("province_code", "comarca").agg(F.sort_array(F.collect_list(F.struct("municipality_code", "municipality", "n"))).alias("municipalities"), F.sum("n").alias("n"))


def platform_inventory(edges: DataFrame, vehicles: DataFrame, entities: DataFrame, platform: str) -> DataFrame:
    """Q9: a platform's listings with the owning seller."""
    own = edges.where(F.col("platform_ulid") == platform).join(vehicles.select("vehicle_ulid", "entity_ulid", "status"), "vehicle_ulid")
    return own.join(entities.select("entity_ulid", "cdp_code", "trade_name"), "entity_ulid", "left").select("vehicle_ulid", "price", "status", "cdp_code", "trade_name")


def vehicle_platforms(edges: DataFrame, platforms_: DataFrame, vehicles: DataFrame, vehicle: str | None = None) -> DataFrame:
    """Q10: the platforms of one vehicle (or of the edges' vehicles), with its owner."""
    own = (edges if vehicle is None else edges.where(F.col("vehicle_ulid") == vehicle)).join(platforms_.select("platform_ulid", "platform"), "platform_ulid")
    return own.join(vehicles.select("vehicle_ulid", F.col("entity_ulid").alias("owner_ulid")), "vehicle_ulid").select("vehicle_ulid", "platform", "price", "owner_ulid")
