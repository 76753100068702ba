"""Nested places (S1): tables of structs laid out by position, and scans that skip what lies outside a box.

Rows are range-partitioned by the Z-order of their position and sorted inside each file, in small row groups, so the statistics of the nested bounding box bound a
small area each and the scan passes over all row groups that the box does not meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def z_order(lat: Column, lon: Column, bits: int = 12) -> Column:
    """The bits of two positions by turns, the most significant first."""
    cell = lambda c, low, span: F.floor((c - low) / span * (1 << bits)).cast("long")
    y, x = cell(lat, -90.0, 180.0), cell(lon, -180.0, 360.0)
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1)), 2 * b)).bitwiseOR(F.shiftleft(F.shiftright(y, b).bitwiseAND(F.lit(1)), 2 * b + 1))
    return out


def write_places(places: DataFrame, path: str, files: int, group_bytes: int = 1 << 20) -> None:
    """places have bbox: struct<xmin, ymin>; rows without a position come last."""
    own = places.withColumn("_z", F.coalesce(z_order(F.col("bbox.ymin"), F.col("bbox.xmin")), F.lit(1 << 40)))
    own.repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z").write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)


def scan_places(spark: SparkSession, path: str, box: tuple[float, float, float, float], country: str, categories: Sequence[str], limit: int | None = None) -> DataFrame:
    """Named places of some categories in a box (west, south, east, north) and country, as flat rows.  The box, the category and the name are pushed to
    the scan, which reads the nested fields it needs and no others."""
    west, south, east, north = box
    df = spark.read.parquet(path)
    inside = F.col("bbox.xmin").between(west, east) & F.col("bbox.ymin").between(south, north)
    named = F.col("names.primary").isNotNull() & (F.col("names.primary") != "")
    found = df.where(inside & F.col("categories.primary").isin(*categories) & named).where(F.get("addresses", F.lit(0))["country"] == country)
    first = F.get("addresses", F.lit(0))
    out = found.select("id", F.col("names.primary").alias("name"), F.col("categories.primary").alias("category"), F.col("bbox.ymin").alias("lat"), F.col("bbox.xmin").alias("lon"), first["locality"].alias("locality"), first["postcode"].alias("postcode"), first["freeform"].alias("address"), F.get("websites", F.lit(0)).alias("website"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return out if limit is None else out.limit(limit)
