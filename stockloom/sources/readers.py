"""File readers, sinks and the schema ledger."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DISCOVERED = "source_key string, source_ref string, kind string, trade_name string, legal_name string, cif string, address string, postal_code string, municipality string, province string, lat double, lon double, phone string, email string, website string, extra string"
LISTING = "source_key string, listing_ref string, deep_link string, title string, make string, model string, year int, km int, price decimal(12,2), fuel string, transmission string, photo_url string, seller string, seller_phone string"


def scan_parquet(spark: SparkSession, path: str, where: Column | None = None, **columns: str) -> DataFrame:
    """A pruned, filtered scan; columns are given as name=path into nested fields."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df.select(*(F.col(p).alias(n) for n, p in columns.items())) if columns else df


def scan_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Header, UTF-8, all strings by schema: codes keep their leading zeros."""
    return spark.read.csv(path, header=True, schema=columns, encoding="UTF-8", quote='"', escape='"')


def gazetteer_names(rows: DataFrame) -> DataFrame:
    """S3: one row for each name of a place: its singular entity's and its nucleus's."""
    name = F.explode(F.array_distinct(F.array("entidad_singular_nombre", "nucleo_nombre"))).alias("name")
    return rows.select("codigo_postal", "municipio_id", name).where("name is not null and name <> ''").distinct()


def postcode_index(rows: DataFrame) -> DataFrame:
    """Postcodes with their set of municipalities."""
    return rows.groupBy("codigo_postal").agg(F.array_sort(F.collect_set("municipio_id")).alias("codes"))


def scan_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document or array for each file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def scan_answers(spark: SparkSession, path: str) -> DataFrame:
    """Saved answers of a source, one a line, as the column `payload` that connectors and registries read; partitions follow the files."""
    return spark.read.text(path).withColumnRenamed("value", "payload")


def to_common(raw: DataFrame, schema: str, **columns: Column | str) -> DataFrame:
    """A source's own rows as the common schema; what it does not give is null.  A source is a declared
    schema plus this mapping: each adapter is a dictionary, not a class."""
    target = raw.sparkSession.createDataFrame([], schema).schema
    given = {n: F.expr(c) if isinstance(c, str) else c for n, c in columns.items()}
    return raw.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in target))


def read_sheet(path: str):
    """A spreadsheet as a pandas frame, where a reader is installed; convert it to CSV once, offline."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("no spreadsheet reader is installed: convert the sheet to CSV and use scan_csv") from e
    import pandas as pd

    return pd.read_excel(path, dtype=str)


def write_lineage(path: str, **facts: object) -> None:
    """A small JSON file beside a run's output, written by the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(facts, f, ensure_ascii=False, indent=1, sort_keys=True, default=str)


def migrate(applied: dict[str, str], ordered: list[tuple[str, str]]) -> list[str]:
    """Names still to apply, in order; an applied one whose text has changed is an error."""
    todo = []
    for name, text in ordered:
        digest = hashlib.sha256(text.encode()).hexdigest()
        if name in applied and applied[name] != digest:
            raise ValueError(f"{name} was applied with another text")
        if name not in applied:
            todo.append(name)
    return todo
