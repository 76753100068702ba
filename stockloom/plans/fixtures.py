"""The inventory relations, drawn from the driver's tables by arithmetic that Spark and the SQL of the oracles share.

Each relation is a table and a dictionary of column -> expression; the expressions use only what both engines
understand the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.blocking import tasks

RELATIONS: dict[str, tuple[str, dict[str, str], str]] = {
    "province": ("nation", {"code": "lpad(CAST(n_nationkey AS STRING), 2, '0')", "name": "n_name", "ccaa_code": "lpad(CAST(n_regionkey AS STRING), 2, '0')"}, ""),
    "ccaa": ("region", {"code": "lpad(CAST(r_regionkey AS STRING), 2, '0')", "name": "r_name"}, ""),
    "municipality": (
        "part",
        {
            "code": "lpad(CAST(p_partkey % 25 AS STRING), 2, '0') || lpad(CAST(p_partkey % 8 AS STRING), 3, '0')",
            "name": "'Villa ' || CAST(p_partkey % 8 AS STRING)",
            "province_code": "lpad(CAST(p_partkey % 25 AS STRING), 2, '0')",
            "comarca": "CASE WHEN p_partkey % 8 = 7 THEN NULL ELSE lpad(CAST(p_partkey % 25 AS STRING), 2, '0') || '-' || CAST((p_partkey % 8) % 3 AS STRING) END",
            "lat": "CAST(36 + (p_partkey % 25) * 0.25 + (p_partkey % 8) * 0.0625 AS DOUBLE)",
            "lon": "CAST(-9 + (p_partkey % 25) * 0.5 - (p_partkey % 8) * 0.125 AS DOUBLE)",
        },
        "DISTINCT",
    ),
    "entity": (
        "customer",
        {
            "entity_ulid": "'E' || lpad(CAST(c_custkey AS STRING), 9, '0')",
            "cdp_code": "'CDP-' || lpad(CAST(c_custkey AS STRING), 9, '0')",
            "n": "c_custkey",
            "trade_name": "CASE c_custkey % 4 WHEN 0 THEN 'Talleres García ' || CAST(c_custkey % 37 AS STRING) || ', S.L.' WHEN 1 THEN 'AUTOS NÚÑEZ ' || CAST(c_custkey % 41 AS STRING) WHEN 2 THEN 'Flexicar ' || CAST(c_custkey % 5 AS STRING) ELSE c_name || ' SA' END",
            "kind": "CASE WHEN c_custkey % 9 = 0 THEN 'particular' ELSE lower(c_mktsegment) END",
            "province_code": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE lpad(CAST(c_nationkey AS STRING), 2, '0') END",
            "municipality_code": "CASE WHEN c_custkey % 13 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE lpad(CAST(c_nationkey AS STRING), 2, '0') || lpad(CAST(c_custkey % 8 AS STRING), 3, '0') END",
            "phone": "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN '91 ' || lpad(CAST((c_custkey * 7) % 601 AS STRING), 3, '0') || ' 44 55' ELSE '+34 6' || lpad(CAST(c_custkey % 97 AS STRING), 2, '0') || ' 555 ' || lpad(CAST(c_custkey % 97 AS STRING), 3, '0') END",
            "website": "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 2 THEN 'http://dealer' || CAST(c_custkey % 401 AS STRING) || '.example/' ELSE 'https://www.Shop' || CAST(c_custkey % 211 AS STRING) || '.example' || CASE WHEN c_custkey % 2 = 0 THEN '/stock?page=1' ELSE '' END END",
            "address": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'Calle Mayor ' || CAST(c_custkey % 90 AS STRING) || ', ' || lpad(CAST(c_custkey % 52000 AS STRING), 5, '0') || ' Villa ' || CAST(c_custkey % 8 AS STRING) END",
            "cif": "CASE WHEN c_custkey % 8 = 0 THEN 'B-' || CAST(10000000 + c_custkey AS STRING) ELSE NULL END",
            "lat": "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(36 + c_nationkey * 0.25 + (c_custkey % 64) * 0.0078125 AS DOUBLE) END",
            "lon": "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(-9 + c_nationkey * 0.5 - (c_custkey % 32) * 0.03125 AS DOUBLE) END",
            "status": "CASE WHEN c_custkey % 17 = 0 THEN 'closed' ELSE 'active' END",
            "source_group": "CASE c_custkey % 6 WHEN 0 THEN 'official_registry' WHEN 1 THEN 'marketplace_motor' WHEN 2 THEN 'oem_dealer_network' WHEN 3 THEN 'directory' ELSE NULL END",
            "created_at": "DATE '2025-01-01' + CAST(c_custkey % 400 AS INT)",
            "first_seen": "CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE DATE '2025-01-01' + CAST((c_custkey * 7) % 300 AS INT) END",
            "is_platform_like": "CASE WHEN c_custkey % 19 = 0 THEN TRUE WHEN c_custkey % 4 = 0 THEN NULL ELSE FALSE END",
            "n_vehicles": "CAST(c_custkey % 30 AS INT)",
        },
        "",
    ),
    "platform": ("supplier", {"platform_ulid": "'P' || lpad(CAST(s_suppkey AS STRING), 9, '0')", "platform": "s_name", "province_code": "lpad(CAST(s_nationkey AS STRING), 2, '0')"}, ""),
    "vehicle": (
        "orders",
        {
            "vehicle_ulid": "'V' || lpad(CAST(o_orderkey AS STRING), 9, '0')",
            "entity_ulid": "'E' || lpad(CAST(o_custkey AS STRING), 9, '0')",
            "price": "CAST(o_totalprice AS DECIMAL(12,2))",
            "status": "CASE WHEN o_orderstatus = 'F' THEN 'gone' ELSE 'available' END",
            "segment": "CASE o_orderkey % 4 WHEN 0 THEN 'used' WHEN 1 THEN 'km0' WHEN 2 THEN 'new' ELSE 'renting' END",
            "vin": "CASE WHEN o_orderkey % 5 = 0 THEN 'wvwzzz1kz' || lpad(CAST(o_orderkey % 3000 AS STRING), 8, '0') WHEN o_orderkey % 5 = 1 THEN 'SHORT' ELSE NULL END",
            "deep_link": "'https://m.example/coches/' || CAST(o_orderkey AS STRING)",
            "first_seen": "o_orderdate",
        },
        "",
    ),
    "edge": ("lineitem", {"vehicle_ulid": "'V' || lpad(CAST(l_orderkey AS STRING), 9, '0')", "platform_ulid": "'P' || lpad(CAST(l_suppkey AS STRING), 9, '0')", "price": "max(CAST(l_extendedprice AS DECIMAL(12,2)))", "first_seen": "min(l_shipdate)"}, "GROUP BY l_orderkey, l_suppkey"),
    "attest": ("events", {"entity_ulid": "'E' || lpad(CAST(user_id AS STRING), 9, '0')", "source_key": "event_type", "seen_at": "max(ts)"}, "GROUP BY user_id, event_type"),
    "car": (
        "part",
        {
            "vehicle_ulid": "'C' || lpad(CAST(p_partkey AS STRING), 9, '0')",
            "entity_ulid": "'E' || lpad(CAST(p_partkey % 50 AS STRING), 9, '0')",
            "make": "p_brand",
            "model": "p_type",
            "title": "p_name",
            "price": "CAST(p_retailprice AS DECIMAL(12,2))",
            "year": "CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE 2019 + CAST(p_partkey % 2 AS INT) END",
            "km": "CASE WHEN p_partkey % 89 = 0 THEN NULL WHEN p_partkey % 5 = 4 THEN 60000 ELSE 50000 END",
            "province_code": "CASE WHEN p_partkey % 83 = 0 THEN NULL ELSE lpad(CAST(28 + p_partkey % 3 AS STRING), 2, '0') END",
            "photo_url": "CASE WHEN p_partkey % 3 = 0 THEN 'https://Img.example/p' || CAST(p_partkey % 701 AS STRING) || CASE WHEN p_partkey % 4 = 0 THEN '/320x240?v=1' WHEN p_partkey % 4 = 2 THEN '_thumb' WHEN p_partkey % 4 = 3 THEN '_320x240.jpg' ELSE '' END ELSE NULL END",
            "first_seen": "DATE '2025-01-01' + CAST((p_partkey * 37) % 300 AS INT)",
            "status": "CASE WHEN p_partkey % 19 = 0 THEN 'gone' ELSE 'available' END",
        },
        "",
    ),
    "old_car": ("part", {"k": "p_partkey", "price": "CAST(p_retailprice AS DECIMAL(12,2))", "km": "p_size", "photo_url": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'p' || CAST(p_partkey % 9 AS STRING) END", "status": "CASE WHEN p_partkey % 23 = 0 THEN 'gone' ELSE 'available' END"}, "WHERE p_partkey % 10 <> 0"),
    "new_car": (
        "part",
        {
            "k": "p_partkey",
            "price": "CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) + 50 AS DECIMAL(12,2)) ELSE CAST(p_retailprice AS DECIMAL(12,2)) END",
            "km": "CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END",
            "photo_url": "'p' || CAST((p_partkey + CASE WHEN p_partkey % 29 = 0 THEN 1 ELSE 0 END) % 9 AS STRING)",
            "seq": "p_partkey",
        },
        "WHERE p_partkey % 10 <> 1",
    ),
    "run": ("events", {"source_key": "'u' || CAST(user_id AS STRING)", "run_id": "event_id", "finished_at": "ts", "ok": "event_type <> 'error'"}, ""),
    "inventory": ("events", {"entity_ulid": "'E' || lpad(CAST(user_id AS STRING), 9, '0')", "canonical_vehicle_ulid": "CASE WHEN event_id % 40 = 0 THEN props ELSE 'K' || CAST(CAST(floor(user_id / 3) AS BIGINT) AS STRING) || '-' || props END", "km": "CASE WHEN CAST(floor(user_id / 3) AS BIGINT) % 9 = 0 THEN 0 ELSE 45000 END"}, "WHERE event_type IN ('view', 'click', 'purchase')"),
    "web": ("pages", {"page_id": "page_id", "url": "url", "html": "html"}, ""),
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, tail = RELATIONS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if tail.startswith("WHERE"):
        df = df.where(tail[6:])
    if tail.startswith("GROUP BY"):
        keys = [k.strip() for k in tail[9:].split(",")]
        from pyspark.sql import functions as F

        grouped = {c: e for c, e in columns.items() if e.startswith(("max(", "min("))}
        # nearly every row of lineitem is an edge of its own: grouped in as many tasks as its rows ask for
        df = df.repartition(tasks(df), *keys) if table == "lineitem" else df
        df = df.groupBy(*keys).agg(*(F.expr(e).alias(c) for c, e in grouped.items()))
        return df.selectExpr(*(f"{c if c in grouped else e} AS {c}" for c, e in columns.items()))
    df = df.selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))
    return df.distinct() if tail == "DISTINCT" else df


def common_sql(names: list[str]) -> str:
    """WITH clause of the relations for the oracle's engine."""
    out = []
    for n in names:
        table, columns, tail = RELATIONS[n]
        head = "SELECT DISTINCT" if tail == "DISTINCT" else "SELECT"
        out.append(f"{n} AS ({head} {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table} {'' if tail == 'DISTINCT' else tail})")
    return "WITH RECURSIVE " + ",\n".join(out)


class Inputs:
    """Relations by attribute: x.entity, x.vehicle; x.table("orders") is the driver's own table."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in RELATIONS:
            raise AttributeError(name)
        return relation(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
