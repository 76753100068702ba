"""Identity steps whose work grows with the rows, against all pairs."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from stockloom.operators import resolve
from stockloom.operators.graph import components


def of(edges):
    return {(r["node"], r["component"]) for r in components(edges.select("a", "b")).collect()}


def sourced(spark, n, seed):
    pick = random.Random(seed)
    names, kinds = ["Talleres Norte SL", "talleres norte", "Autos Lejanos", "Flexicar 1", "Sur", None], [["geo"], ["web", "ads"], ["geo", "web"], ["ads"], None]
    rows = [(f"E{i:03d}", pick.choice(names), pick.choice(["28079", "08019", None]), pick.choice([None, None, "600111222", "+34 600 111 222", "911112233"]), pick.choice([None, None, "http://a.es", "www.b.es/x"]), pick.choice(kinds)) for i in range(n)]
    df = spark.createDataFrame(rows, "entity_ulid string, trade_name string, municipality_code string, phone string, website string, source_keys array<string>")
    return df.select("*", F.lit("directory").alias("source_group"), F.lit(None).cast("string").alias("address"), F.lit(None).cast("string").alias("cif"), F.lit(None).cast("double").alias("lat"), F.lit("c").alias("cdp_code"), F.lit("2025-01-01").cast("date").alias("created_at"))


def test_cross_source_clusters_are_those_of_all_pairs(spark):
    for seed in range(3):
        rows = sourced(spark, 25, seed)
        edges = resolve.cross_source_edges(rows, ["geo"], ["web"]).cache()
        near = {(a, b): float(p) for r in edges.collect() for a, b, p in ((r["a"], r["b"], r["probability"]), (r["b"], r["a"], r["probability"]))}
        want = dict(of(edges))
        got = resolve.cross_source_clusters(rows, ["geo"], ["web"]).collect()
        head = {r["entity_ulid"]: r["canonical_ulid"] for r in got}
        assert len(got) == 25 and {x: want.get(x, x) for x in head} == {x: min(y for y in head if head[y] == head[x]) for x in head}
        assert all(r["match_probability"] == near.get((r["entity_ulid"], r["canonical_ulid"])) for r in got)
        assert edges.count() > 0


def test_cross_source_links_grow_with_the_rows(spark):
    rows = spark.range(400).select(F.format_string("E%03d", "id").alias("entity_ulid"), F.lit("Talleres Norte").alias("trade_name"), F.lit("28079").alias("municipality_code"), F.lit("600111222").alias("phone"), F.lit(None).cast("string").alias("website"), F.array(F.when(F.col("id") % 2 == 0, "geo").otherwise("web")).alias("source_keys"))
    links = resolve.cross_source_links(resolve.cross_source_keys(rows), ["geo"], ["web"])
    assert links.count() <= 2 * 2 * 400 and resolve.cross_source_edges(rows, ["geo"], ["web"]).count() == 200 * 200
    assert len({c for _, c in of(links)}) == 1


def test_vehicle_links_have_the_clusters_of_all_pairs_and_grow_with_the_rows(spark):
    pick = random.Random(5)
    rows = [(f"C{i:03d}", f"E{pick.randrange(4)}", "Seat", pick.choice(["ibiza", "Leon"]), 2020, pick.choice([None, 50000]), Decimal(pick.randrange(-1, 40) * 37), pick.choice(["t1", "T 1", "", None, "t2"]), pick.choice([None, None, "https://x/p1", "https://x/p2?v=1"]), "28", f"2025-01-{1 + i % 20:02d}") for i in range(120)]
    cars = spark.createDataFrame(rows, "vehicle_ulid string, entity_ulid string, make string, model string, year int, km int, price decimal(12,2), title string, photo_url string, province_code string, first_seen string")
    edges, links = resolve.vehicle_edges(cars), resolve.vehicle_links(cars)
    found = [sorted(map(tuple, resolve.vehicle_clusters(cars, e).collect())) for e in (edges, links)]
    assert found[0] == found[1] and {"none", "firma", "both", "photo_url"} >= {r[3] for r in found[0]}
    same = cars.limit(1).select("*").crossJoin(spark.range(100)).withColumn("vehicle_ulid", F.format_string("D%03d", "id")).withColumns({"price": F.lit(100).cast("decimal(12,2)"), "km": F.lit(1), "title": F.lit("t"), "photo_url": F.lit("https://x/p1")})
    assert resolve.vehicle_edges(same).count() == 100 * 99 // 2 and resolve.vehicle_links(same).count() <= 5 * 100


def test_seller_links_are_dealt_by_their_municipality(spark):
    """The forests of `near` are the components at once: one star step checks them."""
    from stockloom.operators.graph import Tables

    e = spark.range(2000).select((F.col("id") % 7).alias("m"), (F.col("id") % 7 + 7 * F.floor(F.col("id") / 14)).alias("a"), F.col("id").alias("b"))
    few, many = Tables(spark), Tables(spark)
    one = {tuple(r) for r in components(e, few, "m").collect()}
    assert one == {tuple(r) for r in components(e.select("a", "b"), many).collect()}
    assert few.made <= 2


def test_keyed_pairs_come_once_without_a_shuffle_of_pairs(spark):
    """Ids with several rows, shared keys of two kinds; no aggregate stands above the join."""
    from stockloom.operators.blocking import keyed_pairs

    pick = random.Random(3)
    rows = [(pick.randrange(25), pick.choice(["x", "y", None]), pick.choice(["1", "2", "3", None]), pick.choice(["u", "v", "w", None])) for _ in range(60)]
    got = keyed_pairs(spark.createDataFrame(rows, "id int, k string, p string, w string"), ["k"], "id", {"p": "p", "w": "w"})
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] and a[1] == b[1]:
                for n, s in ((2, "p"), (3, "w")):
                    if a[n] and a[n] == b[n]:
                        want.setdefault((a[0], b[0]), set()).add(s)
    assert sorted((r["a"], r["b"], r["p"], r["w"]) for r in got.collect()) == sorted((*k, "p" in v, "w" in v) for k, v in want.items()) and want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")] and "Distinct" not in plan
