"""Written sinks, nested places and element-aware pages on small inputs."""

import os

import pytest
from pyspark.sql import functions as F

from stockloom.sources import elements, places, sinks

SCHEMA = "k long, price int, seen long"


def files(at):
    return {os.path.join(d, n) for d, _, names in os.walk(at) for n in names if n.endswith(".parquet") and "/data/" in d}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_run_rewrites_the_buckets_it_touches_and_counts_once(spark, tmp_path):
    table = sinks.BucketedTable(spark, str(tmp_path), SCHEMA, ["k"], 8)
    assert table.read().count() == 0
    assert table.write(spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("price"), F.lit(5).cast("long").alias("seen")), "one", sinks.first_writer(["k"], "seen"))
    before = files(tmp_path)
    merge = sinks.first_writer(["k"], "seen")
    batch = spark.createDataFrame([(3, 99, 9), (3, 98, 8), (1000, 7, 9)], SCHEMA)
    assert table.write(batch, "two", merge) and not table.write(batch, "two", merge)
    want = sorted([(k, 1, 5) for k in range(100) if k != 3] + [(3, 1, 9), (1000, 7, 9)])
    got = rows(table.read())
    assert [r for r in got if r[0] != 3] == [r for r in want if r[0] != 3] and [r for r in got if r[0] == 3][0][:2] == (3, 1)
    now, of = files(tmp_path), table.manifest()[1]
    assert before <= now and len(now - before) <= 2 and sorted(set(of.values())) == ["one", "two"] and list(of.values()).count("two") <= 2
    # a run that wrote its data but failed before its manifest is done again
    number = table.manifest()[0]
    os.remove(tmp_path / f"manifest/{number}/_SUCCESS")
    assert len(rows(table.read())) == 100
    assert table.write(batch, "two", merge) and rows(table.read()) == got
    assert table.clean() >= 1 and rows(table.read()) == got


def test_the_other_merges(spark, tmp_path):
    old, new = spark.createDataFrame([(1, 10, None), (2, None, 3)], SCHEMA), spark.createDataFrame([(2, 20, 4), (3, 30, 5), (1, None, 6)], SCHEMA)
    want = {"fill": [(1, 10, 6), (2, 20, 3), (3, 30, 5)], "ignore": [(1, 10, None), (2, None, 3), (3, 30, 5)], "newest": [(1, 10, 6), (2, 20, 4), (3, 30, 5)]}
    for name, merge in (("fill", sinks.fill_nulls(["k"])), ("ignore", sinks.ignore(["k"])), ("newest", sinks.newest(["k"]))):
        table = sinks.BucketedTable(spark, str(tmp_path / name), SCHEMA, ["k"], 4)
        table.write(old, "a", merge)
        table.write(new, "b", merge)
        assert sorted(rows(table.read()), key=str) == sorted(want[name], key=str), name


def test_scans_of_places_skip_what_lies_outside(spark, tmp_path):
    n = 40_000
    lat, lon = F.col("id") % 200 * 0.4 - 40, F.floor(F.col("id") / 200) * 0.9 - 90
    df = spark.range(n).select(F.col("id").cast("string").alias("id"), F.struct(F.when(F.col("id") % 50 == 0, "").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("primary"), F.lit("c").alias("common")).alias("names"), F.struct(F.when(F.col("id") % 2 == 0, "shop").otherwise("cafe").alias("primary"), F.array(F.lit("x")).alias("alternate")).alias("categories"), F.struct(lon.cast("double").alias("xmin"), lat.cast("double").alias("ymin")).alias("bbox"), F.array(F.struct(F.lit("L").alias("locality"), F.lit("P").alias("postcode"), F.lit("F").alias("freeform"), F.when(F.col("id") % 3 == 0, "ES").otherwise("PT").alias("country"))).alias("addresses"), F.array(F.lit("w")).alias("websites"), F.lit(None).cast("double").alias("confidence"))
    places.write_places(df, str(tmp_path / "p"), 16, 64 << 10)
    box = (-10.0, -10.0, -1.0, 0.0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        out = places.scan_places(spark, str(tmp_path / "p"), box, "ES", ["shop"])
        plan = out._jdf.queryExecution().executedPlan()
        got = {r["id"] for r in out.collect()}
        text = plan.toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = {str(i) for i in range(n) if -10 <= i % 200 * 0.4 - 40 <= 0 and -10 <= i // 200 * 0.9 - 90 <= -1 and i % 2 == 0 and i % 3 == 0 and i % 50}
    assert got == want
    assert "GreaterThanOrEqual(bbox.xmin,-10.0)" in text and "common" not in text[text.index("ReadSchema") :] and "alternate" not in text[text.index("ReadSchema") :]
    # of the whole table only row groups that meet the box are read
    q = spark.read.parquet(str(tmp_path / "p")).where(F.col("bbox.xmin").between(box[0], box[2]) & F.col("bbox.ymin").between(box[1], box[3]))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = q._jdf.queryExecution()
        q._jdf.queryExecution().executedPlan().executeCollect()
        node = plan.executedPlan()
        while node.children().size():
            node = node.children().apply(0)
        read = node.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < read < n / 4


PAGE = """<!DOCTYPE html><!-- <div itemscope> --><body>
<div itemscope itemtype="https://schema.org/Car"><h1 itemprop=name>Seat <b>Ibiza</b> &amp; more</h1>
 <div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><meta itemprop="price" content="19.800,00"><span itemprop="priceCurrency">EUR</span>
  <p itemprop="seller" itemscope><span itemprop="name">Dealer &lt;1&gt;</span></div>
 <img itemprop="image" src="/a.jpg"><a itemprop="url brand" href="/x">SEAT</a><script>var s = "<span itemprop='name'>no</span>";</script>
 <p itemprop="description">2019, 45.000 km, diesel</p></div><i itemprop="loose">L</i>"""


def test_nested_items():
    got = [(i["item"], i["parent"], i["property"], i["values"]) for i in elements.items_of(PAGE)]
    assert got == [
        (0, None, None, [["loose", "L"]]),
        (1, None, None, [["name", "Seat Ibiza & more"], ["offers", "#2"], ["image", "/a.jpg"], ["url", "/x"], ["brand", "/x"], ["description", "2019, 45.000 km, diesel"]]),
        (2, 1, "offers", [["price", "19.800,00"], ["priceCurrency", "EUR"], ["seller", "#3"]]),
        (3, 2, "seller", [["name", "Dealer <1>"]]),
    ]
    assert elements.items_of("") == elements.items_of("<p>no items</p>") == []


def test_microdata_vehicles(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>nothing</p>"), (3, None), (4, "<span itemprop='name'>Opel 2015 120.000 km</span>")], "id int, html string")
    got = {r["id"]: (r["title"], r["year"], r["km"], None if r["price"] is None else float(r["price"])) for r in elements.microdata_vehicles(df, "html").collect()}
    assert got == {1: ("Seat Ibiza & more", 2019, 45000, 19800.0), 4: ("Opel 2015 120.000 km", 2015, 120000, None)}


CARDS = {
    "ga-car-card": '<a href="/out">no</a><article class="ga-car-card big"><h3 class="ga-car-card__title"> <a href="/c/1">Audi A3</a></h3><div class="ga-car-card__price-pill"><span>Desde: 12.500 €</span></div><span class="ga-car-card__spec-text">2018</span><span class="ga-car-card__spec-text">90.000 km</span><span class="ga-car-card__spec-text">Diésel</span></article><p>2001</p><article class="ga-car-card"><h3 class="ga-car-card__title"><a href="/c/1">again</a></h3></article><article class="ga-car-card"><b>no link</b></article>',
    "stm_motors": '<div class="grid"><div class="stm-isotope-listing-item all" data-price="20900.00" data-title="BMW X1"><div><a href="https://h/listings/2"><img></a></div><span>34000 km</span><span>2020</span><span>Gasolina</span></div></div>',
    "auto_listing": '<ul><li class="x auto-listing type-auto-listing"><h3 class="title"><a href="/coches/z">Kia Rio</a></h3><span class="price-amount">8.900</span><ul><li>61.000 km</li><li>Gasolina</li></ul></li><li>not a card 2011</li></ul>',
}


@pytest.mark.parametrize(("theme", "want"), [("ga-car-card", ("https://d.es/c/1", "Audi A3", 12500.0, 2018, 90000, "Diésel")), ("stm_motors", ("https://h/listings/2", "BMW X1", 20900.0, 2020, 34000, "Gasolina")), ("auto_listing", ("https://d.es/coches/z", "Kia Rio", 8900.0, None, 61000, "Gasolina"))])
def test_cards_end_with_their_elements(spark, theme, want):
    pages = spark.createDataFrame([("d.es", CARDS[theme]), ("d.es", "<p>no theme</p>")], "host string, html string")
    (r,) = elements.card_vehicles(elements.page_cards(pages, "html"), "host").collect()
    assert r["theme"] == theme and (r["deep_link"], r["title"], float(r["price"]), r["year"], r["km"], r["fuel"]) == want
