"""Cases of the operators on tiny frames."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stockloom.functions import normalize as N
from stockloom.operators import audit, delta, geo, resolve, serving
from stockloom.operators.graph import components
from stockloom.sources import readers

CAR = "vehicle_ulid string, entity_ulid string, make string, model string, year int, km int, price decimal(12,2), title string, photo_url string, province_code string, first_seen timestamp"


def car(id, **k):
    base = {"entity_ulid": "ENT1", "make": "seat", "model": "ibiza", "year": 2020, "km": 50000, "price": Decimal("8000"), "title": "Seat Ibiza 2020", "photo_url": None, "province_code": "28", "first_seen": datetime(2026, 1, 1)}
    return (id, *(base | k).values())


def grouped(spark, *cars):
    df = spark.createDataFrame(list(cars), CAR)
    out = resolve.vehicle_clusters(df, resolve.vehicle_edges(df)).collect()
    return {r["vehicle_ulid"]: (r["canonical_ulid"], r["match_signal"], r["cluster_size"]) for r in out}


def test_vehicle_clusters(spark):
    g = grouped(
        spark,
        car("a", photo_url="https://x/p.jpg/320x240?v=2", entity_ulid="E1"), car("b", photo_url="https://X/p.jpg", province_code="08", entity_ulid="E2"), car("z", photo_url="https://x/p_320x240.jpg", make="fiat", entity_ulid="E9"),
        car("c", make="Kia", title="t1"), car("d", make="kia ", title="t2", first_seen=datetime(2025, 1, 1)),
        car("e", make="vw", title="Golf", entity_ulid="E3"), car("f", make="vw", title="golf!", entity_ulid="E4", price=Decimal("8160")),
        car("g", make="bmw"), car("h", make="bmw", price=Decimal("8500")), car("i", make="opel", km=None), car("j", make="opel", km=None),
    )
    assert g["a"] == g["b"] == ("a", "photo_url", 2)
    assert g["c"] == g["d"] == ("d", "firma", 2)
    assert g["e"] == g["f"] == ("e", "firma", 2)
    assert all(g[x] == (x, "none", 1) for x in "ghijz")


def test_components_chain_is_order_free(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    for e in (edges, edges[::-1]):
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
        assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize(("h", "d", "p", "allow"), [(95, 100, None, True), (94, 100, None, False), (0, 0, None, True), (50, None, 100, True), (49, None, 100, False), (5, None, None, True), (0, None, 0, True)])
def test_guard(spark, h, d, p, allow):
    row = spark.createDataFrame([(h, d, p)], "h int, d int, p int").select(delta.guard(F.col("h"), F.col("d"), F.col("p")).alias("x")).first()
    assert row["x"] is allow


def test_reconcile_events_and_rerun(spark):
    shape = "k string, price decimal(12,2), km int, photo_url string, status string"
    old = spark.createDataFrame([("a", Decimal(10), 1, None, "available"), ("b", None, 2, "p", "available"), ("c", Decimal(5), 3, "p", "available"), ("d", Decimal(9), 1, "p", "gone"), ("e", Decimal(7), 1, "p", "available")], shape)
    new = spark.createDataFrame([("a", Decimal(11), None, "q", 1), ("a", Decimal(99), 9, "z", 2), ("b", Decimal(3), 4, "p", 3), ("d", Decimal(9), 1, "p", 4), ("e", Decimal(7), 1, "p", 5), ("n", Decimal(1), 1, "p", 6)], "k string, price decimal(12,2), km int, photo_url string, seq int")
    got = sorted((r["k"], r["event"]) for r in delta.reconcile(old, new, ["k"], "seq").collect())
    assert got == [("a", "PHOTO_CHANGE"), ("a", "PRICE_CHANGE"), ("b", "KM_CHANGE"), ("c", "GONE"), ("d", "UNCHANGED"), ("e", "UNCHANGED"), ("n", "NEW")]
    now = delta.apply_snapshot(old, new, ["k"], "seq")
    again = delta.reconcile(now.where("status = 'available'"), new, ["k"], "seq").where("event <> 'UNCHANGED'")
    assert again.count() == 0
    closed = delta.reconcile(old, new, ["k"], "seq", declared=1000)
    assert [r["k"] for r in closed.where("event = 'GONE_SUPPRESSED'").collect()] == ["c"]


def test_quorum(spark):
    rows = [("t", 0, 5), ("t", 1, 5), ("t", 2, 9), ("r", 0, 5), ("r", 1, 9), ("u", 0, 5), ("u", 1, None), ("n", 0, None), ("n", 1, 4), ("n", 2, 4), ("z", 0, 0), ("z", 1, 0), ("w", 0, 100), ("w", 1, 98)]
    got = {r["k"]: r["verdict"] for r in audit.quorum(spark.createDataFrame(rows, "k string, seq int, value long"), "k", 0.05).collect()}
    assert got == {"t": "TRUSTWORTHY", "r": "REFUTED", "u": "UNVERIFIED", "n": "TRUSTWORTHY", "z": "TRUSTWORTHY", "w": "TRUSTWORTHY"}


def test_breaker(spark):
    runs = spark.createDataFrame([("s", i, datetime(2026, 1, 1, i), ok) for i, ok in enumerate([True, False, False, False, False, True, False])], "source_key string, run_id int, finished_at timestamp, ok boolean")
    got = [(r["fails"], r["status"], r["breaker"], r["tripped"], r["cooldown_s"]) for r in audit.breaker(runs).orderBy("run_id").collect()]
    # an hour passes between runs, so the first cooldown (900 s) is over when the fourth failure trips the breaker again
    assert got == [(0, "healthy", "closed", False, 0), (1, "degraded", "closed", False, 0), (2, "degraded", "closed", False, 0), (3, "down", "open", True, 900), (4, "down", "open", True, 1800), (0, "healthy", "closed", False, 0), (1, "degraded", "closed", False, 0)]


def test_normalisers(spark):
    row = spark.createDataFrame([("Talleres Núñez, S.L.", "+34 612 345 678", "https://www.A.es/x?y", "1.234.567,5 €", "03-2019")], "n string, p string, w string, e string, y string").select(
        N.name_key(F.col("n")).alias("n"), N.phone_last9(F.col("p")).alias("p"), N.host(F.col("w")).alias("h"), N.bare_host(F.col("w")).alias("b"), N.to_price(F.col("e")).alias("e"), N.year_of(F.col("y")).alias("y"), N.name_key(F.lit("SL")).alias("s"))
    assert tuple(row.first()) == ("talleresnunez", "612345678", "a.es", None, Decimal("1234567.50"), 2019, "sl")


def test_pages_and_ledger(spark):
    df = spark.range(120)
    assert [r["id"] for r in serving.page(df, ["id"], 2, 50).collect()] == list(range(50, 100))
    with pytest.raises(ValueError):
        serving.page(df, ["id"], 1, 201)
    assert serving.envelope([1], 1)["meta"]["has_more"] is True
    assert readers.migrate({}, [("a", "x")]) == ["a"]
    with pytest.raises(ValueError):
        readers.migrate({"a": "other"}, [("a", "x")])


def test_star_links_have_the_components_of_all_pairs(spark):
    rows = [("E1", "Talleres Norte", "28079", "600111222", None), ("E2", "TALLERES NORTE SL", "28079", None, "http://a.es"), ("E3", "Autos Lejanos", "28079", "600 111 222", None),
            ("E4", "Talleres Norta", "28079", None, None), ("E5", "Talleres Norte", "08019", "600111222", None), ("E6", "Otra Casa", "28079", None, "www.a.es/stock"), ("E7", None, None, None, None)]
    df = spark.createDataFrame(rows, "entity_ulid string, trade_name string, municipality_code string, phone string, website string")
    of = lambda edges: {(r["node"], r["component"]) for r in components(edges.select("a", "b")).collect()}
    found = of(resolve.dealer_links(df))
    assert found == of(resolve.dealer_edges(df)) == {(f"E{i}", "E1") for i in (1, 2, 3, 4, 6)}
    # the block cap counts rows, not distinct names
    assert ("E4", "E1") not in of(resolve.dealer_links(df, most=3)) and of(resolve.dealer_links(df, most=3)) == of(resolve.dealer_edges(df, most=3))


def test_j15_and_j25_read_every_entity(spark):
    from stockloom.plans import catalog
    from stockloom.plans.fixtures import Inputs

    entity = Inputs(spark, "/root/testdata/sf0.001").entity
    assert catalog.QUERIES["j25_attribution"](spark, "/root/testdata/sf0.001").count() == entity.where("n % 2 = 0").count()
    found = {r[0] for r in catalog.QUERIES["j15_fuzzy_names"](spark, "/root/testdata/sf0.001").select("entity_ulid").collect()}
    assert found - {r[0] for r in entity.where("n % 20 = 3").select("entity_ulid").collect()}


def test_rule_values(spark):
    """Outcomes that the rules' own descriptions fix."""
    from pyspark.sql import functions as F

    from stockloom.functions import normalize as N
    from stockloom.operators.resolve import CHAIN
    from stockloom.sources import payloads

    def of(f, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]

    assert of(N.photo_key, "https://c/cars/img.jpg?w=640", "https://C/img/", "https://c/img_thumb", "https://c/img/640w", "https://c/img_320x240.jpg", "  ") == ["https://c/cars/img.jpg", "https://c/img", "https://c/img", "https://c/img", "https://c/img_320x240.jpg", None]
    assert of(N.name_key, "AUTOMOCION DEL OESTE, S.A.", "Talleres Pérez S.L.U.", "Coop Motor S.Coop", "Sala", "ASA", "Garaje C.B.") == ["automociondeloeste", "talleresperez", "coopmotor", "sala", "asa", "garajecb"]
    assert of(N.name_key_words, "Autos S L Norte", "S.C.P. Motor Sociedad Limitada", "Casa S.A.U.") == ["autosnorte", "motor", "casa"]
    assert of(N.bare_host, "https://www.Dealer.es/?utm=1", "dealer.es/stock", "http://dealer.es#top", "dealer.es///") == ["dealer.es", None, "dealer.es", "dealer.es"]
    none = F.lit(None).cast("string")
    assert of(lambda c: N.canonical_key(none, c, none, none, none, none, none, none), " b-123 ") == ["cif:B-123"]
    assert of(lambda c: N.canonical_key(none, none, none, none, none, none, c, F.lit(" 7 ")), " Mil-Anuncios.com ") == ["particular:milanuncioscom:7"]
    assert of(N.repair_action, "HTTP 403", "akamai wall", "Too many requests", "rate of change", "JSON path missing", "boom", None) == ["refingerprint", "escalate_tier", "quarantine", "escalate_owner", "re_receta", "escalate_owner", "escalate_owner"]
    assert of(lambda c: N.repair_action(c, F.lit(401)), "x") == ["refingerprint"] and of(lambda c: N.repair_action(c, F.lit(429)), "x") == ["quarantine"]
    assert of(lambda c: c.rlike(CHAIN), "Grupo Gil Motor", "BMW  Premium Madrid", "Mercedes-Benz Sur", "Mobility Centro", "Autohero", "Motor Grupo") == [True, True, True, True, False, False]
    assert of(payloads.vehicle_path, "https://a.es/coches/seat-leon-12", "https://a.es/coches/", "https://a.es/coches", "https://a.es/es/stock/", "https://a.es/VO/1") == [True, False, False, True, True]
    assert of(N.place_kind, "junkyard", "car_auction", "car_dealer", "automotive_repair", None) == ["desguace", "subasta", "compraventa", "garaje", "garaje"]
    assert of(lambda c: N.shown_value(c, N.FUEL_NAMES), " Gasolina ", "ELÉCTRICO", " GNC ", " ", None) == ["Gasolina", "Electrico", "GNC", None, None]
    got = [(r["family"], r["subfamily"]) for r in of(payloads.family, "<p>Motorflash wp-content", "wix.com joomla", "wp-json wp-cars", '<META name="generator" content="Hugo 1">', "x")]
    assert got == [("dms", "motorflash"), ("builder", "wix"), ("cms", "wordpress+wp_auto_listing"), ("generic", "hugo"), ("generic", "custom")]


def test_adjudication_and_resolution(spark):
    """A clean phone or host merges inside a province, a crowded one alone does not, a fingerprint does anywhere; the richest seller is canonical."""
    from stockloom.operators import resolve

    shape = "entity_ulid string, province_code string, phone string, website string, address string, cif string, lat double, municipality_code string, n_vehicles int, created_at date"
    rows = [
        ("a", "28", "911223344", None, None, None, None, None, 5, None), ("b", "28", "+34 911 22 33 44", "b.es", "x", None, 1.0, None, 1, None), ("c", "08", "911223344x", None, None, None, None, None, 0, None),
        ("d", "28", "600000001", "d.es", None, None, None, None, 0, None), ("e", "08", None, "https://www.d.es/", None, None, None, None, 0, None),
        ("f", "41", "622222222", "f.es", None, None, None, None, 1, None), ("g", "41", "622222222", None, None, None, None, None, 1, None),
        ("h", "50", None, "h.es", None, None, None, None, 1, None), ("i", "50", None, "h.es/x", None, None, None, None, 9, None),
    ]
    sellers = spark.createDataFrame(rows, shape)
    inventory = spark.createDataFrame([*((s, f"v{i}", 10) for s in "de" for i in range(3)), ("d", "zero", 0), *((s, "crowd", 5) for s in "abcde")], "entity_ulid string, canonical_vehicle_ulid string, km int")
    edges = resolve.adjudicate(sellers, resolve.fingerprints(inventory))
    assert {tuple(r) for r in edges.collect()} == {("d", "e", "fingerprint+website", 1.0), ("f", "g", "phone", 1.0), ("h", "i", "website", 1.0)}
    out = {r["entity_ulid"]: (r["resolved_ulid"], r["cluster_size"], r["signal"], r["probability"]) for r in resolve.resolution_clusters(sellers, edges).collect()}
    assert out["a"] == ("a", 1, "none", None) and out["d"] == out["e"] == ("d", 2, "fingerprint+website", 1.0) and out["g"] == ("f", 2, "phone", 1.0) and out["h"][0] == "i"


def test_a_stream_of_snapshots_advances_its_state(spark, tmp_path):
    """The second batch is held against what the first one left, and a later call goes on from the named folder."""
    from stockloom.streaming import incremental

    shape = "k string, price decimal(12,2), km int, photo_url string, status string"
    old = spark.createDataFrame([("a", Decimal(10), 1, "p", "available"), ("b", Decimal(20), 1, "p", "available")], shape)
    snapshot = lambda *rows: spark.createDataFrame([(k, Decimal(p), 1, "p", 1) for k, p in rows], "k string, price decimal(12,2), km int, photo_url string, seq int")
    at = f"file://{tmp_path}/stream"
    one = incremental.stream_reconcile(spark, old, snapshot(("a", 10), ("c", 5)), ["k"], "seq", at)
    assert {(r["k"], r["event"]) for r in one.collect()} == {("a", "UNCHANGED"), ("b", "GONE"), ("c", "NEW")}
    two = incremental.stream_reconcile(spark, old, snapshot(("a", 12), ("c", 5)), ["k"], "seq", at).where("batch = 1")
    assert {(r["k"], r["event"]) for r in two.collect()} == {("a", "PRICE_CHANGE"), ("c", "UNCHANGED")}


def test_nearest_equals_brute_force(spark):
    """Close and far points, a label at a high latitude, ties to the smaller code."""
    import math
    import random

    from stockloom.operators import geo

    rng = random.Random(3)
    labels = [(f"c{i:03}", rng.uniform(36, 43), rng.uniform(-9, 3)) for i in range(80)] + [("north", 70.0, 20.0), ("b", 40.0, 0.5), ("a", 40.0, 1.5)]
    spots = [(i, rng.uniform(36, 43), rng.uniform(-9, 3)) for i in range(60)] + [(100, -50.0, 170.0), (101, 69.0, 30.0), (102, 40.0, 1.0), (103, None, 1.0)]
    got = {r["id"]: r["code"] for r in geo.nearest(spark.createDataFrame(spots, "id int, lat double, lon double"), spark.createDataFrame(labels, "code string, lat double, lon double"), "id", "code").collect()}
    d2 = lambda p, c: ((p[1] - c[1]) ** 2 + ((p[2] - c[2]) * math.cos(math.radians(c[1]))) ** 2, c[0])
    assert got == {p[0]: min(labels, key=lambda c: d2(p, c))[0] for p in spots if p[1] is not None}


def test_fill_down_over_ranges(spark):
    from stockloom.operators import blocking

    rows = [(i, f"h{i}" if i in (3, 40, 41) else None) for i in range(200)]
    got = blocking.fill_down(spark.createDataFrame(rows, "i int, h string").repartition(8), "h", "i").orderBy("i").collect()
    want, last = [], None
    for i, h in rows:
        last = h or last
        want.append((i, last))
    assert [tuple(r) for r in got] == want


def test_free_text_province(spark):
    provinces = geo.province_names(spark.createDataFrame([("28", "Madrid"), ("08", "Barcelona"), ("15", "Coruña, A"), ("48", "Bizkaia"), ("33", "Asturias"), ("26", "Rioja, La")], "code string, name string"))
    towns = spark.createDataFrame([("Prat de Llobregat, El", "08"), ("Sant Boi de Llobregat", "08"), ("Siero", "33"), ("San Martín", "33"), ("San Martín", "28"), ("Fuenlabrada", "28")], "name string, province_code string")
    asked = ["Oyarzun", "BIZKAIA", "A Coruña", "Rioja La", "28", "Fuenlabrada MADRID", "Sant Boi", "EL PRAT DEL LLOBREGAT", "GRANDA SIERO", "San Martín", "zzz", "", None, "PALMA DE MALLORCA", "la"]
    rows = spark.createDataFrame([(i, t, "Autos Madrid S.A." if t == "zzz" else "A.R. MOTORS LA S.L.") for i, t in enumerate(asked)], "id int, t string, s string")
    got = {asked[r["id"]]: (r["province"], r["tier"]) for r in geo.free_text_province(rows, "id", "t", "s", provinces, towns).collect()}
    assert got == {
        "Oyarzun": ("20", "alias"), "BIZKAIA": ("48", "whole"), "A Coruña": ("15", "whole"), "Rioja La": ("26", "whole"), "28": ("28", "whole"), "Fuenlabrada MADRID": ("28", "window"),
        "Sant Boi": ("08", "subset"), "EL PRAT DEL LLOBREGAT": ("08", "subset"), "GRANDA SIERO": ("33", "token"), "San Martín": (None, None), "zzz": ("28", "seller"), "PALMA DE MALLORCA": ("07", "window"),
        "la": ("26", "whole"),
    }


def test_place_by_name(spark):
    provinces = geo.province_names(spark.createDataFrame([("28", "Madrid"), ("08", "Barcelona")], "code string, name string"))
    towns = spark.createDataFrame([("28079", "Madrid", "28", 40.4, -3.7), ("28058", "Fuenlabrada", "28", 40.28, -3.79), ("08019", "Barcelona", "08", 41.38, 2.17)], "code string, name string, province_code string, lat double, lon double")
    places = spark.createDataFrame([(1, "Madrid", 41.38, 2.17), (2, "Nowhere", 40.28, -3.8), (3, None, 41.4, 2.2), (4, "Barcelona", None, None), (5, None, None, None), (6, None, 43.0, -3.7)], "id int, locality string, lat double, lon double")
    got = {r["id"]: (r["province"], r["municipality"]) for r in geo.place_by_name(places, provinces, towns, "id").collect()}
    assert got == {1: ("28", "28079"), 2: ("28", "28058"), 3: ("08", "08019"), 4: ("08", "08019"), 5: (None, None), 6: ("28", None)}


def test_addresses(spark):
    cases = {
        "Av. Mar 4, 17200 Palafrugell, Girona": ("17200", "Palafrugell", "Girona"), "CL UNO  LA LINEA, CADIZ 11300": ("11300", "LA LINEA", "CADIZ"),
        "CL DOS -07100 - SOLLER -BALEARES": ("07100", "SOLLER", "BALEARES"), "Calle Sola 9": (None, None, None), "": (None, None, None), None: (None, None, None), "a, 28001 Villa 1": ("28001", "a", "Villa 1"),
    }
    rows = spark.createDataFrame([(a,) for a in cases], "a string").select("a", N.address_parts(F.col("a")).alias("p")).collect()
    assert {r["a"]: tuple(r["p"]) for r in rows} == cases


def test_coverage_counts_and_segments(spark):
    d = spark.createDataFrame([("a", 100, None, None), ("b", 100, None, 360), ("c", 0, None, None), ("d", 100, 0.5, None), ("e", 100, None, None)], "source string, declared_total long, coverage_floor double, captured_distinct long")
    c = spark.createDataFrame([("a", 90), ("b", 360), ("c", 7), ("d", 60)], "source string, captured_db long")
    got = {r["source"]: (r["captured_db"], r["db_edges"], r["verdict"], r["alert"]) for r in audit.coverage(d, c, spark.createDataFrame([("a", 5)], "source string, db_edges long")).collect()}
    assert got == {"a": (90, 5, "TRUSTWORTHY", None), "b": (360, 0, "TRUSTWORTHY", "over"), "c": (0, 0, "UNVERIFIED", None), "d": (60, 0, "REFUTED", None), "e": (0, 0, "REFUTED", "under")}
    v = spark.createDataFrame([("x", 1000, 1004), ("y", 1000, 1040), ("z", 0, 0)], "k string, db long, seen long")
    assert {r["k"]: r["verdict"] for r in audit.count_verdict(v, "k", "db", "seen", 0.005).collect()} == {"x": "TRUSTWORTHY", "y": "REFUTED", "z": "TRUSTWORTHY"}
    s = spark.createDataFrame([("01", 10, 9, 0, 30), ("02", 5, 2, 1, 70), ("03", 0, 0, 0, 0)], "province_code string, base long, served long, leads long, people long")
    got = {r["province_code"]: (r["want"], r["part"], r["verdict"]) for r in audit.segment_coverage(s, 0.5, 10).collect()}
    assert got == {"01": (5, 3, "SELLADO"), "02": (2, 7, "SELLADO"), "03": (0, 0, "GAP-CON-CAUSA"), "ES": (7, 10, "SELLADO")}


def test_sanity_of_clusters(spark):
    sellers = spark.createDataFrame([("A", "28", "28001", "S", "Flexicar", "firm", None, None), ("B", "08", "08001", "S", "Flexicar", "firm", "", None), ("C", "28", "28001", "S", "Flexicar", "firm", None, None)], "entity_ulid string, province_code string, municipality_code string, source_group string, trade_name string, kind string, website string, phone string")
    cars = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C"), ("4", "C")], "vehicle_ulid string, entity_ulid string")
    found = spark.createDataFrame([("1", "1", 2, "firma"), ("2", "1", 2, "firma"), ("3", "3", 1, "firma")], "vehicle_ulid string, canonical_ulid string, cluster_size long, match_signal string")
    assert tuple(resolve.vehicle_sanity(cars, found, sellers, giant=1).first()) == (1, 1, 1, 0, 1)
    joined = spark.createDataFrame([("A", "A", 2), ("B", "A", 2), ("C", "C", 1)], "entity_ulid string, canonical_ulid string, cluster_size long")
    r = resolve.dealer_sanity(sellers, joined, "%flexicar%").first().asDict()
    assert r == {"same_name_groups": 1, "same_name_merged": 0, "unsupported": 1, "largest": 2, "chain_canonicals": 2, "chain_municipalities": 2}


def test_bisection(spark):
    rows = spark.createDataFrame([(v,) for v in [0, 0, 0, 1, 5, 5, 9, None, 10, -1]], "v long")
    bands = lambda most, lo, hi: sorted(map(tuple, audit.bisect(rows, "v", most, lo, hi).collect()))
    assert bands(2, 0, 10) == [(0, 1, 3), (1, 2, 1), (2, 5, 0), (5, 7, 2), (7, 10, 1)]
    assert bands(100, 0, 10) == [(0, 10, 7)] and bands(1, 20, 30) == [(20, 30, 0)] and bands(0, 9, 10) == [(9, 10, 1)]


def test_old_tables_are_removed_and_young_ones_stay(spark, tmp_path):
    import os

    from stockloom.operators.graph import clean

    for name, age in (("stockloom-old", 9000), ("stockloom-young", 10), ("other", 9000)):
        (tmp_path / name / "t").mkdir(parents=True)
        for p in (tmp_path / name / "t", tmp_path / name):
            os.utime(p, (os.path.getmtime(p) - age,) * 2)
    assert clean(spark, 1, str(tmp_path)) == 1 and sorted(os.listdir(tmp_path)) == ["other", "stockloom-young"]
    assert clean(spark, 1, str(tmp_path / "none")) == 0


def test_attribution_meets_common_words_by_rare_ones(spark):
    """a word of all names and a phone of all rows join nothing; both directions of inclusion count, and the first entry in order."""
    listings = [(f"l{i}", "910000000", f"Autos {i} Norte") for i in range(3000)] + [("x", None, "Autos"), ("y", None, "zeta Autos alfa"), ("z", None, "otro")]
    directory = [(i, f"d{i}", "910000000" if i % 2 else None, f"Autos {i} Sur") for i in range(3000)] + [(9001, "first", None, "alfa"), (9002, "second", None, "zeta alfa")]
    from stockloom.operators import geo

    out = geo.attribute_sellers(spark.createDataFrame(listings, "id string, phone string, seller string"), spark.createDataFrame(directory, "seq int, dealer string, phone string, name string"), "id")
    got = {r["id"]: (r["dealer"], r["tier"]) for r in out.collect()}
    assert got["l5"] == ("d1", "phone") and got["x"] == ("d0", "tokens") and got["y"] == ("first", "tokens") and got["z"] == (None, None) and len(got) == 3003


def test_crowded_phones_make_no_pairs(spark, monkeypatch):
    """400 sellers with one phone are no candidates; two of them with a clean host are."""
    rows = [(f"E{i:03}", "28", "910000000", f"https://h{i // 2 if i < 2 else i}.example/") for i in range(400)]
    sellers = spark.createDataFrame(rows, "entity_ulid string, province_code string, phone string, website string")
    prints = spark.createDataFrame([], "entity_ulid string, canonical_vehicle_ulid string")
    made, pairs = [], resolve.pairs
    monkeypatch.setattr(resolve, "pairs", lambda *a, **k: made.append(pairs(*a, **k)) or made[-1])
    found = resolve.adjudicate(sellers, prints)
    assert [tuple(r) for r in found.collect()] == [("E000", "E001", "phone+website", 1.0)]
    assert sum(p.count() for p in made) == 1  # 79,801 before


def test_nearest_labels_keep_a_point_one_row(spark):
    """2,000 points of one place meet 20 labels of their block as one row each; no aggregate sorts points times labels."""
    from stockloom.operators import geo

    labels = spark.createDataFrame([(f"c{i:02}", "28", 40.0 + i / 100, -3.0) for i in range(20)] + [("none", "28", None, None)], "code string, province_code string, lat double, lon double")
    points = spark.createDataFrame([(i, "28", 40.051, -3.0) for i in range(2000)], "id int, province_code string, lat double, lon double")
    inside = geo.nearest_in_block(points, labels, "province_code", "id", "code")
    assert "min_by" not in inside._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["code"], round(r["km"], 3)) for r in inside.collect()} == {("c05", 0.111)}
    assert [(r["code"], r["count"]) for r in geo.nearest(points, labels, "id", "code").groupBy("code").count().collect()] == [("c05", 2000)]


def test_excess_is_dealt_by_the_size_of_the_table(spark, monkeypatch):
    """A task groups a bounded number of rows, whatever the session's shuffle partitions; a key with most rows is grouped in several tasks first."""
    from stockloom.operators import blocking, resolve

    monkeypatch.setattr(blocking, "TASK_ROWS", 100)
    rows = [(1, 1.0, i % 3) for i in range(3000)] + [(i, 2.0, 7) for i in range(1000)] + [(i // 2, 3.0, i % 2) for i in range(1000)] + [(None, 1.0, 1), (None, 1.0, 2), (5000, 0.0, 1), (5000, -0.0, 2), (5001, 1.0, 1), (5001, 1.0, None)]
    df = spark.createDataFrame(rows, "k long, q double, p long").repartition(8)
    assert blocking.tasks(df) == -(-len(rows) // 100)
    out = resolve.excess(df, ["k", "q"], "p")
    assert (out.first()["excess"], out.first()["groups"]) == (2999 + 500 + 1, 1 + 500 + 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {-(-len(rows) // 100)}), REPARTITION_BY_NUM") >= 2 and "ENSURE_REQUIREMENTS" not in plan.replace("Exchange SinglePartition, ENSURE_REQUIREMENTS", "")
    first = blocking.spread(df, ["k", "q"], 60).withColumn("t", F.spark_partition_id()).where("k = 1 and q = 1").select("t").distinct().count()
    assert first > 1


def dealt(spark, monkeypatch, name, most):
    """The rows of a query with tasks of `most` table rows, and whether its table is grouped in tasks of that many only."""
    import duckdb

    from stockloom.operators import blocking
    from stockloom.plans import catalog

    from .test_oracles import DATA, plain

    monkeypatch.setattr(blocking, "TASK_ROWS", most)
    out, con = catalog.QUERIES[name](spark, DATA), duckdb.connect()
    n = blocking.tasks(spark.read.parquet(f"{DATA}/lineitem.parquet"))
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    rel = con.execute(catalog.ORACLE_SQL[name])
    theirs = sorted(tuple(plain(v) for v in r) for r in rel.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in out.select(*(d[0] for d in rel.description)).collect()) == theirs
    return out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count(f", {n}), REPARTITION_BY_NUM")


def test_both_paths_are_dealt_by_the_size_of_the_table(spark, monkeypatch):
    assert dealt(spark, monkeypatch, "g13_two_paths", 1000) == 4


def test_moved_edges_are_dealt_by_the_size_of_the_table(spark, monkeypatch):
    assert dealt(spark, monkeypatch, "g12_moved_edges", 1000) == 4


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """A municipality of more than 500 sellers called Flexicar 0, one Flexicar 1 and one Flexicar 2; only their names link them."""
    import duckdb

    from stockloom.plans import catalog

    keys = [*(k for k in range(90, 90 + 120 * 660, 120) if k % 7 and k % 13), *(next(k for k in range(2, 9000, 8) if k % 5 == n and k % 3 == 0 and k % 7 and k % 13) for n in (1, 2))]
    at = tmp_path_factory.mktemp("crowded")
    spark.createDataFrame([(k, f"Customer#{k:09d}", 1, "BUILDING", 0.0) for k in keys], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double").coalesce(1).write.parquet(f"{at}/customer.parquet")

    def both(name):
        con = duckdb.connect()
        con.execute(f"create view customer as select * from '{at}/customer.parquet/*.parquet'")
        df = catalog.QUERIES[name](spark, str(at))
        rel = con.execute(catalog.ORACLE_SQL[name])
        columns = [d[0] for d in rel.description]
        ours, theirs = sorted(map(tuple, df.select(*columns).collect())), sorted(rel.fetchall())
        assert ours == theirs
        return [dict(zip(columns, r, strict=True)) for r in ours]

    return len(keys), both


def test_sanity_of_a_crowded_municipality(crowded):
    """similar names are one cluster in a municipality of any size."""
    n, both = crowded
    assert both("g16_dealer_sanity") == [{"same_name_groups": 1, "same_name_merged": 1, "unsupported": 0, "chain_canonicals": 1, "chain_municipalities": 1, "largest": n}] and n > 500


def test_short_names_of_a_crowded_municipality(crowded):
    """names that differ by one character are not apart because their municipality is large."""
    assert crowded[1]("g16_short_names") == [{"rows": 2, "canonicals": 1, "apart": False}]


def test_edges_of_a_crowded_municipality(crowded):
    """every pair of similar names is an edge."""
    n, both = crowded
    assert sum(r["signal"] == "fuzzy" for r in both("g4_dealer_edges")) == 2 * (n - 2) + 1
