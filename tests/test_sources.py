"""Source mappings over small saved answers."""

import json

import pytest

from stockloom.sources import connectors, registries


def pages(spark, *payloads, **more):
    rows = [(p if isinstance(p, str) else json.dumps(p, ensure_ascii=False), *more.values()) for p in payloads]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["payload", *more]))


def test_every_mapping_plans_and_empty_answers_give_nothing(spark):
    bad = pages(spark, "{}", "[]", "not json", "[1, null]", "{\"items\": null}")
    for source in registries.REGISTRIES:
        assert registries.discovered(source, bad).collect() is not None, source
        assert registries.declared(source, bad).count() == 1
    for source in [*connectors.CONNECTORS, *connectors.SIBLINGS]:
        assert connectors.cars(source, bad).count() == 0, source
        assert connectors.sellers(source, bad).count() == 0, source


def test_dealer_locators(spark):
    byd = pages(spark, [{"organizationCode": "B1", "organizationName": " Uno ", "zipCode": "28001", "address": "Calle 1, Alcobendas, Madrid, Spain", "lat": "40.5", "lng": -3.6}, {"organizationCode": "B2", "zipCode": "AD500"}])
    (r,) = registries.discovered("oem_byd", byd).collect()
    assert (r["source_ref"], r["trade_name"], r["province"], r["municipality"], r["lat"], r["kind"]) == ("B1", "Uno", "28", "Alcobendas", 40.5, "concesionario_oficial")
    assert json.loads(r["extra"])["brand"] == "BYD" and registries.declared("oem_byd", byd).first()["declared"] == 1
    h = registries.discovered("oem_hyundai", pages(spark, {"dealers": [{"id": 7, "postalCode": 8205, "addressLine1": "A", "addressLine2": "B", "salesTelephone": "9"}]})).first()
    assert (h["source_ref"], h["postal_code"], h["province"], h["address"], h["phone"]) == ("7", "08205", "08", "A B", "9")
    kia = pages(spark, {"a": {"b": [{"dealerName": "K", "dealerSeq": 1, "dealerPostcode": "01001"}, {"dealerName": "L", "dealerPostcode": "99"}]}})
    assert [(x["source_ref"], x["province"]) for x in registries.discovered("oem_kia", kia).collect()] == [("1", "01")]
    s = registries.discovered("oem_skoda", pages(spark, [{"globalId": "g", "address": {"zip": "5002", "city": "Ávila, Ávila"}}])).first()
    assert (s["postal_code"], s["municipality"]) == ("05002", "Ávila")
    ld = '<script type="application/ld+json">{"@type":"AutomotiveBusiness","name":"D","address":{"postalCode":"46001","streetAddress":"S"}}</script>'
    assert [x["source_ref"] for x in registries.discovered("oem_dacia", pages(spark, ld, ld)).collect()] == ["D|46001"]


@pytest.mark.parametrize(("name", "place", "firm"), [("MG Getafe - Astara Retail", "Getafe", "Astara Retail"), ("MG CANARIAS-LA OROTAVA-SMALLCARS", "LA OROTAVA", "SMALLCARS"), ("MG Vigo", "Vigo", "MG Vigo")])
def test_store_names(spark, name, place, firm):
    r = registries.discovered("oem_mg", pages(spark, {"features": [{"properties": {"id": 1, "name": name}, "geometry": {"coordinates": [-3.5, 40.25]}}]})).first()
    assert (r["municipality"], r["legal_name"], r["lat"], r["lon"]) == (place, firm, 40.25, -3.5)


def test_open_map_and_official_list(spark):
    osm = pages(spark, {"elements": [{"type": "node", "id": 5, "lat": 1.5, "lon": 2.5, "tags": {"shop": "car", "name": "N", "addr:postcode": "28001", "addr:street": "S", "addr:housenumber": "3"}}, {"type": "way", "id": 6, "center": {"lat": 3, "lon": 4}, "tags": {"shop": "x", "name": "W"}}, {"type": "node", "id": 7, "tags": {}}]})
    got = {r["source_ref"]: (r["kind"], r["province"], r["address"], r["lat"]) for r in registries.discovered("osm", osm).collect()}
    assert got == {"node/5": ("compraventa", "28", "S 3", 1.5), "way/6": ("garaje", None, None, 3.0)} and registries.declared("osm", osm).first()["declared"] == 3
    d = registries.discovered("dgt_cat", pages(spark, {"features": [{"attributes": {"OBJECTID": 4, "Dirección": "X", "Teléfono_1": " 91 "}}]})).first()
    assert (d["source_ref"], d["address"], d["phone"], d["kind"]) == ("4", "X", "91", "desguace")
    assert registries.declared("dgt_cat", pages(spark, {"count": 1292})).first()["declared"] == 1292


def test_province_pages(spark):
    link = lambda d, t: f'<a href="x.dealer.{d}.html">{t}</a>'
    html = link("uno", "Concesionarios SEAT en Getafe y Parla | Uno &amp; Co") + link("uno", "otra vez")
    got = registries.discovered("oem_seat", pages(spark, html, slug="madrid").union(pages(spark, link("dos", "SEAT en Puerto, Lanzarote | Dos") + link("tres", "SEAT en La Palma | Tres"), slug="islas-canarias"))).collect()
    assert {(r["source_ref"], r["municipality"], r["trade_name"]) for r in got} >= {("tres@38", "La Palma", "Tres")} and {r["province"] for r in got} == {"28", "38"}


def test_cars(spark):
    c = connectors.cars("coches_net_wholesale", pages(spark, {"items": [{"id": 9, "url": "/c.aspx", "make": "Seat", "model": "León", "year": 1800, "km": 10, "price": {"amount": 99.5}, "transmissionTypeId": 2, "resources": [{"type": "VIDEO", "url": "v"}, {"type": "IMAGE", "url": "i"}], "seller": {"isProfessional": True, "contractId": 5}}]})).first()
    assert (c["listing_ref"], c["deep_link"], c["title"], c["year"], c["km"], float(c["price"]), c["transmission"], c["photo_url"], c["seller"]) == ("9", "https://www.coches.net/c.aspx", "Seat León", None, 10, 99.5, "Automático", "i", "5")
    broken = "Híbrido".encode().decode("latin-1")
    m = connectors.cars("milanuncios_wholesale", pages(spark, {"ads": [{"id": 1, "title": broken, "attributes": [{"field": {"raw": "year"}, "value": {"raw": "2019"}}, {"field": {"raw": "fuel"}, "value": {"raw": "diesel"}}]}]})).first()
    assert (m["title"], m["year"], m["fuel"]) == ("Híbrido", 2019, "Diésel")
    k = connectors.cars("oem_kia_wholesale", pages(spark, {"vehiculos": [{"id": 3, "precio": "19.900", "kilometros": "15.000", "matriculacion": "01/02/2021", "modelo": "Ceed"}]})).first()
    assert (float(k["price"]), k["km"], k["year"], k["title"]) == (19900.0, 15000, 2021, "KIA Ceed")
    s = connectors.cars("oem_seat_cupra_wholesale", pages(spark, {"results": {"result": {"cars": [{"carid": "x", "items": [{"key": "prices", "values": [{"key": "sale", "raw_value": 31990.5}]}, {"key": "model", "value": "Born"}, {"key": "modelyear", "value": "2023"}]}]}}})).first()
    assert (float(s["price"]), s["year"], s["make"], s["model"]) == (31990.5, 2023, "CUPRA", "Born")
    a = connectors.cars("oem_audi_wholesale", pages(spark, {"vehicleBasic": [{"carId": "E", "typedPrices": [{"type": "regular", "amount": 2}, {"type": "retail", "amount": 1}], "symbolicCarline": {"description": "Audi A1"}, "fuel": {"code": "b"}}]})).first()
    assert (float(a["price"]), a["model"], a["fuel"], a["title"]) == (1.0, "A1", "Gasolina", "Audi A1")
    t = connectors.cars("oem_toyota_lexus_wholesale", pages(spark, {"results": [{"id": "u", "images": [{"url": "//b", "sequence": 2}, {"url": "//a", "sequence": 1}], "history": {"registrationDate": "2020-01-01"}}]})).first()
    assert (t["photo_url"], t["year"]) == ("https://a", 2020)
    n = connectors.sellers("milanuncios_wholesale", pages(spark, {"ads": [{"authorId": 4, "type": "private", "location": {"province": {"id": 8}}}, {"type": "professional"}]})).collect()
    assert [(r["source_ref"], r["kind"], r["province"]) for r in n] == [("4", "particular", "08")]


def test_more_cars(spark):
    one = lambda source, payload: connectors.cars(source, pages(spark, payload)).first()
    a = one("as24_wholesale", {"listings": [{"id": "i", "url": "/x", "vehicle": {"make": "Kia", "mileageInKm": {"raw": 120}, "firstRegistrationDate": {"raw": "2019-05-01"}}, "tracking": {"price": "9000"}, "images": ["https://p"], "seller": {"id": 3}}]})
    assert (a["km"], a["year"], float(a["price"]), a["photo_url"], a["deep_link"]) == (120, 2019, 9000.0, "https://p", "https://www.autoscout24.es/x")
    c = connectors.cars("carandclassic_wholesale", pages(spark, {"props": {"searchResults": {"data": [{"id": 1, "url": "/c", "title": "1970 Jaguar E Type", "make": "jaguar", "price": {"value": 1900000}}, {"id": 2, "url": "/d", "isSold": True}]}}})).collect()
    assert [(r["model"], float(r["price"])) for r in c] == [("E Type", 19000.0)]
    n = one("oem_seat_cupra_new_stock", {"results": {"result": {"cars": [{"carid": "k", "items": [{"key": "dateproduction", "value": "2026-01-02"}]}]}}})
    assert (n["km"], n["year"]) == (0, 2026)
    html = '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"item":{"@type":"Car","sku":"s1","name":"Golf","brand":{"name":"VW"},"offers":{"price":"12000"},"mileageFromOdometer":{"value":"1.000"}}}]}</script>'
    j = connectors.json_ld_cars("motorflash_wholesale", pages(spark, html, "<html>")).collect()
    assert [(r["listing_ref"], r["make"], float(r["price"]), r["km"]) for r in j] == [("s1", "VW", 12000.0, 1000)]


def test_microdata_sql_decodes_every_reference(spark, tmp_path):
    """the SQL decodes names without a semicolon, other names than three, and numbers, as the query does."""
    import duckdb

    from stockloom.plans import catalog

    said = ["a &amp &amp;amp; b&ampc", "x = &quot;1&nbsp;&nbsp; 2&quot", "&#65;&#x42;&#x43 &# &#x; &nosuch; &notit; & &&lt;", "caf&eacute &NotEqualTilde;   d", "plain"]
    rows = [(i, "u", f"<html><body><h1>{t}</h1><p>x</p><footer>&copy; {t}</footer></body></html>") for i, t in enumerate(said)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    theirs = con.execute(catalog.ORACLE_SQL["s10_microdata"]).fetchall()
    ours = catalog.QUERIES["s10_microdata"](spark, str(tmp_path)).select("page_id", "item", "parent", "name", "value").collect()
    assert sorted(map(repr, theirs)) == sorted(repr(tuple(r)) for r in ours) and len(ours) == 15
