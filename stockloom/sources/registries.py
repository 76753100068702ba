"""Registry and dealer-locator sources (S14): saved payloads to discovered points of sale.

A source is where its records lie, one mapping, and which records count.  `discovered` gives its rows and `declared` the
number that the source itself states, so that the two paths can be held against one another.  Input: a table with a
column `payload`, a saved response a row (for the HTML directory of oem_seat also `slug`, the page's province)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.normalize import digits, fold
from stockloom.sources import payloads
from stockloom.sources.readers import DISCOVERED, to_common
from stockloom.sources.records import Form, deep, items, joined, mapped, number, records, text

OFFICIAL = "concesionario_oficial"
#: Kinds of mapped shops.
SHOPS = {"car": "compraventa", "car_repair": "garaje", "car_parts": "garaje"}
#: The directory's page names and their province codes.
PROVINCE_PAGES = {
    "alava": "01", "albacete": "02", "alicante": "03", "almeria": "04", "avila": "05", "badajoz": "06", "illes-balears": "07", "barcelona": "08", "burgos": "09", "caceres": "10", "cadiz": "11", "castellon": "12",
    "ciudad-real": "13", "cordoba": "14", "a-coruna": "15", "cuenca": "16", "girona": "17", "granada": "18", "guadalajara": "19", "guipuzcoa": "20", "huelva": "21", "huesca": "22", "jaen": "23", "leon": "24",
    "lleida": "25", "la-rioja": "26", "lugo": "27", "madrid": "28", "malaga": "29", "murcia": "30", "navarra": "31", "ourense": "32", "asturias": "33", "palencia": "34", "pontevedra": "36", "salamanca": "37",
    "cantabria": "39", "segovia": "40", "sevilla": "41", "soria": "42", "tarragona": "43", "teruel": "44", "toledo": "45", "valencia": "46", "valladolid": "47", "bizkaia": "48", "zamora": "49", "zaragoza": "50",
    "ceuta": "51", "melilla": "52",
}
#: Names in the page of the islas-canarias, by province.
CANARIES = {"35": "las palmas|lanzarote|fuerteventura|gran canaria", "38": "tenerife|la palma|gomera|hierro"}


@dataclass(frozen=True)
class Registry:
    paths: tuple[str, ...]
    forms: dict[str, Form]
    #: only records in a province 01 to 52 count
    in_scope: bool = True


def province(zip_code: Column) -> Column:
    """The province of a postcode, null outside 01 to 52."""
    two = F.left(zip_code, F.lit(2))
    return F.when(two.rlike("^[0-9]{2}$") & two.between("01", "52"), two)


def padded(zip_code: Column) -> Column:
    """A postcode that lost its leading zero has it again."""
    return F.when(zip_code.rlike("^[0-9]{4}$"), F.concat(F.lit("0"), zip_code)).otherwise(zip_code)


def facts(**named: Form):
    """Further facts as JSON text; values are paths, or constants after an equals sign."""
    return lambda r: F.to_json(F.struct(*((F.lit(p[1:]) if p.startswith("=") else text(r, p)).alias(n) for n, p in named.items())))


def official(zip_form, zip_paths: list[str], brand: str, extra: dict[str, str] | None = None, **forms: Form) -> dict[str, Form]:
    """A mapping of a make's dealers: kind, postcode and province are alike in all."""
    code = lambda r: zip_form(text(r, *zip_paths))
    return {"kind": lambda r: F.lit(OFFICIAL), "postal_code": code, "province": lambda r: province(code(r)), "extra": facts(brand=f"={brand}", **(extra or {}))} | forms


def third_from_last(address: Column) -> Column:
    """The municipality of `street, municipality, province, Spain`."""
    parts = F.filter(F.transform(F.split(address, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when((F.size(parts) >= 3) & (F.lower(F.element_at(parts, -1)) == "spain"), F.try_element_at(parts, F.lit(-3)))


def same(r: Column) -> Column:
    return r


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def after(words: Column, at: Column) -> Column:
    """The words behind a place, with single spaces."""
    return F.array_join(F.slice(words, at + 1, F.greatest(F.size(words) - at, F.lit(0))), " ")


def store_parts(name: Column) -> Column:
    """Place and firm of a store called `[MG] place - firm`.  A long dash or a bar always parts the two, a hyphen only beside a space.  Where the
    islands' region comes first it is passed over, and the last hyphen parts place and firm even without a space."""
    words = words_of(name)
    said = after(words, F.when(F.lower(F.get(words, 0)) == "mg", 1).otherwise(0))
    region = F.split(said, "[-–—|]", 2)
    islands = (F.size(region) == 2) & (fold(F.trim(region[0])) == "canarias")
    rest = F.when(islands, F.trim(F.get(region, 1))).otherwise(said)
    last = F.substring_index(rest, "-", -1)
    glued = islands & (last != rest) & (last != "") & ~F.contains(last, F.lit(" "))
    rest = F.when(glued, F.concat(F.left(rest, F.length(rest) - F.length(last) - 1), F.lit(" - "), last)).otherwise(rest)
    parts = F.filter(F.transform(F.split(rest, "[–—|]|(?<= )-|-(?= )"), lambda p: F.trim(p)), lambda p: p != "")
    firm = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " - ")
    return F.struct(F.get(parts, 0).alias("place"), F.nullif(firm, F.lit("")).alias("firm"))


REGISTRIES: dict[str, Registry] = {
    "dgt_cat": Registry(("$.features",), {
        "kind": lambda r: F.lit("desguace"), "source_ref": ["$.attributes.ID", "$.attributes.OBJECTID"], "legal_name": "$.attributes.Centro_autorizado_de_Tratamient", "trade_name": "$.attributes.Centro_autorizado_de_Tratamient",
        "province": "$.attributes.Provincia", "municipality": "$.attributes.Municipio", "address": "$.attributes['Dirección']", "postal_code": "$.attributes['Código_postal']",
        "lat": "$.attributes.Latitud", "lon": "$.attributes.Longitud", "phone": "$.attributes['Teléfono_1']", "email": "$.attributes['Correo_electrónico']", "website": "$.attributes.WEB",
        "extra": facts(codigo_centro="$.attributes.Codigo_centro", comunidad="$.attributes.Comunidad"),
    }, in_scope=False),
    "osm": Registry(("$.elements",), {
        "kind": lambda r: F.coalesce(*(F.when(text(r, "$.tags.shop") == s, k) for s, k in SHOPS.items()), F.lit("garaje")),
        "source_ref": lambda r: F.concat_ws("/", text(r, "$.type"), text(r, "$.id")), "legal_name": "$.tags.name", "trade_name": "$.tags.name",
        "province": lambda r: F.nullif(F.regexp_extract(text(r, "$.tags['addr:postcode']"), "^[0-9]{2}", 0), F.lit("")), "municipality": "$.tags['addr:city']", "postal_code": "$.tags['addr:postcode']",
        "address": lambda r: joined(text(r, "$.tags['addr:street']"), text(r, "$.tags['addr:housenumber']")), "lat": ["$.lat", "$.center.lat"], "lon": ["$.lon", "$.center.lon"],
        "phone": ["$.tags.phone", "$.tags['contact:phone']"], "email": ["$.tags.email", "$.tags['contact:email']"], "website": ["$.tags.website", "$.tags['contact:website']"], "extra": facts(osm_shop="$.tags.shop"),
    }, in_scope=False),
    "oem_byd": Registry(("$",), official(
        same, ["$.zipCode"], "BYD", {"feature": "$.feature", "status": "$.statusTrans"}, source_ref="$.organizationCode", legal_name="$.organizationName", trade_name="$.organizationName",
        municipality=lambda r: third_from_last(text(r, "$.address")), address="$.address", lat="$.lat", lon="$.lng", phone="$.phoneNumber", email="$.mail", website="$.website",
    )),
    "oem_hyundai": Registry(("$.dealers",), official(
        padded, ["$.postalCode"], "Hyundai", {"outlet_type": "$.outletType", "province_label": "$.province"}, source_ref=["$.dealerId", "$.id"], legal_name="$.fullDealerName", trade_name=["$.shortOutletName", "$.fullDealerName"], municipality="$.city",
        address=lambda r: joined(text(r, "$.addressLine1"), text(r, "$.addressLine2")), lat="$.lat", lon="$.lng",
        phone=["$.phone", "$.salesTelephone", "$.serviceTelephone"], email=["$.email", "$.salesEmail", "$.serviceEmail"], website="$.webSite",
    )),
    "oem_kia": Registry((), official(
        same, ["$.dealerPostcode"], "Kia", {"service_type": "$.dealerServiceType"}, source_ref=["$.dealerSeq", "$.dealerExternalid"], legal_name="$.dealerName", trade_name="$.dealerName", municipality="$.dealerResidence",
        address="$.dealerAddress", lat="$.dealerLatitude", lon="$.dealerLongitude", phone=["$.dealerPhone1", "$.dealerPhone", "$.dealerPhone2"], email="$.dealerEmail",
    )),
    "oem_mercedes": Registry(("$.dealers",), official(
        same, ["$.address.zipCode"], "Mercedes-Benz", {"region_province": "$.address.region.province"}, source_ref="$.outletId", legal_name="$.legalName", trade_name="$.legalName", municipality="$.address.city",
        address="$.address.street", lat="$.address.coordinates.latitude", lon="$.address.coordinates.longitude",
    )),
    "oem_skoda": Registry(("$",), official(
        lambda c: F.when(digits(padded(digits(c))).rlike("^[0-9]{5}$"), padded(digits(c))), ["$.address.zip"], "Skoda", {"parent_code": "$.parentCode"}, source_ref=["$.globalId", "$.markerId"], legal_name="$.name", trade_name="$.name",
        municipality=lambda r: F.trim(F.regexp_replace(text(r, "$.address.city"), ",[^,]*$", "")), address="$.address.street", lat="$.address.latitude", lon="$.address.longitude",
    )),
    "oem_dacia": Registry((), official(
        same, ["$.address.postalCode"], "Dacia", source_ref=lambda r: F.concat(text(r, "$.name"), F.lit("|"), F.coalesce(text(r, "$.address.postalCode"), F.lit("None"))), legal_name="$.name", trade_name="$.name", municipality="$.address.addressLocality",
        address="$.address.streetAddress", lat="$.geo.latitude", lon="$.geo.longitude", phone="$.telephone",
    )),
    "oem_mg": Registry(("$.features",), {
        "kind": lambda r: F.lit(OFFICIAL), "source_ref": "$.properties.id", "trade_name": "$.properties.name", "legal_name": lambda r: F.coalesce(store_parts(text(r, "$.properties.name"))["firm"], text(r, "$.properties.name")),
        "municipality": lambda r: store_parts(text(r, "$.properties.name"))["place"], "lon": lambda r: number(F.get(items(r, "$.geometry.coordinates"), 0), "$"), "lat": lambda r: number(F.get(items(r, "$.geometry.coordinates"), 1), "$"),
        "extra": facts(brand="=MG", store_type="$.properties.specialStoreType.value"),
    }, in_scope=False),
}


def seat_directory(pages: DataFrame) -> DataFrame:
    """oem_seat: one row for each dealer and province of the directory's province pages (slug, payload)."""
    links = pages.withColumn("_m", F.explode(F.regexp_extract_all("payload", F.lit(r'(\.dealer\.[a-z0-9-]+\.html">[^<]+)<'), 1)))
    label = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("_m", r'^[^>]*>', ""), "&amp;", "&"), "&#39;|&apos;", "'"))
    left, right = F.split(label, r"\|", 2)[0], F.nullif(F.trim(F.get(F.split(label, r"\|", 2), 1)), F.lit(""))
    said = words_of(left)
    behind = F.array_position(F.transform(said, lambda w: F.lower(w)), "en").cast("int")  # `dealers in <town>[, town] [y town]`
    towns = F.when(behind > 0, after(said, behind))
    town = F.nullif(F.trim(F.substring_index(F.substring_index(towns, ",", 1), " y ", 1)), F.lit(""))
    canary = F.coalesce(*(F.when(F.lower(town).rlike(names), code) for code, names in CANARIES.items()))
    code = F.when(F.col("slug") == "islas-canarias", canary).otherwise(F.create_map(*(F.lit(x) for kv in PROVINCE_PAGES.items() for x in kv))[F.col("slug")])
    rows = links.select(F.regexp_extract("_m", r"\.dealer\.([a-z0-9-]+)\.html", 1).alias("dealer"), "slug", town.alias("town"), right.alias("name"), code.alias("province")).where("province is not null")
    one = rows.groupBy("dealer", "province").agg(F.min(F.struct("slug", "town", "name")).alias("x"))
    return one.select("dealer", "province", "x.*")


def discovered(source: str, pages: DataFrame) -> DataFrame:
    """The source's points of sale as the common schema."""
    if source == "oem_seat":
        site = F.concat(F.lit("https://www.concesionarios.seat/home/overview-dw.dealer."), F.col("dealer"), F.lit(".html"))
        return to_common(seat_directory(pages), DISCOVERED, source_key=F.lit(source), source_ref=F.concat_ws("@", "dealer", "province"), kind=F.lit(OFFICIAL), legal_name=F.col("name"), trade_name=F.col("name"), province=F.col("province"),
                         municipality=F.col("town"), website=site, extra=F.to_json(F.struct(F.lit("SEAT").alias("brand"), F.col("slug").alias("province_slug"))))
    spec = REGISTRIES[source]
    if source == "oem_dacia":
        rows = payloads.json_ld(pages, "payload").where(text(F.col("node"), "$['@type']") == "AutomotiveBusiness").withColumnRenamed("node", "r")
    else:
        rows = deep(pages, "dealerName") if source == "oem_kia" else records(pages, *spec.paths)
    out = mapped(rows, DISCOVERED, source, spec.forms)
    if source == "oem_dacia":  # the directory repeats a dealer on several pages
        out = out.dropDuplicates(["trade_name", "postal_code", "address"])
    if source in ("osm", "oem_mg"):
        out = out.where("trade_name is not null")
    return out.where("province is not null") if spec.in_scope else out


def declared(source: str, pages: DataFrame) -> DataFrame:
    """One row, `declared`: the count the source states: its own counter, the records of its answer, or those in scope."""
    if source == "dgt_cat":
        return pages.select(F.try_variant_get(F.try_parse_json("payload"), "$.count", "long").alias("declared")).agg(F.max("declared").alias("declared"))
    if source in ("osm", "oem_mg"):
        return records(pages, *REGISTRIES[source].paths).agg(F.count("*").alias("declared"))
    return discovered(source, pages).agg(F.count("*").alias("declared"))
