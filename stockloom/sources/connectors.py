"""Platform connectors (S15) over saved JSON answers: cars to the common listing schema, sellers to the common one of points of sale.

A connector is where its records lie and two mappings (cars, sellers).  Years outside 1900 to 2100 and kilometres outside 0 to
5,000,000 become null, as do prices that are no numbers.  Input: a table with a column `payload`, a saved answer a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.normalize import digits, fold, province_of_zip, year_of
from stockloom.sources import payloads
from stockloom.sources.readers import DISCOVERED, LISTING
from stockloom.sources.records import Form, absolute, between, entry, first_url, items, joined, labelled, mapped, number, records, text, unbroken

#: Codes of fuels and gearboxes in the answers, and their labels.
GASOLINA, DIESEL, ELECTRICO, HIBRIDO, ENCHUFABLE = "Gasolina", "Diésel", "Eléctrico", "Híbrido", "Híbrido enchufable"
MILANUNCIOS_FUEL = {"gasoline": GASOLINA, "petrol": GASOLINA, "diesel": DIESEL, "hybrid": HIBRIDO, "plugin_hybrid": ENCHUFABLE, "electric": ELECTRICO, "lpg": "GLP", "cng": "GNC", "gas": "Gas"}
SPOTICAR_FUEL = {"DIES": DIESEL, "ESS": GASOLINA, "ELEC": ELECTRICO, "HBD": HIBRIDO, "HBDR": ENCHUFABLE, "GPL": "GLP", "GNV": "GNC"}
AUDI_FUEL = {"D": DIESEL, "B": GASOLINA, "H": HIBRIDO, "E": ELECTRICO, "G": "GLP", "C": "GNC", "W": "Hidrógeno"}
NISSAN_FUEL = {"gasolina": GASOLINA, "diesel": DIESEL, "disel": DIESEL, "electrico": ELECTRICO, "hibrido": HIBRIDO, "hibridoenchufable": ENCHUFABLE, "glp": "GLP", "gnc": "GNC"}
CLASSIC_FUEL = {"petrol": GASOLINA, "gasoline": GASOLINA, "diesel": DIESEL, "electric": ELECTRICO, "hybrid": HIBRIDO, "lpg": "GLP", "gas": "GLP"}
GEARBOX = {"manual": "Manual", "automatico": "Automático", "automtico": "Automático"}


@dataclass(frozen=True)
class Connector:
    paths: tuple[str, ...]
    cars: dict[str, Form]
    sellers: dict[str, Form]
    #: which records count
    keep: str = "true"


def letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def car(ref: list[str], *, year: Form, km: Form, price: Form, **more: Form) -> dict[str, Form]:
    """A car's mapping, its numbers held to their ranges; year, km and price are paths or functions."""
    take = lambda f, r: f(r) if callable(f) else number(r, *([f] if isinstance(f, str) else f))
    return {"listing_ref": ref, "year": lambda r: between(take(year, r).cast("int"), 1900, 2100), "km": lambda r: between(take(km, r).cast("int"), 0, 5_000_000), "price": lambda r: take(price, r)} | more


def fixed(*paths: str) -> Form:
    return lambda r: unbroken(text(r, *paths))


def title(*paths: str, whole: str | None = None) -> Form:
    """The title given, else make, model and version."""
    parts = lambda r: joined(*(unbroken(text(r, p)) for p in paths))
    return parts if whole is None else lambda r: F.coalesce(unbroken(text(r, whole)), parts(r))


def without_make(name: Column, make: Column) -> Column:
    """A name without the make before it."""
    return F.when(F.lower(name).startswith(F.concat(F.lower(make), F.lit(" "))), F.substring(name, F.length(make) + 1, F.length(name))).otherwise(name)


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def at(base: str, *paths: str) -> Form:
    """The address of a record under a base."""
    return lambda r: F.concat(F.lit(base), text(r, *paths))


def attr(r: Column, name: str) -> Column:
    return entry(r, "$.attributes", "$.field.raw", name, "$.value.raw")


def of_key(r: Column, path: str, key: str, value: str = "$.value") -> Column:
    return entry(r, path, "$.key", key, value)


def typed_price(r: Column) -> Column:
    """The retail price of a list by type, else the regular one."""
    return F.coalesce(*(entry(r, "$.typedPrices", "$.type", t, "$.amount").try_cast("double") for t in ("retail", "regular")))


def spanish_number(c: Column) -> Column:
    """1.234,5 as a number."""
    return F.replace(F.regexp_replace(c, r"[^0-9,]", ""), F.lit(","), F.lit(".")).try_cast("double")


def seller(ref: list[str] | Form, **forms: Form) -> dict[str, Form]:
    return {"source_ref": ref, "kind": lambda r: F.lit("compraventa")} | forms


def by_zip(*paths: str) -> dict[str, Form]:
    """Postcode and, from it, the province."""
    return {"postal_code": list(paths), "province": lambda r: province_of_zip(text(r, *paths))}


CONNECTORS: dict[str, Connector] = {
    "coches_net_wholesale": Connector(("$.items",), car(
        ["$.id"], year="$.year", km="$.km", price="$.price.amount", deep_link=lambda r: absolute("https://www.coches.net", text(r, "$.url")), make="$.make", model="$.model", title=title("$.make", "$.model", whole="$.title"), fuel="$.fuelType",
        transmission=lambda r: labelled(text(r, "$.transmissionTypeId"), {"1": "Manual", "2": "Automático"}, F.lit(None)), photo_url=lambda r: entry(r, "$.resources", "$.type", "IMAGE", "$.url"),
        seller=lambda r: F.when(text(r, "$.seller.isProfessional") == "true", text(r, "$.seller.contractId")),
    ), seller(
        lambda r: F.when(text(r, "$.seller.isProfessional") == "true", text(r, "$.seller.contractId")), trade_name="$.seller.name", municipality="$.location.cityLiteral",
        province=lambda r: F.lpad(text(r, "$.location.mainProvinceId"), 2, "0"),
    )),
    "milanuncios_wholesale": Connector(("$.ads",), car(
        ["$.id"], year=lambda r: attr(r, "year").try_cast("double"), km=lambda r: attr(r, "kilometers").try_cast("double"), price="$.price.cash.value", title=fixed("$.title"), deep_link=lambda r: absolute("https://www.milanuncios.com", text(r, "$.url")),
        fuel=lambda r: labelled(attr(r, "fuel"), MILANUNCIOS_FUEL, unbroken(attr(r, "fuel"))), transmission=lambda r: labelled(attr(r, "transmission"), {"AUTOMATIC": "Automático", "MANUAL": "Manual"}, unbroken(attr(r, "transmission"))), seller="$.authorId",
    ), seller(
        ["$.authorId"], kind=lambda r: F.when(text(r, "$.type") == "professional", "compraventa").otherwise("particular"), trade_name=fixed("$.authorName"), municipality=fixed("$.location.city.name"),
        province=lambda r: F.lpad(text(r, "$.location.province.id"), 2, "0"),
    )),
    "wallapop_wholesale": Connector(("$.data.section.payload.items", "$.section.items", "$.items"), car(
        ["$.id"], year="$.type_attributes.year", km="$.type_attributes.km", price="$.price.amount", make="$.type_attributes.brand", model="$.type_attributes.model", title=title("$.type_attributes.brand", "$.type_attributes.model", whole="$.title"),
        deep_link=at("https://es.wallapop.com/item/", "$.web_slug"), fuel="$.type_attributes.engine", photo_url=lambda r: text(F.get(items(r, "$.images"), 0), "$.urls.big", "$.urls.medium", "$.urls.small"), seller="$.user_id",
    ), seller(["$.user_id"], municipality="$.location.city", lat="$.location.latitude", lon="$.location.longitude")),
    "renew_wholesale": Connector(("$.data",), car(
        ["$.identifier", "$.productId"], year=lambda r: year_of(text(r, "$.firstRegistrationDate")), km="$.mileage", price=["$.prices[0].customerDisplayPrice", "$.prices[0].priceWithTaxes"], make="$.brand.label", model="$.model.label",
        title=lambda r: F.coalesce(joined(text(r, "$.brand.label"), text(r, "$.model.label"), text(r, "$.version.label")), text(r, "$.name")),
        deep_link=lambda r: F.concat(F.lit("https://es.renew.auto/vehiculos/detalle.html?productId="), F.url_encode(text(r, "$.productId"))), fuel=["$.energy.label", "$.energy.groupLabel"], transmission="$.transmission.label",
        photo_url=lambda r: F.coalesce(entry(r, "$.assets[0].renditions", "$.resolutionType", "medium", "$.url"), first_url(r, "$.assets[0].renditions", "$.url")), seller=["$.vehicleExhibitionSite.dealerId", "$.dealer.dealerId"],
    ), seller(
        ["$.vehicleExhibitionSite.dealerId", "$.dealer.dealerId"], trade_name=["$.vehicleExhibitionSite.name", "$.dealer.name"], municipality=["$.vehicleExhibitionSite.address.locality", "$.dealer.address.locality"],
        **by_zip("$.vehicleExhibitionSite.address.postalCode", "$.dealer.address.postalCode"),
    )),
    "spoticar_wholesale": Connector(("$.hits", "$.hits.hits"), car(
        ["$._source.field_vo_carnum[0]", "$._source.field_vo_refbase[0]"], year=["$._source.field_vo_annee_modele[0]", "$._source.field_vo_dpi[0]"], km="$._source.field_vo_km[0]", price="$._source.field_vo_prix_base[0]",
        make=fixed("$._source.marque_no_accent[0]", "$._source.marque[0]"), model=fixed("$._source.model[0]"), deep_link=lambda r: absolute("https://www.spoticar.es", text(r, "$._source.url[0]", "$._source.url")),
        title=lambda r: joined(unbroken(text(r, "$._source.marque_no_accent[0]", "$._source.marque[0]")), unbroken(text(r, "$._source.model[0]")), unbroken(text(r, "$._source.version[0]"))),
        fuel=lambda r: labelled(F.upper(text(r, "$._source.fuel_type[0]")), SPOTICAR_FUEL, unbroken(text(r, "$._source.type_carburant[0]"))), transmission=lambda r: labelled(letters(text(r, "$._source.boite_vitesse[0]")), GEARBOX, unbroken(text(r, "$._source.boite_vitesse[0]"))),
        photo_url=lambda r: F.coalesce(*(first_url(r, f"$._source.{k}") for k in ("field_vo_image", "field_image", "images", "field_vo_photos", "image"))), seller="$._source.field_pdv_geo_id[0]",
    ), seller(
        ["$._source.field_pdv_geo_id[0]"], trade_name=fixed("$._source.field_pdv_title[0]"), municipality=fixed("$._source.field_pdv_city[0]"),
        lat=lambda r: F.split(text(r, "$._source.field_pdv_geolocation[0]"), r"\s*,\s*")[0], lon=lambda r: F.get(F.split(text(r, "$._source.field_pdv_geolocation[0]"), r"\s*,\s*"), 1),
    )),
    "oem_audi_wholesale": Connector(("$.vehicleBasic",), car(
        ["$.carId", "$.decodedCarId", "$.id"], year="$.modelYear", km="$.used.mileage", price=typed_price, make=lambda r: F.lit("Audi"), deep_link="$.weblink", model=lambda r: F.regexp_replace(unbroken(text(r, "$.symbolicCarline.description", "$.model.description")), "(?i)^audi ", ""),
        title=lambda r: joined(F.lit("Audi"), F.regexp_replace(unbroken(text(r, "$.symbolicCarline.description", "$.model.description")), "(?i)^audi ", ""), unbroken(text(r, "$.trimline.description"))),
        fuel=lambda r: labelled(F.upper(text(r, "$.fuel.code")), AUDI_FUEL, unbroken(text(r, "$.fuel.description"))), photo_url=lambda r: F.coalesce(first_url(r, "$.used.pictureUrls"), first_url(r, "$.pictures", "$.url")),
        transmission=lambda r: labelled(text(r, "$.gearType.code"), {"gear-type.automatic": "Automático", "gear-type.manual": "Manual"}, labelled(letters(text(r, "$.gearType.description")), GEARBOX)), seller="$.dealer.id",
    ), seller(["$.dealer.id"], trade_name=fixed("$.dealer.name"), municipality=fixed("$.dealer.city"), lat="$.dealer.geoLocation.lat", lon="$.dealer.geoLocation.lon", **by_zip("$.dealer.zipCode"))),
    "oem_ford_wholesale": Connector(("$.VehicleInventoryList.VehicleInventoryItem", "$.VehicleInventoryItem"), car(
        ["$.Vehicle.Identity.ID"], year=lambda r: F.coalesce(number(r, "$.Vehicle.History.YearOfProduction").cast("int"), year_of(text(r, "$.Vehicle.History.DateOfRegistration"))), km="$.Vehicle.CurrentCondition.CurrentOdometerReading.value",
        price="$.VendorInformation.Price.value", make="$.Vehicle.Brand.ShortDescription", model="$.Vehicle.Model.ShortDescription", title=title("$.Vehicle.Brand.ShortDescription", "$.Vehicle.Model.ShortDescription", "$.Vehicle.Variant.ShortDescription"),
        deep_link=lambda r: F.concat(F.lit("https://secure.ford.es/compra/explora/vehiculos-de-ocasion/turismos/results#vehicleDetails/"), text(r, "$.Vehicle.Identity.ID"), F.lit("/"), text(r, "$.VendorInformation.VendorCode")),
        fuel="$.Vehicle.Configuration.FuelType.ShortDescription", transmission="$.Vehicle.Configuration.TransmissionType.ShortDescription", photo_url=lambda r: first_url(r, "$.Vehicle.Configuration.Appearance.ImageRef", "$.value"), seller="$.VendorInformation.VendorCode",
    ), seller(
        ["$.VendorInformation.VendorCode"], trade_name="$.VendorInformation.VendorName", address="$.VendorInformation.ContactInformation.Address.FreeTextAddress.AddressLine[0].value",
    )),
    "oem_kia_wholesale": Connector(("$.vehiculos",), car(
        ["$.id"], year=lambda r: F.coalesce(number(r, "$.any").cast("int"), F.right(text(r, "$.matriculacion"), F.lit(4)).try_cast("int")), km=lambda r: spanish_number(text(r, "$.kilometros")), price=lambda r: positive(spanish_number(text(r, "$.precio"))),
        make=lambda r: F.coalesce(unbroken(text(r, "$.marca")), F.lit("KIA")), model=fixed("$.modelo"), title=lambda r: joined(F.coalesce(unbroken(text(r, "$.marca")), F.lit("KIA")), unbroken(text(r, "$.modelo")), unbroken(text(r, "$.version"))),
        fuel=fixed("$.combustible"), transmission=fixed("$.transmision"), photo_url=lambda r: F.when(text(r, "$.imagen").startswith("http"), text(r, "$.imagen")), seller=fixed("$.concesionario"),
    ), seller(
        lambda r: F.concat_ws(":", F.nullif(F.regexp_replace(fold(unbroken(text(r, "$.concesionario"))), "[^a-z0-9]", ""), F.lit("")), F.regexp_replace(fold(unbroken(text(r, "$.poblacion"))), "[^a-z0-9]", "")),
        trade_name=fixed("$.concesionario"), municipality=fixed("$.poblacion"),
    )),
    "oem_hyundai_wholesale": Connector(("$.vehiculos", "$.listado.vehiculos"), car(
        ["$.bastidor"], year=lambda r: year_of(text(r, "$.matriculacion")), km=lambda r: digits(text(r, "$.kilometraje")).try_cast("int"),
        price=lambda r: positive(F.coalesce(F.when(text(r, "$.importe_financiar").rlike(r"^\d+(\.\d{1,2})?$"), number(r, "$.importe_financiar")), digits(text(r, "$.importe_financiar", "$.importe")).try_cast("double"))),
        make=lambda r: F.lit("Hyundai"), model=lambda r: F.nullif(F.when(F.upper(text(r, "$.modelo")) != "OTROS", unbroken(text(r, "$.modelo"))), F.lit("")),
        title=lambda r: joined(F.lit("Hyundai"), F.when(F.upper(text(r, "$.modelo")) != "OTROS", unbroken(text(r, "$.modelo"))), unbroken(text(r, "$.version"))),
        fuel=fixed("$.combustible"), transmission=fixed("$.transmision"), photo_url=lambda r: F.when(text(r, "$.imagen").startswith("http"), text(r, "$.imagen")), seller_phone=lambda r: digits(text(r, "$.telefono")),
    ), seller(["$.concesionario_id", "$.instalacion_id"], trade_name=fixed("$.name"), phone=lambda r: digits(text(r, "$.phone")), municipality=fixed("$.city"), lat="$.lat", lon="$.lon", **by_zip("$.zipcode"))),
    "nissan_intelligent_choice_wholesale": Connector(("$.vehicles",), car(
        ["$.vehiclesku", "$.vin"], year=["$.registrationYear", "$.modelYear"], km="$.mileage", price=lambda r: F.coalesce(F.nullif(number(r, "$.discountedPrice"), F.lit(0.0)), number(r, "$.rrpPrice")),
        make=lambda r: F.coalesce(unbroken(text(r, "$.make")), F.lit("NISSAN")), model=fixed("$.modelName"), title=lambda r: joined(F.coalesce(unbroken(text(r, "$.make")), F.lit("NISSAN")), unbroken(text(r, "$.modelName")), unbroken(text(r, "$.version"))),
        fuel=lambda r: labelled(letters(unbroken(text(r, "$.fuelType"))), NISSAN_FUEL, unbroken(text(r, "$.fuelType"))), transmission=lambda r: labelled(letters(unbroken(text(r, "$.transmission"))), GEARBOX, unbroken(text(r, "$.transmission"))),
        photo_url=lambda r: F.when(text(r, "$.thumbnailUrl").startswith("http"), text(r, "$.thumbnailUrl")), seller="$.dealer.dealerId",
    ), seller(["$.dealer.dealerId"], trade_name=fixed("$.dealer.dealerName"))),
    "oem_toyota_lexus_wholesale": Connector(("$.results",), car(
        ["$.id"], year=lambda r: F.coalesce(number(r, "$.product.modelYear").cast("int"), F.left(text(r, "$.history.registrationDate"), F.lit(4)).try_cast("int")), km="$.mileage.value", price=lambda r: positive(number(r, "$.price.sellingPriceInclVAT")),
        make=fixed("$.product.brand.description"), model=fixed("$.product.model.description"), title=title("$.product.brand.description", "$.product.model.description", "$.product.versionName"),
        fuel=fixed("$.product.engine.marketingFuelType.description", "$.product.engine.displayFuelType"), transmission=fixed("$.product.transmission.transmissionType.description"),
        photo_url=lambda r: F.regexp_replace(text(F.get(F.array_sort(items(r, "$.images"), lambda a, b: F.coalesce(number(a, "$.sequence"), F.lit(1e6)).cast("int") - F.coalesce(number(b, "$.sequence"), F.lit(1e6)).cast("int")), 0), "$.url"), "^//", "https://"),
        seller=["$.dealer.id", "$.dealerId"],
    ), seller(["$.dealer.id", "$.dealerId"], trade_name=fixed("$.dealer.name"), municipality=fixed("$.dealer.address.city"), lat="$.dealer.geoLocation.lat", lon="$.dealer.geoLocation.lon", **by_zip("$.dealer.address.zip"))),
    "oem_seat_cupra_wholesale": Connector(("$.results.result.cars",), car(
        ["$.carid"], year=lambda r: F.coalesce(of_key(r, "$.items", "modelyear").try_cast("int"), F.left(of_key(r, "$.items", "initialreg"), F.lit(4)).try_cast("int")), km=lambda r: digits(of_key(r, "$.items", "mileage")).try_cast("int"),
        price=lambda r: positive(of_key(F.get(F.filter(items(r, "$.items"), lambda x: text(x, "$.key") == "prices"), 0), "$.values", "sale", "$.raw_value").try_cast("double")),
        make=lambda r: F.coalesce(unbroken(of_key(r, "$.items", "manuf")), F.lit("CUPRA")), model=lambda r: unbroken(of_key(r, "$.items", "model")), transmission=lambda r: unbroken(of_key(r, "$.items", "gear")),
        title=lambda r: F.coalesce(unbroken(of_key(r, "$.items", "localCarTitle")), unbroken(of_key(r, "$.items", "cartitle")), joined(unbroken(of_key(r, "$.items", "manuf")), unbroken(of_key(r, "$.items", "model")))),
        deep_link=at("https://www.cupra.com/es-es/localizador-stock/coche/", "$.carid"), seller="$.hypermediadealer.dealer.key",
    ), seller(
        ["$.hypermediadealer.dealer.key"], trade_name=lambda r: unbroken(of_key(r, "$.hypermediadealer.dealer.items", "name")), municipality=lambda r: unbroken(of_key(r, "$.hypermediadealer.dealer.items", "city")),
        postal_code=lambda r: of_key(r, "$.hypermediadealer.dealer.items", "zip"), province=lambda r: province_of_zip(of_key(r, "$.hypermediadealer.dealer.items", "zip")),
    )),
    "as24_wholesale": Connector(("$.props.pageProps.listings", "$.pageProps.listings", "$.listings"), car(
        ["$.id", "$.identifier"], year=lambda r: F.coalesce(year_of(text(r, "$.vehicle.firstRegistrationDate.raw", "$.vehicle.firstRegistrationDate")), year_of(text(r, "$.tracking.firstRegistration"))),
        km=lambda r: positive(digits(text(r, "$.vehicle.mileageInKm.raw", "$.vehicle.mileageInKm.formatted", "$.vehicle.mileageInKm", "$.tracking.mileage")).try_cast("int")), price=["$.prices.public.priceRaw", "$.prices.dealer.priceRaw", "$.tracking.price", "$.price.priceRaw"],
        make="$.vehicle.make", model="$.vehicle.model", title=lambda r: joined(text(r, "$.vehicle.make"), text(r, "$.vehicle.model"), text(r, "$.vehicle.variant.raw", "$.vehicle.variant.formatted", "$.vehicle.variant", "$.vehicle.modelVersionInput")),
        deep_link=lambda r: absolute("https://www.autoscout24.es", text(r, "$.url")), fuel=["$.vehicle.fuelCategory.raw", "$.vehicle.fuelCategory.formatted", "$.vehicle.fuel"], transmission=["$.vehicle.transmissionType.raw", "$.vehicle.transmissionType.formatted", "$.vehicle.transmission"],
        photo_url=lambda r: text(F.coalesce(F.get(items(r, "$.images"), 0), F.get(items(r, "$.ocsImagesA"), 0)), "$.src", "$.href", "$.url", "$.small.href", "$"), seller="$.seller.id",
    ), seller(
        lambda r: F.when(text(r, "$.seller.type") == "Dealer", text(r, "$.seller.id")), trade_name="$.seller.companyName", municipality="$.location.city", address="$.location.street", **by_zip("$.location.zip"),
    )),
    "coches_com_wholesale": Connector(("$.props.pageProps.classifieds.classifiedList", "$.classifieds.classifiedList", "$.classifiedList"), car(
        ["$.visibleId", "$.id"], year="$.registration.year", km="$.mileage.amount", price="$.price.amount", make="$.make.name", model="$.model.name", title=title("$.make.name", "$.model.name", "$.version.name"),
        deep_link=at("https://www.coches.com/coches-segunda-mano/coches-ocasion.htm?id=", "$.visibleId", "$.id"), fuel="$.fuel.name", transmission="$.transmission.name",
        photo_url=lambda r: F.coalesce(text(r, "$.image"), F.concat(F.lit("https://images.coches.com/_ccom_/"), text(r, "$.imageList[0].name"))), seller="$.dealer.crmId",
    ), seller(["$.dealer.crmId"], trade_name="$.dealer.name", cif="$.dealer.taxIdNumber", province=lambda r: F.lpad(text(r, "$.currentProvince.id"), 2, "0"))),
    "carandclassic_wholesale": Connector(("$.props.searchResults.data", "$.searchResults.data"), car(
        ["$.id"], year="$.year", km="$.attributes.mileage.value", price=lambda r: number(r, "$.price.value") / 100, make="$.make", title="$.title", deep_link=lambda r: absolute("https://www.carandclassic.com", text(r, "$.url")),
        model=lambda r: F.nullif(F.trim(without_make(F.regexp_replace(text(r, "$.title"), r"^\s*\d{4}\s+", ""), text(r, "$.make"))), F.lit("")), fuel=lambda r: labelled(F.lower(text(r, "$.attributes.fuelType")), CLASSIC_FUEL, F.lit(None)),
        transmission=lambda r: labelled(F.lower(text(r, "$.attributes.transmissionType")), {"manual": "Manual", "automatic": "Automático", "auto": "Automático"}, F.lit(None)),
        photo_url=lambda r: absolute("https://assets.carandclassic.com", text(F.get(items(r, "$.images"), 0), "$.url")),
    ), seller(["$.seller.id"], municipality="$.location.town"), "coalesce(try_variant_get(r, '$.isSold', 'boolean'), false) = false"),
    "autocasion_wholesale": Connector(("$.data.ads", "$.ads", "$"), car(
        ["$.id"], year="$.year", km="$.kilometers", price="$.price", make="$.brand.name", model="$.family.name", title=title("$.brand.name", "$.family.name", whole="$.title"), deep_link=lambda r: absolute("https://www.autocasion.com", text(r, "$.url")),
        fuel="$.fuel.name", transmission="$.transmission.name", seller=lambda r: F.nullif(F.regexp_extract(text(r, "$.offeredBy['@id']"), "/profesional/([^/?#]+)", 1), F.lit("")),
    ), seller(lambda r: F.nullif(F.regexp_extract(text(r, "$.offeredBy['@id']"), "/profesional/([^/?#]+)", 1), F.lit("")), trade_name="$.offeredBy.name")),
    "group_vo_chains_flexicar": Connector(("$.results",), car(
        ["$.id"], year="$.year", km="$.km", price="$.price", make="$.brand", model="$.model", title=title("$.brand", "$.model", "$.version"), deep_link=at("https://www.flexicar.es/coches-segunda-mano/", "$.slug"), fuel="$.fuel", transmission="$.transmission",
        photo_url=["$.image", "$.images[0]"], seller="$.carDealershipSlug",
    ), seller(["$.value"], trade_name="$.name", municipality="$.location", **by_zip("$.zipCode")), "try_variant_get(r, '$.slug', 'string') is not null or try_variant_get(r, '$.value', 'string') is not null"),
    "group_subastas_wholesale": Connector(("$.data.lots.items",), car(
        ["$.id"], year=lambda r: year_of(text(r, "$.firstRegistrationDate")), km="$.mileage", price="$.fixedPrice", make=lambda r: F.initcap(text(r, "$.make")), model=lambda r: F.initcap(text(r, "$.model")),
        title=lambda r: joined(F.initcap(text(r, "$.make")), F.initcap(text(r, "$.model")), text(r, "$.version")), deep_link=at("https://carmarket.ayvens.com/es-es/lot/", "$.id"), fuel="$.fuelType", transmission="$.transmissionType", seller="$.saleEventId",
    ), seller(["$.saleEventId"], kind=lambda r: F.lit("subasta"), trade_name="$.saleEvent.name")),
    "oem_jaguar_land_rover": Connector(("$.data.getAll", "$.getAll"), car(
        ["$.id", "$.identifiers.stockId"], year=["$.productionYear", "$.registration.year"], km="$.odometer.value", price=lambda r: positive(number(r, "$.price.current", "$.price.base")), make=fixed("$.manufacturer"), model=fixed("$.model"),
        title=title("$.manufacturer", "$.model", "$.variant"), fuel=fixed("$.fuel.type"), transmission=fixed("$.transmission.type"), photo_url=lambda r: F.regexp_replace(text(r, "$.mainImage"), "^//", "https://"), seller=["$.location.hash", "$.location.details.address.hash"],
    ), seller(["$.location.hash", "$.location.details.address.hash"], trade_name=fixed("$.location.name", "$.location.details.address.name"), municipality=fixed("$.location.details.address.city"), **by_zip("$.location.details.address.postcode"))),
}

#: New stock of the same makes: no kilometres, the year of production or offer.
CONNECTORS["oem_seat_cupra_new_stock"] = Connector(("$.results.result.cars",), CONNECTORS["oem_seat_cupra_wholesale"].cars | {
    "listing_ref": ["$.carid", "$.key"], "km": lambda r: F.lit(0), "year": lambda r: between(F.coalesce(*(F.left(of_key(r, "$.items", k), F.lit(4)).try_cast("int") for k in ("dateproduction", "dateoffer"))), 1990, 2100),
}, CONNECTORS["oem_seat_cupra_wholesale"].sellers | {"source_ref": lambda r: F.coalesce(of_key(r, "$.hypermediadealer.dealer.items", "dealer_id_snw"), text(r, "$.hypermediadealer.dealer.key"))})

#: Schema.org vehicles of JSON-LD scripts, whatever the site: the mapping of the sites that publish no other answer.
JSON_LD_TYPES = ("Car", "Vehicle", "MotorVehicle", "Motorcycle")
JSON_LD = car(
    ["$.sku", "$.productID", "$.vehicleIdentificationNumber", "$.url", "$['@id']"], year=lambda r: year_of(text(r, "$.modelDate", "$.vehicleModelDate", "$.datePublished")), km=lambda r: spanish_number(text(r, "$.mileageFromOdometer.value", "$.mileageFromOdometer", "$.mileage")),
    price=["$.offers.price", "$.offers[0].price", "$.offers.lowPrice", "$.price"], make=["$.brand.name", "$.brand", "$.manufacturer.name", "$.manufacturer"], model=["$.model.name", "$.model", "$.name"], title=["$.name"], deep_link=["$.url", "$.offers.url", "$['@id']"],
    fuel=["$.fuelType", "$.vehicleEngine.fuelType"], transmission="$.vehicleTransmission", photo_url=["$.image.url", "$.image[0].url", "$.image[0]", "$.image"], seller=["$.offers.seller.name", "$.offers.offeredBy.name"],
)

#: Partitioned and segmented drains of a platform read the same answers.
SIBLINGS = {"coches_net_facet": "coches_net_wholesale", "coches_net_segments": "coches_net_wholesale", "autocasion_facet": "autocasion_wholesale", "wallapop_facet": "wallapop_wholesale"}


def connector(source: str) -> Connector:
    return CONNECTORS[SIBLINGS.get(source, source)]


def cars(source: str, pages: DataFrame) -> DataFrame:
    """A row for each car that has a reference, one for each reference (its richest row stays)."""
    spec = connector(source)
    return richest(mapped(records(pages, *spec.paths).where(spec.keep), LISTING, source, spec.cars))


def json_ld_cars(source: str, pages: DataFrame) -> DataFrame:
    """The same of a site's pages (column payload: HTML) by their JSON-LD vehicles; vehicles inside a list's items count too."""
    nodes = payloads.json_ld(pages, "payload")
    listed = F.concat(F.array("node"), F.transform(items(F.col("node"), "$.itemListElement"), lambda x: F.coalesce(F.try_variant_get(x, "$.item", "variant"), x)))
    rows = nodes.withColumn("r", F.explode(listed)).drop("node", "payload")
    return richest(mapped(rows.where(F.coalesce(text(F.col("r"), "$['@type'][0]"), text(F.col("r"), "$['@type']")).isin(*JSON_LD_TYPES)), LISTING, source, JSON_LD))


def richest(cars: DataFrame) -> DataFrame:
    """One row for each reference: the one with most columns filled, the greatest of equals."""
    out = cars.where("listing_ref is not null")
    row = F.struct(*out.columns)
    filled = sum((F.col(c).isNotNull().cast("int") for c in out.columns), F.lit(0))
    return out.groupBy("listing_ref").agg(F.max_by(row, F.struct(filled, row)).alias("row")).select("row.*")


def sellers(source: str, pages: DataFrame, *paths: str) -> DataFrame:
    """A row for each seller that has a reference; paths: where sellers lie if not in the cars."""
    spec = connector(source)
    out = mapped(records(pages, *(paths or spec.paths)).where(spec.keep), DISCOVERED, source, spec.sellers).where("source_ref is not null and source_ref <> ''")
    row = F.struct(*out.columns)
    return out.groupBy("source_ref").agg(F.min(row).alias("row")).select("row.*")
