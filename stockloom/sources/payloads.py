"""HTML, JSON and XML payload extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of site families in lower-cased page sources, by group, in order of precedence.
FAMILIES = {
    "dms": {
        "motorflash": "motorflash|mf-widget|motorflash\\.com", "sumauto": "sumauto|hexagoncuratedcars", "wikicoches": "wikicoches", "tecnom": "tecnom|\\.tecnom\\.",
        "quintegia": "quintegia|dealerbest", "ridecar": "ridecar|ridemovi", "automanager": "automanager|carsales-cdn", "stockspark": "stockspark|infomedia",
        "totnet": "tot-net|totnet", "gestionmax": "gestionmax|cymed", "audatex": "audatex", "cargest": "cargest", "wayboo": "wayboo",
    },
    "builder": {
        "wix": "wix\\.com|_wixcssistemplate|static\\.parastorage\\.com|x-wix-", "squarespace": "squarespace|static1\\.squarespace\\.com",
        "webflow": "webflow|assets\\.website-files\\.com|\\.webflow\\.io", "shopify": "cdn\\.shopify\\.com|shopify", "godaddy_websites": "img1\\.wsimg\\.com|websitebuilder",
        "jimdo": "jimdo|jimstatic", "weebly": "weebly|editmysite", "duda": "\\.dudamobile\\.com|dudaone|irp\\.cdn-website\\.com",
    },
    "cms": {
        "wordpress": "wp-content|wp-includes|wp-json", "joomla": "/components/com_|joomla|/media/jui/",
        "drupal": "sites/default/files|drupal-settings-json|drupal\\.js", "prestashop": "prestashop|/themes/[^/]+/assets",
    },
}
#: Marks of automotive plugins, which count on WordPress pages alone.
PLUGINS = {"motors_plugin": "stm_motors|motors-|plugins/motors", "car_dealer_wp": "car-dealer|wpcardealer|vehicle-listings", "wp_auto_listing": "automotive-|wp-cars|car-listing"}
#: Paths of one vehicle, and addresses of a category alone.
VEHICLE_PATH = (
    r"(?i)/(coche|vehiculo|vehiculos|stock|ocasion|vn|vo|used|coches|coche-usado|seminuevo|seminuevos|segunda-mano|coches-segunda-mano|coches-km0"
    r"|coches-nuevos|car|vehicle|listing|inventory|ficha|detalle|anuncio|oferta|auto|automovil|moto|desguace|pieza|recambio|ocasiones|ocasion-coches)/"
)
CATEGORY_ONLY = r"(?i)^https?://[^/]+/(coche|vehiculo|coches|coches-segunda-mano|ocasion|seminuevo|stock|used|inventory)[/]?$"


def next_data(html: Column) -> Column:
    """The JSON text of a page's data script."""
    return F.nullif(F.regexp_extract(html, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit(""))


def json_ld(pages: DataFrame, html: str) -> DataFrame:
    """A row for each JSON-LD object: scripts that parse, lists and @graph expanded, invalid JSON skipped."""
    scripts = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1)
    v = pages.withColumn("_s", F.explode(scripts)).withColumn("_v", F.try_parse_json("_s")).where("_v is not null")
    many = v.withColumn("_a", F.coalesce(F.try_variant_get("_v", "$['@graph']", "array<variant>"), F.try_variant_get("_v", "$", "array<variant>"), F.array("_v")))
    return many.withColumn("node", F.explode("_a")).drop("_s", "_v", "_a")


def first_of(v: Column, *paths: str) -> Column:
    """the first value found under the paths, unwrapped from {name}, {@value} or {value}."""
    tries = []
    for p in paths:
        tries += [F.try_variant_get(v, f"{p}{w}", "string") for w in (".name", "['@value']", ".value")]
        tries.append(F.when(~F.coalesce(F.schema_of_variant(v) == "VOID", F.lit(False)), F.try_variant_get(v, p, "string")))
    return F.coalesce(*tries)


def open_graph(html: Column, name: str) -> Column:
    """An OpenGraph property's content."""
    return F.nullif(F.regexp_extract(html, rf'(?i)<meta[^>]*property="og:{name}"[^>]*content="([^"]*)"', 1), F.lit(""))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def sitemap(xml: Column, kind: str) -> Column:
    """The <loc> of every <sitemap> or <url> (kind) of a sitemap."""
    return F.transform(F.regexp_extract_all(xml, F.lit(rf"(?is)<{kind}>.*?<loc>\s*(.*?)\s*</loc>.*?</{kind}>"), 1), lambda x: F.trim(x))


def cards(pages: DataFrame, html: str, marks: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each card: the theme whose mark the page holds, the card's place and its fragment; the part before the
    first card is dropped.  marks: theme -> (mark, card regex)."""
    theme = F.coalesce(*(F.when(F.contains(F.col(html), F.lit(mark)), F.lit(t)) for t, (mark, _) in marks.items()))
    split = F.coalesce(*(F.when(F.col("theme") == t, F.split(F.col(html), card)) for t, (_, card) in marks.items()))
    return pages.withColumn("theme", theme).where("theme is not null").select("*", F.posexplode(split).alias("card", "fragment")).where("card > 0").drop(html)


def first_link(fragment: Column) -> Column:
    return F.nullif(F.regexp_extract(fragment, r'(?i)href="([^"]+)"', 1), F.lit(""))


def attribute(attrs: Column, *names: str) -> Column:
    """The value of the first attribute whose lower-case name equals or contains a wanted one."""
    wanted = lambda x: F.lower(F.replace(x["name"], F.lit("&amp;"), F.lit("&")))
    hit = lambda x: F.array_contains(F.array(*map(F.lit, names)), wanted(x)) | F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(wanted(x), n))
    return F.get(F.filter(attrs, hit), 0)["value"]


def clamp(c: Column, lo: int, hi: int) -> Column:
    """The value inside the range, else null."""
    return F.when(c.between(lo, hi), c)


def vehicle_path(url: Column) -> Column:
    """A path of one vehicle, not of a category alone."""
    return url.rlike(VEHICLE_PATH) & ~url.rlike(CATEGORY_ONLY)


def family(html: Column) -> Column:
    """The family of the group that comes first (generic where none does), the first name in it, and all names found.  A WordPress page's
    plugins follow its name; a generic page is named by the first word of its generator, else custom."""
    h = F.lower(html)
    found = {g: F.filter(F.array(*(F.when(h.rlike(p), F.lit(n)) for n, p in names.items())), lambda x: x.isNotNull()) for g, names in FAMILIES.items()}
    plugins = F.filter(F.array(*(F.when(h.rlike(p), F.lit(n)) for n, p in PLUGINS.items())), lambda x: x.isNotNull())
    cms = F.get(found["cms"], 0)
    cms = F.when((cms == "wordpress") & (F.size(plugins) > 0), F.concat(F.lit("wordpress+"), F.array_join(plugins, "+"))).otherwise(cms)
    generator = F.regexp_extract(h, """<meta[^>]+name=["']generator["'][^>]*content=["']([^"']+)["']""", 1)
    first = F.nullif(F.split(F.trim(generator), r"\s+")[0], F.lit(""))
    group = F.coalesce(*(F.when(F.size(a) > 0, F.lit(g)) for g, a in found.items()), F.lit("generic"))
    return F.struct(group.alias("family"), F.coalesce(F.get(found["dms"], 0), F.get(found["builder"], 0), cms, first, F.lit("custom")).alias("subfamily"), F.concat(*found.values()).alias("hits"))


def probe_label(base: Column, answered: Column, urls: Column, fields: Column) -> Column:
    """How a site can be read."""
    return F.when(base.isNull() | ~answered, "MUERTO").when(urls == 0, "SIN_SITEMAP").when(fields >= 2, "SCHEMA_ORG").otherwise("SITEMAP_SOLO")


def route_owner(seller: Column, province: Column, platform: Column) -> Column:
    """A car's owner: a placed seller, a national one, or the platform's bucket; a car is never dropped."""
    to = lambda owner, kind: F.struct(owner.alias("owner"), F.lit(kind).alias("owner_kind"))
    return F.when(seller.isNull(), to(platform, "platform")).when(province.isNull(), to(seller, "national")).otherwise(to(seller, "placed"))
