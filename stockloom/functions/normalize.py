"""Normalisers and parsers (F1-F35) as Column -> Column functions.

Latin accents are folded with `translate`, which stays in whole-stage codegen; `python_udfs.nfkd_fold` is the exact
variant for compatibility characters.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters whose compatibility decomposition leaves one ASCII letter, those letters, and the ones it leaves nothing of.
_FOLDS = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in range(0xC0, 0x250)}
ACCENTED = "".join(c for c, f in _FOLDS.items() if len(f) == 1)
PLAIN = "".join(f for f in _FOLDS.values() if len(f) == 1)
DROPPED = "".join(c for c, f in _FOLDS.items() if not f)
#: Legal-form suffixes, longest first where one ends another.
LEGAL_SUFFIXES = ("sociedadlimitadaunipersonal", "sociedadanonima", "sociedadlimitada", "scoop", "scp", "slu", "sau", "sll", "sl", "sa")
#: Legal tokens between words.
LEGAL_TOKENS = r"\b(s\s?l\s?u?|s\s?a\s?u?|s\s?c\s?p?|sociedad limitada|sociedad anonima)\b"
#: Resize suffixes at the very end of a photo address.
PHOTO_SUFFIX = r"[/_-](?:thumb|thumbnail|small|medium|large|\d+x\d+|\d+w)$"
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
FUELS = {"gasolina": "petrol", "diesel": "diesel", "diésel": "diesel", "electrico": "electric", "eléctrico": "electric", "hibrido": "hybrid", "híbrido": "hybrid", "glp": "lpg"}


def fold(c: Column) -> Column:
    """Lower-case ASCII: accents dropped, letters without a plain form removed."""
    return F.lower(F.translate(F.translate(c, DROPPED, ""), ACCENTED, PLAIN))


def alnum_key(c: Column) -> Column:
    """fold, keep a-z and 0-9."""
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def name_key(c: Column) -> Column:
    """alnum key without one trailing legal suffix, if at least three characters remain."""
    key = alnum_key(c)
    return F.regexp_replace(key, f"^(.{{3,}}?)(?:{'|'.join(LEGAL_SUFFIXES)})$", "$1")


def name_key_words(c: Column) -> Column:
    """legal tokens go anywhere on word boundaries, then spaces go."""
    spaced = F.regexp_replace(fold(c), "[^a-z0-9 ]+", " ")
    return F.regexp_replace(F.regexp_replace(spaced, LEGAL_TOKENS, " "), " +", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def phone_all(c: Column, least: int = 7) -> Column:
    """all digits, if there are at least `least`."""
    return F.when(F.length(digits(c)) >= least, digits(c))


def phone_last9(c: Column, least: int = 7) -> Column:
    """F5 (least 7) and F6 (least 9): the last nine digits."""
    return F.when(F.length(digits(c)) >= least, F.right(digits(c), F.lit(9)))


def host(c: Column) -> Column:
    """host and port of an address, without scheme, www., path and query; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^[a-z]+://", ""), r"^www\.", "")
    return F.nullif(F.regexp_replace(bare, "[/?#].*$", ""), F.lit(""))


def bare_host(c: Column) -> Column:
    """F8: the host, only where no path follows; a query or a fragment does not count."""
    rest = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^https?://", ""), r"^www\.", "")
    rest = F.regexp_replace(F.regexp_replace(rest, "[?#].*$", ""), "/+$", "")
    return F.when(rest.rlike("^[^/]+$"), rest)


def photo_key(c: Column) -> Column:
    """trim, lower, cut the query, trailing slashes and then one resize suffix; a suffix before a file extension stays."""
    cut = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\?.*$", ""), "/+$", "")
    return F.nullif(F.regexp_replace(cut, PHOTO_SUFFIX, ""), F.lit(""))


def geo_key(c: Column) -> Column:
    """folded words with single spaces."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def sorted_tokens(c: Column) -> Column:
    """the geo key with its words sorted."""
    return F.array_join(F.array_sort(F.split(geo_key(c), " ")), " ")


def filled(c: Column) -> Column:
    return F.length(F.trim(F.coalesce(c.cast("string"), F.lit("")))) > 0


def canonical_key(domain: Column, cif: Column, name: Column, muni: Column, prov: Column, address: Column, platform: Column, seller: Column) -> Column:
    """particular > bare domain > tax id > name with municipality > name with province; null where none applies."""
    tail = F.when(filled(address), F.concat(F.lit("|"), alnum_key(address))).otherwise("")
    return F.coalesce(
        F.when(filled(platform) & filled(seller), F.concat(F.lit("particular:"), F.regexp_replace(F.lower(platform), "[^a-z0-9]+", ""), F.lit(":"), F.trim(seller))),
        F.concat(F.lit("domain:"), bare_host(domain)),
        F.when(filled(cif), F.concat(F.lit("cif:"), F.upper(F.trim(cif)))),
        F.when(filled(name) & filled(muni), F.concat(F.lit("name:"), alnum_key(name), F.lit("|"), muni, tail)),
        F.when(filled(name) & filled(prov), F.concat(F.lit("name:"), alnum_key(name), F.lit("|p"), prov, tail)),
    )


def base32_low40(key: Column) -> Column:
    """Eight base-32 characters of the low 40 bits of SHA-256."""
    n = F.conv(F.substring(F.sha2(key, 256), 55, 10), 16, 10).cast("long")
    return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(n, 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(7, -1, -1)))


def code(key: Column, prov: Column, prefix: str = "CDP-ES-") -> Column:
    """a seller's code."""
    return F.concat(F.lit(prefix), prov, F.lit("-"), base32_low40(key))


def org_code(key: Column) -> Column:
    """an organisation's code."""
    return F.concat(F.lit("ORG-"), base32_low40(key))


def surrogate_id(key: Column, at: Column) -> Column:
    """F16: a sortable 26-character id: ten base-32 characters of the milliseconds, sixteen derived from the key."""
    ms = F.unix_millis(at)
    head = [F.substring(F.lit(BASE32), F.shiftright(ms, 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(9, -1, -1)]
    return F.concat(*head, base32_low40(key), base32_low40(F.concat(key, F.lit("#"))))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """great-circle distance, radius 6371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)


def trigrams(c: Column) -> Column:
    """distinct character trigrams."""
    return F.when(F.length(c) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))))


def price_near(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """both positive and at most `tolerance` of the lower apart."""
    return F.coalesce((a > 0) & (b > 0) & (F.abs(a - b) <= F.lit(tolerance) * F.least(a, b)), F.lit(False))


def to_int(c: Column) -> Column:
    """all digits of a text as a number; null if there is none or too many."""
    return F.nullif(digits(c), F.lit("")).try_cast("long")


def to_price(c: Column) -> Column:
    """a price with a decimal comma or point and separators of thousands."""
    plain = F.regexp_replace(c, r"[^0-9.,]", "")
    whole, cents = (F.regexp_extract(plain, r"^(.*?)(?:[.,](\d{1,2}))?$", i) for i in (1, 2))
    return F.concat(digits(whole), F.lit("."), F.rpad(cents, 2, "0")).try_cast("decimal(12,2)")


def year_of(c: Column) -> Column:
    """the year of MM-YYYY, else the first 19xx or 20xx."""
    return F.nullif(F.regexp_extract(c, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")


def zip5(c: Column) -> Column:
    """five digits, filled with zeros on the left."""
    return F.when(F.length(digits(c)) > 0, F.lpad(digits(c), 5, "0"))


def province_of_zip(c: Column) -> Column:
    return F.left(zip5(c), F.lit(2))


def make_of(title: Column) -> Column:
    """the first word of a title."""
    return F.split(F.trim(title), " ", 2)[0]


def model_of(title: Column) -> Column:
    return F.get(F.split(F.trim(title), " ", 2), 1)


def hours_between(at: Column, as_of: Column) -> Column:
    """hours from `at` to an explicit moment."""
    return (F.unix_micros(as_of) - F.unix_micros(at)) / 3.6e9


def percent(a: Column, b: Column) -> Column:
    """100 a / b as a decimal with two places, 0 where b is 0."""
    return F.when(b == 0, F.lit(0).cast("decimal(18,2)")).otherwise(F.round(F.lit(100).cast("decimal(20,0)") * a.cast("decimal(18,0)") / b.cast("decimal(18,0)"), 2).cast("decimal(18,2)"))


def address_parts(c: Column) -> Column:
    """postcode, town and province of an address.  With commas the last part is the province and the one before it the town; of
    two parts, where the first has a wide gap, the town follows the gap.  Without commas the same by dashes.  Postcodes and
    loose dashes are taken off; an address of one part has neither town nor province."""
    bare = lambda x, off=" -": F.regexp_replace(F.regexp_replace(x, r"\b\d{5}\b", ""), f"^[{off}]+|[{off}]+$", "")
    pieces = lambda x, by: F.filter(F.transform(F.split(x, by), lambda p: F.trim(p)), lambda p: p != "")
    at = lambda x, i: F.try_element_at(x, F.lit(i))
    commas, dashes = pieces(F.translate(c, "–—", "--"), ","), pieces(c, "-")
    tail = F.nullif(F.trim(at(F.split(at(commas, 1), r"\s{2,}"), -1)), F.lit(""))
    gap = (F.size(commas) == 2) & at(commas, 1).rlike(r"\s{2,}")
    town = F.when(F.size(commas) >= 2, bare(F.when(gap, F.coalesce(tail, at(commas, -2))).otherwise(at(commas, -2)))).when(F.size(dashes) >= 2, bare(at(dashes, -2), " "))
    province = F.when(F.size(commas) >= 2, at(commas, -1)).when(F.size(dashes) >= 2, at(dashes, -1))
    return F.struct(F.nullif(F.regexp_extract(c, r"\b(\d{5})\b", 1), F.lit("")).alias("postcode"), town.alias("town"), bare(province, " .-").alias("province"))


def origin_key(source: Column, phase: Column, code_: Column) -> Column:
    """F32: source:phase[:code]."""
    return F.concat_ws(":", source, phase, code_)


#: What marks a wall, a wall that needs a higher tier, a throttle, and a drift of the source.
WALLS = ("403", "blocked", "forbidden", "challenge", "captcha", "akamai", "datadome", "cloudflare", "perimeterx")
HIGH_WALLS = ("akamai", "datadome", "perimeterx", "sensor", "residential")
THROTTLES = ("429", "rate limit", "rate-limit", "throttl", "too many", "ban", "banned")
DRIFTS = ("null", "drift", "schema", "field", "missing path", "parse", "selector", "json path", "jsonpath", "no listings")


def repair_action(error: Column, status: Column | None = None) -> Column:
    """what to do about a failure, by its message and the last HTTP status where one is known."""
    text, code_ = F.lower(F.coalesce(error, F.lit(""))), F.lit(None).cast("int") if status is None else status

    def any_of(words: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit |= F.contains(text, F.lit(w))
        return hit

    wall = any_of(WALLS) | F.coalesce(code_.isin(401, 403), F.lit(False))
    return (
        F.when(wall & any_of(HIGH_WALLS), "escalate_tier")
        .when(wall, "refingerprint")
        .when(any_of(THROTTLES) | F.coalesce(code_ == 429, F.lit(False)), "quarantine")
        .when(any_of(DRIFTS), "re_receta")
        .otherwise("escalate_owner")
    )


#: Kinds of places by category, in the order in which they are tested.
JUNKYARDS = ("junkyard",)
AUCTIONS = ("car_auction",)
SELLERS = (
    "car_dealer", "used_car_dealer", "automotive_dealer", "truck_dealer", "truck_dealer_for_businesses", "commercial_vehicle_dealer",
    "motorcycle_dealer", "motorsport_vehicle_dealer", "car_broker", "car_auction", "auto_manufacturers_and_distributors",
)
#: Shown names of fuels and transmissions.
FUEL_NAMES = {"gasolina": "Gasolina", "petrol": "Gasolina", "diesel": "Diesel", "diésel": "Diesel", "diesél": "Diesel", "electrico": "Electrico", "eléctrico": "Electrico", "hibrido": "Hibrido", "híbrido": "Hibrido"}
TRANSMISSION_NAMES = {"manual": "Manual", "automatic": "Automatico", "automatico": "Automatico", "automático": "Automatico", "auto": "Automatico", "secuencial": "Automatico"}


def place_kind(category: Column) -> Column:
    """The kind of a place by its category."""
    return F.when(category.isin(*JUNKYARDS), "desguace").when(category.isin(*AUCTIONS), "subasta").when(category.isin(*SELLERS), "compraventa").otherwise("garaje")


def shown_value(c: Column, names: dict[str, str]) -> Column:
    """A value's shown name; an unknown one is trimmed, an empty one null."""
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(c))), F.nullif(F.trim(c), F.lit("")))


def price_drop(listed: Column, offer: Column) -> Column:
    """amounts and percent of an offer under the listed price, else null."""
    cut = (listed - offer).cast("decimal(12,2)")
    return F.when(offer < listed, F.struct(listed.alias("listed"), offer.alias("offer"), cut.alias("amount"), F.round(100 * cut / listed, 2).cast("decimal(12,2)").alias("percent")))
