"""Element-aware reading of HTML (S10, S27): a tag scanner with a stack of open elements, nested microdata items, and card fragments with what
their elements say.  Pages are parsed in Arrow batches; everything after that is columns.

Broken pages are read as browsers read them where it matters here: a closing tag closes what is still open inside its element, one without an element
is skipped, and what is open at the end ends there."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as N

#: Elements without content, and elements whose content is text alone.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def attributes(raw: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts, one without a value is empty."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def scan(html: str) -> Iterator[tuple[str, str, object, int]]:
    """("open", tag, attributes, begin), ("text", "", text, begin) and ("close", tag, None, end) in order; every open has its close."""
    at, stack, raw = 0, [], None
    for m in _TOKEN.finditer(html):
        closing, tag = m[1], (m[2] or "").lower()
        if raw is not None and not (closing and tag == raw):
            continue  # inside a script or style
        if m.start() > at:
            yield "text", "", html[at : m.start()] if raw else unescape(html[at : m.start()]), at
        at, raw = m.end(), None
        if not tag:
            continue
        if not closing:
            yield "open", tag, attributes(m[3]), m.start()
            if tag in VOID or m[3].endswith("/"):
                yield "close", tag, None, m.end()
            else:
                stack.append(tag)
                raw = tag if tag in RAW else None
        elif tag in stack:
            while (top := stack.pop()) != tag:
                yield "close", top, None, m.start()
            yield "close", tag, None, m.end()
    if at < len(html):
        yield "text", "", html[at:], at
    while stack:
        yield "close", stack.pop(), None, len(html)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def items_of(html: str) -> list[dict]:
    """Microdata items: number, number of the item that holds it (or None), its property there, type, and its own properties with their values in
    order.  A value is the content attribute, the address of a link or picture, the datetime, or else the element's text; a property whose element is an
    item has that item's number as `#n`.  Properties outside any item belong to item 0, the page."""
    found = [{"item": 0, "parent": None, "property": None, "type": None, "values": []}]
    owner, open_, texts = [0], [], []  # items of the open elements, and the properties that gather text
    for kind, _, x, _ in scan(html):
        if kind == "text":
            for t in texts:
                t[2].append(x)
        elif kind == "open":
            names = str(x.get("itemprop", "")).split()
            new, gather = owner[-1], None
            if "itemscope" in x:
                new = len(found)
                found.append({"item": new, "parent": owner[-1] if names else None, "property": names[0] if names else None, "type": x.get("itemtype"), "values": []})
                for n in names:
                    found[owner[-1]]["values"].append([n, f"#{new}"])
            elif names:
                said = next((x[a] for a in ("content", "href", "src", "datetime") if a in x), None)
                slot = [[n, said or ""] for n in names]
                found[owner[-1]]["values"] += slot
                if said is None:
                    gather = (slot, owner[-1], [])
                    texts.append(gather)
            owner.append(new)
            open_.append(gather)
        else:
            owner.pop()
            if gather := open_.pop():
                texts.remove(gather)
                for s in gather[0]:
                    s[1] = squeeze("".join(gather[2]))
    return [i for i in found if i["values"] or i["item"]]


_VALUE = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
_ITEM = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("property", T.StringType()), T.StructField("type", T.StringType()), T.StructField("values", T.ArrayType(_VALUE))])


@F.pandas_udf(T.ArrayType(_ITEM))
def microdata_items(pages: pd.Series) -> pd.Series:
    """The microdata items of each page."""
    return pages.map(lambda html: [i | {"values": [{"name": n, "value": v} for n, v in i["values"]]} for i in items_of(html)] if html else [])


def first_value(items: Column, name: str) -> Column:
    """S10 as connectors use it: the first non-empty value of a property anywhere in the page."""
    values = F.flatten(F.transform(items, lambda i: i["values"]))
    return F.get(F.filter(values, lambda v: (v["name"] == name) & (v["value"] != "") & ~v["value"].startswith("#")), 0)["value"]


def microdata_vehicles(pages: DataFrame, html: str) -> DataFrame:
    """The vehicle that a page's microdata describe; pages with neither a price nor a name have none.  Year and kilometres are read from the description,
    else from the name."""
    own = pages.withColumn("_items", microdata_items(html))
    said = {n: first_value(F.col("_items"), n) for n in ("name", "price", "brand", "image", "description", "vehicleIdentificationNumber")}
    own = own.withColumns({f"_{n}": c for n, c in said.items()}).where("_price is not null or _name is not null")
    text = F.coalesce(F.nullif("_description", F.lit("")), "_name")
    year = F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")
    km = F.regexp_replace(F.regexp_extract(text, r"(?i)([\d.]+)\s*km", 1), r"\.", "").try_cast("int")
    out = {"title": F.col("_name"), "make": F.col("_brand"), "year": year, "km": km, "price": N.to_price(F.col("_price")), "photo_url": F.col("_image"), "vin": F.col("_vehicleIdentificationNumber")}
    return own.select(*pages.columns, *(c.alias(n) for n, c in out.items())).drop(html)


#: A layout of cards: the mark that a page of it holds (lower case); the element of a card; where link, title and price stand; the elements of the
#: specifications.  An element is "tag.class.class", without a tag any; `@name` takes an attribute instead of the text.
LAYOUTS = {
    # Class names of four public themes for dealers' sites.
    "ga-car-card": {"mark": "ga-car-card", "card": "article.ga-car-card", "title": [".ga-car-card__title"], "price": [".ga-car-card__price-pill"], "specs": [".ga-car-card__spec-text"]},
    "sc_cars_item": {"mark": "sc_cars_item", "card": "div.sc_cars_item", "title": [".sc_cars_item_title"], "price": [".cars_price_data.cars_price1"], "specs": [".sc_cars_item_param_text"]},
    "stm_motors": {"mark": "stm-isotope-listing-item", "card": "div.stm-isotope-listing-item", "title": [".car-title", "@data-title"], "price": ["@data-price", ".normal-price"], "specs": ["span"]},
    "auto_listing": {"mark": "auto-listing type-auto-listing", "card": "li.auto-listing.type-auto-listing", "title": [".car_title", ".title"], "price": [".price-amount"], "specs": ["li"]},
}


def _fits(selector: str, tag: str, attrs: dict[str, str]) -> bool:
    name, *classes = selector.split(".")
    return (not name or name == tag) and set(classes) <= set(attrs.get("class", "").split())


def cards_of(html: str, layout: dict) -> list[dict]:
    """The cards of a page by their elements: fragment, first link, title, price and specifications as text.  A card ends where its element ends, so
    nothing beside or after it is taken for a part of it; a card inside a card belongs to the outer one."""
    wanted = {k: [s for s in layout[k] if s[0] != "@"] for k in ("title", "price", "specs")}
    out, depth, card, gather = [], 0, None, []
    for kind, tag, x, at in scan(html):
        if kind == "text":
            for g in gather:
                g[2].append(x)
            continue
        if kind == "open":
            depth += 1
            if card is None and _fits(layout["card"], tag, x):
                card = {"begin": at, "depth": depth, "link": None, "specs": [], "title": {}, "price": {}}
            elif card is not None:
                if tag == "a" and card["link"] is None and x.get("href"):
                    card["link"] = x["href"].strip()
                gather += [(depth, (k, s), []) for k, selectors in wanted.items() for s in selectors if _fits(s, tag, x)]
            if card is not None:
                for k in ("title", "price"):
                    for s in layout[k]:
                        if s[0] == "@" and s[1:] in x:
                            card[k].setdefault(s, x[s[1:]])
            continue
        if card is not None:
            for g in [g for g in gather if g[0] == depth]:
                gather.remove(g)
                (k, s), text = g[1], squeeze("".join(g[2]))
                if k == "specs":
                    card["specs"].append(text)
                else:
                    card[k].setdefault(s, text)
            if depth == card["depth"]:
                first = lambda k: next((card[k][s] for s in layout[k] if card[k].get(s)), None)  # noqa: B023, E731
                out.append({"fragment": html[card["begin"] : at], "link": card["link"], "title": first("title"), "price": first("price"), "specs": [s for s in card["specs"] if s]})
                card, gather = None, []
        depth -= 1
    return out


CARD = "array<struct<fragment: string, link: string, title: string, price: string, specs: array<string>>>"


def page_cards(pages: DataFrame, html: str, layouts: dict[str, dict] = LAYOUTS) -> DataFrame:
    """A row for each card of a page whose layout is known by its mark: theme, card (from 1), link, title, price, specs, fragment.  Cards without a link are
    left out, and of cards with one link the first counts."""

    @F.pandas_udf(CARD)
    def parse(theme: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([cards_of(h, layouts[t]) for t, h in zip(theme, text, strict=True)], dtype=object)

    theme = F.coalesce(*(F.when(F.contains(F.lower(F.col(html)), F.lit(x["mark"])), F.lit(t)) for t, x in layouts.items()))
    own = pages.withColumn("theme", theme).where("theme is not null").withColumn("_cards", parse("theme", html))
    linked = F.filter("_cards", lambda c: c["link"].isNotNull())
    first = F.filter(F.transform(linked, lambda c, i: F.struct(c.alias("c"), F.array_position(F.transform(linked, lambda d: d["link"]), c["link"]).alias("at"), i.alias("i"))), lambda x: x["at"] == x["i"] + 1)
    return own.select(*(c for c in pages.columns if c != html), "theme", F.posexplode(first).alias("_at", "_c")).select("*", (F.col("_at") + 1).alias("card"), "_c.c.*").drop("_at", "_c")


def card_vehicles(cards: DataFrame, host: str) -> DataFrame:
    """The common columns of a listing from cards: a link without a host gets the page's; of the specifications the first that is a year, the first with
    km in it and the first with a fuel count."""
    pick = lambda pattern: F.get(F.filter("specs", lambda s: s.rlike(pattern)), 0)
    link = F.when(F.col("link").startswith("http"), F.col("link")).otherwise(F.concat(F.lit("https://"), F.col(host), "link"))
    km = F.regexp_replace(pick("(?i)km"), r"\D", "").try_cast("int")
    fuel = F.get(F.filter("specs", lambda s: s.rlike(r"(?i)di[eé]sel|gasolina|h[ií]brido|el[eé]ctrico|glp|gnc|gas") & ~s.rlike(r"(?i)km")), 0)
    return cards.select(*(c for c in cards.columns if c not in ("link", "price", "specs", "fragment")), link.alias("deep_link"), N.to_price(F.col("price")).alias("price"), pick(r"^(19|20)\d{2}$").cast("int").alias("year"), F.when(km <= 5_000_000, km).alias("km"), fuel.alias("fuel"))
