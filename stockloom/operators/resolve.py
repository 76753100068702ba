"""Identity resolution (G2-G15): blocked edges, connected components, canonical rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from .blocking import canonical_pick, keyed, keyed_pairs, pairs, richness, spread, stars, tasks
from .graph import Tables, components
from .similarity import near_name_pairs, price_bands, similar_sets

SIGNAL_RANK = {"both": 3, "photo_url": 2, "firma": 1, "none": 0}
#: Strength of a seller source by group; any other source counts 1.
SOURCE_RANK = {"oem_dealer_network": 10, "association": 9, "official_registry": 8, "marketplace_motor": 7, "directory": 6}
#: Fields that make a seller's row rich; a resolution also counts the municipality.
RICH = ("website", "phone", "address", "cif", "lat")
#: Strength of the signals of a resolution.
RESOLUTION_RANK = {"phone": 1, "website": 1, "phone+website": 2, "fingerprint": 3, "fingerprint+phone": 4, "fingerprint+website": 4, "fingerprint+phone+website": 5}
#: Probability of a cross-source signal.
P_PHONE, P_PHONE_ALIEN, P_HOST, P_NAME, P_TWO = 0.97, 0.75, 0.98, 0.82, 0.99
#: Names that mark a chain.
CHAIN = r"(?i)(flexicar|ocasionplus|clicars|carplus|stellantis|mobility.?centro|grupo\s+\w+\s+motor|bmw\s+premium|mercedes.benz\s+\w+)"


def clusters(nodes: DataFrame, id: str, edges: DataFrame, order: Sequence[Column] | None = None, heads: Sequence[str] = (), near: str | None = None) -> DataFrame:
    """nodes plus cluster (the smallest id of the component) and cluster_size; with an order also the id of the first node in it as `canonical`, and of
    that node the columns `heads` as canonical_x, all by one aggregate.  `near` is a column of the edges that they do not leave."""
    of = components(edges, near=near)
    out = nodes.join(of.withColumnRenamed("node", id), id, "left").withColumn("cluster", F.coalesce("component", id)).drop("component")
    if order is None:
        return out.join(out.groupBy("cluster").agg(F.count("*").alias("cluster_size")), "cluster")
    first = F.min_by(F.struct(F.col(id).alias("canonical"), *(F.col(h).alias(f"canonical_{h}") for h in heads)), F.struct(*order, F.col(id)))
    per = out.groupBy("cluster").agg(F.count("*").alias("cluster_size"), first.alias("_head")).select("cluster", "cluster_size", "_head.*")
    return out.join(per, "cluster")


def vehicle_keys(cars: DataFrame) -> DataFrame:
    return cars.withColumns({"_photo": N.photo_key(F.col("photo_url")), "_title": N.alnum_key(F.col("title")), "_make": F.nullif(F.lower(F.trim("make")), F.lit("")), "_model": F.nullif(F.lower(F.trim("model")), F.lit(""))})


def vehicle_edges(cars: DataFrame, id: str = "vehicle_ulid") -> DataFrame:
    """(a, b, signal).  Equal photo keys link anywhere.  Equal make, model, year, km and province (all present) link if
    prices are within 2 % of the lower and the seller or the title key agrees (firma).  Equal photos are linked to
    their smallest id (a star spans the group; the component is the same as with all pairs)."""
    own = vehicle_keys(cars)
    # a branch for each of the two keys, so no block of one model is compared whole
    block, priced = ["_make", "_model", "year", "km", "province_code"], own.where("price > 0")
    titled = priced.where("_title <> ''")
    firma = price_bands(priced, [*block, "entity_ulid"], id, "price", ["_photo"]).select("a", "b", "a__photo", "b__photo").union(price_bands(titled, [*block, "_title"], id, "price", ["_photo"]).select("a", "b", "a__photo", "b__photo"))
    firma = firma.select("a", "b", F.when(F.col("a__photo") == F.col("b__photo"), "both").otherwise("firma").alias("signal"))
    star = stars(own, ["_photo"], id)
    return firma.unionByName(star.withColumn("signal", F.lit("photo_url"))).groupBy("a", "b").agg(F.min("signal").alias("signal"))


def vehicle_links(cars: DataFrame, id: str = "vehicle_ulid") -> DataFrame:
    """(a, b, signal) with the components of vehicle_edges and the strongest signal of each: in the order of the prices of a block with one seller or title, some cars are
    within the tolerance if and only if neighbours are, and so it is among those of them with one photo.  A car has six links at most."""
    block = ["_make", "_model", "year", "km", "province_code"]
    own = Tables(cars.sparkSession).keep(spread_keys(cars, id, vehicle_keys).select(id, *block, "entity_ulid", "_title", "_photo", "price"), "keys")  # read four times
    priced = own.where("price > 0")
    out = stars(own, ["_photo"], id).withColumn("signal", F.lit("photo_url"))
    for rows, k in ((priced, "entity_ulid"), (priced.where("_title <> ''"), "_title")):
        rows = rows.dropna(subset=[*block, k]).select(*block, k, "_photo", id, "price")
        ends = []
        for signal, key in (("firma", [*block, k]), ("both", [*block, k, "_photo"])):
            order = Window.partitionBy(*key).orderBy("price", id)
            rows = rows.withColumns({f"_{signal}": F.lag(id).over(order), f"_{signal}_price": F.lag("price").over(order)})
            near = (F.col("price") - F.col(f"_{signal}_price") <= F.expr("0.02") * F.col(f"_{signal}_price")) & (F.lit(signal == "firma") | F.col("_photo").isNotNull())
            ends.append(F.when(near, F.struct(F.least(f"_{signal}", id).alias("a"), F.greatest(f"_{signal}", id).alias("b"), F.lit(signal).alias("signal"))))
        out = out.unionByName(rows.select(F.explode(F.array(*ends)).alias("e")).where("e is not null").select("e.*"))
    return out.where("a <> b")


def vehicle_clusters(cars: DataFrame, edges: DataFrame, id: str = "vehicle_ulid") -> DataFrame:
    """Each car's cluster, size, strongest signal and canonical car (earliest first_seen, then id)."""
    edges = Tables(cars.sparkSession).keep(edges, "edges")  # read for the clusters and again for their signals
    grouped = clusters(cars.select(id, "first_seen"), id, edges, [F.col("first_seen").isNull(), F.col("first_seen")])
    rank = F.coalesce(*(F.when(F.col("signal") == s, r) for s, r in SIGNAL_RANK.items()))
    best = edges.groupBy(F.col("a").alias(id)).agg(F.max(rank).alias("_rank"))  # both ends are in one cluster
    best = grouped.select(id, "cluster").join(best, id).groupBy("cluster").agg(F.max("_rank").alias("_rank"))
    signal = F.coalesce(*(F.when(F.col("_rank") == r, s) for s, r in SIGNAL_RANK.items()), F.lit("none"))
    return grouped.join(best, "cluster", "left").select(id, "cluster", "cluster_size", signal.alias("match_signal"), F.col("canonical").alias("canonical_ulid"))


def keyed_edges(rows: DataFrame, block: list[str], id: str, keys: dict[str, str]) -> DataFrame:
    """(a, b, signal) of rows equal in one of the key columns inside a block."""
    found = F.array(*(F.when(F.col(s), F.lit(s)) for s in keys))
    return keyed_pairs(rows, block, id, keys).select("a", "b", F.explode(found).alias("signal")).where("signal is not null")


def spread_keys(rows: DataFrame, id: str, keys: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The keys of rows that are first dealt over the tasks: a file is much smaller than what its patterns cost, so one task would read and match it all."""
    return keys(rows.repartition(F.col(id)))


def with_keys(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"name_key": F.nullif(N.name_key(F.col("trade_name")), F.lit("")), "phone_key": N.phone_all(F.col("phone")), "host_key": N.host(F.col("website"))})


def fuzzy_names(rows: DataFrame, block: str, most: int | None, count: Column) -> DataFrame:
    """The rows whose names are compared: of at least eight characters.  `most` leaves out blocks with more named rows (a sum of `count`), as the reference does
    to spare all pairs of a block; the index of near_names has no need of it."""
    long = rows.where("length(name_key) >= 8")
    if most is None:
        return long
    return long.join(rows.groupBy(block).agg(F.sum(count).alias("rows")).where(F.col("rows") <= most).select(block), block, "left_semi")


def dealer_edges(rows: DataFrame, id: str = "entity_ulid", most: int | None = None) -> DataFrame:
    """Equal name, phone or host in one municipality, or names of at least eight characters within two edits, in blocks of any size, or of
    at most `most` named rows."""
    own = Tables(rows.sparkSession).keep(spread_keys(rows, id, with_keys).select(id, "municipality_code", "name_key", "phone_key", "host_key"), "keys")
    exact = keyed_edges(own, ["municipality_code"], id, {"name": "name_key", "phone": "phone_key", "website": "host_key"})
    named = own.dropna(subset=["municipality_code", "name_key"])
    fuzzy = near_name_pairs(fuzzy_names(named, "municipality_code", most, F.lit(1)), ["municipality_code"], id, "name_key")
    return exact.unionByName(fuzzy.select("a", "b", F.lit("fuzzy").alias("signal")))


def dealer_links(rows: DataFrame, id: str = "entity_ulid", most: int | None = None) -> DataFrame:
    """(municipality_code, a, b) with the components of dealer_edges: equal keys are linked as stars, and similar names are compared once a
    name and municipality, so a key that many rows share costs a link a row."""
    block = "municipality_code"
    own = Tables(rows.sparkSession).keep(spread_keys(rows, id, with_keys).select(id, block, "name_key", "phone_key", "host_key"), "keys")  # read five times
    named = own.dropna(subset=[block, "name_key"]).groupBy(block, "name_key").agg(F.min(id).alias(id), F.count("*").alias("rows"))
    near = near_name_pairs(fuzzy_names(named, block, most, F.col("rows")), [block], id, "name_key", blocks=True)
    of_key = keyed(own, block, id, {"name": "name_key", "phone": "phone_key", "website": "host_key"})
    star = of_key.join(of_key.groupBy(block, "_key").agg(F.min(id).alias("a")), [block, "_key"]).where(f"a <> {id}")
    return near.union(star.select(block, "a", F.col(id).alias("b")))


def seller_order(age: str) -> list[Column]:
    """W5 for sellers: source rank, richness, age (unknown last), code."""
    rank = F.coalesce(*(F.when(F.col("source_group") == s, r) for s, r in SOURCE_RANK.items()), F.lit(1))
    return [-rank, -richness(*RICH), F.col(age).isNull(), F.col(age), F.coalesce(F.nullif("cdp_code", F.lit("")), F.lit("ZZZZ"))]


def dealer_clusters(rows: DataFrame, edges: DataFrame, id: str = "entity_ulid") -> DataFrame:
    """Canonical by source rank, richness, first sight and code; edges as of dealer_links."""
    own = rows.select(id, "source_group", *RICH, "first_seen", "cdp_code")
    grouped = clusters(own, id, edges, seller_order("first_seen"), near="municipality_code" if "municipality_code" in edges.columns else None)
    return grouped.select(id, "cluster", "cluster_size", F.col("canonical").alias("canonical_ulid"))


def fingerprints(inventory: DataFrame, crowded: int = 5, id: str = "entity_ulid", item: str = "canonical_vehicle_ulid") -> DataFrame:
    """Distinct (seller, car) of cars that have driven (km > 0), without cars that `crowded` or more sellers share."""
    own = inventory.where("km > 0").select(id, item).dropna().distinct()
    return own.join(own.groupBy(item).count().where(F.col("count") >= crowded), item, "left_anti").select(id, item)


def adjudicate(sellers: DataFrame, prints: DataFrame, theta: float = 0.30, crowd: int = 3, id: str = "entity_ulid") -> DataFrame:
    """Accepted candidate pairs (a, b, signal, probability), first rule that holds: Jaccard at least theta in any province (equal phones
    and hosts are named too); a clean phone in one province; a crowded phone and a clean host in one province; a clean
    host in one province.  A null province is a different one.  `prints` has crowded cars taken out (G7)."""
    own = sellers.withColumns({"phone_key": N.phone_last9(F.col("phone")), "host_key": N.host(F.col("website"))}).select(id, "province_code", "phone_key", "host_key")
    busy = {k: own.dropna(subset=[k]).groupBy(k).count().where(F.col("count") >= crowd).select(F.col(k).alias(f"_{k}"), F.lit(True).alias(f"{k}_busy")) for k in ("phone_key", "host_key")}
    for k, b in busy.items():
        own = own.join(b, F.col(k) == F.col(f"_{k}"), "left").drop(f"_{k}").withColumn(f"{k}_busy", F.coalesce(f"{k}_busy", F.lit(False)))
    overlap = similar_sets(prints, id, "canonical_vehicle_ulid", theta).select("a", "b", "jaccard")
    # a crowded phone counts with a clean host alone, and such pairs are found by the host: its own pairs are not needed
    same = pairs(own.where("not phone_key_busy"), ["province_code", "phone_key"], id).select("a", "b").union(pairs(own.where("not host_key_busy"), ["province_code", "host_key"], id).select("a", "b"))
    sides = [own.select(F.col(id).alias(p), *(F.col(c).alias(f"{p}_{c}") for c in own.columns if c != id)) for p in "ab"]
    both = overlap.select("a", "b").union(same).distinct().join(overlap, ["a", "b"], "left").join(sides[0], "a").join(sides[1], "b")
    near = F.coalesce(F.col("a_province_code") == F.col("b_province_code"), F.lit(False))
    phone = F.coalesce(F.col("a_phone_key") == F.col("b_phone_key"), F.lit(False))
    web = F.coalesce(F.col("a_host_key") == F.col("b_host_key"), F.lit(False))
    host = web & ~F.col("a_host_key_busy")
    crowded = F.col("a_phone_key_busy")
    named = F.concat(F.lit("fingerprint"), F.when(phone, "+phone").otherwise(""), F.when(web, "+website").otherwise(""))
    signal = F.when(F.col("jaccard") >= theta, named).when(near & phone & ~crowded, "phone").when(near & phone & crowded & host, "phone+website").when(near & host, "website")
    p = F.when(F.col("jaccard") >= theta, F.round("jaccard", 4)).otherwise(1.0)
    return both.select("a", "b", signal.alias("signal"), p.cast("double").alias("probability")).where("signal is not null")


def resolution_clusters(sellers: DataFrame, edges: DataFrame, id: str = "entity_ulid") -> DataFrame:
    """Resolved seller, size, strongest signal (then the alphabetically smaller) and highest probability; singletons none and null."""
    own = sellers.withColumn("_rich", richness(*RICH, "municipality_code"))
    grouped = clusters(own, id, edges)
    rank = F.coalesce(*(F.when(F.col("signal") == s, -r) for s, r in RESOLUTION_RANK.items()))
    ends = edges.select(F.col("a").alias(id), "signal", "probability")
    best = grouped.select(id, "cluster").join(ends, id).groupBy("cluster").agg(F.min_by("signal", F.struct(rank, "signal")).alias("signal"), F.max("probability").alias("probability"))
    head = canonical_pick(grouped, "cluster", id, [-F.col("_rich"), -F.coalesce("n_vehicles", F.lit(0)), F.col("created_at").isNull(), F.col("created_at")])
    return grouped.join(best, "cluster", "left").join(head, "cluster").select(id, F.col("canonical").alias("resolved_ulid"), "cluster_size", F.coalesce("signal", F.lit("none")).alias("signal"), "probability")


def orthogonal(a: Column, b: Column, geo: list[str], digital: list[str]) -> Column:
    """One side has a geographic source and the other a digital one."""
    g, d = F.array(*map(F.lit, geo)), F.array(*map(F.lit, digital))
    return (F.arrays_overlap(a, g) & F.arrays_overlap(b, d)) | (F.arrays_overlap(a, d) & F.arrays_overlap(b, g))


#: Signals across sources and the columns of cross_source_keys that they compare.
CROSS_KEYS = {"phone": "pk", "host": "hk", "name": "strong"}


def cross_source_keys(rows: DataFrame) -> DataFrame:
    own = rows.withColumns({"nk": F.nullif(N.name_key(F.col("trade_name")), F.lit("")), "pk": N.phone_last9(F.col("phone"), 9), "hk": N.host(F.col("website")), "chain": F.coalesce(F.col("trade_name").rlike(CHAIN), F.lit(False))})
    return own.withColumn("strong", F.when((F.length("nk") >= 6) & ~F.col("chain"), F.col("nk")))


def cross_source_probability(reasons: Column, one: Column, two: Column) -> Column:
    """The probability of a pair's reasons (not empty); one and two are its name keys."""
    alien = F.coalesce((F.length(one) >= 3) & (F.length(two) >= 3) & (N.jaccard(N.trigrams(one), N.trigrams(two)) < 0.15), F.lit(False))
    return F.when(F.size(reasons) >= 2, P_TWO).when(reasons[0] == "host", P_HOST).when(reasons[0] == "name", P_NAME).when(alien, P_PHONE_ALIEN).otherwise(P_PHONE)


def cross_source_edges(rows: DataFrame, geo: list[str], digital: list[str], id: str = "entity_ulid") -> DataFrame:
    """(a, b, probability, reasons) in one municipality between orthogonal sources.  Phone alone 0.97, or 0.75 where
    both names have three characters and their trigrams overlap under 0.15; host alone 0.98; name alone 0.82 if six characters long
    and no chain; two signals 0.99."""
    own = cross_source_keys(rows)
    hits = [pairs(own, ["municipality_code", k], id).select("a", "b", F.lit(s).alias("s")) for s, k in CROSS_KEYS.items()]
    all_ = hits[0].union(hits[1]).union(hits[2]).groupBy("a", "b").agg(F.array_sort(F.collect_set("s")).alias("reasons"))
    side = lambda p: own.select(F.col(id).alias(p), F.col("nk").alias(f"{p}_nk"), F.col("source_keys").alias(f"{p}_src"))
    both = all_.join(side("a"), "a").join(side("b"), "b").where(orthogonal(F.col("a_src"), F.col("b_src"), geo, digital))
    p = cross_source_probability(F.col("reasons"), F.col("a_nk"), F.col("b_nk"))
    return both.select("a", "b", p.alias("probability"), F.array_join("reasons", "+").alias("reasons"))


def cross_source_links(own: DataFrame, geo: list[str], digital: list[str], id: str = "entity_ulid") -> DataFrame:
    """(municipality_code, a, b) with the components of cross_source_edges, of rows with cross_source_keys.  Of the rows of a municipality with an equal key, the geographic
    ones are linked to the smallest digital one and the digital ones to the smallest geographic one: all are such pairs, and
    they reach every row that has a pair, with two links a row and key at most."""
    has = lambda names: F.coalesce(F.arrays_overlap("source_keys", F.array(*map(F.lit, names))), F.lit(False))
    block = "municipality_code"
    of_key = keyed(own.withColumns({"_geo": has(geo), "_digital": has(digital)}), block, id, CROSS_KEYS, ["_geo", "_digital"]).where("_geo or _digital")
    first = of_key.groupBy(block, "_key").agg(F.min(F.when(F.col("_geo"), F.col(id))).alias("_g"), F.min(F.when(F.col("_digital"), F.col(id))).alias("_d")).dropna(subset=["_g", "_d"])
    ends = F.array(F.when(F.col("_geo"), F.col("_d")), F.when(F.col("_digital"), F.col("_g")))
    return of_key.join(first, [block, "_key"]).select(block, F.explode(ends).alias("a"), F.col(id).alias("b")).where("a <> b")


def cross_source_clusters(rows: DataFrame, geo: list[str], digital: list[str], id: str = "entity_ulid") -> DataFrame:
    """Canonical row and the probability of the direct edge to it (as of cross_source_edges), else null.  The clusters come from
    links, and only the pairs with a canonical row are weighed, so all pairs of a key are never made."""
    compared = ["municipality_code", "source_keys", "nk", *CROSS_KEYS.values()]
    own = spread_keys(rows, id, cross_source_keys).select(id, "source_group", *RICH, "created_at", "cdp_code", *compared)
    own = Tables(rows.sparkSession).keep(own, "keys")  # read for the links, their heads and the clusters
    at = clusters(own, id, cross_source_links(own, geo, digital, id), seller_order("created_at"), compared, "municipality_code")
    # in the order of their names, as cross_source_edges has them
    found = F.filter(F.array(*(F.when(F.col(CROSS_KEYS[s]) == F.col(f"canonical_{CROSS_KEYS[s]}"), F.lit(s)) for s in sorted(CROSS_KEYS))), lambda s: s.isNotNull())
    linked = (F.col(id) != F.col("canonical")) & (F.col("municipality_code") == F.col("canonical_municipality_code")) & orthogonal(F.col("source_keys"), F.col("canonical_source_keys"), geo, digital)
    p = F.when(F.size("reasons") > 0, cross_source_probability(F.col("reasons"), F.col("nk"), F.col("canonical_nk")))
    return at.withColumn("reasons", F.when(linked, found)).select(id, F.col("canonical").alias("canonical_ulid"), "cluster_size", p.cast("double").alias("match_probability"))


def merge_map(rows: DataFrame, key: str, id: str, seen: str) -> DataFrame:
    """Folded -> survivor (the oldest) of rows with an equal key."""
    own = rows.dropna(subset=[key])
    head = canonical_pick(own, key, id, [F.col(seen).isNull(), F.col(seen)])
    return own.join(head, key).where(f"{id} <> canonical").select(F.col(id).alias("folded"), F.col("canonical").alias("survivor"))


def move_edges(edges: DataFrame, moved: DataFrame, id: str, other: str, n: int | None = None) -> DataFrame:
    """Edges re-pointed to survivors; where the survivor has that edge already, the folded one is dropped.  n: tasks that the edges ask for."""
    deal = lambda df, *by: df.repartition(n, *by) if n else df
    both = deal(edges, id).join(deal(moved, "folded"), F.col(id) == F.col("folded"), "left")
    at = both.withColumn("_moved", F.col("survivor").isNotNull()).withColumn(id, F.coalesce("survivor", id)).drop("folded", "survivor")
    keep = deal(at, id, other).groupBy(id, other).agg(F.min_by(F.struct(*[c for c in edges.columns if c not in (id, other)]), F.struct("_moved", *[c for c in edges.columns if c not in (id, other)])).alias("_r"))
    return keep.select(id, other, "_r.*")


def superseded(old: DataFrame, twins: DataFrame, key: str, id: str) -> DataFrame:
    """Rows of a legacy bucket that a twin elsewhere replaces."""
    return old.join(twins.where(F.col(key).isNotNull()), key, "left_semi").select(id)


def excess(rows: DataFrame, key: list[str], platform: str) -> DataFrame:
    """Rows beyond the first of each key that is on two or more platforms (its least and its greatest differ)."""
    n = tasks(rows)
    own = spread(rows.dropna(subset=key).select(*key, F.col(platform).alias("_p")), key, n)
    parts = own.groupBy(*key, "_part").agg(F.count("*").alias("n"), F.min("_p").alias("lo"), F.max("_p").alias("hi"))
    g = parts.repartition(n, *key).groupBy(*key).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("excess"), F.count("*").alias("groups"))


def match_tiers(edges: DataFrame) -> DataFrame:
    """Pairs by signal and tier of their probability; edges as of cross_source_edges."""
    has = lambda w: F.contains("reasons", F.lit(w))
    signal = F.when(has("phone") & has("host"), "phone+website").when(has("phone"), "phone").when(has("host"), "website").otherwise("name")
    tier = F.when(F.col("probability") >= 0.95, "high").when(F.col("probability") >= 0.80, "medium").otherwise("low")
    return edges.groupBy(signal.alias("signal"), tier.alias("tier")).agg(F.count("*").alias("pairs"))


def vehicle_sanity(cars: DataFrame, clustered: DataFrame, sellers: DataFrame, giant: int = 20, id: str = "vehicle_ulid") -> DataFrame:
    """One row: clusters whose cars' sellers are in more than one province, clusters over `giant`, cars without a cluster, repeated
    rows, and single cars with a signal."""
    clustered = Tables(cars.sparkSession).keep(clustered, "clusters")  # read twice
    at = clustered.join(cars.select(id, "entity_ulid"), id).join(sellers.select("entity_ulid", "province_code"), "entity_ulid", "left")
    per = at.groupBy("canonical_ulid").agg(F.count_distinct("province_code").alias("p"), F.max("cluster_size").alias("size"))
    one = per.agg(F.count_if(F.col("p") > 1).alias("cross_province"), F.count_if(F.col("size") > giant).alias("giants"))
    rows = clustered.agg(F.count("*").alias("n"), F.count_distinct(id).alias("d"), F.count_if((F.col("cluster_size") == 1) & (F.col("match_signal") != "none")).alias("singletons_with_signal"))
    all_ = cars.agg(F.count("*").alias("cars")).crossJoin(rows).crossJoin(one)  # one row each
    return all_.select("cross_province", "giants", (F.col("cars") - F.col("n")).alias("uncovered"), (F.col("n") - F.col("d")).alias("repeated"), "singletons_with_signal")


def dealer_sanity(sellers: DataFrame, clustered: DataFrame, chain: str, id: str = "entity_ulid", source: str = "source_group") -> DataFrame:
    """One row: groups of equal source, name and municipality and how many are one cluster (recall), clusters over municipalities without any
    website or phone (precision), the canonicals and municipalities of a chain (names like `chain`), and the largest cluster."""
    at = sellers.select(id, source, "trade_name", "municipality_code", "kind", "website", "phone").join(clustered.select(id, "canonical_ulid", "cluster_size"), id)
    at = Tables(sellers.sparkSession).keep(at, "sellers")  # read three times
    firms = at.where("kind <> 'particular'")
    same = firms.dropna(subset=["municipality_code"]).groupBy(source, "trade_name", "municipality_code").agg(F.count("*").alias("n"), F.count_distinct("canonical_ulid").alias("c")).where("n > 1")
    same = same.agg(F.count("*").alias("same_name_groups"), F.count_if(F.col("c") == 1).alias("same_name_merged"))
    filled = lambda c: F.count_distinct(F.nullif(c, F.lit("")))
    per = at.groupBy("canonical_ulid").agg(F.count_distinct("municipality_code").alias("m"), filled("website").alias("w"), filled("phone").alias("p"), F.max("cluster_size").alias("size"))
    per = per.agg(F.count_if((F.col("m") > 1) & (F.col("w") == 0) & (F.col("p") == 0) & (F.col("size") > 1)).alias("unsupported"), F.max("size").alias("largest"))
    chained = firms.where(F.col("trade_name").ilike(chain)).agg(F.count_distinct("canonical_ulid").alias("chain_canonicals"), F.count_distinct("municipality_code").alias("chain_municipalities"))
    return same.crossJoin(per).crossJoin(chained)  # one row each


def cross_source_sanity(rows: DataFrame, edges: DataFrame, id: str = "entity_ulid") -> DataFrame:
    """One row: the pairs, those whose sides share a source, and those of a chain by name alone."""
    side = lambda p: rows.select(F.col(id).alias(p), F.col("source_keys").alias(f"{p}_src"), F.coalesce(F.col("trade_name").rlike(CHAIN), F.lit(False)).alias(f"{p}_chain"))
    at = edges.join(side("a"), "a").join(side("b"), "b")
    return at.agg(F.count("*").alias("edges"), F.count_if(F.arrays_overlap("a_src", "b_src")).alias("intra_source"), F.count_if((F.col("reasons") == "name") & (F.col("a_chain") | F.col("b_chain"))).alias("chain_name_only"))


def source_pairs(rows: DataFrame, edges: DataFrame, hub: str, id: str = "entity_ulid") -> DataFrame:
    """Of the pairs with `hub` among the sources of either side, how many also have each other source; the row `*` has all of them."""
    side = lambda p: rows.select(F.col(id).alias(p), F.col("source_keys").alias(f"{p}_src"))
    both = edges.select("a", "b").join(side("a"), "a").join(side("b"), "b").select(F.array_union("a_src", "b_src").alias("src")).where(F.array_contains("src", hub))
    return both.select(F.explode(F.concat(F.array(F.lit("*")), F.array_remove("src", hub))).alias("source")).groupBy("source").agg(F.count("*").alias("pairs"))


def short_names_apart(sellers: DataFrame, clustered: DataFrame, one: str, two: str, id: str = "entity_ulid") -> DataFrame:
    """One row: how many rows and clusters two like names (in any case) have, and whether they stay apart: null if one of them is absent."""
    own = sellers.select(id, F.lower("trade_name").alias("_name")).where(F.col("_name").isin(one.lower(), two.lower())).join(clustered.select(id, "canonical_ulid"), id)
    own = Tables(sellers.sparkSession).keep(own, "names")  # read twice
    n = own.agg(F.count("*").alias("rows"), F.count_distinct("canonical_ulid").alias("canonicals"), F.count_distinct("_name").alias("_names"))
    shared = own.groupBy("canonical_ulid").agg(F.count_distinct("_name").alias("n")).where("n > 1").agg(F.count("*").alias("_shared"))
    return n.crossJoin(shared).select("rows", "canonicals", F.when(F.col("_names") == 2, F.col("_shared") == 0).alias("apart"))  # one row each


def suffix_variants(sellers: DataFrame, clustered: DataFrame, like: str, id: str = "entity_ulid") -> DataFrame:
    """For each municipality the rows whose name is like a pattern, their clusters, and whether they are one: variants of a legal suffix should merge."""
    own = sellers.where(F.col("trade_name").ilike(like) & F.col("municipality_code").isNotNull()).select(id, "municipality_code").join(clustered.select(id, "canonical_ulid"), id)
    return own.groupBy("municipality_code").agg(F.count("*").alias("rows"), F.count_distinct("canonical_ulid").alias("canonicals")).withColumn("merged", F.col("canonicals") == 1)
