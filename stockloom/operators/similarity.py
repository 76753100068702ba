"""Joins of texts, prices and sets that are alike, by index keys instead of all pairs of a block.

Each join has keys that no result can do without, so nothing is lost, and an exact test after them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.similarity import LONGER, TOKENS, weighted_ratio
from .graph import Tables


def _segments(length: Column, count: int) -> list[tuple[Column, Column]]:
    """Start (from 0) and length of `count` even segments of a text of this length."""
    edges = [F.floor((length + k) / count).cast("int") for k in range(count)]
    starts = [F.lit(0)]
    for e in edges[:-1]:
        starts.append(starts[-1] + e)
    return list(zip(starts, edges, strict=True))


def _shortened(names: DataFrame, block: Sequence[str], most: int) -> DataFrame:
    """(block..., s, d, _key): a hash of what is left of each name `s` when d of its characters go, for each choice of d up to `most`.  Of equal neighbours the first goes, so few
    choices leave the same."""
    step = names.select(*block, "s", F.lit(0).alias("d"), F.col("s").alias("left"), F.lit(1).alias("at"))
    steps = [step]
    for _ in range(most):
        size = F.length("left")
        step = step.select(*block, "s", (F.col("d") + 1).alias("d"), "left", F.explode(F.when(F.col("at") <= size, F.sequence(F.col("at"), size))).alias("at"))
        step = step.where("at = 1 or substring(left, at, 1) <> substring(left, at - 1, 1)").withColumn("left", F.expr("substring(left, 1, at - 1) || substring(left, at + 1)"))
        steps.append(step)
    out = steps[0]
    for step in steps[1:]:
        out = out.union(step)
    return out.select(*block, "s", "d", F.xxhash64("left").alias("_key"))


def near_names(names: DataFrame, block: Sequence[str], name: str, most: int = 2, crowd: int = 64) -> DataFrame:
    """(block..., a, b), a < b: distinct names of a block within `most` edits.  A name is cut into `most` + 1 segments, of which at least one stands
    unchanged, and moved by at most `most` places, in any name so near; so the longer name of a pair asks for its pieces at those places.

    A piece that more than `crowd` names of a block have (the beginning of numbered names) would compare them all.  Names with such a piece are found another way: two
    names are within `most` edits only if the longer one without `most` characters is the other one without at most as many.  Names that share what is left are few, whatever the block's size."""
    # few bytes of names make many pieces, so tasks are counted beforehand and pieces are never broadcast
    tables, deal = Tables(names.sparkSession), int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = tables.keep(names.select(*block, F.col(name).alias("s")).dropna().distinct().repartition(deal), "names")
    size = F.length("s")
    index = own.select(*block, F.col("s").alias("a"), F.explode(F.array(*(F.struct(size.alias("l"), F.lit(i).alias("i"), F.substring(F.col("s"), start + 1, n).alias("piece")) for i, (start, n) in enumerate(_segments(size, most + 1))))).alias("_key"))
    asks = []
    for shorter in range(most + 1):
        length = size - shorter
        for i, (start, n) in enumerate(_segments(length, most + 1)):
            for shift in range(-most, most + 1):
                inside = (length >= 0) & (start + shift >= 0) & (start + shift + n <= size)
                asks.append(F.when(inside, F.struct(length.alias("l"), F.lit(i).alias("i"), F.substring(F.col("s"), start + shift + 1, n).alias("piece"))))
    asked = own.select(*block, F.col("s").alias("b"), F.explode(F.array_distinct(F.filter(F.array(*asks), lambda x: x.isNotNull()))).alias("_key"))
    longer = "a <> b and (length(a) < length(b) or length(a) = length(b) and a < b)"
    crowded = index.groupBy(*block, "_key").agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).drop("_n")
    found = index.join(crowded, [*block, "_key"], "left_anti").hint("merge").join(asked, [*block, "_key"]).where(longer).select(*block, "a", "b")
    among = index.withColumnRenamed("a", "s").union(asked.withColumnRenamed("b", "s").select(*block, "s", "_key")).join(crowded, [*block, "_key"], "left_semi").select(*block, "s").distinct()
    short = _shortened(tables.keep(among.repartition(deal), "crowded"), block, most)
    asked = short.where(F.col("d") == F.least(F.lit(most), F.length("s"))).select(*block, "_key", F.col("s").alias("b"))
    found = found.union(short.select(*block, "_key", F.col("s").alias("a")).hint("merge").join(asked, [*block, "_key"]).where(longer).select(*block, "a", "b")).distinct()
    return found.where(f"levenshtein(a, b, {most}) >= 0").select(*block, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_name_pairs(rows: DataFrame, block: Sequence[str], id: str, name: str, most: int = 2, blocks: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of ids of a block whose names differ by one to `most` edits; with `blocks` after their block."""
    near = near_names(rows, block, name, most).select(*block, F.col("a").alias("x"), F.col("b").alias("y"))
    side = lambda p, n: rows.select(*block, F.col(name).alias(n), F.col(id).alias(p))
    both = near.join(side("_p", "x"), [*block, "x"]).join(side("_q", "y"), [*block, "y"])
    return both.select(*(block if blocks else ()), F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b"))


def _grams(text: Column) -> Column:
    """Pairs of neighbouring characters inside the tokens of a text; a token of one character is its own."""
    one = lambda t: F.when(F.length(t) < 2, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2))))
    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), one)))


def weighted_matches(asked: DataFrame, known: DataFrame, block: Sequence[str], a: str, b: str, least: float = 88.0) -> DataFrame:
    """(block..., a, b, score) of the distinct names `a` of asked and `b` of known in a block whose weighted ratio is at least `least` (above 85.5, so
    that no partial score of tokens can reach it).  Names have at least four characters; shorter ones match nothing.

    Such names have a token in common, or one of them holds the other but for a few characters, or their common subsequence is so long that they share most
    of their pairs of characters.  So besides tokens, each asked name is found by its rarest pairs, as many as can be missing and one more, and each
    known name by its own rarest ones.  Rarity is taken among the known names of the block."""
    if least <= 100 * TOKENS * 0.9:
        raise ValueError("weighted_matches: a score this low can come from partial tokens, which have no index")
    q = asked.select(*block, F.col(a).alias("a")).dropna().where("length(trim(a)) >= 4").distinct().withColumn("g", _grams(F.col("a")))
    c = known.select(*block, F.col(b).alias("b")).dropna().where("length(trim(b)) >= 4").distinct().withColumn("g", _grams(F.col("b")))
    of_pairs = c.select(*block, "b", F.explode("g").alias("_key"))
    often = of_pairs.groupBy(*block, "_key").agg(F.count("*").alias("often"))

    def rarest(names: DataFrame, n: str, keep: Column) -> DataFrame:
        """(block..., n, k): of each name the rarest of its pairs of characters."""
        counted = names.select(*block, n, "g", F.explode("g").alias("_key")).join(often, [*block, "_key"], "left")
        # a name has as many pairs as characters at most
        order = counted.groupBy(*block, n).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "_key"))).alias("o"), F.first("g").alias("g"))
        return order.select(*block, n, F.explode(F.slice("o", 1, keep)).alias("o")).select(*block, n, F.col("o._key").alias("_key"))

    # a ratio r of texts of l and l' characters leaves l + l' - 2 lcs <= (1 - r)(l + l') characters out, l' <= l (2 - r) / r, and each takes
    # two pairs away; pairs lie inside tokens, so the order of the tokens does not matter
    miss = (1 - least / 100) * (1 + (2 - least / 100) / (least / 100))
    some = F.greatest(F.lit(1), F.least(F.size("g"), (F.floor(F.length("a") * miss + 1e-9) * 2 + 1).cast("int")))
    part = (100 - least / 0.9) / 100
    # where one name holds the other, tokens of one character at its two ends can be parts of longer ones
    few = F.greatest(F.lit(1), F.least(F.size("g"), (F.ceil(F.length("b") * part * 2) * 2 + 3).cast("int")))
    by_pair = rarest(q, "a", some).join(of_pairs, [*block, "_key"])
    held = rarest(c, "b", few).join(q.select(*block, "a", F.explode("g").alias("_key")), [*block, "_key"]).where(f"length(a) >= {LONGER} * length(b)")
    words = lambda df, n: df.select(*block, n, F.explode(F.array_distinct(F.split(F.trim(n), r"\s+"))).alias("_key"))
    by_token = words(q, "a").join(words(c, "b"), [*block, "_key"])
    pairs = Tables(asked.sparkSession).keep(by_pair.select(*block, "a", "b").union(held.select(*block, "a", "b")).union(by_token.select(*block, "a", "b")).distinct(), "pairs")
    return pairs.withColumn("score", weighted_ratio("a", "b")).where(F.col("score") >= least)


def token_matches(queries: DataFrame, candidates: DataFrame, block: str, id: str, tokens: str, code: str) -> DataFrame:
    """(block, id, n, code): of how many candidate codes of the block all tokens of a query are among the tokens, if of any, and the smallest code.  A
    candidate has every token of such a query, so it is found by the query's rarest one; each distinct set of tokens is asked once."""
    asked = queries.where(F.size(tokens) > 0).select(block, id, F.array_sort(F.array_distinct(tokens)).alias("_q"))
    c = candidates.select(block, F.col(tokens).alias("_c"), code).distinct()
    by_token = c.select(block, F.explode(F.array_distinct("_c")).alias("_t"), "_c", code)
    often = by_token.groupBy(block, "_t").agg(F.count("*").alias("_n"))
    q = asked.select(block, "_q").distinct()
    rare = q.select(block, "_q", F.explode("_q").alias("_t")).join(often, [block, "_t"], "left").groupBy(block, "_q").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_t").alias("t"))).alias("_r"))
    rare = rare.where("_r.n > 0").select(block, "_q", F.col("_r.t").alias("_t"))
    hit = rare.join(by_token, [block, "_t"]).where(F.size(F.array_except("_q", "_c")) == 0)
    found = hit.groupBy(block, "_q").agg(F.count_distinct(code).alias("n"), F.min(code).alias(code))
    return asked.join(found, [block, "_q"]).select(block, id, "n", code)


def subsets(small: DataFrame, a: str, large: DataFrame, b: str) -> DataFrame:
    """Pairs of rows of which the token set `a` of the one lies inside the token set `b` of the other.  Such a set `b` has every token of `a`, so it is found by the one that
    fewest sets `b` have."""
    by_token = large.withColumn("_key", F.explode(b))
    often = by_token.groupBy("_key").agg(F.count("*").alias("_often"))
    rare = small.select(a, F.explode(a).alias("_key")).join(often, "_key", "left").groupBy(a).agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), F.col("_key").alias("t"))).alias("_r"))
    keyed = small.join(rare.where("_r.n > 0"), a).withColumn("_key", F.col("_r.t")).drop("_r")
    return keyed.join(by_token, "_key").where(F.size(F.array_except(a, b)) == 0).drop("_key")


def token_subset(queries: DataFrame, candidates: DataFrame, block: str, id: str, tokens: str, code: str) -> DataFrame:
    """Queries whose tokens are all among those of exactly one candidate code of the block."""
    return token_matches(queries, candidates, block, id, tokens, code).where("n = 1").select(id, code)


def price_bands(rows: DataFrame, block: Sequence[str], id: str, price: str, keep: Sequence[str] = (), tolerance: float = 0.02) -> DataFrame:
    """Pairs (a, b), a < b, of a block whose prices differ by at most `tolerance` of the lower one; kept columns appear as a_x and b_x.  Prices fall into bands
    a little wider than the tolerance, so the two are in one band or in neighbours.  A price of 0 is near to another 0 alone; null and negative
    prices to none."""
    own = rows.dropna(subset=[*block, price]).where(F.col(price) >= 0).select(*block, id, price, *(k for k in keep if k not in (*block, price)))
    band = F.when(F.col(price) > 0, F.floor(F.log(F.col(price).cast("double")) / math.log(1.001 * (1 + tolerance))))
    band = F.coalesce(band, F.lit(-(1 << 40))).cast("long")
    near = f"abs(a_{price} - b_{price}) <= {tolerance} * least(a_{price}, b_{price})"
    kind, part = own.schema[price].dataType, Decimal(str(tolerance))
    one = 10 ** max(0, -part.as_tuple().exponent)
    whole = isinstance(kind, DecimalType) and kind.precision + len(str(int((1 + part) * one))) <= 18
    bounds = {}
    if whole:  # whole numbers of the smallest unit, counted once a row: pairs are many more than rows
        units = (F.col(price) * F.lit(10**kind.scale)).cast("long")
        bounds, near = {"_at": units * one, "_top": units * int((1 + part) * one)}, "a__at <= b__top and b__at <= a__top"
    side = lambda p: own.select(*block, *(F.col(c).alias(f"{p}_{c}") for c in own.columns if c not in block), *(v.alias(f"{p}_{c}") for c, v in bounds.items()), band.alias(f"{p}_band"))
    asked = side("b").withColumn("a_band", F.explode(F.array(F.col("b_band"), F.col("b_band") - 1)))
    # few bytes of prices make many pairs, so bands are dealt over all tasks and never broadcast
    keys, n = [*block, "a_band"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = side("a").repartition(n, *keys).hint("merge").join(asked.repartition(n, *keys), keys).where(f"{near} and (a_band < b_band or a_{id} < b_{id})")
    turn = F.col(f"a_{id}") > F.col(f"b_{id}")
    kept = [c for c in own.columns if c not in (*block, id)]
    both = [F.when(turn, F.col(f"{q}_{c}")).otherwise(F.col(f"{p}_{c}")).alias(f"{p}_{c}") for c in kept for p, q in (("a", "b"), ("b", "a"))]
    return found.select(*block, F.least(f"a_{id}", f"b_{id}").alias("a"), F.greatest(f"a_{id}", f"b_{id}").alias("b"), *both)


def price_links(rows: DataFrame, block: Sequence[str], id: str, price: str, tolerance: str = "0.02") -> DataFrame:
    """J7 without its pairs: (id, n_links, class_id) of every row: how many others of the block have a price (a decimal) within `tolerance` of the lower one, and the smallest
    id that such links reach.  Prices count once with their number of rows.  A price meets its upper bound in one running count: prices up to the bound, less those whose own bound
    lies below the price.  Sorted prices are linked if neighbours are, so classes end where the next price is above the bound."""
    own = rows.select(*block, id, F.col(price).cast("decimal(24,6)").alias("_p"))
    kinds = own.dropna().where("_p >= 0").groupBy(*block, "_p").agg(F.count("*").alias("_n"), F.min(id).alias("_first"))
    bound = (F.col("_p") * (1 + F.lit(tolerance).cast("decimal(6,4)"))).cast("decimal(32,10)")
    marks = kinds.select(*block, "_p", "_n", F.explode(F.array(F.struct(F.col("_p").cast("decimal(32,10)").alias("v"), F.lit(0).alias("k")), F.struct(bound.alias("v"), F.lit(1).alias("k")))).alias("m"))
    upto = Window.partitionBy(*block).orderBy("m.v", "m.k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda k: F.sum(F.when(F.col("m.k") == k, F.col("_n")).otherwise(0)).over(upto)
    counted = marks.select(*block, "_p", F.when(F.col("m.k") == 1, count(0)).otherwise(-count(1)).alias("c")).groupBy(*block, "_p").agg((F.sum("c") - 1).alias("n_links"))
    order = Window.partitionBy(*block).orderBy("_p")
    opens = kinds.withColumn("_new", F.coalesce((F.col("_p") > F.lag(bound).over(order)).cast("int"), F.lit(0)))
    chain = opens.withColumn("_chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    chain = chain.join(chain.groupBy(*block, "_chain").agg(F.min("_first").alias("class_id")), [*block, "_chain"]).select(*block, "_p", "class_id")
    out = own.join(counted.join(chain, [*block, "_p"]), [*block, "_p"], "left")
    return out.select(id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", id).alias("class_id"))


def similar_sets(sets: DataFrame, id: str, item: str, least: float) -> DataFrame:
    """(a, b, n_both, jaccard), a < b, of ids whose item sets have a Jaccard similarity of at least `least`.  With all items in one order, the rarest
    first, two such sets share an item among the first n - ceil(least n) + 1 of each; only those are joined, and sizes must allow the
    threshold.  Overlaps are then counted item by item, no set is collected."""
    own = sets.select(F.col(id).alias("id"), F.col(item).alias("item")).dropna().distinct()
    often = own.groupBy("item").agg(F.count("*").alias("often"))
    sizes = own.groupBy("id").agg(F.count("*").alias("n"))
    # of an item that one set alone has, nothing can come
    placed = own.join(often.where("often > 1"), "item").join(sizes, "id")
    # the place of an item in its set: the alone ones come first
    alone = own.join(often.where("often = 1"), "item", "left_semi").groupBy("id").agg(F.count("*").alias("alone"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("often", "item"))
    prefix = placed.withColumn("nth", nth).join(alone, "id", "left").where(F.col("nth") + F.coalesce("alone", F.lit(0)) <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    side = lambda p: prefix.select("item", F.col("id").alias(p), F.col("n").alias(f"n_{p}"))
    fits = f"a < b and least(n_a, n_b) >= {least} * greatest(n_a, n_b) - 1e-9"
    pairs = side("a").join(side("b"), "item").where(fits).select("a", "b", "n_a", "n_b").distinct()
    both = pairs.join(own.select(F.col("id").alias("a"), "item"), "a").join(own.select(F.col("id").alias("b"), "item"), ["b", "item"])
    out = both.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("n_both"))
    return out.withColumn("jaccard", F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).where(F.col("jaccard") >= least).select("a", "b", "n_both", "jaccard")
