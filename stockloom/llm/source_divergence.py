"""Divergence of each source's words from its language and from the language's other sources (operator 13).

Terms are counted by (lang, source, term) with the number of documents that hold them, so a text's terms are summed before the
shuffle.  Each kept term of a language is then one wide row: its counts in an array indexed by the language's sources.
Higher-order functions turn the counts into probabilities in whole billionths and emit one contribution for each pair of
sources; partial aggregation sums them inside the tasks, so a task shuffles at most one row for each pair.  All arithmetic is in
longs and decimals.

Size: a term's array and the pairs grow with the sources of one language and their square, as the result itself does (it ranks
every two sources); the tables of sources are joined, not broadcast, with their rows dealt over tasks.  A term's sums
overflow a long, and so raise an error, beyond 9e18 occurrences; the probabilities are exact up to there.

Cases: null text, lang and source count as ''; texts that are null, empty or without a term count for their group, which is
listed even so; rows that repeat are documents each, whatever their doc_id; equal values rank by item in UTF-8 order; a language
with one source has no `pair` row, one without kept terms has value 0 in each pair and no `term` row; an empty table gives no
rows; extra columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, narrow, spread_join

#: What parts two terms, characters besides A-Z that may have a lower case, and the two cases of the letters that are folded.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
OTHER_CAPITALS = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and documents (that hold the term)."""
    # translate looks at every character; lower does the same where no other capital (or letter-like sign) can change
    others = F.coalesce(F.col("text").rlike(OTHER_CAPITALS), F.lit(False))
    folded = F.when(others, F.translate("text", UPPER, LOWER)).otherwise(F.lower("text"))
    sorted_terms = docs.select("lang", "source", F.sort_array(F.split(folded, BETWEEN)).alias("t"))
    # in a sorted text the first of equal terms is the one that differs from the term before; an outer generator spares
    # a filter on the array's size that would split and sort every text again
    placed = sorted_terms.select("lang", "source", "t", F.posexplode_outer("t").alias("i", "term")).where("term <> ''")
    rows = placed.select("lang", "source", "term", F.when((F.col("i") > 0) & (F.get("t", F.col("i") - 1) == F.col("term")), 0).otherwise(1).alias("first"))
    return rows.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("documents"))


def share(n: str, total: str, smoothing: int) -> str:
    """SQL of the smoothed share in whole billionths, from 1, of a count n of `total` over `terms` terms."""
    return f"1 + (cast({n} + {smoothing} as decimal(20, 0)) * 1000000000BD) div cast({total} + {smoothing} * terms as decimal(20, 0))"


def divergence(docs: DataFrame, least_documents: int = 30, smoothing: int = 5, top: int = 50) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank: how far the shares of a language's frequent terms in one source are from
    those in each other source, and the terms that a source has more of than its language."""
    tables = Tables(docs.sparkSession)
    own = narrow(docs, "text", "lang", "source").select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    by_lang = Window.partitionBy("lang").orderBy("source")
    groups = tables.keep(own.groupBy("lang", "source").agg(F.count("*").alias("rows")).withColumn("at", F.row_number().over(by_lang) - 1).select("lang", "source", "at"), "groups")

    # one row a kept term: its counts by source
    counts = term_counts(own)
    kept = counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    kept = tables.keep(kept.where(F.col("documents") >= least_documents).select("lang", "term", "n", "by_source"), "kept")
    sums = kept.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    group = groups.join(sums, ["lang", "source"], "left").join(whole, "lang", "left").select("lang", "source", "at", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")))
    group = tables.keep(group, "group")

    sources = group.groupBy(F.col("lang").alias("_lang")).agg(F.sort_array(F.collect_list(F.struct("at", "source", "total"))).alias("sources"), F.first("terms").alias("terms"), F.first("lang_total").alias("lang_total"))
    wide = spread_join(kept, sources, F.col("lang") == F.col("_lang"), F.col("term"))
    counted = F.transform("sources", lambda s: F.struct(F.coalesce(F.element_at("by_source", s["source"]), F.lit(0)).alias("n"), s["total"].alias("total")))
    shares = F.expr(f"transform(counted, s -> {share('s.n', 's.total', smoothing)})")
    of_lang = F.expr(share("n", "lang_total", smoothing))
    wide = wide.withColumn("counted", counted).select("lang", "term", "sources", F.transform("counted", lambda s: s["n"]).alias("counts"), shares.alias("shares"), of_lang.alias("of_lang"))
    wide = tables.keep(wide, "wide")

    # pairs: i < j, mirrored after the sums
    pairs = F.flatten(F.transform("shares", lambda p, i: F.transform(F.slice("shares", i + 2, F.size("shares")), lambda q, k: F.struct(i.alias("i"), (i + k + 1).alias("j"), F.abs(p - q).alias("f")))))
    summed = wide.select("lang", F.inline(pairs)).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    both = summed.select("lang", F.inline(F.array(F.struct("i", "j", "value"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "value"))))
    others = group.select("lang", F.col("source").alias("item"), F.col("at").alias("j"))
    every = group.select("lang", "source", F.col("at").alias("i")).join(others, "lang").where("i <> j")
    pair = every.join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    more = F.filter(F.zip_with("sources", F.arrays_zip("counts", "shares"), lambda s, c: F.struct(s["source"].alias("source"), c["counts"].alias("n"), c["shares"].alias("p"))), lambda x: x["n"] > 0)
    term = wide.select("lang", "of_lang", F.col("term").alias("item"), F.inline(more)).where("p > of_lang").select("lang", "source", F.lit("term").alias("part"), "item", (F.col("p") - F.col("of_lang")).alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pair.withColumn("rank", place).union(term.withColumn("rank", place).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
