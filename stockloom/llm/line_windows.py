"""Line dedup by overlapping three-line windows (operator 6, DataFrame functions only).

A text's lines are its parts between line feeds, trimmed of spaces, tabs and carriage returns for comparison; blank lines are
passed over.  Every three consecutive lines make a window, known by two hashes.  Of windows that occur more than once anywhere,
all but the first occurrence (by doc_id, then position) mark their three lines; marked positions of a document are
merged and those lines go, with everything else left as it was.

The windows are aggregated before any join (map-side), only repeated ones are joined back, and AQE can split a hot one.
The texts are shuffled once, to meet their marked lines.

Cases: null texts stay null, and texts with under three lines that aren't blank are untouched; a text all of whose lines go
becomes empty; rows that repeat both doc_id and text count as one document; of rows that repeat the doc_id alone, a hash of the text decides which is first; rows with a null doc_id
come last; an empty table gives no rows; only the named columns are read, so others may have clashing names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, narrow


def windows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row, at (the window's place), lines (line numbers covered), h1, h2."""
    numbered = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(" \t\r")).alias("t"))), lambda p: p["t"] != "")
    hashed = F.transform(numbered, lambda p: F.struct(p["i"].alias("i"), F.xxhash64(p["t"]).alias("x"), F.hash(p["t"]).alias("y")))
    wide = docs.select("doc_id", "row", hashed.alias("p")).where(F.size("p") >= width)
    starts = F.transform(F.sequence(F.lit(1), F.size("p") - width + 1), lambda k: F.slice("p", k, width))
    each = wide.select("doc_id", "row", F.posexplode(starts).alias("at", "w"))
    part = lambda f: F.transform("w", lambda p: p[f])
    return each.select("doc_id", "row", "at", part("i").alias("lines"), F.xxhash64(part("x")).alias("h1"), F.hash(part("y")).alias("h2"))


def marked(docs: DataFrame, width: int, tables: Tables) -> DataFrame:
    """doc_id, row and the line numbers that go."""
    found = windows(docs, width)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "at")
    many = found.select("h1", "h2", place.alias("place")).groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    many = tables.keep(many.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("first.doc_id").alias("_doc"), F.col("first.row").alias("_row"), F.col("first.at").alias("_at")), "repeated")
    later = found.join(many, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).where("not (row = _row and at = _at and doc_id <=> _doc)")
    return later.groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))


def dedup_documents(docs: DataFrame, width: int = 3, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The named columns of docs with the lines gone from text, and lines (all, blank ones too) and removed_lines."""
    tables, docs = Tables(docs.sparkSession), narrow(docs, *columns)
    row = F.xxhash64("doc_id", "text")
    gone = tables.keep(marked(narrow(docs, "doc_id", "text").select("doc_id", row.alias("row"), "text"), width, tables), "gone")
    # merged at every size: the marked documents grow with the input
    both = docs.withColumn("_row", row).join(gone.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_at"), "gone").hint("merge"), (F.col("_row") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    cleaned = both.withColumn("_lines", lines).withColumn("text", text)
    return cleaned.select(*docs.columns, F.coalesce(F.size("_lines"), F.lit(0)).alias("lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed_lines"))


def drop_repeated_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs without the repeated lines, n_chars counted anew; documents with nothing left but white space through it go."""
    out = dedup_documents(docs, width, tuple(docs.columns))
    left = out.where("removed_lines = 0 or text rlike '[^ \\\\t\\\\r\\\\n]'")
    return left.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)
