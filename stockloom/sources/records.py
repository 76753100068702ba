"""Records of JSON payloads as VARIANT values, and the small column forms that source mappings are written in.

A mapping is a dictionary of target column -> form.  A form is a JSON path, a list of paths (the first filled one counts), or a
function of the record's column.  A payload is parsed once; every path then reads the parsed value."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.sources.readers import to_common

Form = str | list[str] | Callable[[Column], Column]


def text(v: Column, *paths: str) -> Column:
    """The first of the paths that holds more than white space, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(F.try_variant_get(v, p, "string")), F.lit("")) for p in paths))


def number(v: Column, *paths: str) -> Column:
    return F.coalesce(*(text(v, p).try_cast("double") for p in paths))


def items(v: Column, path: str) -> Column:
    """The array at a path, or an empty one."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def entry(v: Column, path: str, key: str, wanted: str, value: str) -> Column:
    """Of an array of {key, value} objects, the value of the first whose key is the wanted one."""
    return text(F.get(F.filter(items(v, path), lambda x: text(x, key) == wanted), 0), value)


def first_url(v: Column, path: str, *inside: str) -> Column:
    """The first absolute address in an array of texts or of objects."""
    urls = F.transform(items(v, path), lambda x: text(x, *(inside or ("$",))))
    return F.get(F.filter(urls, lambda u: u.startswith("http")), 0)


def absolute(base: str, url: Column) -> Column:
    """A path on a site as an address; an address stays."""
    return F.when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url)


def joined(*parts: Column) -> Column:
    """The filled parts with spaces, null if there is none."""
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))


def labelled(value: Column, labels: dict[str, str], other: Column | None = None) -> Column:
    """The label of a value; of one without a label, `other` or the value itself."""
    known = reduce(lambda c, kv: c.when(value == kv[0], kv[1]), labels.items(), F.when(F.lit(False), ""))
    return known.otherwise(value if other is None else other)


def unbroken(c: Column) -> Column:
    """UTF-8 text that was read as Latin-1, read rightly; any other text as it is.  Stays in the JVM."""
    latin = F.encode(F.regexp_replace(c, r"[^\x00-\xFF]", "?"), "ISO-8859-1").cast("string")
    return F.when(~c.rlike(r"[^\x00-\xFF]") & F.is_valid_utf8(latin), latin).otherwise(c)


def between(c: Column, low: int, high: int) -> Column:
    return F.when(c.between(low, high), c)


def records(pages: DataFrame, *paths: str, payload: str = "payload") -> DataFrame:
    """A row with `r` for each record of the first path that holds an array; payloads that aren't JSON give none."""
    parsed = pages.withColumn("_v", F.try_parse_json(payload))
    found = F.coalesce(*(F.try_variant_get("_v", p, "array<variant>") for p in paths))
    return parsed.withColumn("r", F.explode(found)).drop("_v", payload)


def mapped(rows: DataFrame, schema: str, source: str, forms: dict[str, Form]) -> DataFrame:
    """Rows with a record `r` as the common schema."""
    r = F.col("r")
    columns = {n: f(r) if callable(f) else text(r, *([f] if isinstance(f, str) else f)) for n, f in forms.items()}
    names = {c.strip().split()[0]: c.strip().split(None, 1)[1] for c in schema.replace("(12,2)", "(12;2)").split(",")}
    cast = {n: c.try_cast(names[n].replace(";", ",")) for n, c in columns.items()}
    return to_common(rows, schema, source_key=F.lit(source), **cast)


def deep(pages: DataFrame, key: str, depth: int = 4, payload: str = "payload") -> DataFrame:
    """A row with `r` for each object that has the key, at most `depth` levels down, whatever its wrapper."""
    inside = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<variant>"))
    out = pages.withColumns({"_level": F.array(F.try_parse_json(payload)), "_found": F.array().cast("array<variant>")})
    for _ in range(depth + 1):
        out = out.withColumn("_found", F.concat("_found", F.filter("_level", lambda v: text(v, f"$.{key}").isNotNull()))).withColumn("_level", F.flatten(F.transform("_level", inside)))
    return out.withColumn("r", F.explode("_found")).drop("_level", "_found", payload)
