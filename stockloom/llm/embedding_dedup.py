"""Embedding near-dedup by sorted projection passes (operator 3).

Equal vectors of a label are collapsed to one class with a number of its own, so rows that share a vec_id never share a class.  Each
pass orders the classes of a label lexicographically by their concatenated random hyperplane hashes; range-sorted partitions are
streamed, and each class is compared with the `window` classes before it; the rows at a partition's borders are compared across it.  The
passes carry no vectors: a class travels as a sketch of 256 hyperplane signs, and two classes are candidates when their sketches differ
in so few bits as a cosine of `least` leaves but for a chance of 3 in a million (`sketch_radius`).  Candidate pairs are united over all
passes.  Then the vectors are shuffled once, to the cells of their candidate component, where every two classes are compared by cosine
in double precision: these links alone are counted and united to components.  A pair is missed only if no pass and no chain
of candidates connects it; with 24 passes and windows of 64 it was no pair at all of check_s and check_h.

Cases: null labels, null, empty and zero vectors and those with null or non-finite components link with nothing, as do
vectors of different lengths; vectors are read as doubles, and scaled by their largest component before they are multiplied, so neither huge nor
tiny ones are lost; rows with a null vec_id take no part (no component, not kept); rows that repeat a vec_id are vectors of their
own, linked by their own values; an empty table gives no rows; extra columns are not read."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, Union, components, groups_of, in_chunks, narrow

PASSES, BITS, WINDOW, SKETCH = 24, 30, 64, 256


def sketch_radius(least: float, bits: int = SKETCH) -> int:
    """Most signs in which two vectors of cosine `least` differ: the mean and 4.5 standard deviations."""
    p = math.acos(least) / math.pi
    return math.ceil(bits * p + 4.5 * math.sqrt(bits * p * (1 - p)))


def matrix(column):
    """Rows of equal length of an Arrow list column as a float64 matrix scaled to length 1."""
    import numpy as np

    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    x = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hashed(classes: DataFrame, passes: int, bits: int, seed: int) -> DataFrame:
    """The classes with a sort key for each pass and a sketch, from the signs of random hyperplanes by dimension."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                planes = np.random.default_rng([seed, dim]).standard_normal((dim, passes * bits + SKETCH))
                signs = matrix(part.column(5)) @ planes > 0
                keys = (signs[:, : passes * bits].reshape(-1, passes, bits) * (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).sum(2)
                sketch = np.packbits(signs[:, passes * bits :], axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(list(c), pa.list_(pa.int64())) for c in (keys, sketch))], [*part.schema.names, "keys", "sketch"])

    own = classes.select("id", "label", "dim", "copies", "vec", "v")
    return own.mapInArrow(run, "id long, label string, dim int, copies long, vec long, v array<double>, keys array<long>, sketch array<long>")


def windows(rows: DataFrame, keys: list[str], window: int, radius: int, borders: bool) -> DataFrame:
    """Sorted rows to candidate pairs (kind 0: a, b), one for each union inside a run; with `borders` also the first
    (kind 1) and last (kind 2) `window` rows of each partition."""
    shape = "kind int, pid int, a long, b long, pass int, label string, dim int, key long, sketch array<long>"

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        pid, schema = TaskContext.get().partitionId(), pa.schema([("kind", pa.int32()), ("pid", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("pass", pa.int32()), ("label", pa.string()), ("dim", pa.int32()), ("key", pa.int64()), ("sketch", pa.list_(pa.int64()))])

        def border(kind, table):
            n = table.num_rows
            return pa.table([pa.array([kind] * n, pa.int32()), pa.array([pid] * n, pa.int32()), table["id"], pa.nulls(n, pa.int64()), table["pass"], table["label"], table["dim"], table["key"], table["sketch"]], schema=schema).to_batches()

        tail, seen = None, 0
        for batch in batches:
            now = pa.Table.from_batches([batch])
            if borders and seen < window:
                yield from border(1, now.slice(0, window - seen))
            seen += now.num_rows
            both = now if tail is None else pa.concat_tables([tail, now])
            old = 0 if tail is None else tail.num_rows
            ids = np.asarray(both["id"])
            cut = np.zeros(len(ids), bool)
            for k in keys:
                c = np.asarray(both[k])
                cut[1:] |= c[1:] != c[:-1]
            edges, found = [0, *np.flatnonzero(cut).tolist(), len(ids)], []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi - lo < 2 or hi <= old:
                    continue
                x, union = np.asarray(both["sketch"].slice(lo, hi - lo).combine_chunks().flatten()).view(np.uint64).reshape(hi - lo, -1), Union()
                for at in range(max(0, old - lo), hi - lo, 256):
                    end, begin = min(at + 256, hi - lo), max(0, at - window)
                    i, j = np.nonzero(np.bitwise_count(x[at:end, None] ^ x[None, begin:end]).sum(2, dtype=np.int32) <= radius)
                    i, j = i + at, j + begin
                    near = (j < i) & (i - j <= window)
                    for p, q in zip(ids[lo + i[near]].tolist(), ids[lo + j[near]].tolist(), strict=True):
                        if p != q and union.join(p, q):
                            found.append((p, q))
            if found:
                n, (a, b) = len(found), zip(*found, strict=True)
                yield from pa.table([pa.array([0] * n, pa.int32()), pa.array([pid] * n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(n, f.type) for f in list(schema)[4:])], schema=schema).to_batches()
            tail = both.slice(max(0, both.num_rows - window)).combine_chunks()
        if borders and tail is not None:
            yield from border(2, tail)

    return rows.mapInArrow(run, shape)


def exact_links(members: DataFrame, least: float, most: int, tables: Tables) -> DataFrame:
    """Of every two classes of a component, by their cosine: rows of kind 0 (a, to how many other vectors class a is linked, copies counted), and of
    kind 1 (a, b), a spanning forest of the links in a cell."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, cell in groups_of(batches, ["component", "i", "j"]):
            ids, role, copies, x = np.asarray(cell["id"]), np.asarray(cell["role"]), np.asarray(cell["copies"]), matrix(cell["v"])
            alone, union = cell["i"][0] == cell["j"][0], Union()
            one = np.arange(len(ids)) if alone else np.flatnonzero(role == 0)
            two = one if alone else np.flatnonzero(role == 1)
            near = x[one] @ x[two].T >= least
            if alone:
                np.fill_diagonal(near, False)
                counts = [(ids, near @ copies)]
            else:
                counts = [(ids[one], near @ copies[two]), (ids[two], copies[one] @ near)]
            for p, q in zip(*np.nonzero(np.triu(near) if alone else near), strict=True):
                union.join(int(ids[one[p]]), int(ids[two[q]]))
            links = union.links()
            a, b = ([x[0] for x in links], [x[1] for x in links])
            for kind, c, d in [*((0, *c) for c in counts), (1, a, b)]:
                if len(c):
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(c), pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.int64())], ["kind", "a", "b"])

    keys = ["component", "i", "j"]
    cells = in_chunks(members, ["component"], "id", most, tables)
    return cells.repartition(*keys).sortWithinPartitions(*keys, "role", "id").mapInArrow(run, "kind int, a long, b long")


def near_duplicates(vectors: DataFrame, least: float = 0.98, passes: int = PASSES, bits: int = BITS, window: int = WINDOW, most: int = 2048, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    tables, radius = Tables(vectors.sparkSession), sketch_radius(least)
    rows = narrow(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False)))
    rows = rows.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("v")), "h2": F.when(F.col("ok"), F.hash("v", F.size("v")))})
    classes = rows.where("ok").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("vec"), F.min("v").alias("v"), F.count("*").alias("copies"))
    # the numbers are fixed once the table is written
    numbered = classes.select(F.monotonically_increasing_id().alias("id"), "label", F.size("v").alias("dim"), "copies", "vec", "v")
    classes = tables.keep(hashed(numbered, passes, bits, seed), "classes")
    sort = ["pass", "label", "dim", "key", "id"]
    passed = classes.select(F.posexplode("keys").alias("pass", "key"), "label", "dim", "id", "sketch").select(*sort, "sketch")
    found = tables.keep(windows(passed.repartitionByRange(*sort).sortWithinPartitions(*sort), sort[:3], window, radius, True), "found")
    parts = sorted(r["pid"] for r in found.where("kind = 1").select("pid").distinct().collect())
    across = F.create_map(*(F.lit(v) for i, p in enumerate(parts) for v in (p, i))) if parts else F.lit(None)
    edge = found.where("kind > 0").select((across[F.col("pid")] - F.when(F.col("kind") == 1, 1).otherwise(0)).alias("border"), "pass", "label", "dim", "key", F.col("a").alias("id"), "sketch") if parts else None
    pairs = found.where("kind = 0").select("a", "b")
    if edge is not None:
        pairs = pairs.union(windows(edge.repartition("border").sortWithinPartitions("border", *sort), ["border", *sort[:3]], window, radius, False).select("a", "b"))
    candidates = tables.keep(components(pairs, tables), "candidates")
    links = tables.keep(exact_links(classes.join(candidates, F.col("id") == F.col("node")).select("component", "id", "copies", "v"), least, most, tables), "links")
    tables.drop(found, candidates)
    counts = links.where("kind = 0").groupBy(F.col("a").alias("_id")).agg(F.sum("b").alias("links"))
    linked = tables.keep(components(links.where("kind = 1").select("a", "b"), tables), "linked")
    # a class's component is known by the smallest vec_id of its classes
    placed = classes.select("id", "label", "copies", "vec", "v").join(linked, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id")).drop("node")
    least_id = placed.groupBy(F.col("component").alias("_component")).agg(F.min("vec").alias("component_id"))
    # a class's own rows find it by its two hashes, computed anew from the vector of the class
    of = placed.join(least_id, F.col("component") == F.col("_component")).join(counts, F.col("id") == F.col("_id"), "left")
    of = of.select(F.col("label").alias("_label"), F.xxhash64("v").alias("_h1"), F.hash("v", F.size("v")).alias("_h2"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.select("vec_id", "label", "h1", "h2").join(of, (F.col("label") == F.col("_label")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
