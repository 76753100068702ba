"""Vectors as short codes of codebook indexes, fitted by Lloyd's rounds with Hamerly's bounds (operator 12).

Each component becomes the integer floor(scale * x).  A vector is cut into equal parts, and each part position has a codebook.  The rows
are written once a round with their state: for each part the index of its entry, one upper bound of the distance to
it, and one lower bound of the distance to the second-nearest entry.  When entries move, the bounds move with them; a part is scanned
against all entries only when its upper bound, tightened by one exact distance, is not strictly below its lower bound.  Equality
therefore scans, so ties always end at the lower index.  Bounds are whole numbers, rounded outwards after integer square roots,
so no rounding can skip a scan that is needed.

Tasks emit one row of sums for each entry of each codebook; these are added up by Spark, and the driver holds nothing but the codebooks, whose size
is fixed by the parameters.  A round's table replaces the one before it in the shared folder, so lost executors cost a task and not a round.

Cases: rows whose vector is null or holds null or non-finite components are dropped, as the contract says; null vec_ids come last
in the order of the first entries, and repeated vec_ids are ordered by their vectors; fewer kept rows than entries make smaller
codebooks; components are held within +-2^26 (x within +-16,384 at scale 4,096), so sums of squares stay exact; a vector whose length is not
that of the first kept one, or not a multiple of the number of parts, takes no part and has null code and errors; null labels
are one label; an empty table gives no rows; extra columns are not read."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, narrow, spread_join

LIMIT = 1 << 26
STATE = "vec_id long, label string, x array<int>, code array<int>, upper array<long>, lower array<long>"


def root_down(n):
    """Exact floor of the square root of non-negative longs."""
    import numpy as np

    r = np.sqrt(n.astype(np.float64)).astype(np.int64)
    r -= r * r > n
    return r + ((r + 1) * (r + 1) <= n)


def root_up(n):
    r = root_down(n)
    return r + (r * r < n)


def scan(x, entries):
    """Index of the nearest entry (the lower one of equals), its squared distance, and that of the second-nearest, of each row of x."""
    import numpy as np

    d = ((x * x).sum(1)[:, None] - 2 * (x @ entries.T)) + (entries * entries).sum(1)[None, :]
    at, rows = d.argmin(1), np.arange(len(x))
    near = d[rows, at]
    if len(entries) == 1:
        return at, near, np.full(len(x), np.iinfo(np.int64).max >> 2)
    d[rows, at] = np.iinfo(np.int64).max
    return at, near, d.min(1)


def assign(x, code, upper, lower, entries, moved):
    """New code, upper and lower bounds of one part of each row after its codebook moved, and how many rows were scanned in full.
    `moved` is the upper bound of each entry's way; code is None in the first round."""
    import numpy as np

    if code is None:
        at, near, second = scan(x, entries)
        return at.astype(np.int32), root_up(near), root_down(second), len(x)
    code, upper = code.copy(), upper + moved[code]
    # the farthest way of any entry but the own one
    far = int(moved.argmax())
    second = int(np.delete(moved, far).max(initial=0))
    lower = lower - np.where(code == far, second, moved[far])
    fails = np.flatnonzero(upper >= lower)
    if len(fails):
        off = x[fails] - entries[code[fails]]
        upper[fails] = root_up((off * off).sum(1))
        fails = fails[upper[fails] >= lower[fails]]
    if len(fails):
        at, near, other = scan(x[fails], entries)
        code[fails], upper[fails], lower[fails] = at, root_up(near), root_down(other)
    return code, upper, lower, len(fails)


def lists(column, kind):
    """An Arrow list column of equally long lists as a matrix."""
    import numpy as np

    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(len(column), -1)


def assigned(rows: DataFrame, books, moved, parts: int) -> DataFrame:
    """The rows with their state under the codebooks (parts x entries x components)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def as_list(m, kind):
            return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel(), kind))

        for batch in batches:
            if not batch.num_rows:
                continue
            x = lists(batch.column(2), np.int64).reshape(batch.num_rows, parts, -1)
            old = None if moved is None else [lists(batch.column(i), np.int64) for i in (3, 4, 5)]
            out = [assign(x[:, p], *((o[:, p] for o in old) if old else (None, None, None)), books[p], None if moved is None else moved[p])[:3] for p in range(parts)]
            code, upper, lower = (np.stack(c, 1) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], as_list(code, pa.int32()), as_list(upper, pa.int64()), as_list(lower, pa.int64())], ["vec_id", "label", "x", "code", "upper", "lower"])

    return rows.mapInArrow(run, STATE)


def entry_sums(state: DataFrame, parts: int, entries: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry): how many parts have it and the sums of their components, added up in tasks and then by Spark."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total, count = None, np.zeros(parts * entries, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = lists(batch.column(0), np.int64).reshape(batch.num_rows * parts, -1)
            slot = (lists(batch.column(1), np.int64) + np.arange(parts) * entries).ravel()
            order = np.argsort(slot, kind="stable")
            some, begins = np.unique(slot[order], return_index=True)
            total = np.zeros((parts * entries, x.shape[1]), np.int64) if total is None else total
            total[some] += np.add.reduceat(x[order], begins, axis=0)
            count += np.bincount(slot, minlength=parts * entries)
        for slot in np.flatnonzero(count).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([count[slot]], pa.int64()), pa.array([total[slot].tolist()], pa.list_(pa.int64()))], ["slot", "n", "sums"])

    rows = state.select("x", "code").mapInArrow(run, "slot int, n long, sums array<long>")
    by_component = rows.select("slot", "n", F.posexplode("sums").alias("k", "s")).groupBy("slot", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sorted(by_component.collect()):  # parts x entries x components rows
        out.setdefault(divmod(r["slot"], entries), (r["n"], []))[1].append(r["s"])
    return out


def fit(rows: DataFrame, first, parts: int, rounds: int, tables: Tables):
    """The rows with their final state, and the codebooks; `first` has the first entries (entries x components)."""
    import numpy as np

    books = np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2))
    state, moved = tables.keep(assigned(rows, books, None, parts), "state"), None
    for _ in range(rounds):
        new = books.copy()
        for (part, entry), (n, sums) in entry_sums(state, parts, len(first)).items():
            new[part, entry] = [s // n for s in sums]
        moved, books = root_up(((new - books) ** 2).sum(2)), new
        before = state
        state = tables.keep(assigned(before, books, moved, parts), "state")
        tables.drop(before)
    return state, books


def errors(state: DataFrame, books, parts: int) -> DataFrame:
    """vec_id, label, code (hex) and error of each row."""
    digits = max(2, len(f"{books.shape[1] - 1:x}"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x, code = lists(batch.column(2), np.int64).reshape(batch.num_rows, parts, -1), lists(batch.column(3), np.int64)
            off = x - books[np.arange(parts), code]
            names = ["".join(f"{c:0{digits}x}" for c in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names, pa.string()), pa.array((off * off).sum((1, 2)), pa.int64())], ["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of vectors (vec_id, embedding, label)."""
    import numpy as np

    tables = Tables(vectors.sparkSession)
    rows = narrow(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    rows = rows.where("v is not null").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = F.transform("v", lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.greatest(F.lit(-1e300), F.least(F.lit(1e300), x)) * scale))).cast("int"))
    rows = tables.keep(rows.select("vec_id", "label", whole.alias("x")), "rows")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    dim = len(first[0]["x"]) if first else 0
    if not dim or dim % parts:
        none = F.lit(None)
        return rows.select("vec_id", none.cast("string").alias("code"), none.cast("long").alias("error"), none.cast("long").alias("label_error"), none.cast("string").alias("codebooks_sha256"))
    fits = F.size("x") == dim
    first = rows.where(fits).orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    state, books = fit(rows.where(fits), np.array([r["x"] for r in first], np.int64), parts, rounds, tables)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = errors(state, books, parts)
    coded = tables.keep(coded.union(rows.where(~fits).select("vec_id", "label", F.lit(None).cast("string"), F.lit(None).cast("long"))), "coded")
    tables.drop(state, rows)
    of = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = spread_join(coded, of, F.col("label").eqNullSafe(F.col("_label")), F.struct("vec_id", "code"), "left")
    return out.select("vec_id", "code", "error", F.when(F.col("code").isNotNull(), F.col("label_error")).alias("label_error"), F.when(F.col("code").isNotNull(), F.lit(digest)).alias("codebooks_sha256"))
