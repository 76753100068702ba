"""Exact top-k by inner product with pivot-table elimination (operator 10).

Vectors become integers floor(scale * x).  A table holds each vector's distances to many pivots; its rows are sorted by nearest
pivot and distance to it and cut into blocks, so a block's distances to every pivot lie in a narrow range [lo, hi].  By the
triangle inequality max over pivots of (d(q,p) - hi, lo - d(q,p)) is a lower bound of the distance from a query to all of a
block, and as <q,x> = (|q|^2 + |x|^2 - d(q,x)^2) / 2 it gives an upper bound of all its scores.  A query first searches its own block, whose
k-th best score is its floor.  Blocks whose bound lies below a query's floor are not sent to it at all.  In the others, groups of
`group` rows are evaluated in the order of their bounds, each by one matrix product for the queries that it can still
serve, until no bound reaches the k-th best.  The bests of all blocks are merged.

Bounds are taken for groups, not single rows: a row's bound costs as many steps as there are pivots, more than its score costs.
Pivots are a bounded, documented sample: `pivots` of the `sample` vectors with the smallest hashed ids, taken
farthest-first; they change the speed only, never the result.  On vectors without any structure (the test tables') hardly a
bound excludes anything, so nearly all pairs are evaluated; on clustered ones most blocks are never sent.

Cases: vectors that are null, hold null or non-finite components, or have a null vec_id take no part; empty vectors count as zeros; of different
lengths, the shorter counts as filled with zeros; a query's own row is never its candidate, while other rows that repeat its vec_id are, and
query rows that repeat a vec_id each get their rows; ties go to the smaller vec_id; scores beyond a long are held at its ends; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, groups_of, narrow

EXACT = 2.0**53


def whole(column, width: int, scale: float):
    """floor(scale * x) of an Arrow list column as a float64 matrix, filled with zeros to `width`."""
    import numpy as np

    sizes = np.diff(np.asarray(column.offsets))
    values = np.floor(scale * np.asarray(column.flatten(), np.float64))
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def farthest(points, count: int):
    """Farthest-first choice of pivots."""
    import numpy as np

    chosen, near = [0], None
    while len(chosen) < min(count, len(points)):
        d = np.sqrt(((points - points[chosen[-1]]) ** 2).sum(1))
        near = d if near is None else np.minimum(near, d)
        chosen.append(int(near.argmax()))
    return points[chosen]


def bounds(q_norm, q_far, lo, hi, norm, wide: float):
    """(queries, groups) upper bounds of the scores.  `wide` is the largest squared norm of a pivot, for the rounding of the distances."""
    import numpy as np

    gap = np.zeros((len(q_norm), len(norm)))
    for p in range(lo.shape[1]):
        np.maximum(gap, q_far[:, p, None] - hi[None, :, p], out=gap)
        np.maximum(gap, lo[None, :, p] - q_far[:, p, None], out=gap)
    both = q_norm[:, None] + norm[None]
    return (both - gap**2) / 2 + 1 + 1e-5 * (both + wide)


def ranges(far, norms, size: int):
    """(lo, hi, norm) of each group of `size` rows in a row."""
    import numpy as np

    at = np.arange(0, len(far), size)
    return np.minimum.reduceat(far, at), np.maximum.reduceat(far, at), np.maximum.reduceat(norms, at)


def best(q: dict, x: dict, k: int, group: int, wide: float) -> tuple:
    """(query index, row index, score) of at least the k best rows of every query, its own excepted; what lies below a
    query's floor, or surely below its k best, is left out.  q and x hold row, vec_id, v, far, norm; q has floor too."""
    import numpy as np

    v = x["v"].T
    if float(np.abs(q["v"]).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q["v"].shape[1]) >= EXACT:
        scores = np.clip(q["v"].astype(object) @ v.astype(object), -(2**63), 2**63 - 1).astype(object)
        found = [(i, j, int(scores[i, j])) for i in range(len(q["row"])) for j in sorted((j for j in range(v.shape[1]) if x["row"][j] != q["row"][i]), key=lambda j: (-int(scores[i, j]), x["vec_id"][j]))[:k]]
        return tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    upper = bounds(q["norm"], q["far"], *ranges(x["far"], x["norm"], group), wide)
    floor = q["floor"].copy()
    top = np.full((len(floor), k), -np.inf)
    hits = []

    def evaluate(rows, g):
        lo = g * group
        some = q["v"][rows] @ v[:, lo : lo + group]
        some[q["row"][rows, None] == x["row"][None, lo : lo + group]] = -np.inf
        i, j = np.nonzero((some >= floor[rows, None]) & (some > -np.inf))
        if len(i):
            hits.append((rows[i], lo + j, some[i, j]))
            new = np.unique(i)
            now = np.partition(np.concatenate([top[rows[new]], some[new]], 1), -k, axis=1)[:, -k:]
            top[rows[new]] = now
            floor[rows[new]] = np.maximum(floor[rows[new]], now[:, 0])

    first = upper.argmax(1)
    for g in np.unique(first):
        evaluate(np.flatnonzero((first == g) & (upper[:, g] >= floor)), g)
    for g in np.argsort(-upper.max(0), kind="stable"):
        evaluate(np.flatnonzero((first != g) & (upper[:, g] >= floor)), g)
    if not hits:
        return (np.zeros(0, np.int64),) * 3
    i, j, s = (np.concatenate(c) for c in zip(*hits, strict=True))
    near = s >= floor[i]
    i, j, s = i[near], j[near], s[near]
    order = np.lexsort((x["vec_id"][j], -s, i))
    i, j, s = i[order], j[order], s[order]
    few = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[few], j[few], s[few].astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, pivots: int = 48, sample: int = 2048, block: int = 4096, queries: int = 4096, group: int = 64, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: the k best other rows of every row for which is_query (over vec_id) holds."""
    found = search(vectors, is_query, k, scale, pivots, sample, block, queries, group, seed)[0]
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, k: int, scale: float, pivots: int, sample: int, block: int, queries: int, group: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(query, query_id, vec_id, score) of the bests of every block that was sent to a query; and the blocks sent (query, i)."""
    import numpy as np

    tables = Tables(vectors.sparkSession)
    ok = F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = narrow(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.coalesce(ok, F.lit(False)))
    rows = rows.withColumn("asks", F.coalesce(is_query, F.lit(False)))
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if("asks").alias("q"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    drawn = [r["v"] for r in rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).collect()]
    width = max(1, shape["width"] or 1)
    kind = "<i4" if scale * (shape["most"] or 0) < 2**31 - 2 else "<f8"
    points = np.zeros((max(1, len(drawn)), width))
    for i, v in enumerate(drawn):
        points[i, : len(v)] = np.floor(scale * np.array(v))
    chosen = farthest(points, pivots)
    wide, asked = float((chosen**2).sum(1).max()), max(1, -(-(shape["q"] or 0) // queries))
    fields = "vec_id long, asks boolean, x binary, far binary, norm double"

    def table(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(batch.column(1), width, scale)
            norm = (x * x).sum(1)
            far = np.stack([((x - p) ** 2).sum(1) for p in chosen], 1) ** 0.5
            near = far.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(far[np.arange(len(x)), near]), batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array([r.tobytes() for r in far.astype("<f4")], pa.binary()), pa.array(norm)], ["nearest", "near", "vec_id", "asks", "x", "far", "norm"])

    def opened(part) -> dict:
        one = lambda c: np.asarray(part[c])
        far = np.frombuffer(b"".join(part["far"].to_pylist()), "<f4").reshape(part.num_rows, -1).astype(np.float64)
        return {"row": one("row"), "vec_id": one("vec_id"), "norm": one("norm"), "far": far, "v": np.frombuffer(b"".join(part["x"].to_pylist()), kind).reshape(part.num_rows, width).astype(np.float64)}

    def blocks(batches):
        """Sorted rows, cut into blocks and numbered; a query's floor is the k-th best score of its block."""
        import pyarrow as pa
        from pyspark import TaskContext

        held, base, done = [], TaskContext.get().partitionId() << 36, 0

        def one(part):
            n = part.num_rows
            part = part.append_column("row", pa.array(base + done + np.arange(n)))
            x, floor = opened(part), np.full(n, -np.inf)
            if len(ask := np.flatnonzero(np.asarray(part["asks"]))):
                q = {c: v[ask] for c, v in x.items()} | {"floor": np.full(len(ask), -np.inf)}
                i, _, s = best(q, x, k, group, wide)
                full = np.flatnonzero(np.bincount(i, minlength=len(ask)) == k)
                low = np.full(len(ask), np.inf)
                np.minimum.at(low, i, s)
                floor[ask[full]] = low[full]
            out = pa.table([pa.array(np.full(n, base + done)), *(part[c] for c in ("row", "vec_id", "asks", "x", "far", "norm")), pa.array(floor)], names=["i", "row", "vec_id", "asks", "x", "far", "norm", "floor"])
            yield from out.to_batches(max_chunksize=1024)

        for batch in batches:
            part = pa.Table.from_batches([batch]).select(["vec_id", "asks", "x", "far", "norm"])
            held.append(part)
            while sum(t.num_rows for t in held) >= block:
                all_ = pa.concat_tables(held)
                yield from one(all_.slice(0, block).combine_chunks())
                held, done = [all_.slice(block)], done + block
        if held and sum(t.num_rows for t in held):
            yield from one(pa.concat_tables(held).combine_chunks())

    sort = ["nearest", "near", "vec_id"]
    known = rows.select("vec_id", "v", "asks").mapInArrow(table, f"nearest int, near double, {fields}").repartitionByRange(*sort).sortWithinPartitions(*sort)
    known = tables.keep(known.mapInArrow(blocks, f"i long, row long, {fields}, floor double"), "pivots")

    def summary(batches):
        import pyarrow as pa

        for (i,), part in groups_of(batches, ["i"]):
            lo, hi, norm = ranges(np.frombuffer(b"".join(part["far"].to_pylist()), "<f4").reshape(part.num_rows, -1), np.asarray(part["norm"]), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([lo.tobytes()], pa.binary()), pa.array([hi.tobytes()], pa.binary()), pa.array(norm)], ["i", "lo", "hi", "norm"])

    asks = known.where("asks").withColumn("j", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(asked)).cast("int"))
    of_block = tables.keep(known.select("i", "far", "norm").mapInArrow(summary, "i long, lo binary, hi binary, norm double"), "blocks")
    chunks = max(1, -(-(shape["n"] or 0) // block // 1024))
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("binary")
    one = of_block.select(F.pmod(F.xxhash64("i"), F.lit(chunks)).cast("int").alias("c"), many(asked).alias("j"), F.lit(0).alias("role"), "i", "lo", "hi", "norm", F.lit(0.0).alias("floor"))
    two = asks.select(many(chunks).alias("c"), "j", F.lit(1).alias("role"), F.col("row").alias("i"), F.col("far").alias("lo"), none.alias("hi"), "norm", "floor")

    def served(batches):
        """The blocks that can serve each query."""
        import pyarrow as pa

        for (_, j), part in groups_of(batches, ["c", "j"]):
            role = np.asarray(part["role"])
            own, ask = part.filter(pa.array(role == 0)), part.filter(pa.array(role == 1))
            if not own.num_rows or not ask.num_rows:
                continue
            far, lo, hi = (np.frombuffer(b"".join(t[c].to_pylist()), "<f4").reshape(t.num_rows, -1).astype(np.float64) for t, c in ((ask, "lo"), (own, "lo"), (own, "hi")))
            floor = np.asarray(ask["floor"])
            for at in range(0, ask.num_rows, 512):
                upper = bounds(np.asarray(ask["norm"])[at : at + 512], far[at : at + 512], lo, hi, np.asarray(own["norm"]), wide)
                q, b = np.nonzero(upper >= floor[at : at + 512, None])
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(ask["i"])[at + q]), pa.array(np.asarray(own["i"])[b]), pa.array(np.full(len(q), j), pa.int32())], ["query", "i", "j"])

    keys = ["c", "j"]
    sent = tables.keep(one.union(two).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(served, "query long, i long, j int").distinct(), "sent")
    to = sent.select(F.col("i").alias("to"), F.col("j").alias("_j"), "query")
    role = lambda n: F.lit(n).alias("role")
    questions = asks.join(to, F.col("row") == F.col("query")).select(F.col("to").alias("i"), "j", role(1), "row", "vec_id", "x", "far", "norm", "floor")
    answers = known.join(to.select("to", "_j").distinct(), F.col("i") == F.col("to")).select("i", F.col("_j").alias("j"), role(0), "row", "vec_id", "x", "far", "norm", "floor")

    def answer(batches):
        import pyarrow as pa

        for _, cell in groups_of(batches, ["i", "j"]):
            role = np.asarray(cell["role"])
            own, ask = (cell.filter(pa.array(role == n)) for n in (0, 1))
            if not own.num_rows or not ask.num_rows:
                continue
            q, x = opened(ask) | {"floor": np.asarray(ask["floor"])}, opened(own)
            n, m, s = best(q, x, k, group, wide)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (q["row"][n], q["vec_id"][n], x["vec_id"][m], s)], ["query", "query_id", "vec_id", "score"])

    keys = ["i", "j"]
    cells = answers.union(questions).repartition(*keys).sortWithinPartitions(*keys, "role", "row")
    return cells.mapInArrow(answer, "query long, query_id long, vec_id long, score long"), sent
