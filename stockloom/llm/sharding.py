"""Sharding by balanced label propagation (operator 1).

Documents with equal texts are linked.  They start spread evenly over the shards; then every group asks, round by round, to move
its documents to the open shard where most of their neighbours already are, and each shard grants moves, largest
gain first, up to its quota.  Groups that are still cut then are laid whole in the room that is left; one stays cut only where no shard can hold it.  Documents of one group in one shard are interchangeable, so a group is
one row with its documents in each shard, whatever its size.  Of the moves from one shard to another those before some group in the order of gain and key are granted: a
round looks for that group in histograms, so rows are rewritten where they lie and neither joined nor sorted.  Documents without links fill the room
that is left, so the row counts of any two shards differ by one at most (law `rows`).

Cases: null texts are not linked, size 8, CRC 0; empty texts are equal texts; documents that repeat a doc_id keep
their rows; more shards than documents leaves some empty; an empty table gives no rows; extra columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, narrow, running_totals, spread_join


#: Rows that a task writes, groups that a task of a round reads (by batches), and rows of one gain that a round looks through without a histogram of their keys.
ROWS, GROUPS, LEVEL = 1 << 14, 1 << 16, 1 << 16
LEAST = -(2**63)


def asks(n, tie, open_):
    """The cells that ask to move (their group, their shard), the shard they wish for and their group's documents there, of groups with n[g, s]
    documents in each shard.  Of equal shards the tie decides."""
    import numpy as np

    k = n.shape[1]
    rank = np.where(n > 0, (n * k + (tie[:, None] + np.arange(k) * 7919) % k) * k + np.arange(k), -1)
    best = rank[:, open_].max(1)
    g, s = np.nonzero((rank >= 0) & (rank < best[:, None]))
    return g, s, best[g] % k, best[g] // (k * k)


def over_groups(state: DataFrame, k: int, of, schema: str) -> DataFrame:
    """What `of` (g1, g2, tie, n) makes of each batch of groups: columns as arrays."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = None
        for batch in batches:
            g1, g2, start, tie = (np.asarray(batch.column(i)) for i in range(4))
            n = np.asarray(batch.column(4).flatten()).reshape(-1, k)
            if kinds is None:
                kinds = [c.split()[0] for c in schema.split(", ")]
            columns = of(g1, g2, tie, n)
            if isinstance(columns, np.ndarray):  # the groups with other numbers
                each = pa.FixedSizeListArray.from_arrays(pa.array(columns.ravel()), k).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), each], batch.schema.names)
            elif len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], kinds)

    return state.mapInArrow(run, schema)


def cuts(state: DataFrame, k: int, open_: list[int], levels: dict, grant: dict, tasks: int) -> list[tuple[int, int, int, int]]:
    """For every two shards (s * k + t) where the granted moves end: (gain, g1, g2, documents of that group's that move).  `levels` are the documents and rows of each gain.  Rows of the
    gain at which a grant ends are told apart by their keys: by a histogram of the keys' first bits, if they are many, and then one by one, so that the driver gets
    some times the square root of their number."""
    import numpy as np

    ends, open_levels, many = [(2**62, LEAST, 0, 0)] * (k * k), {}, 0
    for pair, g in grant.items():
        for gain, f, rows in sorted(levels[pair], reverse=True):
            if g < f:
                break
            g, ends[pair] = g - f, (gain - 1, LEAST, 0, 0)
        if 0 < g < f:
            open_levels[pair], many = (gain, g), many + rows
    if not open_levels:
        return ends
    bits = int(np.log2(many / len(open_levels))) // 2 + 1 if many > LEVEL else 0
    at, bucket_at = np.full(k * k, -1), np.zeros(k * k, np.int64)
    for pair, (gain, _) in open_levels.items():
        at[pair] = gain

    def level(g1, tie, n):
        """The rows of the open levels, and the first bits of their keys."""
        g, s, t, gain = asks(n, tie, open_)
        here = gain == at[s * k + t]
        g, s, pair = g[here], s[here], (s * k + t)[here]
        return g, s, pair, (g1[g] >> (64 - bits) if bits else np.zeros(len(g), np.int64))

    def histogram(g1, g2, tie, n):
        g, s, pair, bucket = level(g1, tie, n)
        return pair, bucket, n[g, s]

    def members(g1, g2, tie, n):
        g, s, pair, bucket = level(g1, tie, n)
        here = bucket == bucket_at[pair]
        return pair[here], g1[g][here], g2[g][here], n[g, s][here]

    rest = {pair: g for pair, (_, g) in open_levels.items()}
    if bits:
        counts = over_groups(state, k, histogram, "pair long, bucket long, n long").groupBy("pair", "bucket").agg(F.sum("n").alias("n")).coalesce(tasks)
        done = set()
        for r in sorted(counts.collect()):
            if r["pair"] not in done:
                bucket_at[r["pair"]] = r["bucket"]
                if r["n"] >= rest[r["pair"]]:
                    done.add(r["pair"])
                else:
                    rest[r["pair"]] -= r["n"]
    for pair, g1, g2, n in sorted(over_groups(state, k, members, "pair long, g1 long, g2 long, n long").collect()):
        if rest[pair] > 0:
            ends[pair] = (open_levels[pair][0], g1, g2, min(n, rest[pair]))
            rest[pair] -= n
    return ends


def propagate(state: DataFrame, quotas: list[int], rounds: int, tasks: int, tables: Tables) -> DataFrame:
    """Groups (g1, g2, start, tie, n: the documents in each shard) after label propagation; no shard gets more than its quota of rows."""
    import numpy as np

    k = len(quotas)
    load = state.select(*(F.coalesce(F.sum(F.col("n")[s]), F.lit(0)) for s in range(k))).first()
    load = list(load)
    for _ in range(rounds):
        room = [max(0, q - x) for q, x in zip(quotas, load, strict=True)]
        open_ = [s for s in range(k) if room[s]] or list(range(k))

        def flows(g1, g2, tie, n, open_=open_):
            g, s, t, gain = asks(n, tie, open_)
            key, of, rows = np.unique((gain * k + s) * k + t, return_inverse=True, return_counts=True)
            return key % (k * k), key // (k * k), np.bincount(of, n[g, s], len(key)), rows

        levels, flow = {}, {}
        for pair, gain, f, r in over_groups(state, k, flows, "pair long, gain long, f long, r long").groupBy("pair", "gain").agg(F.sum("f"), F.sum("r")).coalesce(tasks).collect():
            levels.setdefault(pair, []).append((gain, f, r))
            flow[divmod(pair, k)] = flow.get(divmod(pair, k), 0) + f
        into = {t: sum(f for (_, b), f in flow.items() if b == t) for _, t in flow}
        grant = {(s, t): min(f, min(f, flow.get((t, s), 0)) + room[t] * f // into[t]) for (s, t), f in flow.items()}
        grant = grant if all(sum(g for (_, b), g in grant.items() if b == t) - sum(g for (a, _), g in grant.items() if a == t) <= room[t] for t in into) else {(s, t): min(f, room[t] * f // into[t]) for (s, t), f in flow.items()}
        if not sum(grant.values()):
            break
        ends = np.array(cuts(state, k, open_, levels, {s * k + t: g for (s, t), g in grant.items()}, tasks)).T

        def move(g1, g2, tie, n, open_=open_, ends=ends):
            g, s, t, gain = asks(n, tie, open_)
            end, x, y, part = ends[:, s * k + t]
            here = gain == end
            whole = (gain > end) | here & ((g1[g] < x) | (g1[g] == x) & (g2[g] < y))
            m = np.where(whole, n[g, s], np.where(here & (g1[g] == x) & (g2[g] == y), part, 0))
            n = n.copy()
            np.subtract.at(n, (g, s), m)
            np.add.at(n, (g, t), m)
            return n

        new = tables.keep(over_groups(state, k, move, "g1 long, g2 int, start long, tie int, n array<long>"), "state")
        tables.drop(state)
        state = new
        for (s, t), g in grant.items():
            load[s] -= g
            load[t] += g
    return state


def settle(state: DataFrame, quotas: list[int], tasks: int, tables: Tables) -> tuple[DataFrame, list[int]]:
    """Groups (g1, g2, start, spans: up to which of its documents each shard takes them), and the room that they leave in each shard.  Groups that propagation left cut
    are laid side by side, in the order of the shards they wish for, in the room that whole groups leave.  Only the groups across a shard's end
    (fewer than the shards) are dealt one by one: to the shard with the least room that holds them, and in pieces only where none does."""
    k = len(quotas)
    most = F.array_max(F.transform("n", lambda x, s: F.struct(x.alias("n"), s.alias("s"))))["s"]
    per = state.select("g1", "g2", F.col("start").alias("b"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.size(F.filter("n", lambda x: x > 0)).alias("pieces"), most.alias("s"))
    per = tables.keep(per, "per")
    whole = per.where("pieces = 1").select("g1", "g2", "b", "n", "s")
    load = {r["s"]: r["n"] for r in whole.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    room = [q - load.get(s, 0) for s, q in enumerate(quotas)]
    ends = [sum(room[: s + 1]) for s in range(k)]
    cut = running_totals(per.where("pieces > 1"), [], ["s", "g1", "g2"], "n", tables, tasks)
    shard_at = lambda c: F.coalesce(*(F.when(c < e, s) for s, e in enumerate(ends)), F.lit(k)).cast("int")
    laid = tables.keep(cut.select("g1", "g2", "b", "n", shard_at(F.col("start")).alias("s"), shard_at(F.col("start") + F.col("n") - 1).alias("e")).coalesce(tasks), "laid")
    inside = laid.where("s = e").select("g1", "g2", "b", "n", "s")
    for r in inside.groupBy("s").agg(F.sum("n").alias("n")).collect():
        room[r["s"]] -= r["n"]
    dealt = []
    for r in sorted(laid.where("s <> e").collect(), key=lambda r: (-r["n"], r["g1"], r["g2"])):
        left, pieces = r["n"], []
        while left:
            s = min((s for s in range(k) if room[s] >= left), key=lambda s: (room[s], s), default=None)
            s = max(range(k), key=lambda s: (room[s], -s)) if s is None else s
            m = min(left, room[s])
            pieces.append((s, m))
            room[s] -= m
            left -= m
        pieces.sort()
        dealt.append((r["g1"], r["g2"], r["b"], [(sum(m for _, m in pieces[: i + 1]), s) for i, (s, _) in enumerate(pieces)]))
    out = whole.union(inside).select("g1", "g2", "b", F.array(F.struct(F.col("n").alias("e"), "s")).alias("spans"))
    if dealt:
        out = out.union(state.sparkSession.createDataFrame(dealt, "g1 long, g2 int, b long, spans array<struct<e: long, s: int>>"))
    return out, room


def shard(docs: DataFrame, shards: int = 24, rounds: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    tables = Tables(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    base = tables.keep(narrow(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("g1"), F.when(F.col("text").isNotNull(), F.hash("text", F.octet_length("text"))).alias("g2")), "base")
    rows = base.count()
    quotas = [rows // shards + (s < rows % shards) for s in range(shards)]
    # small tables are written by few tasks, whatever the number of shuffle partitions
    tasks, few = (max(1, -(-rows // most)) for most in (ROWS, 2 * GROUPS))
    groups = base.where("g1 is not null").groupBy("g1", "g2").agg(F.count("*").alias("c")).where("c > 1")
    # documents of groups are numbered one group after the other, and number i starts in shard i % shards
    each = F.expr(f"transform(sequence(0, {shards - 1}), s -> c div {shards} + if(pmod(s - start, {shards}) < c % {shards}, 1L, 0L))")
    state = running_totals(groups, [], ["g1", "g2"], "c", tables, tasks).select("g1", "g2", "start", F.pmod(F.xxhash64("g1", "g2"), F.lit(shards)).cast("int").alias("tie"), each.alias("n"))
    at, room = settle(propagate(tables.keep(state.coalesce(few), "state"), quotas, rounds, few, tables), quotas, few, tables)
    at = at.withColumnsRenamed({"g1": "_g1", "g2": "_g2"})
    both = tables.keep(spread_join(base, at, (F.col("g1") == F.col("_g1")) & (F.col("g2") == F.col("_g2")), F.col("doc_id"), "left").select(*base.columns, "b", "spans").coalesce(tasks), "both")
    linked = running_totals(both.where("spans is not null"), [], ["g1", "g2", "doc_id"], F.lit(1), tables, tasks)
    put = linked.select("doc_id", "size", "text_crc32", F.filter("spans", lambda x: x["e"] > F.col("start") - F.col("b"))[0]["s"].alias("shard"))
    free = running_totals(both.where("spans is null"), [], ["text_crc32", "doc_id"], F.lit(1), tables, tasks)
    ends = [sum(room[: s + 1]) for s in range(shards)]
    fill = F.coalesce(*(F.when(F.col("start") < e, s) for s, e in enumerate(ends)))
    out = put.union(free.select("doc_id", "size", "text_crc32", fill.cast("int").alias("shard")))
    placed = running_totals(out, [], ["shard", "doc_id"], F.lit(1), tables, tasks)
    first = F.create_map(*(F.lit(v) for s in range(shards) for v in (s, sum(quotas[:s]))))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("start") - first[F.col("shard")]).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
