"""Mixing sources to target weights (operator 4).

Each source's documents are laid end to end in a fixed order and cut into blocks of `block` words.  A source's target is its
weighted share of `volume` times all words, at most `repeat` times its own; the excess is shared again among the others by
weight.  Every output shard draws its source counts from a multinomial; a source's draws are numbered over all shards,
what goes beyond its target is dropped and what is missing is added in one last shard, so the totals are exact.  Slot k of a
source takes block permutation_e(k mod blocks) of its epoch e = k div blocks, a keyed Feistel permutation of the indexes; the last slot of a
source takes only the words still missing.  Slots and document pieces are joined by block index.

The table of sources (name, words) is on the driver: it is the mix's configuration, a row for each weight.

Cases: null and empty texts have no words and are taken 0 times; a null source is a source of its own, sorted last;
a source without words has target 0; rows that repeat a doc_id are separate documents; an empty table gives no rows;
extra columns are not read.  Equal input gives equal output."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Tables, narrow, running_totals

BLOCK, SLOTS, SEED = 64, 256, 17


def targets(sizes: list[int], weights: list[float], volume: float = 1.5, repeat: float = 2.0) -> list[float]:
    """Words to take from each source."""
    total, capped = volume * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(repeat * sizes[i] for i in capped)
        share = rest / sum(weights[i] for i in free) if free else 0.0
        new = {i for i in free if share * weights[i] > repeat * sizes[i]}
        if not new:
            return [float(repeat * sizes[i]) if i in capped else share * weights[i] for i in range(len(sizes))]
        capped |= new


def keys_of(seed: int, source: int, epoch: int) -> list[int]:
    """Four 32-bit round keys."""
    h = hashlib.sha256(f"{seed}:{source}:{epoch}".encode()).digest()
    return [int.from_bytes(h[4 * i : 4 * i + 4], "little") for i in range(4)]


def permuted(index, n: int, keys: list[int], back: bool = False):
    """A keyed permutation of 0..n-1 (or its inverse) at the given indexes: a Feistel network over the next even
    power of two, walked until it falls inside."""
    import numpy as np

    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x = np.asarray(index, np.uint64).copy()
    todo = np.ones(len(x), bool)
    while todo.any():
        v = x[todo]
        left, right = v >> np.uint64(half), v & low
        for key in reversed(keys) if back else keys:
            if back:
                left, right = right, left
            mixed = (right * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)) * np.uint64(0xC2B2AE3D27D4EB4F)
            left = left ^ ((mixed >> np.uint64(29)) & low)
            if not back:
                left, right = right, left
        x[todo] = (left << np.uint64(half)) | right
        todo &= x >= n
    return x.astype(np.int64)


class Source:
    """One source: its words, blocks, target, and how many slots reach the target."""

    def __init__(self, at: int, words: int, target: float, block: int, seed: int) -> None:
        self.words, self.target, self.blocks = words, target, -(-words // block)
        self.take, self.short = round(target), words - (self.blocks - 1) * block
        epochs = range(1 + self.take // max(1, words)) if words else ()
        self.at_end = [e * self.blocks + int(permuted([self.blocks - 1], self.blocks, keys_of(seed, at, e), back=True)[0]) for e in epochs]
        self.block, self.slots = block, 0
        if words and self.take:
            self.slots = math.ceil(self.take / block)
            while self.reach(self.slots) < self.take:
                self.slots += 1

    def reach(self, slots: int) -> int:
        """Words in the first so many slots; the last block of a source may be short."""
        return slots * self.block - sum(k < slots for k in self.at_end) * (self.block - self.short)


def plan(docs: DataFrame, weights: tuple[float, ...], block: int, slots: int, seed: int, tables: Tables):
    """(documents with size, s, start), (slots: s, b, shard, k, epoch, take), sources."""
    import numpy as np

    spark = docs.sparkSession
    sized = narrow(docs, "doc_id", "text", "source").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("row"))
    placed = tables.keep(running_totals(sized, ["source"], ["doc_id", "size", "row"], "size", tables), "placed")
    found = sorted(((r["source"], r["n"] or 0) for r in placed.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    weight = [weights[i % len(weights)] for i in range(len(found))]
    goal = targets([n for _, n in found], weight)
    sources = [Source(i, n, t, block, seed) for i, ((_, n), t) in enumerate(zip(found, goal, strict=True))]
    total = sum(s.slots for s in sources)
    shards = max(1, -(-total // slots))
    p = np.array([s.slots for s in sources] or [1], float)
    p = p / p.sum() if p.sum() else p

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            for j in batch.column(0).to_pylist():
                counts = np.random.default_rng([seed, j]).multinomial(min(slots, total - j * slots), p)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), j), pa.int64()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["shard", "s", "n"])

    drawn = tables.keep(spark.range(shards if total else 0).mapInArrow(draw, "shard long, s int, n long"), "drawn")
    got = {r["s"]: r["n"] for r in drawn.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    numbered = running_totals(drawn, ["s"], ["shard"], "n", tables).select("s", "shard", "start", "n")
    more = [(i, shards, got.get(i, 0), s.slots - got.get(i, 0)) for i, s in enumerate(sources) if s.slots > got.get(i, 0)]
    numbered = numbered.union(spark.createDataFrame(more, "s int, shard long, start long, n long"))
    # dealt anew before the slots are made, about 50,000 a task, for a small table of shards makes many of them
    asked = numbered.repartition(max(1, -(-total // 50_000)), "shard", "s").select("s", "shard", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("k"))

    def fill(batches):
        import pyarrow as pa

        for batch in batches:
            s, k = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for i in np.unique(s).tolist():
                own, src = (s == i) & (k < sources[i].slots), sources[i]
                if not own.any():
                    continue
                ks, shard = k[own], np.asarray(batch.column(1))[own]
                epoch, b = ks // src.blocks, ks % src.blocks
                for e in np.unique(epoch).tolist():
                    b[epoch == e] = permuted(b[epoch == e], src.blocks, keys_of(seed, i, e))
                take = np.where(b == src.blocks - 1, src.short, block)
                take = np.where(ks == src.slots - 1, src.take - src.reach(src.slots - 1), take)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ks), i), pa.int32()), pa.array(b, pa.int64()), pa.array(shard, pa.int64()), pa.array(ks, pa.int64()), pa.array(epoch, pa.int64()), pa.array(take, pa.int64())], ["s", "b", "shard", "k", "epoch", "take"])

    filled = tables.keep(asked.mapInArrow(fill, "s int, b long, shard long, k long, epoch long, take long"), "slots")
    at = spark.createDataFrame([(name, i, n, t) for i, ((name, n), t) in enumerate(zip(found, goal, strict=True))], "_source string, s int, source_size long, target double")
    placed = placed.join(F.broadcast(at), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return placed, filled, sources


def pieces(placed: DataFrame, filled: DataFrame, block: int) -> DataFrame:
    """What each slot takes of each document: doc_id, s, start, size, shard, k, epoch, first (word of the document), words."""
    cut = placed.where("size > 0").select("doc_id", "s", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("b"))
    lo, hi = F.greatest("start", F.col("b") * block), F.least(F.col("start") + F.col("size"), F.col("b") * block + F.col("take"))
    return cut.join(filled, ["s", "b"]).select("doc_id", "s", "start", "size", "shard", "k", "epoch", (lo - F.col("start")).alias("first"), (hi - lo).alias("words")).where("words > 0")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    tables = Tables(docs.sparkSession)
    placed, filled, _ = plan(docs, weights, block, slots, seed, tables)
    taken = pieces(placed, filled, block).groupBy(F.col("s").alias("_s"), F.col("start").alias("_start")).agg(F.sum("words").alias("taken"))
    out = placed.join(taken, (F.col("size") > 0) & (F.col("s") == F.col("_s")) & (F.col("start") == F.col("_start")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as documents: a row for each document and epoch with the words taken from it in that epoch, its other columns
    as they are (a whole document keeps its text exactly; of a partly taken one, neighbouring words keep what stands
    between them).  n_chars is counted anew."""
    tables = Tables(docs.sparkSession)
    placed, filled, _ = plan(docs, weights, block, slots, seed, tables)
    took = pieces(placed, filled, block).groupBy("s", "start", "epoch").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("parts"))
    of = placed.where("size > 0").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("source").alias("_source"), F.col("s").alias("_s"), F.col("start").alias("_start"), F.col("size").alias("_size"))
    took = took.join(of, (F.col("s") == F.col("_s")) & (F.col("start") == F.col("_start")))
    # a document's columns travel as one struct, so that none of its names can clash
    own = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_text"), F.col("source").alias("_of"))
    if placed.groupBy("doc_id", "row", "source").count().where("count > 1").isEmpty():
        own, nth = own.withColumn("_nth", F.lit(1)), F.lit(1)
    else:  # rows alike in doc_id, text and source: the n-th goes with the n-th place
        own = own.withColumn("_nth", F.row_number().over(Window.partitionBy("_own", "_text", "_of").orderBy(F.xxhash64("_doc"))))
        nth = F.row_number().over(Window.partitionBy("_id", "_row", "_source", "epoch").orderBy("_start"))
    took = took.select("_id", "_row", "_source", "_size", "parts", nth.alias("_at"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_row")) & F.col("_of").eqNullSafe(F.col("_source")) & (F.col("_nth") == F.col("_at"))
    out = own.join(took, same).select("_doc.*", "parts", "_size")
    columns = docs.columns

    def run(batches):
        import re

        import pyarrow as pa

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for text, spans, size in zip(part.column(columns.index("text")).to_pylist(), part.column(len(columns)).to_pylist(), part.column(len(columns) + 1).to_pylist(), strict=True):
                    runs: list[list[int]] = []
                    for s in spans:
                        if runs and runs[-1][1] == s["first"]:
                            runs[-1][1] += s["words"]
                        else:
                            runs.append([s["first"], s["first"] + s["words"]])
                    if runs == [[0, size]]:
                        texts.append(text)
                    else:
                        at_word = [m.span() for m in word.finditer(text)]
                        texts.append("\n".join(text[at_word[a][0] : at_word[b - 1][1]] for a, b in runs))
                cols = [pa.array(texts, pa.string()) if c == "text" else pa.array([len(t) for t in texts], pa.int64()) if c == "n_chars" else part.column(i) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(cols, columns)

    kinds = ", ".join(f"`{f.name}` {'long' if f.name == 'n_chars' else f.dataType.simpleString()}" for f in docs.schema)
    return out.mapInArrow(run, kinds)

