"""SimHash near-dedup with BK-trees (operator 8).

Fingerprints: texts are lower-cased in A-Z, cut into words, and every 3-word shingle votes with its XXH64.  Equal
fingerprints are collapsed first.  Two fingerprints that differ in at most r of 64 bits agree on some choice of m - r out
of m blocks, so each fingerprint joins one shard for every such choice.  The index is a BK-tree for every shard (children keyed by
their integer Hamming distance to the parent), built once and written; a search follows only edges within the radius.  Shards above
`most` fingerprints are cut into chunks with a tree each, and each tree is sent to the trees whose fingerprints search it.  A tree has
a fixed bound whatever the input, but all trees together grow with it, so they are sent to where their shard's queries
are and not broadcast to every task.  A task emits a spanning forest of the links it finds, never all pairs.

Cases: null, empty and all-space texts have fingerprint zero and link with each other; null doc_ids keep their
fingerprint, are never a representative, and get the component of their fingerprint (null if no row with a doc_id has one within reach of it); repeated
rows stay rows; rows that share a doc_id but not the text are linked each by its own fingerprint; an empty table gives no rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, Union, components, groups_of, in_chunks, narrow
from .paragraph_minhash import signatures, similar

SLICE = 256
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of one text, as a signed integer."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(line[b:e], 42) for b, e in zip(begins[at : at + BLOCK], stops[at : at + BLOCK], strict=True)], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (long) for every document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t, width) for t in part.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return narrow(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Values under integer Hamming distance; each node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.ids: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int, id: int) -> tuple[int, int]:
        """Adds a node; its parent and its distance to it."""
        new, at, up, d = len(self.values), 0, 0, 0
        self.values.append(value)
        self.ids.append(id)
        self.children.append({})
        while at != new:
            up, d = at, (value ^ self.values[at]).bit_count()
            at = self.children[at].setdefault(d, new)
        return up, d

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(self.ids[at])
            todo += [child for k, child in self.children[at].items() if d - radius <= k <= d + radius]
        return found

    @staticmethod
    def packed(values: list[int], ids: list[int]) -> bytes:
        """A tree of the values as bytes: value, id, parent and distance to it of each node."""
        import numpy as np

        tree = BKTree()
        ends = [tree.add(v, i) for v, i in zip(values, ids, strict=True)]
        return np.array(values, np.uint64).tobytes() + np.array(ids, np.int64).tobytes() + np.array(ends, np.int32).tobytes()

    @staticmethod
    def opened(raw: bytes) -> BKTree:
        import numpy as np

        tree, n = BKTree(), len(raw) // 24
        tree.values, tree.ids = np.frombuffer(raw, np.uint64, n).tolist(), np.frombuffer(raw, np.int64, n, 8 * n).tolist()
        tree.children = [{} for _ in range(n)]
        for at, (up, d) in enumerate(np.frombuffer(raw, np.int32, 2 * n, 16 * n).reshape(n, 2).tolist()):
            if at:
                tree.children[up][d] = at
        return tree


def masks(blocks: int, radius: int) -> list[int]:
    """Bit masks, as signed longs, of every choice of blocks - radius blocks."""
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = sum(((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in chosen)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def blocks_for(n: int, radius: int, aim: int = 256) -> int:
    """Blocks so that an even shard has at most about `aim` fingerprints."""
    blocks = radius + 1
    while blocks < radius + 4 and n >> (64 * (blocks - radius) // blocks) > aim:
        blocks += 1
    return blocks


def shard_trees(shards: DataFrame) -> DataFrame:
    """c, k, i, size and tree of every shard (c, k), or of every chunk i of one, that has more than one fingerprint."""

    def run(batches):
        import pyarrow as pa

        for (c, k, i, many), shard in groups_of(batches, ["c", "k", "i", "many"]):
            if many > 1 or shard.num_rows > 1:
                tree = BKTree.packed([v & (1 << 64) - 1 for v in shard["fp"].to_pylist()], shard["id"].to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([k], pa.int64()), pa.array([i], pa.int32()), pa.array([many], pa.int32()), pa.array([tree], pa.binary())], ["c", "k", "i", "many", "tree"])

    keys = ["c", "k", "i", "many"]
    return shards.repartition("c", "k", "i").sortWithinPartitions(*keys, "id").mapInArrow(run, "c int, k long, i int, many int, tree binary")


def tree_links(trees: DataFrame, radius: int) -> DataFrame:
    """A spanning forest (a, b) of the links inside each shard.  The fingerprints of a tree search that tree; where a shard has several,
    tree i is sent to every tree j > i, whose fingerprints search it."""

    def own(batches):
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                tree, found = BKTree.opened(raw), Union()
                for value, id in zip(tree.values, tree.ids, strict=True):
                    for other in tree.within(value, radius):
                        found.join(id, other)
                if links := found.links():
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    def sent(batches):
        import pyarrow as pa

        for batch in batches:
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree, asks, found = BKTree.opened(one), BKTree.opened(two), Union()
                for value, id in zip(asks.values, asks.ids, strict=True):
                    for other in tree.within(value, radius):
                        found.join(id, other)
                if links := found.links():
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    several = trees.where("many > 1")
    to = several.select("c", "k", F.col("i").alias("_i"), F.col("tree").alias("_tree"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("i")).where("i < _i")
    cells = several.join(to, ["c", "k", "i"]).select("tree", F.col("_tree").alias("asks"))
    return trees.select("tree").mapInArrow(own, "a long, b long").union(cells.mapInArrow(sent, "a long, b long"))


def near_duplicates(docs: DataFrame, radius: int = 3, most: int = 1024, width: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) for every document."""
    tables = Tables(docs.sparkSession)
    prints = tables.keep(fingerprints(docs, width), "prints")
    classes = tables.keep(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc")), "classes")
    # the fingerprint itself names a class: documents that share a doc_id may have several
    points = classes.select("fp", F.col("fp").alias("id"))
    chosen = masks(blocks_for(classes.count(), radius), radius)
    shards = points.withColumn("e", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(chosen))))).select("e.c", "e.k", "fp", "id")
    sizes = shards.groupBy("c", "k").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    big = tables.keep(sizes.select(F.col("c").alias("_c"), F.col("k").alias("_k"), F.ceil(F.col("_n") / most).cast("int").alias("_many")), "big")
    shards = shards.join(big, (F.col("c") == F.col("_c")) & (F.col("k") == F.col("_k")), "left").withColumn("many", F.coalesce("_many", F.lit(1)))
    trees = tables.keep(shard_trees(shards.withColumn("i", F.pmod(F.xxhash64("id"), F.col("many")).cast("int")).select("c", "k", "i", "many", "fp", "id")), "trees")
    found = components(tree_links(trees, radius), tables)
    of = tables.keep(classes.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), "doc", F.coalesce("component", "fp").alias("component")), "of")
    least = of.groupBy(F.col("component").alias("_component")).agg(F.min("doc").alias("component_id"))
    of = of.join(least, F.col("component") == F.col("_component")).select("_fp", "component_id")
    return prints.join(of, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


def sketches(docs: DataFrame, width: int, bands: int, rows: int, seed: int = 31) -> DataFrame:
    """doc_id, row (hash of the text), fp (64-bit SimHash over the distinct shingles), h (hash of the shingle set), size (of the set), shingles (sorted distinct
    unsigned 32-bit hashes) and keys (MinHash bands of the shingle set) for every document."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest, kind = xxhash.xxh64_intdigest, np.zeros(1, np.uint64)

        def one(text):
            words = (text or "").encode("utf-8", "replace").lower().split()
            if not words:
                return 0, 0, 0, b"", []
            line, n = b" ".join(words), max(1, len(words) - width + 1)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            begins, stops = [0, *(ends[: n - 1] + 1).tolist()], ends[-n:].tolist()
            h = np.unique(np.fromiter((digest(line[b:e], 42) for b, e in zip(begins, stops, strict=True)), np.uint64, n))
            votes = sum(np.unpackbits(h[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for at in range(0, len(h), BLOCK))
            fp = int(np.packbits(2 * votes > len(h), bitorder="little").view(np.int64)[0])
            known = digest(h.tobytes(), 3)
            keys = signatures(h, np.zeros(1, np.int64), kind, bands, rows, seed)[0].view(np.int64)
            return fp, known - (1 << 64) if known >> 63 else known, len(h), np.unique((h >> np.uint64(32)).astype("<u4")).tobytes(), keys

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                cols = zip(*map(one, part.column(2).to_pylist()), strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "row", "fp", "h", "size", "shingles", "keys"])

    own = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("row"), "text")
    return own.mapInArrow(run, "doc_id long, row long, fp long, h long, size int, shingles binary, keys array<long>")


def reachable(values: list[int], radius: int) -> list[int]:
    """For each value the number of the first value that it is linked to, over steps of at most `radius` bits.  A value that was found leaves the
    search: the tree is built anew whenever half of it has been found, so a dense group costs little more than one search."""
    root, left = list(range(len(values))), set(range(len(values)))
    tree, size = None, 0
    for first in range(len(values)):
        if first not in left:
            continue
        left.discard(first)
        todo = [first]
        while todo and left:
            if tree is None or 2 * len(left) <= size:
                tree, size = BKTree(), len(left)
                for at in left:
                    tree.add(values[at], at)
            for at in tree.within(values[todo.pop()], radius):
                if at in left:
                    left.discard(at)
                    root[at] = first
                    todo.append(at)
    return root


def band_links(cells: DataFrame, threshold: float, radius: int) -> DataFrame:
    """A spanning forest (a, b) over fp of the fingerprints of each cell that differ in at most radius bits, found in the cell's BK-tree."""

    def run(batches):
        import pyarrow as pa

        for _, cell in groups_of(batches, ["key", "i", "j"]):
            if cell.num_rows < 2:
                continue
            values = cell["fp"].to_pylist()
            root = reachable([v & (1 << 64) - 1 for v in values], radius)
            if links := [(values[x], values[r]) for x, r in enumerate(root) if r != x]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    keys = ["key", "i", "j"]
    return cells.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "a long, b long")


def drop_similar(docs: DataFrame, width: int = 5, threshold: float = 0.8, radius: int = 18, bands: int = 8, rows: int = 3, most: int = 1 << 12) -> DataFrame:
    """One document of each group linked by Jaccard similarity of `threshold` or more between sets of `width`-word shingles: the one with the
    smallest doc_id (of rows that repeat it, a hash of the text decides).

    The shards are MinHash bands: two sets of similarity 0.8 share one of 8 bands of 3 with probability 1 - (1 - 0.8^3)^8 = 0.997, and
    unrelated documents share none, so a document joins 8 shards and the shards hold its near copies, whatever the size of the table.  In a shard's
    BK-tree the fingerprints within `radius` bits are linked (two sets of similarity 0.8 differ in 10 of 64 bits, standard deviation 3), and
    every pair inside a component of such links is verified by its shingle sets, whose shingles count as 32-bit hashes.

    Cases: rows without a doc_id stay, all of them; rows that repeat both doc_id and text count as one document, of which the row that is first in the order
    of its other columns stays; texts without a word stay; an empty table gives no rows."""
    tables = Tables(docs.sparkSession)
    prints = tables.keep(sketches(docs, width, bands, rows), "prints")
    classes = prints.where("doc_id is not null and size > 0")
    # smaller sets (below 4 shingles at 0.8) reach the threshold only when they are equal
    points = classes.where(F.col("size") >= F.lit(threshold / (1 - threshold) - 1e-9)).select(F.explode("keys").alias("key"), "fp").distinct()
    shared = points.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("key").alias("_key"))
    shards = tables.keep(points.join(shared, F.col("key") == F.col("_key"), "left_semi"), "shards")
    near = components(band_links(in_chunks(shards, ["key"], "fp", most, tables), threshold, radius), tables)
    # equal fingerprints are candidates too
    of = classes.join(near, F.col("fp") == F.col("node"), "left").select(F.coalesce("component", "fp").alias("component"), "h", "shingles")
    sets = of.groupBy("component", "h").agg(F.min("shingles").alias("shingles"))
    several = of.groupBy("component").agg(F.min("h").alias("_x"), F.max("h").alias("_y")).where("_x <> _y").select(F.col("component").alias("_component"))
    sets = tables.keep(sets.join(several, F.col("component") == F.col("_component"), "left_semi"), "sets")
    linked = components(similar(sets, threshold, 1024, tables), tables)
    found = prints.where("doc_id is not null and size > 0").select("doc_id", "row", "h").join(linked, F.col("h") == F.col("node"), "left").select("doc_id", "row", F.coalesce("component", "h").alias("g"))
    found = tables.keep(found, "found")
    place = F.struct("doc_id", "row")
    least = found.groupBy("g").agg(F.min(place).alias("_least"), F.max(place).alias("_most")).where("_least <> _most").select(F.col("g").alias("_g"), "_least")
    gone = found.join(least, F.col("g") == F.col("_g")).where(place != F.col("_least")).select(F.col("doc_id").alias("_gone"), F.col("row").alias("_row")).distinct()
    own = docs.withColumn("_text", F.coalesce(F.xxhash64("text"), F.lit(0)))
    kept = own.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("_text") == F.col("_row")), "left_anti")
    repeats = tables.keep(prints.where("doc_id is not null").groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(F.count("*").alias("_n")).where("_n > 1"), "repeats")
    if repeats.isEmpty():
        return kept.select(*docs.columns)
    same = (F.col("doc_id") == F.col("_doc")) & (F.col("_text") == F.col("_row"))
    once = kept.join(repeats, same, "left_semi").groupBy("doc_id", "_text").agg(F.min(F.struct(*docs.columns)).alias("first")).select("first.*")
    return kept.join(repeats, same, "left_anti").select(*docs.columns).union(once)
