"""Packing along a space-filling curve (operator 9).

Documents are tokenized whole; their hashed token counts are projected to three dimensions and squashed to a grid,
whose Hilbert index is the sort key, so neighbours on the curve have similar words.  All documents are laid end to end
in that order (exact distributed prefix sums after a range sort) and cut every `length` ids, so a sequence is full but
for the end; the last, short stretch is cut into powers of two, which need no padding.

Tokenizing: no token crosses a piece of the pre-tokenizer, so the ids of pieces are kept in a bounded cache, and only unseen
ones go to the tokenizer.

Cases: null texts count as empty, and an empty text is its end id alone; very long texts are cut over many sequences;
rows that repeat a doc_id are separate documents (in order of their length and CRC); an empty table gives no rows; extra columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, narrow, running_totals

END, LENGTH, HASHED, BITS = 1, 2048, 1024, 10
WORDS = 600_000


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The letter runs, digits and punctuation runs that the vocabulary's pre-tokenizer cuts a text into are looked up in a bounded
    cache.  Texts that are Latin characters alone once lower-cased, for which lower-casing and cutting are known, are cut here at once; of others the Latin
    chunks between spaces are, and the rest goes to the tokenizer."""

    def __init__(self, spec: str) -> None:
        import os
        import re
        import unicodedata

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own would only hold memory
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_str(spec), {}
        kinds = {k: "".join(re.escape(chr(c)) for c in range(33, 0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        letters, digits = kinds["L"], kinds["N"]
        self.cut = re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[^ \\t-\\r{letters}{digits}]+|[{digits}]").findall
        self.plain = re.compile("[\t-\r\x20-\x7e\xa1-\u024f]*").fullmatch
        probe, pre = "It's 42 ÄÖ-ß.,x don't", self.tokenizer.pre_tokenizer
        known = self.tokenizer.normalizer.normalize_str(probe) if pre and self.tokenizer.normalizer else ""
        self.known_cut = known != "" and [known[a:b] for _, (a, b) in pre.pre_tokenize_str(known)] == self.cut(probe.lower())

    @staticmethod
    def shared(spec: str) -> Encoder:
        """One encoder for all tasks that a Python worker runs, so its caches outlive a task."""
        import sys
        import types

        kept = sys.modules.setdefault("_stockloom_worker", types.ModuleType("_stockloom_worker")).__dict__.setdefault("encoders", {})
        if (key := hash(spec)) not in kept:
            kept.clear()
            kept[key] = Encoder(spec)
        return kept[key]

    def learn(self, words: list[str]) -> None:
        """Ids of words that are each one piece, 64 at once."""
        import numpy as np

        lines = [words[at : at + 64] for at in range(0, len(words), 64)]
        for line, e in zip(lines, self.tokenizer.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids, of = np.array(e.ids, "<u4"), e.word_ids
            if of and of[-1] == len(line) - 1:
                ends = np.flatnonzero(np.append(np.diff(of) != 0, True)) + 1
                raw, begin = ids.tobytes(), 0
                for w, end in zip(line, ends.tolist(), strict=True):
                    self.words[w] = raw[4 * begin : 4 * end]
                    begin = end
            else:  # not a piece each: one at a time
                for w, one in zip(line, self.tokenizer.encode_batch(line, add_special_tokens=False), strict=True):
                    self.words[w] = np.array(one.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        split = []
        for t in texts:
            if self.known_cut and "<|" not in t and self.plain(low := t.lower()):
                split.append(self.cut(low))
            else:  # a key that holds a space is a whole chunk for the tokenizer
                pieces = []
                for c in t.encode("utf-8", "replace").split():  # at ASCII white space
                    c = c.decode()
                    pieces += self.cut(low) if self.known_cut and "<|" not in c and self.plain(low := c.lower()) else [" " + c]
                split.append(pieces)
        if len(self.words) > WORDS:
            self.words = {}
        new = set().union(*split).difference(self.words)
        whole = [w for w in new if w[0] == " "]
        for at in range(0, len(whole), 1024):
            some = whole[at : at + 1024]
            for w, e in zip(some, self.tokenizer.encode_batch([w[1:] for w in some], add_special_tokens=False), strict=True):
                self.words[w] = np.array(e.ids, "<u4").tobytes()
        self.learn([w for w in new if w[0] != " "])
        return [b"".join(map(self.words.__getitem__, s)) for s in split]


def hilbert(grid, bits: int):
    """Hilbert index of integer points (n, dims): Gray-code transpose of the coordinates, most significant bits first."""
    import numpy as np

    x = grid.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fix, q = np.zeros_like(x[0]), top
    while q > 1:
        fix = np.where((x[dims - 1] & q) != 0, fix ^ (q - 1), fix)
        q >>= 1
    x ^= fix
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenized(docs: DataFrame, tokenizer: str, end: int = END, seed: int = 3) -> DataFrame:
    """doc_id, ids (16-bit where the vocabulary allows, else 32-bit; compressed, for they are written and shuffled), doc_tokens (with the end id), key, crc."""
    import numpy as np

    with open(tokenizer, encoding="utf-8") as f:  # a vocabulary file, some MB at most, sent to the executors
        spec = f.read()
    planes = np.random.default_rng(seed).standard_normal((HASHED, 3)).astype(np.float32)

    def run(batches):
        import zlib

        import pyarrow as pa
        import zstandard

        encoder, squeeze = Encoder.shared(spec), zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids, points, out = encoder.encode([t or "" for t in part.column(1).to_pylist()]), [], []
                for raw in ids:
                    own = np.frombuffer(raw, "<u4")
                    counts = np.bincount(own & (HASHED - 1), minlength=HASHED).astype(np.float32)
                    points.append((counts @ planes) / max(1.0, float(np.sqrt(counts @ counts))))
                    out.append(np.append(own, np.uint32(end)))
                grid = ((np.tanh(np.array(points)) + 1) / 2 * (1 << BITS)).clip(0, (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([squeeze(o.astype("<u2" if o.max() < 65536 else "<u4").tobytes()) for o in out], pa.binary()), pa.array([len(o) for o in out], pa.int64()), pa.array(hilbert(grid, BITS), pa.int64()), pa.array([zlib.crc32(o.tobytes()) for o in out], pa.int64())], ["doc_id", "ids", "doc_tokens", "key", "crc"])

    return narrow(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, ids binary, doc_tokens long, key long, crc long")


def sequence_ends(total: int, length: int) -> list[int]:
    """Lengths of the sequences after the full ones: the binary parts of the rest, each a power of two."""
    rest = total % length
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""
    tables = Tables(docs.sparkSession)
    docs_ids = tables.keep(tokenized(docs, tokenizer, end).withColumn("row", F.monotonically_increasing_id()), "ids")
    placed = tables.keep(running_totals(docs_ids.select("row", "doc_id", "doc_tokens", "key", "crc"), [], ["key", "doc_id", "doc_tokens", "crc", "row"], "doc_tokens", tables).select(F.col("row").alias("_row"), "start"), "placed")
    total = docs_ids.agg(F.sum("doc_tokens")).first()[0] or 0
    tail = sequence_ends(total, length)
    both = docs_ids.join(placed, F.col("row") == F.col("_row")).select("doc_id", "ids", "doc_tokens", "start")

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        import zstandard

        full, restore = total // length, zstandard.ZstdDecompressor().decompress
        begins = np.concatenate([[0], np.cumsum(tail)]).astype(np.int64) + full * length
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                out = []
                for r in rows:
                    raw, n, p = r["ids"], r["doc_tokens"], r["start"]
                    raw = restore(raw)
                    ids = raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                    done = 0
                    while done < n:
                        if (here := p + done) < full * length:
                            seq, off, most = here // length, here % length, length - here % length
                        else:
                            t = int(np.searchsorted(begins, here, "right")) - 1
                            seq, off, most = full + t, here - int(begins[t]), int(begins[t + 1]) - here
                        m = min(n - done, most)
                        cut = ids[4 * done : 4 * (done + m)]
                        out.append((r["doc_id"], done, m, zlib.crc32(cut), n, seq, off, cut))
                        done += m
                if out:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:7]), pa.array([o[7] for o in out], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return both.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
