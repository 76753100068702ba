"""Quality of documents by attention-based multiple-instance learning (operator 11).

A document is a bag of passages of `PASSAGE` words, and only the document has a label.  Every passage becomes hashed counts of its
3-grams of character classes (capitals, small letters, digits and spaces are one class each, other characters are themselves)
and of its words, square-rooted and scaled to length 1; an encoder turns them into a short vector h.  Gated attention,
w . (tanh(V h) * sigmoid(U h)) with a softmax over the passages of a document, weighs the passages, and a logistic unit scores the weighted sum.  All
layers are learned together from the documents' labels by gradient descent.  A whole text is scored in one pass
over blocks of passages with a running softmax, so a text of any length needs the memory of one block besides itself.

The model is fitted on the driver from at most `per_label` documents of each label (those with at most `most_passages` passages),
drawn by a hash; what is sent are their passages' hashed counts, compressed.  Labels weigh in the fit as they occur among all
labelled documents outside the held-out fold, so scores are probabilities.  A score reads nothing but the whole text.

Cases: null and empty texts are one passage without words, scored like any other; null labels, labels other than 0 and 1, and doc_ids
that bear both are never learned from, nor is a null doc_id, which is not held out; of labels that repeat one counts; repeated documents get equal scores; with labels of one kind
every score is 1 or 0 accordingly, with none it is 0.5; an empty table gives no rows; extra columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow

#: Words of a passage, hashed features of each of the two kinds, and passages that are held at a time.
PASSAGE, DIM, BLOCK = 64, 512, 256
PER_LABEL, MOST_PASSAGES = 800, 64
HIDDEN, GATES = 24, 16
CLASSES = None


def passage_blocks(text: str | None, block: int = BLOCK):
    """Matrices (passages x 2 DIM, float32, rows of length 1 or 0) of up to `block` passages each, over the whole text."""
    import numpy as np

    global CLASSES
    if CLASSES is None:
        CLASSES = np.arange(256, dtype=np.uint32) + 8
        for kind, chars in enumerate((b" \t\n\r\v\f", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"0123456789")):
            CLASSES[np.frombuffer(chars, np.uint8)] = kind
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    kind = CLASSES[raw]
    inside = kind != 0
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        yield np.zeros((1, 2 * DIM), np.float32)
        return
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    for first in range(0, len(starts), block * PASSAGE):
        own = slice(first, min(first + block * PASSAGE, len(starts)))
        s, e = starts[own], ends[own]
        lo, hi, n = int(s[0]), int(e[-1]), -(-len(s) // PASSAGE)
        k = np.concatenate(([np.uint32(0)], kind[lo:hi], [np.uint32(0)]))
        gram = ((k[:-2] * np.uint32(0x9E3779B1) ^ k[1:-1]) * np.uint32(0x85EBCA6B) ^ k[2:]) * np.uint32(0xC2B2AE35) >> np.uint32(16)
        of_char = np.zeros(hi - lo, np.int64)
        of_char[s[PASSAGE::PASSAGE] - lo] = 1
        of_char = np.cumsum(of_char)
        shapes = np.bincount(of_char * DIM + (gram & np.uint32(DIM - 1)), minlength=n * DIM).reshape(n, DIM)
        # a word's hash: its bytes by powers of an odd number, counted from its start
        at = np.arange(hi - lo) - np.repeat(s - lo, np.diff(np.append(s, hi)))
        powers = np.cumprod(np.full(64, 0x01000193, np.uint32), dtype=np.uint32)
        sums = np.add.reduceat(np.where(inside[lo:hi], raw[lo:hi] + np.uint32(1), np.uint32(0)) * powers[at & 63], s - lo, dtype=np.uint32)
        word = (sums ^ (sums >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
        words = np.bincount(np.arange(len(s)) // PASSAGE * DIM + (word & np.uint32(DIM - 1)), minlength=n * DIM).reshape(n, DIM)
        x = np.sqrt(np.hstack([shapes, words])).astype(np.float32)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        yield x


def sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """The encoder (E, e), the gates (V, U, w) and the logistic unit (c, b), or one constant score."""

    def __init__(self, constant: float | None = None, seed: int = 5) -> None:
        import numpy as np

        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.constant = constant
        self.w = {"E": 3 * draw(2 * DIM, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES), "w": draw(GATES), "c": draw(HIDDEN), "b": np.zeros(1, np.float32)}

    def encode(self, x):
        """h, its two gates and the attention logit of each passage."""
        import numpy as np

        w = self.w
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
        return h, t, g, (t * g) @ w["w"]

    def score(self, text: str | None) -> float:
        import numpy as np

        if self.constant is not None:
            return self.constant
        top, mass, total = -np.inf, 0.0, 0.0
        for x in passage_blocks(text):
            h, _, _, a = self.encode(x)
            new = max(top, float(a.max()))
            p, old = np.exp(a - new), np.exp(top - new)
            top, mass, total = new, mass * old + float(p.sum()), total * old + p @ h
        return float(sigmoid(total / mass @ self.w["c"] + self.w["b"][0]))

    def fit(self, x, begins, y, weight, steps: int = 400, rate: float = 0.01, decay: float = 1e-3) -> Model:
        """Full-batch Adam; bag i has the rows from begins[i] on, label y[i] and its weight in the loss."""
        import numpy as np

        of, weight = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(x)))), weight / weight.sum()
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        for step in range(1, steps + 1):
            w = self.w
            h, t, g, a = self.encode(x)
            p = np.exp(a - np.maximum.reduceat(a, begins)[of])
            p /= np.add.reduceat(p, begins)[of]
            z = np.add.reduceat(p[:, None] * h, begins)
            d = ((sigmoid(z @ w["c"] + w["b"][0]) - y) * weight).astype(np.float32)
            dz = d[:, None] * w["c"]
            # through the softmax: the gain of a passage over its bag's mean
            dp = (h * dz[of]).sum(1)
            da = p * (dp - np.add.reduceat(p * dp, begins)[of])
            dt, dg = da[:, None] * w["w"] * g * (1 - t * t), da[:, None] * w["w"] * t * g * (1 - g)
            dh = (p[:, None] * dz[of] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
            grads = {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "c": z.T @ d, "b": d.sum(keepdims=True)}
            for k, grad in grads.items():
                grad = grad.astype(np.float32) + (decay / 100 * w[k] if k in ("E", "V", "U", "c") else 0)
                m[k][0] = 0.9 * m[k][0] + 0.1 * grad
                m[k][1] = 0.999 * m[k][1] + 0.001 * grad * grad
                w[k] = (w[k] - rate * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


HELD_OUT = "pmod(crc32(cast(doc_id as string)), 4) = 2"


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most_passages: int = MOST_PASSAGES) -> Model:
    """A model from the labelled documents outside the held-out fold."""
    import numpy as np
    import zstandard

    known = narrow(labels, "doc_id", "quality").where(f"doc_id is not null and quality in (0, 1) and not ({HELD_OUT})")
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("_other")).where("label = _other").drop("_other")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model(float(next(iter(counts), 0.5)))
    # a few more are drawn than needed, as labels may have no document
    place = F.xxhash64("doc_id")
    cut = F.create_map(*(F.lit(v) for label, n in counts.items() for v in (label, min(1 << 20, int((1 << 20) * (2 * per_label + 50) / n) + 1))))
    drawn = known.where(F.pmod(place, F.lit(1 << 20)) < cut[F.col("label")]).withColumnRenamed("doc_id", "_id")

    def run(batches):
        import pyarrow as pa

        squeeze = zstandard.ZstdCompressor(level=3).compress  # most features of a passage are zero
        for batch in batches:
            for label, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                bag = []
                for x in passage_blocks(text, most_passages):
                    bag.append(x)
                    if len(bag) > 1:
                        break
                if len(bag) == 1:
                    packed = squeeze(bag[0].astype(np.float16).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([doc_id], pa.int64()), pa.array([packed], pa.binary())], ["label", "doc_id", "x"])

    own = narrow(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    # of documents that repeat a doc_id one is taken, so the rows sent are bounded by the labels drawn
    bags = own.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("label", "doc_id", "text").mapInArrow(run, "label int, doc_id long, x binary").groupBy("label", "doc_id").agg(F.min("x").alias("x"))
    restore, taken, kept = zstandard.ZstdDecompressor().decompress, {}, []
    for r in sorted(bags.withColumn("_h", place).collect(), key=lambda r: (r["_h"], r["doc_id"])):
        taken[r["label"]] = taken.get(r["label"], 0) + 1
        if taken[r["label"]] <= per_label:
            kept.append((r["label"], np.frombuffer(restore(bytes(r["x"])), np.float16).reshape(-1, 2 * DIM)))
    if len(taken) < 2:
        return Model(float(next(iter(taken), 0.5)))
    begins = np.cumsum([0, *(len(x) for _, x in kept[:-1])])
    y = np.array([label for label, _ in kept], np.float32)
    weight = np.array([counts[label] / min(taken[label], per_label) for label, _ in kept], np.float32)
    return Model().fit(np.concatenate([x for _, x in kept]).astype(np.float32), begins, y, weight)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_label: int = PER_LABEL, most_passages: int = MOST_PASSAGES) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels, per_label, most_passages)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [model.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    own = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
