"""Language identification by hierarchical discrimination (operator 7).

A text becomes hashed counts of its letter 1- to 3-grams (words padded by one space), square-rooted and scaled to length 1.
A softmax regression picks the language family; inside the family one-versus-one linear support vector machines
(dual coordinate descent) vote on the language.  The model is fitted on the driver from at most `per_lang` labelled
documents of each language, drawn by a hash of doc_id; their features, not their texts, are sent.  Predictions
read nothing but the whole text.

Cases: null texts and texts without a letter are `und` with score 0; so are all when nothing can be learned; null labels
are never learned from; a null doc_id is neither learned from nor held out; repeated rows get equal answers;
an empty table gives no rows; extra columns are not read."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow

DIM = 4096
PER_LANG = 300
#: Language family by ISO 639-1 code, the first subtag of a language tag; another code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa si ur",
    "turkic": "az kk ky tr tt ug uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
    "iranian": "fa ku ps tg",
    "malay": "id jv ms su tl",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
LETTERS = None


def features(text: str | None):
    """Hashed letter n-grams of a whole text as a float32 vector of length 1, or None if it has no letter."""
    import numpy as np

    global LETTERS
    if LETTERS is None:
        LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = LETTERS[code & 0xFFFF]
    if (high := code > 0xFFFF).any():
        letter = np.where(high, np.isin(code, [c for c in np.unique(code[high]).tolist() if chr(c).isalpha()]), letter)
    if not letter.any():
        return None
    code = np.concatenate(([np.uint32(32)], np.where(letter, code, np.uint32(32)), [np.uint32(32)]))
    blank = code == 32
    code = code[~(blank & np.concatenate(([False], blank[:-1])))]
    mix = np.uint32(0x9E3779B1)
    one = code * mix
    two = (one[:-1] ^ (code[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (code[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
    counts = sum(np.bincount(h >> 20, minlength=DIM) for h in (one, two, three))
    x = np.sqrt(counts).astype(np.float32)
    return x / np.linalg.norm(x)


def fit_svm(x, y, cost: float = 4.0, rounds: int = 30, seed: int = 7):
    """A linear SVM (hinge loss, bias as one more feature) by dual coordinate descent; y is +1 or -1."""
    import numpy as np

    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, a, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = min(max(a[i] - (y[i] * (x[i] @ w) - 1) / q[i], 0.0), cost)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w.astype(np.float32)


def fit_softmax(x, y, classes: int, steps: int = 400, rate: float = 20.0, decay: float = 1e-4):
    """Softmax regression by full-batch gradient descent with momentum."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    w, v, one = np.zeros((x.shape[1], classes), np.float32), 0.0, np.eye(classes, dtype=np.float32)[y]
    share = (1 / np.maximum(one.sum(0), 1)) @ one.T / classes
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        v = 0.9 * v - rate * 0.1 * (x.T @ ((p - one) * share[:, None]) + decay * w)
        w += v
    return w.astype(np.float32)


class Model:
    """Families, and in each its languages, with the weights that tell them apart."""

    def __init__(self, langs: list[str], x, y) -> None:
        import numpy as np

        family = {lang: FAMILY.get(re.split("[-_]", lang.lower())[0], lang) for lang in langs}
        self.families = sorted(set(family.values()))
        self.members = [[lang for lang in langs if family[lang] == f] for f in self.families]
        y = np.asarray(y)
        self.top = fit_softmax(x, np.array([self.families.index(family[lang]) for lang in y]), len(self.families)) if len(self.families) > 1 else None
        self.pairs: dict[tuple[str, str], object] = {}
        for own in self.members:
            for a, b in combinations(own, 2):
                rows = np.isin(y, [a, b])
                self.pairs[a, b] = fit_svm(x[rows], np.where(y[rows] == a, 1.0, -1.0))

    def predict(self, x) -> tuple[str, float]:
        import numpy as np

        p, at = 1.0, 0
        if self.top is not None:
            z = x @ self.top[:-1] + self.top[-1]
            e = np.exp(z - z.max())
            at = int(e.argmax())
            p = float(e[at] / e.sum())
        own = self.members[at]
        votes, sure = dict.fromkeys(own, 0), {lang: [] for lang in own}
        for a, b in combinations(own, 2):
            w = self.pairs[a, b]
            q = float(1 / (1 + np.exp(-4 * float(x @ w[:-1] + w[-1]))))
            votes[a if q >= 0.5 else b] += 1
            sure[a].append(q)
            sure[b].append(1 - q)
        best = max(own, key=lambda lang: (votes[lang], sum(sure[lang])))
        return best, min(1.0, max(0.0, p * min(sure[best], default=1.0)))


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """A model from documents outside the held-out fold (crc32 of the doc_id as text, mod 5, is 0)."""
    import numpy as np

    own = narrow(docs, "doc_id", "text", "lang").where("text is not null and lang is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0")
    counts = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not counts:
        return None
    cut = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1 << 20, int((1 << 20) * (1.5 * per_lang + 50) / n) + 1))))
    drawn = own.withColumn("h", F.xxhash64("doc_id")).where(F.pmod("h", F.lit(1 << 20)) < cut[F.col("lang")]).select("lang", F.pmod("h", F.lit(1 << 20)).alias("h"), "doc_id", "text")

    def run(batches):
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress  # most features of a text are zero
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                xs = [features(t) for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([None if x is None else squeeze(x.astype(np.float16).tobytes()) for x in xs], pa.binary())], ["lang", "h", "doc_id", "x"])

    import zstandard

    restore = zstandard.ZstdDecompressor().decompress
    got = sorted((r["lang"], r["h"], r["doc_id"], bytes(r["x"])) for r in drawn.mapInArrow(run, "lang string, h long, doc_id long, x binary").where("x is not null").collect())
    taken, kept = {}, []
    for lang, _, _, x in got:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= per_lang:
            kept.append((lang, x))
    if not kept:
        return None
    return Model(sorted(taken), np.array([np.frombuffer(restore(x), np.float16) for _, x in kept]).astype(np.float32), [lang for lang, _ in kept])


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    return predictions(narrow(docs, "doc_id", "text"), fit(docs, per_lang))


def predictions(docs: DataFrame, model: Model | None) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [("und", 0.0) if model is None or (x := features(t)) is None else model.predict(x) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0"), F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5, per_lang: int = PER_LANG) -> DataFrame:
    """The documents with an identified language: rows that are `und`, or whose score is below `least`, go.  A null
    lang is filled with the prediction."""
    model, columns = fit(docs, per_lang), docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, langs = (part.column(columns.index(c)).to_pylist() for c in ("text", "lang"))
                found = [("und", 0.0) if model is None or (x := features(t)) is None else model.predict(x) for t in texts]
                stay = [lang != "und" and score >= least for lang, score in found]
                at_lang = columns.index("lang")
                cols = [pa.array([a if a is not None else b[0] for a, b in zip(langs, found, strict=True)], pa.string()) if i == at_lang else part.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays(cols, columns).filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)
