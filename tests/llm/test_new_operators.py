"""Operators 11 to 13 against plain Python, the identity of classes in 3 and 8, and the near-dedup rule for odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm import code_compression, embedding_dedup, passage_quality, simhash_bktree, source_divergence
from stockloom.llm.queries import op11_passage_attention

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, Label string"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


# --- 11


def test_quality_is_learned_and_held_out_labels_are_not_read(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r["doc_id"]: r for r in op11_passage_attention(spark, sf).collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(out) == docs.count() and all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in out.items())
    good, bad = ([out[i]["score"] for i, q in known.items() if q == want and held(i)] for want in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.97 and np.mean([g >= 0.7 for g in good]) >= 0.95 and np.mean([b < 0.7 for b in bad]) >= 0.85
    # labels of the held-out fold, languages and sources are not read
    other = labels.withColumn("quality", F.when(F.expr(passage_quality.HELD_OUT), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = passage_quality.scores(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s")}), other)
    assert all(abs(r["score"] - out[r["doc_id"]]["score"]) < 1e-6 for r in again.collect())


def test_passages_cover_whole_texts():
    """Blocks of passages hold every word once, however the text is blocked; empty texts are one passage of nothing."""
    text = " ".join(f"Word{i}!" for i in range(1000)) + " " + "x" * 5000
    whole = np.concatenate(list(passage_quality.passage_blocks(text)))
    parts = np.concatenate(list(passage_quality.passage_blocks(text, 3)))
    assert len(whole) == len(parts) == -(-1001 // passage_quality.PASSAGE)
    # the words' half of the features is the same; characters beside a block's border are counted with a space
    half = slice(passage_quality.DIM, None)
    scaled = lambda x: x[:, half] / np.linalg.norm(x[:, half], axis=1, keepdims=True)
    assert np.allclose(scaled(whole), scaled(parts), atol=1e-6)
    for empty in (None, "", " \n\t"):
        (x,) = passage_quality.passage_blocks(empty)
        assert x.shape == (1, 2 * passage_quality.DIM) and not x.any()


def test_streamed_attention_equals_the_softmax_over_all_passages():
    model, text = passage_quality.Model(seed=9), " ".join(f"w{i % 97} CAPS{i % 13}$" for i in range(40_000))
    x = np.concatenate(list(passage_quality.passage_blocks(text)))
    h, _, _, a = model.encode(x)
    p = np.exp(a - a.max())
    want = passage_quality.sigmoid((p @ h) / p.sum() @ model.w["c"] + model.w["b"][0])
    assert model.score(text) == pytest.approx(float(want), abs=1e-5)


def test_quality_gradients():
    """The analytic step lowers the loss that it claims to: a fit separates bags of which one passage tells the label."""
    rng = np.random.default_rng(1)
    x, begins, y = [], [], []
    for i in range(60):
        begins.append(len(x))
        y.append(i % 2)
        rows = np.abs(rng.standard_normal((4, 2 * passage_quality.DIM)).astype(np.float32))
        if i % 2:
            rows[int(rng.integers(4)), 7] += 40
        x += list(rows / np.linalg.norm(rows, axis=1, keepdims=True))
    x, y = np.array(x), np.array(y, np.float32)
    model = passage_quality.Model().fit(x, np.array(begins), y, np.ones(60, np.float32), steps=300)
    h, _, _, a = model.encode(x)
    for b, label in zip(begins, y, strict=True):
        p = np.exp(a[b : b + 4] - a[b : b + 4].max())
        assert (passage_quality.sigmoid((p @ h[b : b + 4]) / p.sum() @ model.w["c"] + model.w["b"][0]) > 0.5) == bool(label)


def test_quality_of_odd_tables(spark):
    docs = "doc_id long, text string, Text string, _h long"
    rows = [(1, "a b", "", 1), (1, "a b", "", 1), (None, "x", "", 1), (5, None, "", 1), (6, "", "", 1), (7, "long " * 50_000, "", 1), (8, "TEXT!!", "", 1)]
    own = spark.createDataFrame(rows, docs)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = passage_quality.scores(own, none).collect()
    assert len(out) == len(rows) and {r["score"] for r in out} == {0.5} and not [r for r in out if r["doc_id"] is None and r["held_out"]]
    one = spark.createDataFrame([(1, 1, 0), (6, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in passage_quality.scores(own, one).collect()} == {1.0}
    ids = [i for i in (1, 5, 6, 7, 8) if not held(i)]
    both = spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate(ids)] + [(ids[0], 0, 0), (ids[1], 0, 0)], "doc_id long, quality int, toxic int")
    got = passage_quality.scores(own, both).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert passage_quality.scores(own.limit(0), both).count() == 0


# --- 12


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows (vec_id, vector, label) in order -> codes, errors and the final codebooks, by plain Lloyd rounds in whole numbers."""
    import math

    x = [[math.floor(scale * c) for c in v] for _, v, _ in rows]
    size = len(x[0]) // parts
    cut = [[r[p * size : (p + 1) * size] for p in range(parts)] for r in x]
    books = [[cut[i][p] for i in range(min(entries, len(x)))] for p in range(parts)]
    dist = lambda a, b: sum((m - n) ** 2 for m, n in zip(a, b, strict=True))
    near = lambda a, book: min(range(len(book)), key=lambda k: (dist(a, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for r in cut:
                of[near(r[p], books[p])].append(r[p])
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[p])]
    codes = [[near(r[p], books[p]) for p in range(parts)] for r in cut]
    errors = [sum(dist(r[p], books[p][k]) for p, k in enumerate(c)) for r, c in zip(cut, codes, strict=True)]
    return ["".join(f"{k:02x}" for k in c) for c in codes], errors, books


@pytest.mark.parametrize("kind", ["random", "ties", "few"])
def test_codes_equal_plain_lloyd(spark, kind):
    rng = np.random.default_rng(2)
    n = 9 if kind == "few" else 150
    draw = (lambda: rng.integers(-1, 2, 16) / 4096) if kind == "ties" else (lambda: rng.standard_normal(16))
    rows = [(i // 2 if kind == "ties" else i, draw().tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]
    rows.sort(key=lambda r: (r[0], [int(np.floor(4096 * c)) for c in r[1]]))
    codes, errors, books = lloyd(rows)
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    per = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        per[label] += e
    odd = [(900, None, 1), (901, [1.0, None] * 8, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, None)]
    got = code_compression.compress(spark.createDataFrame([(*r, "x") for r in [*rows, *odd]], VECTORS).repartition(5)).collect()
    want = sorted((i, c, e, per[label], digest) for (i, _, label), c, e in zip(rows, codes, errors, strict=True))
    assert sorted(tuple(r) for r in got) == want


def test_bounds_skip_scans_and_never_a_change():
    """Over rounds of moving entries the bounded assignment equals the full scan, and most parts are not scanned."""
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((4000, 8)) * 300 + rng.integers(0, 12, 4000)[:, None] * 2000).astype(np.int64)
    books, state, scans = x[:16].copy(), (None, None, None), []
    moved = None
    for _ in range(8):
        *state, n = code_compression.assign(x, *state, books, moved)
        scans.append(n)
        want = code_compression.scan(x, books)
        assert (state[0] == want[0]).all() and (state[1] ** 2 >= want[1]).all() and (state[2] ** 2 <= want[2]).all()
        new = books.copy()
        for k in range(16):
            if (state[0] == k).any():
                new[k] = x[state[0] == k].sum(0) // (state[0] == k).sum()
        moved, books = code_compression.root_up(((new - books) ** 2).sum(1)), new
    assert scans[0] == 4000 and scans[-1] < 1500


def test_roots():
    n = np.array([0, 1, 2, 3, 4, 8, 9, 10**12, 10**12 - 1, (1 << 57) - 1, ((1 << 28) + 1) ** 2 - 1], np.int64)
    import math

    assert code_compression.root_down(n).tolist() == [math.isqrt(i) for i in n.tolist()]
    assert code_compression.root_up(n).tolist() == [math.isqrt(i - 1) + 1 if i else 0 for i in n.tolist()]


def test_codes_of_odd_tables(spark):
    assert code_compression.compress(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(1, [0.5] * 16, 1, ""), (1, [0.5] * 16, 1, ""), (None, [1e300] * 16, None, ""), (2, [0.1] * 8, 1, ""), (3, [], 2, ""), (4, [-1e300] * 16, 2, "")]
    got = sorted(code_compression.compress(spark.createDataFrame(rows, VECTORS)).collect(), key=str)
    assert len(got) == 6 and {r["vec_id"]: r["code"] is None for r in got} == {1: False, None: False, 2: True, 3: True, 4: False}
    assert {r["error"] for r in got if r["code"] is not None} == {0}
    odd = spark.createDataFrame([(1, [0.1] * 9, 1, "")], VECTORS)
    assert [r["code"] for r in code_compression.compress(odd).collect()] == [None]


# --- 13


def diverge(rows, least=30, smoothing=5, top=50):
    import re

    docs = [((lang or ""), (source or ""), [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        count = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        whole = sum(count.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + smoothing) // (sum(c.values()) + smoothing * len(kept)) for t in kept}
        shares, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in shares:
            pairs = [(sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in shares if o != s]
            terms = [(shares[s][t] - q[t], t) for t in kept if count[s][t] and shares[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def test_divergence_equals_plain_python(spark):
    rng = np.random.default_rng(4)
    words = ["The", "the", "ÀB", "àb", "Straße", "x1y", "don't", "日本", "Ω", "ω", "ⅧA", "zz", "\U0001f600k"] + [f"w{i}" for i in "abcdefghijklmnop"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 30))), ["en", "de", None][i % 3], ["s1", "s2", "S1", None, ""][i % 5]) for i in range(300)]
    rows += [(None, "en", "only"), ("", "fr", "a"), ("one two", "fr", "b"), ("long " * 40_000, "en", "s1"), *[("tie", "it", s) for s in "ab" for _ in range(40)], *rows[:5]]
    df = spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, Text string, _h int")
    for most in (50, 3):
        got = sorted(tuple(r) for r in source_divergence.divergence(df, top=most).collect())
        assert got == diverge(rows, top=most)
    assert source_divergence.divergence(df.limit(0)).count() == 0


# --- identity of classes, and the near-dedup stage's rule


def test_vectors_that_share_a_vec_id_are_linked_by_their_own_values(spark):
    near = embedding_dedup.near_duplicates
    rows = [(7, [1.0, 0.0, 0.0], 1, ""), (7, [0.0, 1.0, 0.0], 1, ""), (8, [1.0, 0.0, 0.0], 1, ""), (9, [0.0, 1.0, 0.0], 1, ""), (1, [1.0, 0.001, 0.0], 1, "")]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(1, 2, 1, True), (7, 1, 7, True), (7, 2, 1, False), (8, 2, 1, False), (9, 1, 7, False)]


def test_cosines_are_taken_in_double(spark):
    rows = [(i, v, 1, "") for i, v in enumerate([[1e39, 0.0], [2e39, 0.0], [1e-46, 0.0], [1.0, 0.0], [1e-310, 0.0], [0.0, 0.0]])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 4: (4, 0), 5: (0, 5)}


def test_links_of_a_dense_table_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((12, 24))
    v = np.concatenate([c + rng.standard_normal((25, 24)) * s for c, s in zip(centers, np.linspace(0.02, 0.25, 12), strict=True)])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = np.arange(len(v)) % 2
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    of = np.arange(len(v))
    while (new := np.where(near.any(1), np.minimum(of, np.where(near, of[None, :], len(v)).min(1)), of)).tolist() != of.tolist():
        of = new
    out = embedding_dedup.near_duplicates(spark.createDataFrame([(i, x.tolist(), int(k), "") for i, (x, k) in enumerate(zip(v, label, strict=True))], VECTORS), window=8, most=16)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()}
    assert got == {i: (int(near[i].sum()), int(of[i])) for i in range(len(v))}


def test_texts_that_share_a_doc_id_are_linked_by_their_own_fingerprints(spark):
    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"b{i}" for i in range(400))
    rows = [(5, a), (2, a + " a400"), (5, b), (9, b + " b400"), (None, b), (None, "other words here now")]
    out = simhash_bktree.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    prints = {t: simhash_bktree.fingerprint(t) for _, t in rows}
    assert (prints[a] ^ prints[rows[1][1]]).bit_count() <= 3 and (prints[b] ^ prints[rows[3][1]]).bit_count() <= 3
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in out.collect()}
    assert got == {(5, prints[a]): 2, (2, prints[rows[1][1]]): 2, (5, prints[b]): 5, (9, prints[rows[3][1]]): 5, (None, prints[b]): 5, (None, prints[rows[5][1]]): None}


def test_near_dedup_of_a_row_does_not_depend_on_others(spark):
    """Rows without a doc_id stay, all of them; rows that repeat doc_id and text are one, whatever else the table holds."""
    text = " ".join(f"q{i}" for i in range(60))
    base = [(None, text, "en"), (None, text, "en"), (3, text, "en"), (4, text + " more", "en"), (10, None, "en"), (11, "", "en")]
    repeats = [(20, "some other text of a few words", "en"), (20, "some other text of a few words", "de"), (20, "some other text of a few words", "en")]
    shape = "doc_id long, text string, lang string"
    for rows in (base, base + repeats):
        got = Counter(tuple(r) for r in simhash_bktree.drop_similar(spark.createDataFrame(rows, shape)).collect())
        want = Counter([base[0], base[1], base[2], base[4], base[5]]) + (Counter([repeats[1]]) if len(rows) > 6 else Counter())
        assert got == want


def test_reachable_equals_brute_force():
    rng = np.random.default_rng(6)
    base = [int(x) for x in rng.integers(0, 1 << 62, 20)]
    values = list(dict.fromkeys(v ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 9))}) for v in base * 12))
    root = simhash_bktree.reachable(values, 6)
    of = list(range(len(values)))
    while (new := [min(of[j] for j, w in enumerate(values) if (v ^ w).bit_count() <= 6) for v in values]) != of:
        of = new
    assert root == of


def test_similar_sets_in_cells_of_all_sizes_equal_brute_force(spark):
    """Cells of 1 to 150 sets over several batches, small ones compared together and large ones dealt in chunks."""
    from stockloom.llm.common import Tables
    from stockloom.llm.paragraph_minhash import similar

    rng = np.random.default_rng(7)
    rows, h = [], 0
    for c in range(120):
        pool = rng.integers(0, 1 << 32, 40, np.uint64).astype("<u4")
        for _ in range(150 if c == 5 else 40 if c == 6 else int(rng.integers(1, 12))):
            keep = np.unique(pool[rng.random(40) < rng.choice([0.5, 0.95])])
            rows.append((c, h, bytes(keep.tobytes())) if len(keep) else (c, h, bytes(pool[:1].tobytes())))
            h += 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = similar(spark.createDataFrame(rows, "component int, h long, shingles binary"), 0.8, 64, Tables(spark)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    up = list(range(h))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    got, want = up, list(range(h))
    for r in found:
        a, b = sorted((root(r["a"]), root(r["b"])))
        got[b] = a
    got = [root(x) for x in range(h)]
    sets = [(c, set(np.frombuffer(s, "<u4").tolist())) for c, _, s in rows]
    up = want
    for x, (c, s) in enumerate(sets):
        for y in range(x):
            if sets[y][0] == c and len(s & sets[y][1]) >= 0.8 * len(s | sets[y][1]):
                a, b = sorted((root(x), root(y)))
                up[b] = a
    assert got == [root(x) for x in range(h)] and len(set(got)) < h


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    """what a step shuffled and the tables of the steps before it go when its own table is written."""
    import os
    import time

    from stockloom.llm.common import Tables

    def shuffled():
        where = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in where for a, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}

    before, tables = shuffled(), Tables(spark)
    one = tables.keep(spark.range(5000).repartition(4, "id"), "one")
    two = tables.keep(one.groupBy((one["id"] % 7).alias("k")).count(), "two")
    tables.drop_but(two)
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and [r["count"] for r in two.orderBy("k").collect()] == [715, 715, 714, 714, 714, 714, 714]
    assert [p.rsplit("/", 1)[1] for _, p in tables.paths.values()] == ["two-2"]


def test_spans_of_repeated_paragraphs_are_written_step_by_step(spark, monkeypatch):
    """the shuffle files of first occurrences, of their join and of merging are never on disk together; a side's words are asked for four times as far as before; texts are kept as zstd."""
    from stockloom.llm import paragraph_minhash

    kept, sizes = [], []
    keep, contexts = paragraph_minhash.Tables.keep, paragraph_minhash.contexts
    monkeypatch.setattr(paragraph_minhash.Tables, "keep", lambda self, df, name, codec=None: kept.append((name, codec)) or keep(self, df, name, codec))
    monkeypatch.setattr(paragraph_minhash, "contexts", lambda docs, asked, size, cutter: sizes.append(size) or contexts(docs, asked, size, cutter))
    shared = " ".join(f"w{i}" for i in range(60)) + " " + " ".join(["same"] * 80)
    docs = spark.createDataFrame([(i, " ".join(f"d{i}x{j}" for j in range(20)) + " " + shared + f" end{i}") for i in range(3)], "doc_id long, text string")
    found = paragraph_minhash.repeated_paragraphs(docs).collect()
    assert {(r["doc_id"], r["first_word"], r["last_word"]) for r in found if r["removed"]} == {(1, 20, 159), (2, 20, 159)}
    names = [n for n, _ in kept]
    assert names.index("classed") < names.index("firsts") < names.index("placed") < names.index("spans") and ("texts", "zstd") in kept
    assert sizes[:2] == [32, 128]
