"""Queries and pipeline stages over the whole documents table of the smallest scale, held against plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from stockloom.llm import language_id, sharding, simhash_bktree, source_mixing
from stockloom.llm.queries import op8_simhash_bktree, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, width=5):
    w = words(text)
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_fingerprints_and_components(spark, rows):
    prints = {}
    for r in rows:
        w = words(r["text"])
        votes, n = [0] * 64, max(1, len(w) - 2)
        for i in range(n if w else 0):
            h = xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42)
            for b in range(64):
                votes[b] += h >> b & 1
        prints[r["doc_id"]] = sum(1 << b for b in range(64) if w and 2 * votes[b] > n)
    of = {i: i for i in prints}
    for _ in range(len(of)):
        new = {i: min(of[j] for j, q in prints.items() if (p ^ q).bit_count() <= 3) for i, p in prints.items()}
        if new == of:
            break
        of = new
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op8_simhash_bktree(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", of[i]) for i, p in prints.items()}


def test_shards(docs, rows):
    out = sharding.shard(docs).collect()
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(24)]
    assert len(out) == len(rows) and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    of = {r["doc_id"]: r for r in out}
    groups = defaultdict(set)
    for r in rows:
        o = of[r["doc_id"]]
        assert o["size"] == len((r["text"] or "").encode()) + 8 and o["text_crc32"] == zlib.crc32((r["text"] or "").encode()) and o["law"] == "rows"
        if r["text"] is not None:
            groups[r["text"]].add(o["shard"])
    assert all(len(v) == 1 for v in groups.values())


def test_mix(docs, rows):
    size = {r["doc_id"]: len(words(r["text"])) for r in rows}
    per = Counter()
    for r in rows:
        per[r["source"]] += size[r["doc_id"]]
    names = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        free = [s for s in names if s not in capped]
        rest = 1.5 * sum(per.values()) - sum(2 * per[s] for s in capped)
        target = {s: 2.0 * per[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 2 * per[s]}
        if not over:
            break
        capped |= over
    out, again = source_mixing.mix(docs).collect(), source_mixing.mix(docs).collect()
    assert sorted(out) == sorted(again)
    source, taken = {r["doc_id"]: r["source"] for r in rows}, Counter()
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_languages_held_out(docs, rows):
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    out = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    asked = [r for r in rows if held(r) and r["lang"] is not None and out[r["doc_id"]]["lang_pred"] != "und"]
    assert all(out[r["doc_id"]]["held_out"] == held(r) for r in rows)
    assert sum(out[r["doc_id"]]["lang_pred"] == r["lang"] for r in asked) >= 0.95 * len(asked)
    # labels and sources of the held-out documents are not read
    other = docs.withColumns({"lang": F.when(F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0"), F.lit("xx")).otherwise(F.col("lang")), "source": F.lit("one")})
    assert sorted(language_id.identify(other).collect()) == sorted(out.values())


def test_pipeline_stages(spark, docs, rows):
    """Each stage over what the one before it kept."""
    from tokenizers import Tokenizer

    stage = dict(corpus_pipeline.STAGES)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect()}
    first = stage["language ID"](spark, docs, SF).collect()
    assert {r["doc_id"] for r in first} == {i for i, (lang, score) in found.items() if lang != "und" and score >= 0.5}
    # three lines in a row that came before, in any document, go
    table = spark.createDataFrame(first, docs.schema)
    seen, want = set(), {}
    for r in sorted(first, key=lambda r: r["doc_id"]):
        lines = r["text"].split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for k in range(len(full) - 2):
            w = tuple(lines[i].strip(" \t\r") for i in full[k : k + 3])
            if w in seen:
                gone |= set(full[k : k + 3])
            seen.add(w)
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or text.strip(" \t\r\n"):
            want[r["doc_id"]] = text
    second = stage["line dedup"](spark, table, SF).collect()
    assert {r["doc_id"]: r["text"] for r in second} == want
    # one document of each group of 5-word Jaccard similarity 0.8 or more
    table = spark.createDataFrame(second, docs.schema)
    sets = {r["doc_id"]: shingles(r["text"]) for r in second}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and near(sets[i], sets[j]):
                a, b = group[i], group[j]
                group = {k: min(a, b) if v in (a, b) else v for k, v in group.items()}
    third = stage["SimHash near-dedup"](spark, table, SF).collect()
    kept = {r["doc_id"] for r in third}
    assert kept >= set(group.values()) and len(kept - set(group.values())) <= 0.03 * len(sets)
    # whole documents keep their texts; parts are runs of their words
    table = spark.createDataFrame(third, docs.schema)
    fourth = stage["source mixing"](spark, table, SF).collect()
    text, taken = {r["doc_id"]: r["text"] for r in third}, Counter()
    for r in fourth:
        taken[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"]) and not Counter(words(r["text"])) - Counter(words(text[r["doc_id"]]))
    assert taken == Counter({r["doc_id"]: r["taken"] for r in source_mixing.mix(table).collect() if r["taken"]})
    # every text's ids, each once
    tokenizer, pieces = Tokenizer.from_file(tokenizer_path()), defaultdict(list)
    for r in stage["packing"](spark, spark.createDataFrame(fourth, docs.schema), SF).collect():
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
    for r in fourth:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        own = sorted(pieces[r["doc_id"], len(ids)])
        assert np.array(ids, "<u4").tobytes() in b"".join(x for _, x in own) or len({s for s, _ in own}) < len(own)


def test_pipeline_on_an_empty_table_and_long_words(spark, docs):
    none, long = docs.limit(0), spark.createDataFrame([(1, "x" * 500_000 + " and the of", "en", "a", 500_011), (2, "and the of " * 60_000, "en", "a", 660_000), (3, None, None, None, None)], docs.schema)
    for name, f in corpus_pipeline.STAGES:
        none, long = f(spark, none, SF), f(spark, long, SF)
        assert none.count() == 0, name
        if name != "packing":
            assert none.columns == long.columns == list(corpus_pipeline.COLUMNS)
    assert long.count() >= 1
    assert simhash_bktree.near_duplicates(docs.limit(0)).count() == 0
