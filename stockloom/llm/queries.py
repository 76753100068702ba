"""The thin queries over the driver's tables, one for each operator of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import code_compression, embedding_dedup, exact_topk, hilbert_packing, language_id, license_digests, line_windows, paragraph_minhash, passage_quality, sharding, simhash_bktree, source_divergence, source_mixing
from .common import read_table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_balanced_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"))


def op2_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digests.scan(read_table(spark, sf_dir, "documents"))


def op3_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(read_table(spark, sf_dir, "documents"))


def op5_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_minhash.repeated_paragraphs(read_table(spark, sf_dir, "documents"))


def op6_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.dedup_documents(read_table(spark, sf_dir, "documents"))


def op7_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op8_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bktree.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op10_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_passage_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_quality.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_bounded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_compression.compress(read_table(spark, sf_dir, "embeddings"))


def op13_term_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_balanced_labels, op2_license_digests, op3_sorted_projections, op4_source_mix, op5_paragraph_minhash, op6_line_windows, op7_language_families, op8_simhash_bktree, op9_hilbert_packing, op10_pivot_topk, op11_passage_attention, op12_bounded_lloyd, op13_term_vectors)}


def _license_sql() -> str:
    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def canonical(column: str) -> str:
        c = f"' ' || regexp_replace(lower(regexp_replace({column}, {quote(license_digests.COPYRIGHT)}, '', 'g')), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
        for a, b in license_digests.SPELLINGS.items():
            c = f"replace({c}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
        return f"sha256(trim(replace({c}, '  ', ' '), ' '))"

    rows = ", ".join(f"({quote(k.rstrip('*'))}, {quote(v)})" for k, v in license_digests.known_texts().items())
    return f"""WITH known AS (SELECT {canonical("t")} AS digest, min(license) AS license FROM (VALUES {rows}) AS v(license, t) GROUP BY 1),
own AS (SELECT doc_id, {canonical("text")} AS digest FROM documents)
SELECT doc_id, own.digest, license FROM own LEFT JOIN known USING (digest)"""


#: Pairs by brute force, components by a recursive closure.  Rows are told apart by number, so rows that repeat a vec_id link by their own vectors.
_OP3 = """WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
links AS (SELECT a.row AS a, b.row AS b FROM n a JOIN n b ON a.label = b.label AND a.row <> b.row WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT row AS a, row AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON v.row = b GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN comp ON comp.a = row LEFT JOIN deg ON deg.a = row"""

#: Rows are told apart by number, so rows that repeat a vec_id are candidates of each other.
_OP10 = """WITH n AS (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings),
v AS (SELECT row, vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM n
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.row AS row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_dot_product(q.e, c.e), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

_OP6 = """WITH l AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line, unnest(p) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, line, trim(raw, ' ' || chr(9) || chr(13)) AS x FROM l),
n AS (SELECT doc_id, line, x, lead(x, 1) OVER w AS y, lead(x, 2) OVER w AS z, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2 FROM t WHERE x <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
o AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, line) AS nth FROM n WHERE z IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest([line, l1, l2]) AS line FROM o WHERE nth > 1),
kept AS (SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY l.line) AS text FROM l ANTI JOIN g USING (doc_id, line) GROUP BY l.doc_id),
removed AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS lines, coalesce(r.n, 0) AS removed_lines
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN removed r USING (doc_id)"""


def _lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd rounds: every distance of every round, floors by whole-number division."""
    out = f"""WITH n AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT row, part, e[part * (len(e) // {parts}) + 1 : (part + 1) * (len(e) // {parts})] AS x FROM n, range({parts}) AS r(part)),
b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x AS c FROM p WHERE row <= {entries})"""
    near = "SELECT row, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT row, part, x, entry, list_sum([CAST(x[k] - c[k] AS BIGINT) * (x[k] - c[k]) for k in range(1, len(x) + 1)]) AS d FROM p JOIN b{} USING (part)) GROUP BY row, part, x"
    for r in range(rounds):
        out += f""",
a{r} AS MATERIALIZED ({near.format(r)}),
m{r} AS (SELECT part, entry, k, sum(x[k]) AS s, count(*) AS n FROM a{r}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS k) GROUP BY part, entry, k),
b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(u.c, b{r}.c) AS c FROM b{r} LEFT JOIN (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c FROM m{r} GROUP BY part, entry) u USING (part, entry))"""
    return (
        out
        + f""",
z AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM ({near.format(rounds)}) GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
g AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM n JOIN z USING (row) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM n JOIN z USING (row) JOIN g ON n.label IS NOT DISTINCT FROM g.label, h"""
    )


#: Every kept term with every group, by plain joins.
_OP13 = """WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS MATERIALIZED (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
w AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS all_n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY lang, source) AS HUGEINT) AS total, count(*) OVER (PARTITION BY lang, source) AS v, CAST(sum(all_n) OVER (PARTITION BY lang, source) AS HUGEINT) AS lang_total FROM w),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (total + 5 * v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (all_n + 5) // (lang_total + 5 * v) AS q FROM s),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS one, y.source AS two, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z ON z.lang = a.lang AND one = a.source AND two = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50"""

ORACLE_SQL = {"op2_license_digests": _license_sql(), "op3_sorted_projections": _OP3, "op6_line_windows": _OP6, "op10_pivot_topk": _OP10, "op12_bounded_lloyd": _lloyd_sql(), "op13_term_vectors": _OP13}
