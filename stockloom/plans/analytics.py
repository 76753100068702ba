"""Functions, deltas, state, identity resolution and serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import python_udfs as P
from ..functions.similarity import weighted_ratio
from ..operators import audit, blocking, delta, geo, resolve, serving
from ..sources import payloads
from ..streaming import incremental
from .registry import query

Q = query


def _fold(c):
    return f"lower(translate(translate({c}, '{N.DROPPED}', ''), '{N.ACCENTED}', '{N.PLAIN}'))"


def _key(c):
    return f"regexp_replace({_fold(c)}, '[^a-z0-9]', '', 'g')"


def _name(c):
    return f"regexp_replace({_key(c)}, '^(.{{3,}}?)(?:sociedadlimitadaunipersonal|sociedadanonima|sociedadlimitada|scoop|scp|slu|sau|sll|sl|sa)$', '\\1')"


def _digits(c):
    return f"regexp_replace({c}, '[^0-9]', '', 'g')"


def _host(c):
    return f"nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '^[a-z]+://', ''), '^www\\.', ''), '[/?#].*$', ''), '')"


def _bare(c):
    rest = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '^https?://', ''), '^www\\.', ''), '[?#].*$', ''), '/+$', '')"
    return f"CASE WHEN regexp_matches({rest}, '^[^/]+$') THEN {rest} END"


def _code(k):
    chars = " || ".join(f"substr('{N.BASE32}', CAST((n >> {5 * i}) & 31 AS INTEGER) + 1, 1)" for i in range(7, -1, -1))
    return f"(SELECT {chars} FROM (SELECT CAST('0x' || substr(sha256({k}), 55, 10) AS BIGINT) AS n))"


# --- functions


@Q("f1_name_keys", f"SELECT entity_ulid, {_name('trade_name')} AS f1, {_key('trade_name')} AS f3 FROM entity")
def _(x):
    return x.entity.select("entity_ulid", N.name_key(F.col("trade_name")).alias("f1"), N.alnum_key(F.col("trade_name")).alias("f3"))


@Q("f1_exact_fold", f"SELECT entity_ulid, {_key('trade_name')} AS f FROM entity")
def _(x):
    return x.entity.select("entity_ulid", F.regexp_replace(P.nfkd_fold("trade_name"), "[^a-z0-9]", "").alias("f"))


@Q("f2_name_key_words", f"SELECT entity_ulid, regexp_replace(regexp_replace(regexp_replace({_fold('trade_name')}, '[^a-z0-9 ]+', ' ', 'g'), '\\b(s\\s?l\\s?u?|s\\s?a\\s?u?|s\\s?c\\s?p?|sociedad limitada|sociedad anonima)\\b', ' ', 'g'), ' +', '', 'g') AS f2 FROM entity")
def _(x):
    return x.entity.select("entity_ulid", N.name_key_words(F.col("trade_name")).alias("f2"))


@Q("f4_phones", f"SELECT entity_ulid, CASE WHEN length({_digits('phone')}) >= 7 THEN {_digits('phone')} END AS f4, CASE WHEN length({_digits('phone')}) >= 7 THEN right({_digits('phone')}, 9) END AS f5, CASE WHEN length({_digits('phone')}) >= 9 THEN right({_digits('phone')}, 9) END AS f6 FROM entity")
def _(x):
    p = F.col("phone")
    return x.entity.select("entity_ulid", N.phone_all(p).alias("f4"), N.phone_last9(p).alias("f5"), N.phone_last9(p, 9).alias("f6"))


@Q("f7_hosts", f"SELECT entity_ulid, {_host('website')} AS f7, {_bare('website')} AS f8 FROM entity")
def _(x):
    return x.entity.select("entity_ulid", N.host(F.col("website")).alias("f7"), N.bare_host(F.col("website")).alias("f8"))


_PHOTO = "nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '\\?.*$', ''), '/+$', ''), '[/_-](?:thumb|thumbnail|small|medium|large|\\d+x\\d+|\\d+w)$', ''), '')"


@Q("f10_photo_keys", f"SELECT vehicle_ulid, {_PHOTO.format(c='photo_url')} AS f10 FROM car")
def _(x):
    return x.car.select("vehicle_ulid", N.photo_key(F.col("photo_url")).alias("f10"))


@Q("f12_geo_keys", f"SELECT entity_ulid, trim(regexp_replace({_fold('trade_name')}, '[^a-z0-9]+', ' ', 'g')) AS geo, array_to_string(list_sort(string_split(trim(regexp_replace({_fold('trade_name')}, '[^a-z0-9]+', ' ', 'g')), ' ')), ' ') AS sorted FROM entity")
def _(x):
    return x.entity.select("entity_ulid", N.geo_key(F.col("trade_name")).alias("geo"), N.sorted_tokens(F.col("trade_name")).alias("sorted"))


_CK = f"""k AS (SELECT entity_ulid, province_code, coalesce(
'domain:' || {_bare('website')},
CASE WHEN length(trim(coalesce(cif, ''))) > 0 THEN 'cif:' || upper(trim(cif)) END,
CASE WHEN municipality_code IS NOT NULL THEN 'name:' || {_key("trade_name")} || '|' || municipality_code || CASE WHEN address IS NULL THEN '' ELSE '|' || {_key("address")} END END,
CASE WHEN province_code IS NOT NULL THEN 'name:' || {_key("trade_name")} || '|p' || province_code || CASE WHEN address IS NULL THEN '' ELSE '|' || {_key("address")} END END) AS key FROM entity)"""


def _canonical(x):
    c, none = F.col, F.lit(None).cast("string")
    return x.entity.select("entity_ulid", "province_code", N.canonical_key(c("website"), c("cif"), c("trade_name"), c("municipality_code"), c("province_code"), c("address"), none, none).alias("key"))


@Q("f13_canonical_key", f"WITH {_CK} SELECT entity_ulid, key FROM k")
def _(x):
    return _canonical(x).select("entity_ulid", "key")


@Q("f14_code", f"WITH {_CK} SELECT entity_ulid, 'CDP-ES-' || province_code || '-' || {_code('key')} AS code, 'ORG-' || {_code('key')} AS org FROM k")
def _(x):
    """F14 and F15."""
    return _canonical(x).select("entity_ulid", N.code(F.col("key"), F.col("province_code")).alias("code"), N.org_code(F.col("key")).alias("org"))


def _surrogate(key, at):
    ms = " || ".join(f"substr('{N.BASE32}', CAST((ms >> {5 * i}) & 31 AS INTEGER) + 1, 1)" for i in range(9, -1, -1))
    return f"(SELECT {ms} FROM (SELECT epoch_ms({at}) AS ms)) || {_code(key)} || {_code(f"{key} || '#'")}"


@Q("f16_surrogate_ids", f"SELECT vehicle_ulid, {_surrogate('vehicle_ulid', 'CAST(first_seen AS TIMESTAMP)')} AS ulid FROM vehicle")
def _(x):
    return x.vehicle.select("vehicle_ulid", N.surrogate_id(F.col("vehicle_ulid"), F.col("first_seen").cast("timestamp")).alias("ulid"))


@Q("f17_haversine", "SELECT entity_ulid, round(2 * 6371.0 * asin(sqrt(least(pow(sin(radians(40.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.0)) * pow(sin(radians(-3.0 - lon) / 2), 2), 1.0))), 6) AS km FROM entity WHERE lat IS NOT NULL")
def _(x):
    return x.entity.where("lat is not null").select("entity_ulid", F.round(N.haversine_km(F.col("lat"), F.col("lon"), F.lit(40.0), F.lit(-3.0)), 6).alias("km"))


@Q("f18_levenshtein", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS d FROM part")
def _(x):
    return x.table("part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("d"))


@Q("f19_trigram_jaccard", "WITH g AS (SELECT p_partkey, list_distinct([substr(p_name, i, 3) for i in range(1, length(p_name) - 1)]) AS a, list_distinct([substr(p_type, i, 3) for i in range(1, length(p_type) - 1)]) AS b FROM part) SELECT p_partkey, CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END AS j FROM g")
def _(x):
    return x.table("part").select("p_partkey", N.jaccard(N.trigrams(F.col("p_name")), N.trigrams(F.col("p_type"))).alias("j"))


@Q("f20_weighted_ratio")
def _(x):
    return x.entity.select("entity_ulid", weighted_ratio(N.geo_key(F.col("trade_name")), F.lit("talleres garcia 3 s l")).alias("score"))


@Q("f21_price_near", "SELECT o.k, coalesce(o.price > 0 AND n.price > 0 AND abs(o.price - n.price) <= 0.02 * least(o.price, n.price), false) AS near FROM old_car o JOIN new_car n ON o.k = n.k")
def _(x):
    return x.old_car.select("k", "price").join(x.new_car.select("k", F.col("price").alias("p")), "k").select("k", N.price_near(F.col("price"), F.col("p")).alias("near"))


@Q("f22_text_repair", "SELECT entity_ulid, trade_name AS repaired FROM entity")
def _(x):
    broken = F.decode(F.encode("trade_name", "UTF-8"), "ISO-8859-1")
    return x.entity.select("entity_ulid", P.repair_text(broken).alias("repaired"))


@Q("f23_numbers", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_orderkey AS BIGINT) AS n FROM lineitem")
def _(x):
    cents = (F.col("l_extendedprice").cast("decimal(12,2)") * 100).cast("long")
    text = F.concat(F.format_number((cents / 100).cast("long"), 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" €"))
    spanish = F.translate(text, ",.", ".,")
    return x.table("lineitem").select("l_orderkey", "l_linenumber", N.to_price(spanish).alias("price"), N.to_int(F.concat(F.lit("ref "), F.col("l_orderkey").cast("string"), F.lit(" km"))).alias("n"))


@Q("f24_years", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def _(x):
    return x.table("orders").select("o_orderkey", N.year_of(F.date_format("o_orderdate", "MM-yyyy")).alias("year"))


@Q("f25_zip", f"SELECT entity_ulid, CASE WHEN length({_digits('cif')}) > 0 THEN substr(lpad({_digits('cif')}, 5, '0'), 1, 5) END AS zip, left(CASE WHEN length({_digits('cif')}) > 0 THEN substr(lpad({_digits('cif')}, 5, '0'), 1, 5) END, 2) AS province FROM entity")
def _(x):
    return x.entity.select("entity_ulid", N.zip5(F.col("cif")).alias("zip"), N.province_of_zip(F.col("cif")).alias("province"))


@Q("f26_make_model", "SELECT entity_ulid, string_split(trade_name, ' ')[1] AS make, CASE WHEN strpos(trade_name, ' ') > 0 THEN substr(trade_name, strpos(trade_name, ' ') + 1) END AS model FROM entity")
def _(x):
    return x.entity.select("entity_ulid", N.make_of(F.col("trade_name")).alias("make"), N.model_of(F.col("trade_name")).alias("model"))


@Q("f27_first_of_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS v FROM events")
def _(x):
    return x.table("events").select("event_id", payloads.first_of(F.try_parse_json("props"), "$.missing", "$.k").alias("v"))


@Q("f28_iso_times", "SELECT o_orderkey, o_orderdate AS at FROM orders")
def _(x):
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return x.table("orders").select("o_orderkey", F.try_to_timestamp(iso).cast("timestamp_ntz").alias("at"))


@Q("f29_hours", "SELECT o_orderkey, (epoch_us(TIMESTAMP '2000-01-01') - epoch_us(o_orderdate)) / 3.6e9 AS hours FROM orders")
def _(x):
    return x.table("orders").select("o_orderkey", N.hours_between(F.col("o_orderdate").cast("timestamp"), F.lit("2000-01-01").cast("timestamp")).alias("hours"))


@Q("f30_percent", "SELECT segment, CAST(100.0 * count(*) FILTER (WHERE status = 'gone') / count(*) AS DOUBLE) > 10 AS over10 FROM vehicle GROUP BY 1")
def _(x):
    return x.vehicle.groupBy("segment").agg((N.percent(F.count_if(F.col("status") == "gone"), F.count("*")) > 10).alias("over10"))


_ADDRESS = "CASE n % 5 WHEN 0 THEN address || ', Lugo' WHEN 1 THEN 'CL UNO ' || CAST(n AS STRING) || '  LA LINEA, CADIZ 11300' WHEN 2 THEN 'CL DOS -07' || lpad(CAST(n % 1000 AS STRING), 3, '0') || ' - SOLLER -BALEARES.' WHEN 3 THEN 'CL TRES – 4, 17200 Palafrugell -, Girona.' ELSE address END"


@Q("f31_address", f"SELECT entity_ulid, nullif(regexp_extract(a, '\\b(\\d{{5}})\\b', 1), '') AS postcode, CASE n % 5 WHEN 1 THEN 'LA LINEA' WHEN 2 THEN 'SOLLER' WHEN 3 THEN 'Palafrugell' WHEN 0 THEN trim(regexp_extract(a, ', \\d{{5}} (.*), Lugo', 1)) ELSE regexp_extract(a, '^(.*?),', 1) END AS town, CASE n % 5 WHEN 1 THEN 'CADIZ' WHEN 2 THEN 'BALEARES' WHEN 3 THEN 'Girona' WHEN 0 THEN 'Lugo' ELSE regexp_extract(a, ', \\d{{5}} (.*)$', 1) END AS province FROM (SELECT entity_ulid, n, {_ADDRESS} AS a FROM entity) WHERE a IS NOT NULL")
def _(x):
    return x.entity.withColumn("a", F.expr(_ADDRESS)).dropna(subset=["a"]).select("entity_ulid", N.address_parts(F.col("a")).alias("p")).select("entity_ulid", "p.*")


@Q("f32_origin", "SELECT run_id, source_key || ':fetch' || CASE WHEN ok THEN '' ELSE ':500' END AS origin FROM run")
def _(x):
    return x.run.select("run_id", N.origin_key(F.col("source_key"), F.lit("fetch"), F.when(~F.col("ok"), "500")).alias("origin"))


_F33 = """SELECT doc_id, CASE
WHEN (st IN (401, 403) OR regexp_matches(t, '403|blocked|forbidden|challenge|captcha|akamai|datadome|cloudflare|perimeterx')) AND regexp_matches(t, 'akamai|datadome|perimeterx|sensor|residential') THEN 'escalate_tier'
WHEN st IN (401, 403) OR regexp_matches(t, '403|blocked|forbidden|challenge|captcha|akamai|datadome|cloudflare|perimeterx') THEN 'refingerprint'
WHEN st = 429 OR regexp_matches(t, '429|rate limit|rate-limit|throttl|too many|ban') THEN 'quarantine'
WHEN regexp_matches(t, 'null|drift|schema|field|missing path|parse|selector|json path|jsonpath|no listings') THEN 're_receta'
ELSE 'escalate_owner' END AS action
FROM (SELECT doc_id, lower(coalesce(text, '')) AS t, CASE doc_id % 40 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 500 END AS st FROM documents)"""


@Q("f33_repair_action", _F33)
def _(x):
    status = F.when(F.col("doc_id") % 40 == 0, 403).when(F.col("doc_id") % 40 == 1, 429).when(F.col("doc_id") % 40 == 2, 500)
    return x.table("documents").select("doc_id", N.repair_action(F.col("text"), status).alias("action"))


@Q("f35_price_drop", "SELECT k, CAST(CASE WHEN offer < price THEN price - offer END AS DECIMAL(12,2)) AS amount FROM (SELECT k, price, CAST(price - CASE WHEN k % 3 = 0 THEN 100 ELSE 0 END AS DECIMAL(12,2)) AS offer FROM old_car)")
def _(x):
    """F35 and D19."""
    offer = (F.col("price") - F.when(F.col("k") % 3 == 0, 100).otherwise(0)).cast("decimal(12,2)")
    return x.old_car.select("k", N.price_drop(F.col("price"), offer)["amount"].alias("amount"))


# --- deltas and state

_BOTH = "b AS (SELECT coalesce(o.k, n.k) AS k, o.k AS ok, n.k AS nk, o.status, o.price AS op, n.price AS np, o.km AS okm, n.km AS nkm, o.photo_url AS oph, n.photo_url AS nph FROM old_car o FULL JOIN new_car n ON o.k = n.k), c AS (SELECT *, ok IS NOT NULL AND nk IS NOT NULL AND np IS NOT NULL AND op IS NOT NULL AND op <> np AS c1, ok IS NOT NULL AND nk IS NOT NULL AND nkm IS NOT NULL AND okm IS NOT NULL AND okm <> nkm AS c2, ok IS NOT NULL AND nk IS NOT NULL AND nph IS NOT NULL AND oph IS DISTINCT FROM nph AS c3 FROM b)"
_EVENTS = "SELECT k, 'NEW' AS event, CAST(NULL AS VARCHAR) AS old_value, CAST(np AS VARCHAR) AS new_value FROM c WHERE ok IS NULL UNION ALL SELECT k, '{gone}', CAST(op AS VARCHAR), NULL FROM c WHERE nk IS NULL AND status = 'available' UNION ALL SELECT k, 'PRICE_CHANGE', CAST(op AS VARCHAR), CAST(np AS VARCHAR) FROM c WHERE c1 UNION ALL SELECT k, 'KM_CHANGE', CAST(okm AS VARCHAR), CAST(nkm AS VARCHAR) FROM c WHERE c2 UNION ALL SELECT k, 'PHOTO_CHANGE', oph, nph FROM c WHERE c3 UNION ALL SELECT k, 'UNCHANGED', NULL, NULL FROM c WHERE ok IS NOT NULL AND nk IS NOT NULL AND NOT (c1 OR c2 OR c3)"


@Q("d1_reconcile", f"WITH {_BOTH} {_EVENTS.format(gone='GONE')}")
def _(x):
    return delta.reconcile(x.old_car, x.new_car, ["k"], "seq")


@Q("d3_suppressed", f"WITH {_BOTH}, e AS ({_EVENTS.format(gone='GONE_SUPPRESSED')}) SELECT event, count(*) AS n FROM e GROUP BY 1")
def _(x):
    """A declared total far above what was harvested closes the guard."""
    return delta.reconcile(x.old_car, x.new_car, ["k"], "seq", declared=10**9).groupBy("event").agg(F.count("*").alias("n"))


@Q("d2_guard", "SELECT o_orderkey, CASE WHEN declared IS NOT NULL THEN h >= 0.95 * declared WHEN prev IS NULL OR prev = 0 THEN true ELSE h >= 0.5 * prev END AS allow FROM (SELECT o_orderkey, o_orderkey % 100 AS h, CASE WHEN o_orderkey % 3 = 0 THEN 100 END AS declared, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 150 END AS prev FROM orders)")
def _(x):
    k = F.col("o_orderkey")
    return x.table("orders").select("o_orderkey", delta.guard(k % 100, F.when(k % 3 == 0, F.lit(100)), F.when(k % 5 != 0, k % 150)).alias("allow"))


@Q("d1_snapshot", "SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN 'available' ELSE 'gone' END AS status, coalesce(n.price, o.price) AS price, coalesce(n.km, o.km) AS km FROM old_car o FULL JOIN new_car n ON o.k = n.k")
def _(x):
    return delta.apply_snapshot(x.old_car, x.new_car, ["k"], "seq").select("k", "status", "price", "km")


@Q("d1_idempotent", "SELECT 0 AS changes")
def _(x):
    """A second reconciliation of the applied snapshot finds nothing new, gone or changed."""
    now = delta.apply_snapshot(x.old_car, x.new_car, ["k"], "seq")
    again = delta.reconcile(now.where("status = 'available'"), x.new_car, ["k"], "seq")
    return again.agg(F.count_if(F.col("event") != "UNCHANGED").cast("int").alias("changes"))


@Q("d4_edge_price", "SELECT o.k, o.price AS old_price, n.price AS new_price FROM old_car o JOIN new_car n ON o.k = n.k WHERE o.price <> n.price")
def _(x):
    return delta.edge_price_events(x.old_car, x.new_car, ["k"])


@Q("d5_landed_events", "SELECT k, 'NEW' AS event FROM new_car ANTI JOIN old_car USING (k)")
def _(x):
    return delta.insert_ignore(x.old_car, x.new_car, ["k"]).select("k", F.lit("NEW").alias("event"))


@Q("d6_aged_out", "SELECT k, true AS removed FROM old_car ANTI JOIN new_car USING (k)")
def _(x):
    return delta.aged_out(x.old_car, x.new_car, ["k"], F.lit(True)).select("k", "removed")


@Q("d7_delta_since", "SELECT event_id, user_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY ORDER BY ts DESC, event_id LIMIT 100")
def _(x):
    e = x.table("events")
    since = e.agg(F.max("ts").alias("m"))
    return e.crossJoin(F.broadcast(since)).where("ts >= m - interval 2 days").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id", "event_type")


_SPELLS = "i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY source_key ORDER BY finished_at, run_id ROWS UNBOUNDED PRECEDING) AS isl FROM run), f AS (SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY source_key, isl ORDER BY finished_at, run_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fails FROM i)"
_RUNS = f"{_SPELLS}, t AS (SELECT *, CASE WHEN fails = 0 THEN 'healthy' WHEN fails < 3 THEN 'degraded' ELSE 'down' END AS status, CASE WHEN fails < 3 THEN 'closed' ELSE 'open' END AS breaker, CAST(CASE WHEN fails >= 3 THEN least(900 * pow(2, fails - 3), 86400) ELSE 0 END AS BIGINT) AS cooldown_s FROM f), w AS (SELECT *, epoch_us(finished_at) + cooldown_s * 1000000 AS until, lag(epoch_us(finished_at) + cooldown_s * 1000000) OVER s AS was, lead(epoch_us(finished_at)) OVER s AS nxt FROM t WINDOW s AS (PARTITION BY source_key ORDER BY finished_at, run_id)), u AS (SELECT *, fails >= 3 AND (fails = 3 OR coalesce(epoch_us(finished_at) >= was, false)) AS tripped FROM w)"


@Q("d8_breaker_state", f"WITH {_RUNS} SELECT source_key, run_id, fails, status, breaker, tripped, cooldown_s FROM u")
def _(x):
    return audit.breaker(x.run).select("source_key", "run_id", "fails", "status", "breaker", "tripped", "cooldown_s")


@Q("d9_breaker_now", f"WITH {_RUNS}, l AS (SELECT source_key, arg_max(breaker, (finished_at, run_id)) AS b, arg_max(fails, (finished_at, run_id)) AS fails, arg_max(until, (finished_at, run_id)) AS until FROM u GROUP BY 1), m AS (SELECT max(finished_at) AS now FROM run) SELECT source_key, fails, CASE WHEN b = 'open' AND epoch_us(now) >= until THEN 'half_open' ELSE b END AS breaker FROM l, m")
def _(x):
    run = x.run.withColumn("finished_at", F.col("finished_at").cast("timestamp"))
    now = run.agg(F.max("finished_at").alias("now"))
    return audit.breaker_now(audit.breaker(run).crossJoin(F.broadcast(now)), F.col("now"))  # one row


@Q("d8_stream_breaker", f"WITH {_RUNS}, n AS (SELECT epoch_us(max(finished_at)) AS now FROM run) SELECT source_key, 'run' AS kind, run_id, fails, status, breaker, tripped, cooldown_s, CAST(epoch_us(finished_at) AS BIGINT) AS at_us FROM u UNION ALL SELECT source_key, 'half_open', NULL, fails, status, 'half_open', NULL, NULL, CAST(until AS BIGINT) FROM u, n WHERE breaker = 'open' AND until <= coalesce(nxt, now)")
def _(x):
    """D8, D9 as a stream with state and timers: each run, and each breaker whose cooldown ended before the next run or the end of the log."""
    out = incremental.stream_health(x.spark, x.sf_dir).where("kind in ('run', 'half_open')")
    return out.select("source_key", "kind", "run_id", "fails", "status", "breaker", "tripped", "cooldown_s", F.unix_micros("at").alias("at_us"))


@Q("d12_stream_alerts", "WITH r AS (SELECT *, CASE WHEN run_id % 4 = 0 THEN 'discover' ELSE 'scrape' END AS phase FROM run), s AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY source_key, phase ORDER BY finished_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sp FROM r) SELECT source_key, phase, CAST(min(epoch_us(finished_at)) FILTER (WHERE NOT ok) AS BIGINT) AS opened_us, 'run ' || arg_max(run_id, (finished_at, run_id)) FILTER (WHERE NOT ok) AS message, count(*) FILTER (WHERE NOT ok) AS raised, CAST(max(epoch_us(finished_at)) FILTER (WHERE ok) AS BIGINT) AS resolved_us FROM s GROUP BY source_key, phase, sp HAVING count(*) FILTER (WHERE NOT ok) > 0")
def _(x):
    """D12, D13 as a stream: the last word on each alert of an origin (source and phase)."""
    rows = incremental.stream_health(x.spark, x.sf_dir).where("kind like 'alert%'")
    last = rows.groupBy("source_key", "phase", F.unix_micros("opened_at").alias("opened_us")).agg(F.max_by("message", "raised").alias("message"), F.max("raised").alias("raised"), F.max(F.when(F.col("kind") == "alert_resolved", F.unix_micros("at"))).alias("resolved_us"))
    return last.select("source_key", "phase", "opened_us", "message", "raised", "resolved_us")


_HEALTH = "h AS (SELECT source_key, max(finished_at) FILTER (WHERE ok) AS last_ok, CAST(24 + 12 * (length(source_key) % 3) AS INTEGER) AS iv, count(*) FILTER (WHERE NOT ok) % 5 AS fails FROM run GROUP BY 1), m AS (SELECT max(finished_at) AS now FROM run)"


def _health(x):
    run = x.run.withColumn("finished_at", F.col("finished_at").cast("timestamp"))
    h = run.groupBy("source_key").agg(F.max(F.when(F.col("ok"), F.col("finished_at"))).alias("last_ok"), (F.count_if(~F.col("ok")) % 5).alias("consecutive_fails"))
    now = run.agg(F.max("finished_at").alias("now"))
    return h.withColumn("harvest_interval_hours", 24 + 12 * (F.length("source_key") % 3)).crossJoin(F.broadcast(now)), F.col("now")  # one row


@Q("d10_due", f"WITH {_HEALTH}, s AS (SELECT source_key, (epoch_us(now) - epoch_us(last_ok)) / 3.6e9 AS hours, iv, fails FROM h, m) SELECT source_key, hours, hours - iv AS overdue FROM s WHERE hours >= iv AND fails < 3")
def _(x):
    return audit.due(*_health(x))


@Q("d11_silent", f"WITH {_HEALTH} SELECT source_key, (epoch_us(now) - epoch_us(last_ok)) / 3.6e9 AS hours_silent FROM h, m WHERE (epoch_us(now) - epoch_us(last_ok)) / 3.6e9 > 2 * iv")
def _(x):
    return audit.silent(*_health(x))


@Q("d12_alerts", "WITH s AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY source_key ORDER BY finished_at, CASE WHEN ok THEN 1 ELSE 0 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sp FROM run) SELECT source_key AS origin, CAST(min(run_id) FILTER (WHERE NOT ok) AS VARCHAR) AS first_message, count(*) FILTER (WHERE NOT ok) AS raised, count(*) FILTER (WHERE ok) > 0 AS resolved FROM s GROUP BY source_key, sp HAVING count(*) FILTER (WHERE NOT ok) > 0")
def _(x):
    """Open alerts are updated in place and closed by a success."""
    run = x.run.select(F.col("source_key").alias("origin"), F.col("finished_at").alias("at"), "ok", "run_id")
    raised = run.where("not ok").select("origin", "at", F.lit("warning").alias("severity"), F.col("run_id").cast("string").alias("message"))
    a = audit.fold_alerts(raised, run.where("ok").select("origin", "at"))
    first = run.where("not ok").groupBy("origin", "at").agg(F.min("run_id").cast("string").alias("first_message"))
    return a.join(first, (a["origin"] == first["origin"]) & (a["opened_at"] == first["at"])).select(a["origin"], "first_message", "raised", F.col("resolved_at").isNotNull().alias("resolved"))


@Q("d14_repair_log", f"SELECT doc_id, action, action IN ('quarantine', 'escalate_owner') AS succeeded, CASE WHEN action IN ('re_receta', 'escalate_owner') THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN action IN ('quarantine', 'escalate_owner') THEN 'applied' ELSE 'pending' END AS outcome, coalesce(d.source || ':', '') || 'scrape' || CASE WHEN doc_id % 3 = 0 THEN ':CDP-' || doc_id ELSE '' END AS origin FROM ({_F33}) f JOIN (SELECT DISTINCT doc_id, source FROM documents) d USING (doc_id)")
def _(x):
    k = F.col("doc_id")
    failures = x.table("documents").select(k, F.col("source").alias("source_key"), F.lit("scrape").alias("phase"), F.when(k % 3 == 0, F.concat(F.lit("CDP-"), k.cast("string"))).alias("cdp_code"), F.col("text").alias("reason"), F.when(k % 40 == 0, 403).when(k % 40 == 1, 429).when(k % 40 == 2, 500).alias("http_status"))
    return audit.repair_log(failures).select("doc_id", "action", "succeeded", "severity", "outcome", "origin")


def _replay(cap: int, trim: int, touch: bool) -> str:
    """The window of each type, one event after the other."""
    end = "list_append([y for y in d if y <> e.id], e.id)" if touch else "CASE WHEN list_contains(d, e.id) THEN d ELSE list_append(d, e.id) END"
    return f"""WITH RECURSIVE e AS (SELECT event_type AS origin, event_id, props AS id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
w AS (SELECT origin, event_id, id, k, false AS seen, [id] AS d FROM e WHERE k = 1
UNION ALL SELECT origin, event_id, id, k, seen, CASE WHEN len(z) > {cap} THEN list_slice(z, len(z) - {trim} + 1, len(z)) ELSE z END FROM (
  SELECT e.origin, e.event_id, e.id, e.k, list_contains(d, e.id) AS seen, {end} AS z FROM w JOIN e ON w.origin = e.origin AND e.k = w.k + 1))
SELECT origin, event_id, seen, len(d) AS held FROM w"""


@Q("d16_bounded_seen", _replay(40, 25, False))
def _(x):
    """First in, first out: beyond 40 payloads of a type the oldest go, down to 25."""
    return incremental.stream_window_of_ids(x.spark, x.sf_dir, 40, 25).select("origin", F.col("order").alias("event_id"), "seen", "held")


@Q("d16_lru_cache", _replay(30, 30, True))
def _(x):
    """Least recently used: a payload that comes again is young again; beyond 30 the oldest goes."""
    return incremental.stream_window_of_ids(x.spark, x.sf_dir, 30, touch=True).select("origin", F.col("order").alias("event_id"), "seen", "held")


@Q("d15_stream_dedup", "SELECT props, count(*) > 0 AS seen FROM events GROUP BY 1")
def _(x):
    return incremental.stream_first_seen(x.spark, x.sf_dir).select("props").distinct().withColumn("seen", F.lit(True))


@Q("d7_stream_log", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(x):
    return incremental.stream_log(x.spark, x.sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@Q("d1_stream_reconcile", f"WITH {_BOTH}, e AS ({_EVENTS.format(gone='GONE')}) SELECT event, count(*) AS n FROM e GROUP BY 1")
def _(x):
    return incremental.stream_reconcile(x.spark, x.old_car, x.new_car, ["k"], "seq").groupBy("event").agg(F.count("*").alias("n"))


@Q("x1_stream_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(x):
    """Extension: event-time windows over the log."""
    return incremental.stream_windows(x.spark, x.sf_dir)


# --- identity

_FIRMA = f"p AS (SELECT *, {_PHOTO.format(c='photo_url')} AS pk, {_key('title')} AS tk FROM car), fi AS (SELECT a.vehicle_ulid AS a, b.vehicle_ulid AS b FROM p a JOIN p b ON lower(trim(a.make)) = lower(trim(b.make)) AND lower(trim(a.model)) = lower(trim(b.model)) AND a.year = b.year AND a.km = b.km AND a.province_code = b.province_code AND a.vehicle_ulid < b.vehicle_ulid WHERE a.price > 0 AND b.price > 0 AND abs(a.price - b.price) <= 0.02 * least(a.price, b.price) AND (a.entity_ulid = b.entity_ulid OR (a.tk = b.tk AND a.tk <> ''))), ph AS (SELECT a.vehicle_ulid AS a, b.vehicle_ulid AS b FROM p a JOIN p b ON a.pk = b.pk AND a.vehicle_ulid < b.vehicle_ulid), ed AS (SELECT coalesce(fi.a, ph.a) AS a, coalesce(fi.b, ph.b) AS b, CASE WHEN fi.a IS NOT NULL AND ph.a IS NOT NULL THEN 'both' WHEN ph.a IS NOT NULL THEN 'photo_url' ELSE 'firma' END AS signal FROM fi FULL JOIN ph ON fi.a = ph.a AND fi.b = ph.b)"
_REACH = "reach AS (SELECT {id} AS s, {id} AS t FROM {rel} UNION SELECT r.s, e.t FROM reach r JOIN sym e ON r.t = e.s), comp AS (SELECT s AS id, min(t) AS cluster, count(*) AS size FROM reach GROUP BY 1)"


@Q("g2_vehicle_edges", f"WITH {_FIRMA} SELECT a, b, signal FROM ed WHERE signal <> 'photo_url'")
def _(x):
    return resolve.vehicle_edges(x.car).where("signal <> 'photo_url'")


_G3 = f"{_FIRMA}, sym AS (SELECT a AS s, b AS t FROM ed UNION SELECT b, a FROM ed), {_REACH.format(id='vehicle_ulid', rel='car')}, best AS (SELECT c.cluster, max(CASE signal WHEN 'both' THEN 3 WHEN 'photo_url' THEN 2 ELSE 1 END) AS r FROM ed JOIN comp c ON c.id = ed.a GROUP BY 1), head AS (SELECT cluster, arg_min(vehicle_ulid, (first_seen, vehicle_ulid)) AS canonical_ulid FROM comp JOIN car ON vehicle_ulid = id GROUP BY 1), g AS (SELECT id AS vehicle_ulid, size AS cluster_size, CASE coalesce(r, 0) WHEN 3 THEN 'both' WHEN 2 THEN 'photo_url' WHEN 1 THEN 'firma' ELSE 'none' END AS match_signal, canonical_ulid FROM comp LEFT JOIN best USING (cluster) JOIN head USING (cluster))"


@Q("g3_vehicle_clusters", f"WITH {_G3} SELECT vehicle_ulid, cluster_size, match_signal, canonical_ulid FROM g")
def _(x):
    return resolve.vehicle_clusters(x.car, resolve.vehicle_links(x.car)).select("vehicle_ulid", "cluster_size", "match_signal", "canonical_ulid")


@Q("flagship_clusters_by_province", f"WITH {_G3} SELECT car.province_code, match_signal, count(*) AS listings, count(DISTINCT canonical_ulid) AS vehicles FROM g JOIN car USING (vehicle_ulid) GROUP BY 1, 2")
def _(x):
    out = resolve.vehicle_clusters(x.car, resolve.vehicle_links(x.car)).join(x.car.select("vehicle_ulid", "province_code"), "vehicle_ulid")
    return out.groupBy("province_code", "match_signal").agg(F.count("*").alias("listings"), F.count_distinct("canonical_ulid").alias("vehicles"))


_RICH = "((CASE WHEN length(trim(website)) > 0 THEN 1 ELSE 0 END) + (CASE WHEN length(trim(phone)) > 0 THEN 1 ELSE 0 END) + (CASE WHEN length(trim(address)) > 0 THEN 1 ELSE 0 END) + (CASE WHEN length(trim(cif)) > 0 THEN 1 ELSE 0 END) + (CASE WHEN lat IS NOT NULL THEN 1 ELSE 0 END))"
_RANKED = f"-(CASE source_group WHEN 'oem_dealer_network' THEN 10 WHEN 'association' THEN 9 WHEN 'official_registry' THEN 8 WHEN 'marketplace_motor' THEN 7 WHEN 'directory' THEN 6 ELSE 1 END), -{_RICH}"
_DEALER = f"d AS (SELECT entity_ulid, cdp_code, municipality_code, nullif({_name('trade_name')}, '') AS nk, CASE WHEN length({_digits('phone')}) >= 7 THEN {_digits('phone')} END AS pk, {_host('website')} AS hk FROM entity)"
_DEDGE = "de AS (SELECT a.entity_ulid AS a, b.entity_ulid AS b, 'name' AS signal FROM d a JOIN d b ON a.municipality_code = b.municipality_code AND a.nk = b.nk AND a.entity_ulid < b.entity_ulid UNION SELECT a.entity_ulid, b.entity_ulid, 'phone' FROM d a JOIN d b ON a.municipality_code = b.municipality_code AND a.pk = b.pk AND a.entity_ulid < b.entity_ulid UNION SELECT a.entity_ulid, b.entity_ulid, 'website' FROM d a JOIN d b ON a.municipality_code = b.municipality_code AND a.hk = b.hk AND a.entity_ulid < b.entity_ulid UNION SELECT a.entity_ulid, b.entity_ulid, 'fuzzy' FROM d a JOIN d b ON a.municipality_code = b.municipality_code AND a.nk <> b.nk AND a.entity_ulid < b.entity_ulid WHERE length(a.nk) >= 8 AND length(b.nk) >= 8 AND levenshtein(a.nk, b.nk) <= 2)"
#: The same in blocks of at most 500 named rows, as the reference has them.
_DEDGE_500 = _DEDGE[:-1] + " AND a.municipality_code IN (SELECT municipality_code FROM d WHERE nk IS NOT NULL GROUP BY 1 HAVING count(*) <= 500))"


@Q("g4_dealer_edges", f"WITH {_DEALER}, {_DEDGE} SELECT a, b, signal FROM de")
def _(x):
    """G4 and G5."""
    return resolve.dealer_edges(x.entity)


@Q("g6_dealer_clusters", f"WITH {_DEALER}, {_DEDGE_500}, sym AS (SELECT a AS s, b AS t FROM de UNION SELECT b, a FROM de), {_REACH.format(id='entity_ulid', rel='entity')}, head AS (SELECT cluster, arg_min(entity_ulid, ({_RANKED}, coalesce(first_seen, DATE '9999-12-31'), coalesce(cdp_code, 'ZZZZ'), entity_ulid)) AS canonical_ulid FROM comp JOIN entity ON entity_ulid = id GROUP BY 1) SELECT id AS entity_ulid, size AS cluster_size, canonical_ulid FROM comp JOIN head USING (cluster)")
def _(x):
    return resolve.dealer_clusters(x.entity, resolve.dealer_links(x.entity, most=500)).select("entity_ulid", "cluster_size", "canonical_ulid")


_PRINTS = "i AS (SELECT DISTINCT entity_ulid AS id, canonical_vehicle_ulid AS item FROM inventory WHERE km > 0), k AS (SELECT item FROM i GROUP BY 1 HAVING count(*) >= 5), fp AS (SELECT id, item FROM i WHERE item NOT IN (SELECT item FROM k))"


@Q("g7_fingerprints", f"WITH {_PRINTS} SELECT id AS entity_ulid, item AS canonical_vehicle_ulid FROM fp")
def _(x):
    return resolve.fingerprints(x.inventory)


_ADJ = f"""s AS (SELECT entity_ulid AS id, province_code, CASE WHEN length({_digits("phone")}) >= 7 THEN right({_digits("phone")}, 9) END AS pk, {_host("website")} AS hk FROM entity),
pc AS (SELECT pk, count(*) AS n FROM s WHERE pk IS NOT NULL GROUP BY 1), hc AS (SELECT hk, count(*) AS n FROM s WHERE hk IS NOT NULL GROUP BY 1),
{_PRINTS}, z AS (SELECT id, count(*) AS n FROM fp GROUP BY 1),
ov AS (SELECT a, b, n / (p.c + q.c - n) AS jac FROM (SELECT x.id AS a, y.id AS b, count(*) AS n FROM fp x JOIN fp y ON x.item = y.item AND x.id < y.id GROUP BY 1, 2) JOIN (SELECT id, n AS c FROM z) p ON p.id = a JOIN (SELECT id, n AS c FROM z) q ON q.id = b WHERE n / (p.c + q.c - n) >= 0.30),
cand AS (SELECT a, b FROM ov UNION SELECT a.id, b.id FROM s a JOIN s b ON a.province_code = b.province_code AND a.pk = b.pk AND a.id < b.id UNION SELECT a.id, b.id FROM s a JOIN s b ON a.province_code = b.province_code AND a.hk = b.hk AND a.id < b.id),
fl AS (SELECT c.a, c.b, jac, coalesce(x.province_code = y.province_code, false) AS near, coalesce(x.pk = y.pk, false) AS ph, coalesce(pc.n, 0) >= 3 AS crowd, coalesce(x.hk = y.hk, false) AS web, coalesce(hc.n, 0) < 3 AS clean FROM cand c JOIN s x ON x.id = c.a JOIN s y ON y.id = c.b LEFT JOIN ov ON ov.a = c.a AND ov.b = c.b LEFT JOIN pc ON pc.pk = x.pk LEFT JOIN hc ON hc.hk = x.hk),
sg AS (SELECT a, b, jac, CASE WHEN jac >= 0.30 THEN 'fingerprint' || CASE WHEN ph THEN '+phone' ELSE '' END || CASE WHEN web THEN '+website' ELSE '' END WHEN near AND ph AND NOT crowd THEN 'phone' WHEN near AND ph AND crowd AND web AND clean THEN 'phone+website' WHEN near AND web AND clean THEN 'website' END AS signal FROM fl),
ad AS (SELECT a, b, signal, CASE WHEN jac >= 0.30 THEN round(jac, 4) ELSE 1.0 END AS probability FROM sg WHERE signal IS NOT NULL)"""


@Q("g8_adjudication", f"WITH {_ADJ} SELECT a, b, signal, CAST(probability AS DOUBLE) AS probability FROM ad")
def _(x):
    return resolve.adjudicate(x.entity, resolve.fingerprints(x.inventory))


_G9 = f"""WITH {_ADJ}, sym AS (SELECT a AS s, b AS t FROM ad UNION SELECT b, a FROM ad), {_REACH.format(id='entity_ulid', rel='entity')},
rk AS (SELECT c.cluster, signal, CAST(probability AS DOUBLE) AS p, CASE signal WHEN 'phone' THEN 1 WHEN 'website' THEN 1 WHEN 'phone+website' THEN 2 WHEN 'fingerprint' THEN 3 WHEN 'fingerprint+phone+website' THEN 5 ELSE 4 END AS r FROM ad JOIN comp c ON c.id = ad.a),
bs AS (SELECT cluster, arg_min(signal, (-r, signal)) AS signal, max(p) AS probability FROM rk GROUP BY 1),
head AS (SELECT cluster, arg_min(entity_ulid, (-({_RICH} + CASE WHEN municipality_code IS NULL THEN 0 ELSE 1 END), -coalesce(n_vehicles, 0), created_at, entity_ulid)) AS resolved_ulid FROM comp JOIN entity ON entity_ulid = id GROUP BY 1)
SELECT id AS entity_ulid, resolved_ulid, size AS cluster_size, coalesce(bs.signal, 'none') AS signal, bs.probability AS probability FROM comp LEFT JOIN bs USING (cluster) JOIN head USING (cluster)"""


@Q("g9_resolution_clusters", _G9)
def _(x):
    return resolve.resolution_clusters(x.entity, resolve.adjudicate(x.entity, resolve.fingerprints(x.inventory))).select("entity_ulid", "resolved_ulid", "cluster_size", "signal", "probability")


def _sourced(x):
    src = F.when(F.floor(F.col("n") / 8) % 2 == 0, F.array(F.lit("geo"))).otherwise(F.array(F.lit("web"), F.lit("ads")))
    return x.entity.withColumn("source_keys", src)


_CROSS = f"""s AS (SELECT entity_ulid AS id, municipality_code AS mu, (n // 8) % 2 AS g, nullif({_name("trade_name")}, '') AS nk, CASE WHEN length({_digits("phone")}) >= 9 THEN right({_digits("phone")}, 9) END AS pk, {_host("website")} AS hk, coalesce(regexp_matches(trade_name, '(?i)(flexicar|ocasionplus|clicars|carplus|stellantis|mobility.?centro|grupo\\s+\\w+\\s+motor|bmw\\s+premium|mercedes.benz\\s+\\w+)'), false) AS chain FROM entity),
h AS (SELECT a.id AS a, b.id AS b, coalesce(a.pk = b.pk, false) AS p, coalesce(a.hk = b.hk, false) AS w, coalesce(a.nk = b.nk AND length(a.nk) >= 6 AND NOT a.chain AND NOT b.chain, false) AS m, a.nk AS an, b.nk AS bn FROM s a JOIN s b ON a.mu = b.mu AND a.id < b.id AND a.g <> b.g),
t AS (SELECT *, list_distinct([substr(an, i, 3) for i in range(1, length(an) - 1)]) AS ta, list_distinct([substr(bn, i, 3) for i in range(1, length(bn) - 1)]) AS tb FROM h WHERE p OR w OR m)
SELECT a, b, CAST(CASE WHEN CAST(p AS INT) + CAST(w AS INT) + CAST(m AS INT) >= 2 THEN 0.99 WHEN w THEN 0.98 WHEN m THEN 0.82 WHEN length(an) >= 3 AND length(bn) >= 3 AND len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) < 0.15 THEN 0.75 ELSE 0.97 END AS DOUBLE) AS probability FROM t"""


@Q("g10_cross_source_edges", f"WITH {_CROSS}")
def _(x):
    return resolve.cross_source_edges(_sourced(x), ["geo"], ["web"]).select("a", "b", F.col("probability").cast("double").alias("probability"))


_A21 = _CROSS.replace("\nSELECT a, b, CAST(", ",\nce AS (SELECT p, w, CAST(", 1) + ")"


@Q("a21_match_tiers", f"WITH {_A21} SELECT CASE WHEN p AND w THEN 'phone+website' WHEN p THEN 'phone' WHEN w THEN 'website' ELSE 'name' END AS signal, CASE WHEN probability >= 0.95 THEN 'high' WHEN probability >= 0.80 THEN 'medium' ELSE 'low' END AS tier, count(*) AS pairs FROM ce GROUP BY 1, 2")
def _(x):
    return resolve.match_tiers(resolve.cross_source_edges(_sourced(x), ["geo"], ["web"]))


_G11 = f"""WITH {_CROSS.replace("\nSELECT a, b, CAST(", ",\nce AS (SELECT a, b, CAST(", 1)}), sym AS (SELECT a AS s, b AS t FROM ce UNION SELECT b, a FROM ce), {_REACH.format(id='entity_ulid', rel='entity')},
head AS (SELECT cluster, arg_min(entity_ulid, ({_RANKED}, created_at, coalesce(cdp_code, 'ZZZZ'), entity_ulid)) AS canonical_ulid FROM comp JOIN entity ON entity_ulid = id GROUP BY 1)
SELECT id AS entity_ulid, canonical_ulid, size AS cluster_size, probability AS match_probability FROM comp JOIN head USING (cluster) LEFT JOIN ce ON (ce.a = id AND ce.b = canonical_ulid) OR (ce.b = id AND ce.a = canonical_ulid)"""


@Q("g11_cross_source_clusters", _G11)
def _(x):
    return resolve.cross_source_clusters(_sourced(x), ["geo"], ["web"])


_VIN = "mv AS (SELECT vehicle_ulid AS folded, survivor FROM (SELECT vehicle_ulid, first_value(vehicle_ulid) OVER (PARTITION BY upper(vin) ORDER BY first_seen, vehicle_ulid) AS survivor FROM vehicle WHERE length(vin) = 17) WHERE vehicle_ulid <> survivor)"


def _vins(x):
    return resolve.merge_map(x.vehicle.where("length(vin) = 17").withColumn("vin", F.upper("vin")), "vin", "vehicle_ulid", "first_seen")


@Q("g12_vin_merge", f"WITH {_VIN} SELECT folded, survivor FROM mv")
def _(x):
    return _vins(x)


@Q("g12_moved_edges", f"WITH {_VIN} SELECT DISTINCT coalesce(survivor, vehicle_ulid) AS vehicle_ulid, platform_ulid FROM edge LEFT JOIN mv ON vehicle_ulid = folded")
def _(x):
    return resolve.move_edges(x.edge, _vins(x), "vehicle_ulid", "platform_ulid", blocking.tasks(x.table("lineitem"))).select("vehicle_ulid", "platform_ulid")


@Q("g13_two_paths", "WITH g AS (SELECT l_partkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 2) SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS by_groups, CAST(coalesce(sum(n), 0) - count(*) AS BIGINT) AS by_pairs FROM g")
def _(x):
    """The bound by an aggregate, and again from distinct pairs."""
    one = resolve.excess(x.table("lineitem"), ["l_partkey", "l_quantity"], "l_suppkey").select(F.col("excess").alias("by_groups"))
    by, pair = ["l_partkey", "l_quantity"], ["l_partkey", "l_quantity", "l_suppkey"]
    n = blocking.tasks(x.table("lineitem"))
    parts = blocking.spread(x.table("lineitem").select(*pair), by, n).groupBy(*pair, "_part").agg(F.count("*").alias("c"))
    rows = parts.repartition(n, *by).groupBy(*pair).agg(F.sum("c").alias("c"))
    two = rows.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("p")).where("p >= 2").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("by_pairs"))
    return one.crossJoin(two)  # one row each


@Q("g14_link_merge", "SELECT vehicle_ulid AS folded, survivor FROM (SELECT vehicle_ulid, first_value(vehicle_ulid) OVER (PARTITION BY substr(deep_link, 1, 29) ORDER BY first_seen, vehicle_ulid) AS survivor FROM vehicle) WHERE vehicle_ulid <> survivor")
def _(x):
    return resolve.merge_map(x.vehicle.withColumn("link", F.expr("substr(deep_link, 1, 29)")), "link", "vehicle_ulid", "first_seen")


@Q("g15_superseded", "SELECT v.vehicle_ulid FROM vehicle v WHERE v.status = 'gone' AND EXISTS (SELECT 1 FROM vehicle t WHERE t.status <> 'gone' AND t.vin = v.vin)")
def _(x):
    return resolve.superseded(x.vehicle.where("status = 'gone'"), x.vehicle.where("status <> 'gone'"), "vin", "vehicle_ulid")


_G3_PARTS = f"{_FIRMA}, sym AS (SELECT a AS s, b AS t FROM ed UNION SELECT b, a FROM ed), {_REACH.format(id='vehicle_ulid', rel='car')}"


@Q("g16_sanity", f"WITH {_G3_PARTS}, pv AS (SELECT cluster, count(DISTINCT e.province_code) AS n FROM comp JOIN car ON vehicle_ulid = id LEFT JOIN entity e ON e.entity_ulid = car.entity_ulid GROUP BY 1) SELECT (SELECT count(*) FROM pv WHERE n > 1) AS cross_province, (SELECT count(DISTINCT cluster) FROM comp WHERE size > 20) AS giants, (SELECT count(*) FROM car) - (SELECT count(*) FROM comp) AS uncovered, (SELECT count(*) FROM comp) - (SELECT count(DISTINCT id) FROM comp) AS repeated, (SELECT count(*) FROM comp WHERE size = 1 AND id IN (SELECT a FROM ed UNION SELECT b FROM ed)) AS singletons_with_signal")
def _(x):
    """Cars: clusters of two provinces, giants, cars covered not once, single cars with a signal."""
    return resolve.vehicle_sanity(x.car, resolve.vehicle_clusters(x.car, resolve.vehicle_links(x.car)), x.entity)


_G6_PARTS = f"{_DEALER}, {_DEDGE}, sym AS (SELECT a AS s, b AS t FROM de UNION SELECT b, a FROM de), {_REACH.format(id='entity_ulid', rel='entity')}, j AS (SELECT comp.cluster, comp.size, e.* FROM comp JOIN entity e ON e.entity_ulid = comp.id)"
_G6_PARTS_500 = _G6_PARTS.replace(_DEDGE, _DEDGE_500)


@Q("g16_dealer_sanity", f"WITH {_G6_PARTS}, g AS (SELECT count(DISTINCT cluster) AS c FROM j WHERE kind <> 'particular' AND municipality_code IS NOT NULL GROUP BY source_group, trade_name, municipality_code HAVING count(*) > 1), fp AS (SELECT cluster FROM j GROUP BY 1 HAVING count(DISTINCT municipality_code) > 1 AND count(DISTINCT nullif(website, '')) = 0 AND count(DISTINCT nullif(phone, '')) = 0 AND max(size) > 1), ch AS (SELECT count(DISTINCT cluster) AS c, count(DISTINCT municipality_code) AS m FROM j WHERE trade_name ILIKE '%flexicar%' AND kind <> 'particular') SELECT count(*) AS same_name_groups, count(*) FILTER (WHERE c = 1) AS same_name_merged, (SELECT count(*) FROM fp) AS unsupported, (SELECT c FROM ch) AS chain_canonicals, (SELECT m FROM ch) AS chain_municipalities, (SELECT max(size) FROM j) AS largest FROM g")
def _(x):
    """Sellers: equal names of a source and municipality that are one cluster, clusters over municipalities without any website or phone, and whether
    a chain stays apart by municipality."""
    return resolve.dealer_sanity(x.entity, resolve.dealer_clusters(x.entity, resolve.dealer_links(x.entity)), "%flexicar%")


@Q("g16_short_names", f"WITH {_G6_PARTS}, o AS (SELECT lower(trade_name) AS nm, cluster FROM j WHERE lower(trade_name) IN ('flexicar 1', 'flexicar 2')), sh AS (SELECT cluster FROM o GROUP BY 1 HAVING count(DISTINCT nm) > 1) SELECT count(*) AS rows, count(DISTINCT cluster) AS canonicals, CASE WHEN count(DISTINCT nm) = 2 THEN (SELECT count(*) FROM sh) = 0 END AS apart FROM o")
def _(x):
    """Two short names that differ by one character stay apart."""
    return resolve.short_names_apart(x.entity, resolve.dealer_clusters(x.entity, resolve.dealer_links(x.entity)), "Flexicar 1", "FLEXICAR 2")


@Q("g16_suffix_variants", f"WITH {_G6_PARTS_500} SELECT municipality_code, count(*) AS rows, count(DISTINCT cluster) AS canonicals, count(DISTINCT cluster) = 1 AS merged FROM j WHERE trade_name ILIKE 'talleres%garc%a 1%' AND municipality_code IS NOT NULL GROUP BY 1")
def _(x):
    """Names like one pattern, by municipality."""
    return resolve.suffix_variants(x.entity, resolve.dealer_clusters(x.entity, resolve.dealer_links(x.entity, most=500)), "talleres%garc%a 1%")


@Q("a21_source_pairs", f"WITH {_A21.replace('ce AS (SELECT p, w,', 'ce AS (SELECT a, b, p, w,')}, u AS (SELECT list_distinct(list_concat(CASE x.g WHEN 0 THEN ['geo'] ELSE ['web', 'ads'] END, CASE y.g WHEN 0 THEN ['geo'] ELSE ['web', 'ads'] END)) AS src FROM ce JOIN s x ON x.id = a JOIN s y ON y.id = b), hb AS (SELECT unnest(list_concat(['*'], [z for z in src if z <> 'geo'])) AS source FROM u WHERE list_contains(src, 'geo')) SELECT source, count(*) AS pairs FROM hb GROUP BY 1")
def _(x):
    rows = _sourced(x)
    return resolve.source_pairs(rows, resolve.cross_source_edges(rows, ["geo"], ["web"]), "geo")


@Q("a28_global_recount", "WITH c AS (SELECT (SELECT count(*) FROM vehicle WHERE status = 'available') AS v, (SELECT count(DISTINCT vehicle_ulid) FROM edge) AS r, (SELECT count(*) FROM edge) AS t), d AS (SELECT *, CASE WHEN greatest(v, r, t) = 0 THEN 0.0 ELSE (greatest(v, r, t) - least(v, r, t)) / greatest(v, r, t) END AS divergence FROM c) SELECT 'vehicle_total' AS subject, v AS vehicle_total, r AS edge_reachable, t AS edges_total, CASE WHEN v = r OR v = t OR divergence <= 0.10 THEN 'TRUSTWORTHY' ELSE 'REFUTED' END AS verdict, divergence FROM d")
def _(x):
    return audit.global_recount(x.vehicle, x.edge)


@Q("g16_cross_source_sanity", f"WITH {_A21.replace('ce AS (SELECT p, w,', 'ce AS (SELECT a, b, p, w,')} SELECT count(*) AS edges, count(*) FILTER (WHERE x.g = y.g) AS intra_source, count(*) FILTER (WHERE NOT p AND NOT w AND (x.chain OR y.chain)) AS chain_name_only FROM ce JOIN s x ON x.id = a JOIN s y ON y.id = b")
def _(x):
    """Pairs across sources: pairs of one source, and chains linked by their name alone."""
    rows = _sourced(x)
    return resolve.cross_source_sanity(rows, resolve.cross_source_edges(rows, ["geo"], ["web"]))


# --- serving

_CANON = "canon AS (SELECT entity_ulid, min(entity_ulid) OVER (PARTITION BY phone, province_code) AS canonical_ulid FROM entity WHERE phone IS NOT NULL AND province_code IS NOT NULL)"


def _overlay(x):
    own = x.entity.where("phone is not null and province_code is not null")
    head = blocking.canonical_pick(own.withColumn("g", F.concat("phone", "province_code")), "g", "entity_ulid", [])
    return own.withColumn("g", F.concat("phone", "province_code")).join(head, "g").select("entity_ulid", F.col("canonical").alias("canonical_ulid"))


@Q("v1_platforms", "SELECT entity_ulid FROM entity WHERE kind IN ('machinery', 'household') OR coalesce(is_platform_like, false)")
def _(x):
    return serving.platforms(x.entity, ["machinery", "household"]).select("entity_ulid")


@Q("v2_canonical", f"WITH {_CANON} SELECT e.entity_ulid, coalesce(c.canonical_ulid, e.entity_ulid) AS canonical_ulid, h.cdp_code AS canonical_cdp_code FROM entity e LEFT JOIN canon c USING (entity_ulid) JOIN entity h ON h.entity_ulid = coalesce(c.canonical_ulid, e.entity_ulid)")
def _(x):
    """V2-V4."""
    return serving.canonical_view(x.entity, _overlay(x), "entity_ulid", "canonical_ulid", "cdp_code").select("entity_ulid", "canonical_ulid", "canonical_cdp_code")


@Q("q1_health_counts", "SELECT (SELECT count(*) FROM entity WHERE status = 'active') AS entities, count(*) AS vehicles, count(*) FILTER (WHERE status = 'available') AS available FROM vehicle")
def _(x):
    v = x.vehicle.agg(F.count("*").alias("vehicles"), F.count_if(F.col("status") == "available").alias("available"))
    return x.entity.agg(F.count_if(F.col("status") == "active").alias("entities")).crossJoin(v)  # one row each


@Q("q2_cluster_members", f"WITH {_CANON}, v AS (SELECT e.entity_ulid, e.cdp_code, coalesce(c.canonical_ulid, e.entity_ulid) AS canonical_ulid FROM entity e LEFT JOIN canon c USING (entity_ulid)) SELECT entity_ulid, cdp_code, canonical_ulid, entity_ulid = canonical_ulid AS is_canonical FROM v WHERE canonical_ulid = (SELECT canonical_ulid FROM v WHERE cdp_code = 'CDP-000000004')")
def _(x):
    view = serving.canonical_view(x.entity, _overlay(x), "entity_ulid", "canonical_ulid", "cdp_code")
    return serving.cluster_members(view, "entity_ulid", "canonical_ulid", "cdp_code", "CDP-000000004")


@Q("q3_canonical_inventory", f"WITH {_CANON} SELECT coalesce(c.canonical_ulid, e.entity_ulid) AS canonical_ulid, count(DISTINCT e.entity_ulid) AS members, count(v.vehicle_ulid) AS cars FROM entity e LEFT JOIN canon c USING (entity_ulid) LEFT JOIN vehicle v ON v.entity_ulid = e.entity_ulid AND v.status = 'available' GROUP BY 1")
def _(x):
    view = x.entity.select("entity_ulid").join(_overlay(x), "entity_ulid", "left").withColumn("canonical_ulid", F.coalesce("canonical_ulid", "entity_ulid"))
    cars = x.vehicle.where("status = 'available'").groupBy("entity_ulid").agg(F.count("*").alias("c"))
    return view.join(cars, "entity_ulid", "left").groupBy("canonical_ulid").agg(F.count("*").alias("members"), F.coalesce(F.sum("c"), F.lit(0)).alias("cars"))


@Q("q4_cluster_inventory", f"WITH {_CANON} SELECT v.vehicle_ulid, v.price FROM vehicle v JOIN canon c USING (entity_ulid) WHERE v.status = 'available' AND c.canonical_ulid = (SELECT min(canonical_ulid) FROM canon) ORDER BY v.first_seen DESC, v.vehicle_ulid LIMIT 50")
def _(x):
    o = _overlay(x)
    at = o.agg(F.min("canonical_ulid").alias("canonical_ulid"))
    own = x.vehicle.where("status = 'available'").join(o.join(F.broadcast(at), "canonical_ulid", "left_semi"), "entity_ulid", "left_semi")
    return serving.page(own, [F.desc("first_seen"), "vehicle_ulid"]).select("vehicle_ulid", "price")


@Q("q5_entity_delta", "SELECT event_id, event_type, value FROM events WHERE user_id = 3 AND ts >= TIMESTAMP '1990-01-01' ORDER BY ts DESC, event_id LIMIT 100")
def _(x):
    e = x.table("events").where("user_id = 3 and ts >= timestamp'1990-01-01'")
    return e.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "event_type", "value")


@Q("q6_by_province", "SELECT cdp_code, trade_name FROM entity WHERE province_code = '07' ORDER BY municipality_code ASC NULLS LAST, cdp_code LIMIT 50")
def _(x):
    return serving.page(x.entity.where("province_code = '07'"), [F.asc_nulls_last("municipality_code"), "cdp_code"]).select("cdp_code", "trade_name")


@Q("q7_province_tree", "SELECT e.province_code, m.comarca, e.municipality_code, m.name AS municipality, count(*) AS n, count(*) FILTER (WHERE kind = 'building') AS n_building, count(*) FILTER (WHERE kind = 'particular') AS n_particular FROM entity e LEFT JOIN municipality m ON e.municipality_code = m.code WHERE e.province_code IS NOT NULL GROUP BY 1, 2, 3, 4")
def _(x):
    return serving.province_tree(x.municipality, x.entity, ["building", "particular"])


@Q("q8_geo_completeness", "SELECT count(*) AS total, count(municipality_code) AS with_municipality, CASE WHEN count(*) = 0 THEN 0.0 ELSE 100.0 * count(municipality_code) / count(*) END AS pct FROM entity WHERE status <> 'closed'")
def _(x):
    return x.entity.where("status <> 'closed'").agg(F.count("*").alias("total"), F.count("municipality_code").alias("with_municipality"), F.when(F.count("*") == 0, 0.0).otherwise(100.0 * F.count("municipality_code") / F.count("*")).alias("pct"))


@Q("q9_platform_inventory", "SELECT g.vehicle_ulid, g.price, v.status, e.cdp_code, e.trade_name FROM edge g JOIN vehicle v USING (vehicle_ulid) LEFT JOIN entity e ON v.entity_ulid = e.entity_ulid WHERE g.platform_ulid = 'P000000003'")
def _(x):
    return serving.platform_inventory(x.edge, x.vehicle, x.entity, "P000000003")


@Q("q10_vehicle_platforms", "SELECT g.vehicle_ulid, p.platform, g.price, v.entity_ulid AS owner_ulid FROM edge g JOIN platform p USING (platform_ulid) JOIN vehicle v USING (vehicle_ulid) WHERE g.vehicle_ulid = (SELECT min(vehicle_ulid) FROM vehicle)")
def _(x):
    first = x.vehicle.agg(F.min("vehicle_ulid").alias("vehicle_ulid"))
    return serving.vehicle_platforms(x.edge.join(F.broadcast(first), "vehicle_ulid", "left_semi"), x.platform, x.vehicle)  # one row


# --- attribution


_WORDS = f"list_distinct(list_filter(string_split(trim(regexp_replace({_fold('trade_name')}, '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))"
_SIDES = f"k AS (SELECT entity_ulid, n, cdp_code, CASE WHEN length({_digits('phone')}) >= 7 THEN {_digits('phone')} END AS pk, nullif({_name('trade_name')}, '') AS nk, {_WORDS} AS ws FROM entity), l AS (SELECT * FROM k WHERE n % 2 = 0), dr AS (SELECT * FROM k WHERE n % 2 = 1)"


@Q("j25_attribution", f"WITH {_SIDES}, ph AS (SELECT l.entity_ulid AS id, arg_min(dr.cdp_code, dr.n) AS c FROM l JOIN dr ON l.pk = dr.pk GROUP BY 1), na AS (SELECT l.entity_ulid AS id, arg_min(dr.cdp_code, dr.n) AS c FROM l JOIN dr ON l.nk = dr.nk GROUP BY 1), tk AS (SELECT l.entity_ulid AS id, arg_min(dr.cdp_code, dr.n) AS c FROM l JOIN dr ON len(l.ws) > 0 AND len(dr.ws) > 0 AND (list_has_all(dr.ws, l.ws) OR list_has_all(l.ws, dr.ws)) GROUP BY 1) SELECT l.entity_ulid, coalesce(ph.c, na.c, tk.c) AS dealer, CASE WHEN ph.c IS NOT NULL THEN 'phone' WHEN na.c IS NOT NULL THEN 'name' WHEN tk.c IS NOT NULL THEN 'tokens' END AS tier FROM l LEFT JOIN ph ON ph.id = l.entity_ulid LEFT JOIN na ON na.id = l.entity_ulid LEFT JOIN tk ON tk.id = l.entity_ulid")
def _(x):
    listings = x.entity.where("n % 2 = 0").select("entity_ulid", "phone", F.col("trade_name").alias("seller"))
    directory = x.entity.where("n % 2 = 1").select(F.col("n").alias("seq"), F.col("cdp_code").alias("dealer"), "phone", F.col("trade_name").alias("name"))
    return geo.attribute_sellers(listings, directory, "entity_ulid")
