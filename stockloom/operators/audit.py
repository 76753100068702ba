"""Audits and keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N


def quorum(paths: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Rows (key, seq, value) -> key, verdict, divergence.  Null values are dropped; the first path is the primary.  Fewer than
    two values: UNVERIFIED.  Divergence is (max - min) / max, 0 if max is 0.  TRUSTWORTHY if the modal value has two votes, no other
    has, and the primary agrees with it, or if the divergence is within the tolerance; else REFUTED."""
    primary = paths.groupBy(key).agg(F.min_by("value", "seq").alias("primary"))
    votes = paths.dropna(subset=["value"]).groupBy(key, "value").agg(F.count("*").alias("v"))
    stats = votes.groupBy(key).agg(F.sum("v").alias("n"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.count_if(F.col("v") >= 2).alias("strong"), F.max_by("value", "v").alias("modal"))
    divergence = F.when(F.col("n") >= 2, F.when(F.col("hi") == 0, 0.0).otherwise((F.col("hi") - F.col("lo")) / F.col("hi")))
    agreed = (F.col("strong") == 1) & F.coalesce(F.col("primary") == F.col("modal"), F.lit(False))
    verdict = F.when(F.coalesce("n", F.lit(0)) < 2, "UNVERIFIED").when(agreed | (divergence <= tolerance), "TRUSTWORTHY").otherwise("REFUTED")
    return primary.join(stats, key, "left").select(key, verdict.alias("verdict"), divergence.alias("divergence"))


def coverage(declared: DataFrame, captured: DataFrame, edges: DataFrame, floor: float = 0.85, ceiling: float = 1.15, tolerance: float = 0.30) -> DataFrame:
    """Declared (source, declared_total, coverage_floor, captured_distinct), captured (source, captured_db) and edges (source, db_edges) ->
    ratio, verdict and the side of an alert.  The quorum (A14) asks the captured rows, the declared total and, where it is known, the
    harvest's own count; edges are ours as well and stay a figure beside it.  Nothing declared: no ratio, counts of 0, UNVERIFIED, no alert."""
    own = declared.join(captured, "source", "left").join(edges, "source", "left").withColumn("_on", F.coalesce(F.col("declared_total") > 0, F.lit(False)))
    own = own.withColumns({c: F.when(F.col("_on"), F.coalesce(c, F.lit(0))).otherwise(0) for c in ("captured_db", "db_edges")})
    paths = own.where("_on").select("source", F.posexplode(F.array(*(F.col(c).cast("long") for c in ("captured_db", "declared_total", "captured_distinct")))).alias("seq", "value"))
    ratio = F.when(F.col("_on"), F.col("captured_db") / F.col("declared_total"))
    alert = F.when(ratio < F.coalesce("coverage_floor", F.lit(floor)), "under").when(ratio > ceiling, "over")
    out = own.join(quorum(paths, "source", tolerance).select("source", "verdict"), "source", "left")
    return out.select("source", "declared_total", "captured_db", "db_edges", ratio.alias("coverage"), F.coalesce("verdict", F.lit("UNVERIFIED")).alias("verdict"), alert.alias("alert"))


def count_verdict(counts: DataFrame, key: str, first: str, second: str, tolerance: float = 0.0) -> DataFrame:
    """Rows of key and two counts -> the same with the quorum's verdict; the first count is the primary."""
    paths = counts.select(key, F.posexplode(F.array(F.col(first).cast("long"), F.col(second).cast("long"))).alias("seq", "value"))
    return counts.join(quorum(paths, key, tolerance), key)


def global_recount(vehicles: DataFrame, edges: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """One row: the live counts of available vehicles (the primary), of vehicles that an edge reaches and of edges, and the quorum's verdict on them."""
    one = vehicles.where("status = 'available'").agg(F.count("*").alias("vehicle_total"))
    two = edges.agg(F.count_distinct("vehicle_ulid").alias("edge_reachable"), F.count("*").alias("edges_total"))
    counts = one.crossJoin(two).withColumn("subject", F.lit("vehicle_total"))  # one row each
    paths = counts.select("subject", F.posexplode(F.array("vehicle_total", "edge_reachable", "edges_total")).alias("seq", "value"))
    return counts.join(quorum(paths, "subject", tolerance), "subject")


def segment_coverage(rows: DataFrame, ratio: float, total: int, place: str = "province_code") -> DataFrame:
    """Rows (place, base, served, leads, people) -> the apportioned denominator round(base x ratio), the share served and the share found
    (served and leads) of it in percent, 0 without one, the verdict, and the place's part of `total` by people; the last row, ES, is the nation.
    Rounding is half to even."""
    even = lambda c: F.bround(c, 0).cast("long")
    people = rows.agg(F.sum("people").alias("_people"))
    own = rows.crossJoin(F.broadcast(people)).select(place, "served", "leads", even(F.col("base") * F.lit(ratio)).alias("want"), even(F.lit(total) * F.col("people") / F.col("_people")).alias("part"))  # one row
    all_ = own.union(own.agg(F.lit("ES"), F.sum("served"), F.sum("leads"), F.sum("want"), F.sum("part")))
    share = lambda n: F.when(F.col("want") > 0, n / F.col("want") * 100).otherwise(0.0)
    pct = share(F.col("served"))
    return all_.select(place, "served", "leads", "want", "part", pct.alias("served_pct"), share(F.col("served") + F.col("leads")).alias("found_pct"), F.when(pct >= 85, "SELLADO").when(pct >= 50, "COB-PARCIAL").otherwise("GAP-CON-CAUSA").alias("verdict"))


#: Actions that cost money, and so are only noted; actions whose alert is critical.
COSTLY = ("refingerprint", "escalate_tier", "re_receta")
CRITICAL = ("re_receta", "escalate_owner")


def repair_log(failures: DataFrame) -> DataFrame:
    """Failures (source_key, phase, cdp_code, reason, http_status) -> the log of repairs: action (F33), whether it is done, the origin (F32) and
    severity of its alert, and the outcome."""
    own = failures.withColumn("action", N.repair_action(F.col("reason"), F.col("http_status")))
    costly = F.col("action").isin(*COSTLY)
    severity = F.when(F.col("action").isin(*CRITICAL), "critical").otherwise("warning")
    return own.withColumns({"succeeded": ~costly, "origin": N.origin_key(F.col("source_key"), F.col("phase"), F.col("cdp_code")), "severity": severity, "outcome": F.when(costly, "pending").otherwise("applied")})


def chapman(overlap: DataFrame) -> DataFrame:
    """Rows with n1, n2, m -> the estimate, its variance and the 95 % interval, clamped at 0."""
    n1, n2, m = (F.col(c).cast("double") for c in ("n1", "n2", "m"))
    est = (n1 + 1) * (n2 + 1) / (m + 1) - 1
    var = (n1 + 1) * (n2 + 1) * (n1 - m) * (n2 - m) / ((m + 1) * (m + 1) * (m + 2))
    half = 1.96 * F.sqrt(F.greatest(var, F.lit(0.0)))
    return overlap.withColumns({"estimate": est, "variance": var, "lo": F.greatest(est - half, F.lit(0.0)), "hi": est + half})


def breaker(runs: DataFrame, source: str = "source_key", at: str = "finished_at", order: str = "run_id", ok: str = "ok", degrade: int = 1, down: int = 3, trip: int = 3, base: int = 900, most: int = 86400) -> DataFrame:
    """D8 as a batch: for each run the failures in a row so far, the source's status, its breaker, whether this run tripped it, and the cooldown.
    A spell is an island of runs without a success.  From `trip` failures on the breaker is open for `base` seconds, doubled for each further failure,
    at most `most`; a failure after the cooldown (half-open by then) trips it anew."""
    by = Window.partitionBy(source).orderBy(at, order)
    island = runs.withColumn("_island", F.sum(F.col(ok).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    fails = F.sum((~F.col(ok)).cast("int")).over(Window.partitionBy(source, "_island").orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0))
    status = F.when(F.col("fails") >= down, "down").when(F.col("fails") >= degrade, "degraded").otherwise("healthy")
    is_open = F.col("fails") >= trip
    cool = F.when(is_open, F.least(F.lit(base) * F.pow(F.lit(2.0), F.col("fails") - trip), F.lit(float(most)))).otherwise(0).cast("long")
    out = island.withColumn("fails", fails).withColumns({"status": status, "breaker": F.when(is_open, "open").otherwise("closed"), "cooldown_s": cool})
    waited = F.unix_micros(F.col(at).cast("timestamp")) >= F.lag(F.unix_micros(F.col(at).cast("timestamp")) + F.col("cooldown_s") * 1_000_000).over(by)
    tripped = is_open & ((F.col("fails") == trip) | F.coalesce(waited, F.lit(False)))
    return out.withColumn("tripped", tripped).select(source, order, at, ok, "fails", "status", "breaker", "tripped", "cooldown_s")


def breaker_now(state: DataFrame, as_of: Column, source: str = "source_key", at: str = "finished_at", order: str = "run_id") -> DataFrame:
    """Each source's breaker at a moment: closed, open, or half_open once the cooldown is over."""
    last = state.groupBy(source).agg(F.max_by(F.struct("breaker", "cooldown_s", F.col(at).alias("at"), "fails", as_of.alias("now")), F.struct(at, order)).alias("s")).select(source, "s.*")
    over = F.unix_micros("now") >= F.unix_micros("at") + F.col("cooldown_s") * 1_000_000
    return last.select(source, "fails", F.when((F.col("breaker") == "open") & over, "half_open").otherwise(F.col("breaker")).alias("breaker"))


def due(health: DataFrame, as_of: Column, fails: int = 3) -> DataFrame:
    """Sources at or beyond their interval with fewer than `fails` failures, most overdue first."""
    hours = F.when(F.col("last_ok").isNull(), F.lit(float("inf"))).otherwise((F.unix_micros(as_of) - F.unix_micros("last_ok")) / 3.6e9)
    own = health.withColumn("hours", hours).where((F.col("hours") >= F.col("harvest_interval_hours")) & (F.col("consecutive_fails") < fails))
    return own.select("source_key", "hours", (F.col("hours") - F.col("harvest_interval_hours")).alias("overdue")).orderBy(F.desc("overdue"), "source_key")


def silent(health: DataFrame, as_of: Column) -> DataFrame:
    """Sources without a success for more than twice their interval."""
    hours = (F.unix_micros(as_of) - F.unix_micros("last_ok")) / 3.6e9
    return health.withColumn("hours_silent", hours).where(F.col("hours_silent") > 2 * F.col("harvest_interval_hours")).select("source_key", "hours_silent")


def fold_alerts(raised: DataFrame, resolved: DataFrame) -> DataFrame:
    """Raised (origin, at, severity, message) and resolved (origin, at) -> alerts.  One open alert for an origin: later
    ones update its message and keep id and severity, until a resolution closes it."""
    both = raised.select("origin", "at", "severity", "message", F.lit(0).alias("k")).unionByName(resolved.select("origin", "at", F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("message"), F.lit(1).alias("k")))
    before = Window.partitionBy("origin").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, -1)
    spell = both.withColumn("spell", F.coalesce(F.sum("k").over(before), F.lit(0)))
    o = F.struct("at", "message", "severity")
    g = spell.groupBy("origin", "spell").agg(
        F.min(F.when(F.col("k") == 0, F.col("at"))).alias("opened_at"),
        F.min_by("severity", F.when(F.col("k") == 0, o)).alias("severity"),
        F.max_by("message", F.when(F.col("k") == 0, o)).alias("message"),
        F.max(F.when(F.col("k") == 1, F.col("at"))).alias("resolved_at"),
        F.count_if(F.col("k") == 0).alias("raised"),
    )
    return g.where("raised > 0").select("origin", "opened_at", "severity", "message", "resolved_at", "raised")


def bisect(rows: DataFrame, value: str, most: int, lo: int, hi: int) -> DataFrame:
    """(lo, hi, n): bands [lo, hi) of an integer column with at most `most` rows each (or of width one), by halving.  Each value is counted
    once, then added to the bands of every level that hold it; a band is kept if it is small enough and the one it came from was not.  Bands
    without rows are kept too; nulls and values out of range are in none."""
    levels = max(hi - lo - 1, 1).bit_length()
    band = lambda x, y: F.struct(x.cast("long").alias("lo"), y.cast("long").alias("hi"))

    def halves(x: Column) -> tuple[Column, Column]:
        mid = F.floor((x["lo"] + x["hi"]) / 2).cast("long")
        return band(x["lo"], mid), band(mid, x["hi"])

    def deeper(path: Column, _: Column) -> Column:
        last = F.element_at(path, -1)
        low, high = halves(last)
        return F.when(last["hi"] - last["lo"] <= 1, path).otherwise(F.concat(path, F.array(F.when(F.col("v") < low["hi"], low).otherwise(high))))

    counts = rows.where(F.col(value).between(lo, hi - 1)).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    whole = band(F.lit(lo), F.lit(hi))
    path = F.reduce(F.sequence(F.lit(1), F.lit(levels)), F.array(whole), deeper)
    held = counts.select(F.explode(path).alias("b"), "c").groupBy("b").agg(F.sum("c").alias("n"))
    large = (F.col("n") > most) & (F.col("b")["hi"] - F.col("b")["lo"] > 1)
    children = held.where(large).select(F.explode(F.array(*halves(F.col("b")))).alias("b"))
    root = rows.sparkSession.range(1).select(whole.alias("b"))
    out = children.union(root).join(held, "b", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(~large)
    return out.select("b.lo", "b.hi", "n")
