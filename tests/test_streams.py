"""The streams over several micro-batches, over a folder of part files, and across a restart, against their batch queries."""

import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from stockloom.operators import audit
from stockloom.plans import catalog
from stockloom.streaming import incremental

from .test_oracles import DATA, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """events.parquet as a folder of four files in the order of time; four more wait beside it."""
    at = tmp_path_factory.mktemp("events")
    os.makedirs(at / "events.parquet")
    os.makedirs(at / "later")
    con = duckdb.connect()
    for i in range(8):
        to = at / ("events.parquet" if i < 4 else "later") / f"part-{i}.parquet"
        con.execute(f"copy (select * exclude (p) from (select *, ntile(8) over (order by ts, event_id) as p from '{DATA}/events.parquet') where p = {i + 1} order by ts, event_id) to '{to}' (format parquet)")
        os.utime(to, (1_700_000_000 + i, 1_700_000_000 + i))
    return at


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df.collect())


def want(name, con):
    rel = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    return names, sorted(tuple(plain(v) for v in r) for r in rel.fetchall())


def test_folders_are_read(spark, parts):
    n = spark.read.parquet(f"{parts}/events.parquet").count()
    assert n > 400 and incremental.stream_log(spark, str(parts)).count() == n
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{parts}/events.parquet/*.parquet'")
    for name in ("d7_stream_log", "d15_stream_dedup", "x1_stream_windows", "d16_bounded_seen", "d16_lru_cache"):
        names, theirs = want(name, con)
        assert rows(catalog.QUERIES[name](spark, str(parts)).select(*names)) == theirs, name


def test_health_and_windows_go_on_after_a_restart(spark, parts, tmp_path):
    """A micro-batch a file; the stream ends, more files come, and it goes on from its checkpoint."""
    at = tmp_path / "tables"
    shutil.copytree(parts / "events.parquet", at / "events.parquet")
    health, window = (lambda: incremental.stream_health(spark, str(at), 1, str(tmp_path / "h"))), (lambda: incremental.stream_window_of_ids(spark, str(at), 40, 25, False, 1, str(tmp_path / "w")))
    first = health().count()
    window()
    for f in sorted((parts / "later").iterdir()):
        shutil.copy2(f, at / "events.parquet")
    out = health()
    assert out.count() > first
    assert len(spark.read.format("statestore").option("stateVarName", "health").load(str(tmp_path / "h/check")).select("key").distinct().collect()) > 0
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{at}/events.parquet/*.parquet'")
    names, theirs = want("d8_stream_breaker", con)
    assert rows(out.where("kind in ('run', 'half_open')").withColumn("at_us", F.unix_micros("at")).select(*names)) == theirs
    assert any(r[names.index("kind")] == "half_open" for r in theirs)
    names, theirs = want("d16_bounded_seen", con)
    assert rows(window().withColumn("event_id", F.col("order")).select(*names)) == theirs
    # the same runs in one batch table
    run = spark.read.parquet(f"{at}/events.parquet").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_key"), F.col("event_id").alias("run_id"), F.col("ts").alias("finished_at"), (F.col("event_type") != "error").alias("ok"))
    columns = ["source_key", "run_id", "fails", "status", "breaker", "tripped", "cooldown_s"]
    assert rows(audit.breaker(run).select(*columns)) == rows(out.where("kind = 'run'").select(*columns))


def test_a_timer_makes_the_breaker_half_open(spark, tmp_path):
    """Three failures trip it; another source's later run moves the time on, and the timer fires without a run of the first."""
    schema = "source_key string, run_id long, at timestamp, phase string, ok boolean, severity string, message string"
    t = lambda m: f"2025-01-01 {m // 60:02d}:{m % 60:02d}:00"
    runs = [("a", i, t(i), "scrape", False, "warning", f"m{i}") for i in range(3)] + [("b", 9, t(60), "scrape", True, "warning", "")]
    for i, part in enumerate((runs[:3], runs[3:])):
        spark.createDataFrame([tuple(x) for x in part], schema.replace("at timestamp", "at string")).coalesce(1).withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
        from stockloom.streaming import stateful

        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = incremental.drained(stateful.source_health(s), spark, str(tmp_path / "run"))
        found = [(r["source_key"], r["kind"], r["breaker"], r["tripped"]) for r in out.collect()]
        assert ("a", "run", "open", True) in found and (("a", "half_open", "half_open", None) in found) == (i == 1)
    alerts = [(r["kind"], r["raised"], r["message"]) for r in out.where("kind like 'alert%'").orderBy("raised").collect()]
    assert alerts == [("alert_opened", 1, "m0"), ("alert_raised", 2, "m1"), ("alert_raised", 3, "m2")]


def test_a_window_is_fed_batch_by_batch(spark):
    """An origin with many rows reaches its window in Arrow batches, sorted by Spark: no group is handed over whole."""
    from stockloom.streaming import stateful

    ids = spark.range(30000).select(F.lit("o").alias("origin"), (29999 - F.col("id")).alias("order"), (F.col("id") % 7).cast("string").alias("id"))
    out = stateful.bounded_window(ids, None, 10, 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "TransformWithState" not in plan and "FlatMapGroups" not in plan
    assert out.where("window is null").count() == 30000 and out.where("not seen").count() == 7
    (last,) = out.where("window is not null").collect()
    again = stateful.bounded_window(ids.limit(1), spark.createDataFrame([("o", last["window"])], "origin string, window array<string>"), 10, 5).where("window is null").collect()
    assert [r["seen"] for r in again] == [True]


def test_sources_share_the_state_of_their_bucket(spark, tmp_path):
    """Sources meet in a few keys of the store, and each still has its own streak, breaker and alerts over three micro-batches (plainly counted here)."""
    from stockloom.streaming import stateful

    schema = "source_key string, run_id long, at timestamp, phase string, ok boolean, severity string, message string"
    runs = [(None if i % 41 == 0 else f"s{i % 41}", i, 1_700_000_000 + i // 100 * 400, "ab"[i * i % 7 % 2], (i * 7919) % 11 > 6, ("warning", "critical")[i % 2], f"m{i}") for i in range(3600)]
    for k in range(3):
        spark.createDataFrame(runs[k * 1200 : k * 1200 + 1200], schema.replace("at timestamp", "at long")).coalesce(1).withColumn("at", F.timestamp_seconds("at")).write.mode("append").parquet(str(tmp_path / "in"))
        out = incremental.drained(stateful.source_health(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), buckets=4, base=300), spark, str(tmp_path / "run"))
    keys = spark.read.format("statestore").option("stateVarName", "health").load(str(tmp_path / "run/check")).select("key").distinct().count()
    assert 1 < keys <= 4
    end, want, state, alerts = runs[-1][2], [], {}, {}
    half = lambda s, x: (s, "half_open", x[1], None, None, x[0], "half_open", None, None, None, None, None, None)
    for s, i, at, phase, ok, severity, message in runs:
        fails, until = state.get(s, (0, None))
        over = until is not None and at >= until
        want += [half(s, (fails, until))] if over else []
        alert = lambda kind, a: (s, kind, at, i, phase, None, None, None, None, a[1], a[2], a[0], a[3])  # noqa: B023, E731
        cooldown, tripped, old = 0, False, alerts.pop((s, phase), None)
        if ok:
            want += [alert("alert_resolved", old)] if old else []
            state[s] = fails, until = 0, None
        else:
            fails += 1
            alerts[s, phase] = now = (old[0], old[1], message, old[3] + 1) if old else (at, severity, message, 1)
            want.append(alert("alert_raised" if old else "alert_opened", now))
            if fails >= 3:
                cooldown, tripped = min(300 * 2 ** (fails - 3), 86400), until is None or over
                until = at + cooldown
            state[s] = fails, until
        want.append((s, "run", at, i, phase, fails, "open" if fails >= 3 else "closed", tripped, cooldown, None, None, None, None))
    want += [half(s, x) for s, x in state.items() if x[1] is not None and x[1] <= end]
    seconds = lambda c: (F.unix_micros(c) / 1_000_000).cast("long").alias(c)
    found = [tuple(r) for r in out.select("source_key", "kind", seconds("at"), "run_id", "phase", "fails", "breaker", "tripped", "cooldown_s", "severity", "message", seconds("opened_at"), "raised").collect()]
    assert {"half_open", "alert_resolved", "alert_raised"} <= {r[1] for r in want}
    assert sorted(found, key=str) == sorted(want, key=str)
