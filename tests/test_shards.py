"""What runs along a series is worked out in shards of time: against plain loops, and spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from burnline.dims import HOUR, SERIES
from burnline.operators import alerts, cycles, lookups, scoring
from burnline.operators.folds import ordered_fold
from burnline.queries import Q

SF = "/root/testdata/sf0.001"

READ = "account string, provider string, kind string, ts_us bigint, used double, resets_us bigint, is_estimated boolean"


def series(seed):
    """Readings over many shards, some of them empty, of three series; one account is null."""
    rng, rows = random.Random(seed), []
    for account, provider, kind in (("a", "claude", "w5h"), (None, "claude", "weekly"), ("b", "codex", "weekly")):
        used = 0.0
        for t in sorted(rng.sample(range(-20 * HOUR, 400 * HOUR, HOUR // 7), 120)):
            used = 0.0 if rng.random() < 0.06 else min(100.0, used + rng.choice([0.0, 0.0, 4.0, 15.0]))
            rows.append((account, provider, kind, t, used, rng.choice([None, t + 3 * HOUR]), rng.random() < 0.3))
    return rows


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.ts_us):
        out.setdefault((r.account, r.provider, r.kind), []).append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_series_over_shards_equal_plain_loops(spark, seed):
    seg = cycles.segment(spark.createDataFrame(series(seed), READ), SERIES)
    fated = by_key(scoring.risk_outcome(seg, SERIES).collect())
    state = by_key(cycles.running_state(spark.createDataFrame(series(seed), READ), SERIES).collect())
    assert sum(map(len, fated.values())) == sum(map(len, state.values())) == 360
    for key, rows in fated.items():
        block = opened = rise = fall = full = None
        for i, (r, s) in enumerate(zip(rows, state[key], strict=True)):
            p, n = (rows[i - 1] if i else None), (rows[i + 1] if i + 1 < len(rows) else None)
            assert (r.prev_ts, r.prev_used) == ((p.ts_us, p.used) if p else (None, None))
            block = (block or 0) + r.is_reset
            later = [x.ts_us for x in rows[i + 1 :] if x.block_id == r.block_id and x.used >= 100]
            assert (r.block_id, r.next_full_us, r.last_us, r.last_block) == (block, later[0] if later else None, rows[-1].ts_us, rows[-1].block_id)
            if not p or r.is_reset:
                opened = (r.ts_us, r.used, p.ts_us if p else None, i + 1)
            elif p.used == 0 < r.used:
                rise = (r.ts_us, p.ts_us)
            elif r.used < p.used:
                fall = (r.ts_us, r.used, p.ts_us)
            if r.used >= 100 and (not p or p.used < 100):
                full = r.ts_us
            found = tuple(tuple(x) if x is not None else None for x in (s.open, s.rise, s.fall))
            assert (s.n, s.next_ts, s.next_used, *found, s.full) == (i + 1, n and n.ts_us, n.used if n else None, opened, rise, fall, full)


def test_lookups_over_shards_equal_plain_loops(spark):
    rows, rng = [(k, t, float(t)) for k in ("a", None) for t in range(0, 300 * HOUR, 17 * HOUR)], random.Random(3)
    moments = [(k, i, rng.randrange(-50 * HOUR, 400 * HOUR)) for k in ("a", None) for i in range(60)]
    s, m = spark.createDataFrame(rows, "k string, ts_us bigint, v double"), spark.createDataFrame(moments, "k string, i int, at bigint")
    for forward in (False, True):
        got = {(r.k, r.i): r.o and r.o.ts_us for r in scoring.as_of(m, s, ["k"], "at", ["v"], "o", forward).collect()}
        for k, i, at in moments:
            near = [t for j, t, _ in rows if j == k and (t >= at if forward else t <= at)]
            assert got[k, i] == ((min if forward else max)(near) if near else None)
    each = lookups.as_of_each(m, ["k", "i", "at"], s, ["k"], {"x": F.when(F.col("i") % 2 == 0, F.col("at")), "y": F.col("at") + 30 * HOUR}, ["ts_us"]).collect()
    assert len(each) == len(moments)
    for r in each:
        for found, at in ((r.x, r["at"] if r.i % 2 == 0 else None), (r.y, r["at"] + 30 * HOUR)):
            near = [t for j, t, _ in rows if j == r.k and at is not None and t <= at]
            assert (found and found.ts_us) == (max(near) if near else None)


@pytest.mark.parametrize("step", ["state", "fate", "lookup"])
def test_one_series_is_spread_over_tasks(spark, step):
    """One task sorted all of a series before; the next reading at the cap looked at all later ones anew, with the square of a block."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s = spark.range(2000).select(F.lit("a").alias("account"), F.lit("claude").alias("provider"), F.lit("w5h").alias("kind"), (F.col("id") * (HOUR // 4)).alias("ts_us"), F.lit(50.0).alias("used"), F.lit(None).cast("bigint").alias("resets_us"), F.lit(False).alias("is_estimated"))
        m = s.select(*SERIES, F.col("ts_us").alias("at"))
        out = {"state": lambda: cycles.running_state(s, SERIES), "fate": lambda: scoring.risk_outcome(cycles.segment(s, SERIES), SERIES), "lookup": lambda: scoring.as_of(m, s, SERIES, "at", ["used"], "o")}[step]()
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert "rowframe, 1, unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("name", ["robust_slope", "alert_log", "retained_prediction_linear", "episode_score_linear", "backtest_table_linear"])
def test_tasks_follow_rows(spark, monkeypatch, name):
    """Tasks were as many as Spark's setting, whatever the rows, so that a task's memory grew with them."""
    want = sorted(map(str, Q[name](spark, SF).collect()))
    monkeypatch.setattr(lookups, "MANY_ROWS", 100)
    monkeypatch.setattr(lookups, "TASK_ROWS", 100)
    out = Q[name](spark, SF)
    assert sorted(map(str, out.collect())) == want and want
    if name == "robust_slope":
        assert lookups.tasks(2000) == 20 and out.rdd.getNumPartitions() == 20


def test_lookups_are_dealt_to_as_many_tasks_as_told(spark):
    s = spark.range(2000).select(F.lit("a").alias("k"), (F.col("id") * HOUR).alias("ts_us"), F.col("id").alias("v"))
    m = s.select("k", F.col("ts_us").alias("at"))
    out = lookups.as_of_each(m, ["k", "at"], s, ["k"], {"x": F.col("at")}, ["v"], n=15)
    assert out.rdd.getNumPartitions() == 15 and out.where("x.v * %d = at" % HOUR).count() == 2000


def test_a_fold_over_changes_fires_what_one_over_all_ticks_does(spark, monkeypatch):
    """The fold sorted and read all ticks of a key in one task before."""
    rng, rows, used, resets = random.Random(7), [], 0.0, 5.0
    for i in range(3000):
        used = 0.0 if rng.random() < 0.01 else min(100.0, used + rng.choice([0.0, 0.0, 0.0, 2.0]))
        resets = rng.choice([resets] * 60 + [None, (resets or 0.0) + 2e6, i * 1e7])
        rows.append(("a", rng.choice(["claude", "codex"]), "weekly", i * HOUR // 50, used, resets, "OK", True, i * HOUR // 50 + HOUR, i * HOUR // 50))
    ticks = spark.createDataFrame(rows, "account string, provider string, kind string, now_us bigint, used double, resets_us double, status string, exhausts boolean, eta_us bigint, source_us bigint")
    folded = []
    monkeypatch.setattr(alerts, "ordered_fold", lambda r, *a: folded.append(r.count()) or ordered_fold(r, *a))
    got = sorted(map(tuple, alerts.alert_log(ticks).collect()))
    monkeypatch.setattr(alerts, "changes", lambda inputs, n=None: inputs)
    assert got == sorted(map(tuple, alerts.alert_log(ticks).collect())) and len(got) > 20
    assert folded[1] == 6000 and folded[0] < 2000


def test_tasks_read_little_while_tables_are_written(spark, tmp_path):
    """A task read a share of the whole, 128 MiB at most, and held it all to write its shuffle."""
    from burnline.storage import settle, written

    at, name = str(tmp_path / "many"), "spark.sql.files.maxPartitionBytes"
    spark.range(0, 80, 1, 80).write.parquet(at)
    had = spark.conf.get(name)
    for cut in (written, settle):
        rows = cut(spark.read.parquet(at).withColumn("task", F.spark_partition_id()))
        assert rows.count() == 80 and rows.select("task").distinct().count() >= 10
        assert spark.conf.get(name) == had


def test_moments_without_a_rate_are_the_same(spark):
    """Queries that show no rate fitted slopes all the same."""
    from burnline import queries as q
    from burnline.operators import burn

    d, cols = "/root/testdata/sf0.001", [*q.KEYS, "n_block", "started_us", "anchor_us", "resets_us", "over_tokens"]
    want = sorted(map(str, q._facts(spark, d).select(cols).collect()))
    fit = burn.with_slope
    try:
        burn.with_slope = lambda *a, **k: 1 / 0
        assert sorted(map(str, q._situations(spark, d).select(cols).collect())) == want
        assert q.Q["current_block"](spark, d).count() == len(want)
    finally:
        burn.with_slope = fit


@pytest.mark.parametrize("name", ["dense_score_linear", "dense_score_recorded", "better_model_linear"])
def test_scores_are_computed_by_tasks_that_read_little(spark, name):
    """The last stages read as much as the session's setting says, and a choice graded anew for each of its reads."""
    plan = Q[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" not in plan and "Window" not in plan
