"""Golden cases of the quota operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnline import config
from burnline.dims import HOUR, SECOND
from burnline.operators import alerts, arbitration, burn, cycles, montecarlo, projection, scoring, store, tokens
from burnline.plans import forecast
from burnline.sources import files

SAMPLES = "account string, provider string, kind string, ts_us bigint, used double, resets_us bigint, is_estimated boolean"
EVENTS = "account string, provider string, request_id string, message_id string, ts_us bigint, model string, input_tokens bigint, output_tokens bigint, cache_creation bigint, cache_read bigint, total_tokens bigint"
NOW = 1_785_000_000 * SECOND


def samples(spark, rows, provider="claude", kind="w5h", estimated=False):
    """rows: (seconds from NOW, used, seconds from NOW of the reset or None)."""
    return spark.createDataFrame([("a", provider, kind, NOW + int(t * SECOND), float(u), None if r is None else NOW + int(r * SECOND), estimated) for t, u, r in rows], SAMPLES)


def events(spark, rows, provider="claude"):
    return spark.createDataFrame([("a", provider, str(i), "m", NOW + int(t * SECOND), "x", n, 0, 0, 0, n) for i, (t, n) in enumerate(rows)], EVENTS)


def origin(spark, used, provider="claude", kind="w5h", given=None, source=0):
    return spark.createDataFrame([("a", provider, kind, NOW, NOW + source * SECOND, float(used), None if given is None else NOW + given * SECOND, False)], "account string, provider string, kind string, now_us bigint, source_us bigint, used double, given_us bigint, is_estimated boolean")


def linear(spark, rows, toks=(), used=None, given=None, **kw):
    s = samples(spark, rows, **kw)
    return forecast.linear(s, events(spark, toks or [(-9e9, 1)], kw.get("provider", "claude")), origin(spark, rows[-1][1] if used is None else used, kw.get("provider", "claude"), kw.get("kind", "w5h"), given, rows[-1][0])).first()


def test_linear_burn(spark):
    r = linear(spark, [(-3600, 40, 9000), (-1800, 50, 9000), (0, 60, 9000)], given=9000)
    assert r.status == "OK" and r.burn_per_hour == pytest.approx(20) and r.eta_us == NOW + 2 * HOUR and r.exhausts


def test_cap_is_strict(spark):
    r = linear(spark, [(-3600, 40, 7200), (-1800, 50, 7200), (0, 60, 7200)], given=7200)
    assert r.eta_us is None and not r.exhausts


@pytest.mark.parametrize(("a", "b", "estimated", "reset"), [(60, 40, False, True), (60, 40, True, False), (60, 3, True, True), (60, 56, False, False)])
def test_reset_predicate(spark, a, b, estimated, reset):
    rows = cycles.segment(samples(spark, [(-60, a, None), (0, b, None)], estimated=estimated), ["account"]).orderBy("ts_us").collect()
    assert rows[1].is_reset is reset and rows[1].block_id == int(reset)


def test_rolling_clear(spark):
    for rows, reset in (([(-60, 17, 100), (0, 0, 100)], False), ([(-60, 100, -30), (0, 3, None)], True)):
        got = cycles.segment(samples(spark, rows, "codex", "weekly"), ["account"]).orderBy("ts_us").collect()
        assert got[1].is_reset is reset


def test_observed_boundary(spark):
    r = linear(spark, [(-2000, 100, None), (-1700, 100, None), (-420, 2, None), (0, 6, None)])
    assert r.resets_us == NOW + (-1700 - 420) / 2 * SECOND + 5 * HOUR


def test_zero_use_boundary_has_no_reset(spark):
    assert linear(spark, [(-2000, 100, None), (-1000, 0, None), (0, 0, None)]).resets_us is None


def test_calibration_span(spark):
    r = linear(spark, [(-1000, 40, None), (0, 50, None)], toks=[(-1000, 900_000), (0, 100_000)])
    assert r.ratio == pytest.approx(10 / 100_000)


def test_rolling_calibration(spark):
    rows = [(-4000, 50, None), (-3000, 20, None), (-2000, 0, None), (-1000, 30, None), (0, 60, None)]
    toks = [(-1500, 2400), (-500, 3000)]
    assert linear(spark, rows, toks, provider="codex", kind="weekly").ratio == pytest.approx(60 / 5400)


def test_overage(spark):
    rows = [(0, 90, None), (900, 100, None), (1800, 100, None)]
    s = samples(spark, [(t - 1800, u, r) for t, u, r in rows])
    f = forecast.facts(s, events(spark, [(-1000, 50), (-900, 75), (-100, 300)]), origin(spark, 100))
    assert f.select(burn.overage_tokens(F.col("used"))).first()[0] == 375
    cost = f.select(burn.overage_cost(F.col("used"), {"claude": (2.0, 1.0, 1.0, 1.0)})).first()[0]
    assert cost == pytest.approx(375 * 2 / 1e6)
    assert f.select(burn.overage_cost(F.col("used"), {"claude": (0.0,) * 4})).first()[0] is None


def test_working_hours(spark):
    friday = 1_784_905_200 * SECOND  # 2026-07-24 15:00 UTC
    row = spark.createDataFrame([("a", friday, 20.0, friday + 24 * 7 * HOUR, friday + 20 * HOUR)], "k string, now_us bigint, hours double, horizon_us bigint, eta_us bigint")
    got = projection.work_hours_eta(row, ["k"], "UTC", 9.0, 17.0, frozenset(range(5))).first().work_us
    assert got == friday + (4 * 24 + 20) * HOUR  # Wednesday 11:00


def test_wall_clock_over_the_autumn_change(spark):
    at = 1_793_498_400 * SECOND  # 2026-11-01 02:00 UTC, 22:00 in New York the evening before
    got = spark.range(1).select(projection.wall_clock(F.lit(at), F.lit(5.0), "America/New_York")).first()[0]
    assert got - at == 6 * HOUR


def test_block_anchor(spark):
    rows = events(spark, [(-6 * 3600 + i * 3600, 1) for i in range(7)]).withColumn("now_us", F.lit(NOW))
    assert tokens.block_anchors(rows, ["account"], 5 * HOUR).first().anchor_us == NOW - HOUR


def test_censored_percentile():
    outcomes = np.array([10.0, 20.0, 30.0] + [100.0] * 7)
    assert montecarlo.censored_percentile(outcomes, 0.5, 100.0) is None and montecarlo.censored_percentile(outcomes, 0.1, 100.0) == 20.0


def test_truth_is_interpolated(spark):
    s = cycles.segment(samples(spark, [(0, 50, 99999), (1800, 55, 99999), (5400, 75, 99999)]), ["account", "provider", "kind"])
    m = spark.createDataFrame([("a", "claude", "w5h", NOW, NOW + HOUR)], "account string, provider string, kind string, made_us bigint, target_us bigint")
    assert scoring.used_at(m, s, ["account", "provider", "kind"], "made_us", "target_us").first().truth == pytest.approx(65.0)


def test_realized_exhaustion(spark):
    s = cycles.segment(samples(spark, [(0, 50, 3600), (1800, 100, 3600)]), ["account"])
    rows = scoring.with_next_exhaustion(s, ["account"]).orderBy("ts_us").select(scoring.realized_hours().alias("h")).collect()
    assert rows[0].h == 0.5 and rows[1].h is None


def test_pooling(spark):
    s = spark.createDataFrame([("m", 100, 1.0, 1.0, 2.0), ("m", 300, 3.0, -1.0, 4.0)], "model string, moments bigint, mae double, bias double, persistence_mae double")
    assert tuple(scoring.pool_scores(s).first()) == ("m", 400, 2.5, -0.5, 3.5)


@pytest.mark.parametrize(("mae", "moments", "persistence", "chosen"), [(1.0, 600, 3.0, "montecarlo"), (1.9, 600, 3.0, "linear"), (1.0, 100, 3.0, "linear"), (1.0, 600, 1.1, "linear")])
def test_model_choice(spark, mae, moments, persistence, chosen):
    s = spark.createDataFrame([("linear", 600, 2.0, 0.0, persistence), ("montecarlo", moments, mae, 0.0, persistence)], "model string, moments bigint, mae double, bias double, persistence_mae double")
    assert scoring.choose_model(s).first().chosen == chosen
    assert scoring.select_model("linear", s)[0] == "linear"
    with pytest.raises(ValueError, match="unknown model"):
        scoring.select_model("holtwinters", s)


def _ticks(spark, rows, provider, kind):
    cols = "account string, provider string, kind string, now_us bigint, source_us bigint, used double, resets_us double, status string, exhausts boolean, eta_us bigint"
    return spark.createDataFrame([("a", provider, kind, NOW + i * SECOND, NOW + i * SECOND, float(u), float(NOW + r * SECOND), "OK", False, None) for i, (u, r) in enumerate(rows)], cols)


@pytest.mark.parametrize(("rows", "provider", "kind", "fires"), [([(89, 9000), (91, 9000), (92, 9000)], "claude", "w5h", [1]), ([(95, 100), (95, 200), (96, 300), (10, 400), (95, 500)], "codex", "weekly", [0, 4]), ([(95, 100), (95, 200)], "claude", "weekly", [0, 1])])
def test_alert_sequences(spark, rows, provider, kind, fires):
    got = alerts.alert_log(_ticks(spark, rows, provider, kind)).where("alert = 'threshold'").orderBy("fired_us").collect()
    assert [(r.fired_us - NOW) // SECOND for r in got] == fires


def test_keep_first_and_last(spark):
    new = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("old", 1, "c")], "key string, seq int, v string")
    assert [tuple(r) for r in store.keep_first(new, new.where("key = 'old'"), ["key"], "seq").collect()] == [("k", 1, "a")]
    assert {r.v for r in store.keep_last(new, ["key"], F.col("seq")).collect()} == {"b", "c"}
    assert store.above_floor(new, 2, "seq").count() == 1


def test_arbitration_depends_on_order(spark):
    rows = [("a", 1, 10, 1.0, None), ("a", 2, 5, 2.0, 1000 * SECOND), ("a", 3, 20, 3.0, 1030 * SECOND), ("a", 4, 30, 4.0, 1090 * SECOND)]
    got = arbitration.arbitrate(spark.createDataFrame(rows, "k string, rank int, ts_us bigint, used double, resets_us bigint"), ["k"]).first()
    assert got.rank == 4


def test_rollout_files(spark, tmp_path):
    lines = [{"timestamp": f"2026-07-24T10:0{i}:00Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 10.0 + i, "output_tokens": 1}, "total_token_usage": {"total_tokens": t}}, "rate_limits": {"primary": {"used_percent": 5.0 + i, "window_minutes": 300, "resets_in_seconds": 60}}}} for i, t in enumerate((11, 11, 30))]
    home = tmp_path / "sessions/2026/07/24"
    home.mkdir(parents=True)
    (home / "rollout-x.jsonl").write_text("\n".join([json.dumps(x) for x in lines] + ["not json", "", '{"payload": {"type": "other"}}']))
    ev = files.rollout_events(files.lines(spark, [str(tmp_path)], "rollout-*.jsonl"))
    assert sorted(r.input_tokens for r in files.rollout_token_events(ev).collect()) == [10, 12]
    r = files.rollout_readings(ev).first()
    assert (r.kind, r.used) == ("w5h", 7.0) and r.resets_us - r.ts_us == 60 * SECOND


def test_cli_text(spark):
    rows = [(NOW, "Current session: 88% used · resets Jul 29 at 5pm (America/New_York)"), (NOW, "Current week (all models): 12.5% used"), (NOW, "Current week (Opus): 3% used"), (NOW, "Current session: 1% used · resets Feb 30 at 5pm (UTC)"), (NOW, "Current session: 2% used · resets 5pm (Mars/Base)")]
    got = files.cli_readings(spark.createDataFrame(rows, "now_us bigint, line string")).collect()
    assert [(r.kind, r.used, r.resets_us is None) for r in got] == [("w5h", 88.0, False), ("weekly", 12.5, True), ("w5h", 1.0, True), ("w5h", 2.0, True)]
    assert got[0].resets_us == 1_785_358_800 * SECOND


def test_rpc_refuses_text(spark):
    body = '{"rateLimits":{"primary":{"usedPercent":"7","windowDurationMins":300},"secondary":{"usedPercent":9,"windowDurationMins":10080,"resetsAt":5}}}'
    got = files.rpc_readings(spark.createDataFrame([(NOW, body)], "now_us bigint, body string")).collect()
    assert [(r.kind, r.used, r.resets_us) for r in got] == [("weekly", 9.0, 5 * SECOND)]


def test_config(tmp_path):
    assert config.load_config(None) == config.Config()
    p = tmp_path / "c.toml"
    for text, message in (("pol = 1", "unknown"), ("[thresholds]\nwarn_percent = -1", "warn_percent"), ("[working_hours]\nstart = '18:00'", "before end")):
        p.write_text(text)
        with pytest.raises(config.ConfigError, match=message):
            config.load_config(str(p))
    p.write_text(config.default_text())
    assert config.load_config(str(p)) == config.Config()
    p.write_text("[thresholds]\nwarn_percent = 0")
    assert config.load_config(str(p)).thresholds.warn_percent == 0
    assert config.time_zone(config.Config(timezone="Europe/Rome")) == "Europe/Rome" and config.time_zone(config.Config())


def test_nothing_else_imports_llm():
    import pathlib

    root = pathlib.Path(config.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "burnline.llm" in p.read_text()]
