"""Ticks: what is stored, forecast, retained and alerted, with settings that act."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from burnline.config import Config, Predictor, Thresholds, Windows
from burnline.dims import HOUR, SECOND
from burnline.plans import tick as ticks

NOW = 1_785_000_000 * SECOND
READ = "account string, provider string, kind string, ts_us bigint, used double, resets_us bigint, is_estimated boolean"
QUICK = replace(Config(), timezone="UTC", predictor=Predictor(model="linear", mc_runs=50))


@pytest.fixture
def feed(spark, tmp_path):
    def one(now, rows, tokens=(), cfg=QUICK, name="store"):
        readings = spark.createDataFrame([("a", p, k, t, float(u), r, False) for p, k, t, u, r in rows], READ)
        events = spark.createDataFrame([("a", "claude", str(t), "m", t, "x", n, 0, 0, 0, n) for t, n in tokens], "account string, provider string, request_id string, message_id string, ts_us bigint, model string, input_tokens bigint, output_tokens bigint, cache_creation bigint, cache_read bigint, total_tokens bigint")
        return ticks.tick(spark, str(tmp_path / name), readings, events, now, cfg)

    one.store = ticks.Store(spark, str(tmp_path / "store"))
    return one


def burst(used, step=HOUR // 4, reset=3 * HOUR):
    return [("claude", "w5h", NOW - (len(used) - 1 - i) * step, u, NOW + reset) for i, u in enumerate(used)]


def test_first_tick(feed):
    got = feed(NOW, burst([40, 50, 60, 70]), [(NOW - HOUR, 1000), (NOW - HOUR // 2, 3000)])
    assert {(r.model, r.status) for r in got.all_forecasts.collect()} == {("linear", "OK"), ("montecarlo", "OK")}
    grid = {(r.provider, r.kind): r.status for r in got.forecasts.collect()}
    assert grid == {("claude", "w5h"): "OK", ("claude", "weekly"): "NO_DATA", ("codex", "w5h"): "NO_DATA", ("codex", "weekly"): "NO_DATA"}
    assert feed.store.samples().count() == 4 and feed.store.token_events().count() == 2
    assert {(r.model, r.status) for r in feed.store.forecasts().collect()} == {("linear", "OK"), ("montecarlo", "OK")}  # no placeholders


def test_rows_read_again_change_nothing(feed):
    rows, tokens = burst([40, 50, 60, 70]), [(NOW - HOUR, 1000)]
    feed(NOW, rows, tokens)
    feed(NOW + SECOND, [(*r[:3], 1.0, r[4]) for r in rows], tokens)
    assert sorted(r.used for r in feed.store.samples().collect()) == [40, 50, 60, 70]
    assert feed.store.token_events().count() == 1


def test_alerts_fire_once_and_again_in_the_next_cycle(feed):
    kinds = lambda t: sorted(r.alert for r in t.alerts.collect())
    assert kinds(feed(NOW, burst([70, 80, 95]))) == ["burn", "threshold"]
    later = NOW + 60 * SECOND
    assert kinds(feed(later, [("claude", "w5h", later, 96, NOW + 3 * HOUR)])) == []
    turned = NOW + 4 * HOUR
    assert kinds(feed(turned, [("claude", "w5h", turned, 93, NOW + 8 * HOUR)])) == ["threshold"]


@pytest.mark.parametrize(("t", "fires"), [(Thresholds(), []), (Thresholds(warn_percent=60), ["threshold"]), (Thresholds(burn_alert_within_hours=3, burn_min_percent=10), ["burn"]), (Thresholds(burn_alert_within_hours=3, burn_min_percent=65), [])])
def test_thresholds_act(feed, t, fires):
    got = feed(NOW, burst([50, 55, 60]), cfg=replace(QUICK, thresholds=t))
    assert sorted(r.alert for r in got.alerts.collect()) == fires


def test_lookback_acts(feed):
    rows = burst([10, 20, 30, 31, 32], step=HOUR // 2)
    burn = lambda p, name: feed(NOW, rows, cfg=replace(QUICK, predictor=p), name=name).all_forecasts.where("model = 'linear'").first().burn_per_hour
    assert burn(Predictor(model="linear", mc_runs=10), "short") == pytest.approx(2)
    assert burn(Predictor(model="linear", mc_runs=10, lookback_minutes_w5h=600), "long") == pytest.approx(11)


def test_watched_windows_and_providers(feed):
    rows = [*burst([40, 50, 60]), ("codex", "weekly", NOW, 30, None)]
    got = feed(NOW, rows, cfg=replace(QUICK, windows=Windows(watch=("weekly",)), claude=replace(QUICK.claude, enabled=False)))
    assert [(r.provider, r.kind) for r in got.forecasts.collect()] == [("codex", "weekly")]


def test_stale_reading_is_idle_and_its_band_is_kept(feed):
    rows = burst([40, 50, 60, 70], reset=4 * HOUR)
    feed(NOW, rows, [(NOW - 30 * HOUR + i * HOUR, 1000) for i in range(30)] + [(NOW - HOUR // 2, 9000)])
    late = NOW + 20 * 60 * SECOND
    got = feed(late, rows[-1:])
    assert got.all_forecasts.where("model = 'linear'").first().status == "IDLE"
    fresh = feed(late + SECOND, rows[-1:], cfg=replace(QUICK, thresholds=Thresholds(stale_after_minutes_w5h=60)))
    assert fresh.all_forecasts.where("model = 'linear'").first().status == "OK"


def test_auto_stays_on_the_default_without_enough_moments(feed, spark):
    feed(NOW, burst([40, 50, 60, 70]))
    assert ticks.choose(spark, feed.store, Config())[0] == "linear"
    assert ticks.choose(spark, feed.store, replace(Config(), predictor=Predictor(model="montecarlo"))) == ("montecarlo", "named in the settings")


def test_notify_survives_a_failing_sender(feed):
    def broken(rows):
        raise RuntimeError("no sender")

    ticks.notify(feed(NOW, burst([70, 80, 95])), broken)


SAVED = "account string, provider string, kind string, model string, made_us bigint, used double, status string, burn_per_hour double, eta_us bigint, p90_us bigint, risk double, predicted_used double, confidence string"


def everything(store):
    frames = (store.samples(), store.token_events(), store.forecasts(), store.alert_state())
    return [sorted(map(str, f.collect())) for f in frames]


def test_a_tick_that_is_run_again_changes_nothing(feed):
    rows, tokens = burst([70, 80, 95]), [(NOW - HOUR, 1000), (NOW - HOUR // 2, 3000)]
    once = feed(NOW, rows, tokens)
    first, fired = everything(feed.store), sorted(map(str, once.alerts.collect()))
    again = feed(NOW, rows, tokens)
    assert everything(feed.store) == first and sorted(map(str, again.alerts.collect())) == fired and fired
    later = NOW + 60 * SECOND
    feed(later, [("claude", "w5h", later, 96, NOW + 3 * HOUR)])
    second = everything(feed.store)
    feed(later, [("claude", "w5h", later, 96, NOW + 3 * HOUR)])
    assert everything(feed.store) == second
    from burnline.operators import scoring

    moments = scoring.matched_moments(feed.store.forecasts(), ["linear", "montecarlo"], F.lit(1.0), ["account", "provider", "kind"])
    assert moments.count() == 4  # both models at both moments


def test_old_days_go_and_states_of_dead_series_too(feed):
    feed(NOW, [*burst([70, 80, 95]), ("codex", "weekly", NOW, 99, NOW + 3 * HOUR)], [(NOW - HOUR, 1000)])
    assert feed.store.alert_state().count() == 4
    late = NOW + 60 * 24 * HOUR
    feed(late, [("claude", "w5h", late, 5, late + HOUR)])
    assert [r.used for r in feed.store.samples().collect()] == [5]
    assert feed.store.token_events().count() == 0
    assert {r.made_us for r in feed.store.forecasts().collect()} == {late}
    assert {r.provider for r in feed.store.alert_state().collect()} == {"claude"}


def test_reset_empties_the_tables_and_sets_a_floor(feed):
    rows, tokens = burst([70, 80, 95]), [(NOW - HOUR, 1000)]
    feed(NOW, rows, tokens)
    assert feed.store.reset(NOW + SECOND) == 3 + 1 + 2 + 2
    assert everything(feed.store) == [[], [], [], []] and feed.store.floor() == NOW + SECOND
    later = NOW + 60 * SECOND  # the logs still hold the old rows
    got = feed(later, [*rows, ("claude", "w5h", later, 96, NOW + 3 * HOUR)], [*tokens, (later, 5)])
    assert [r.used for r in feed.store.samples().collect()] == [96]
    assert [r.total_tokens for r in feed.store.token_events().collect()] == [5]
    assert sorted(r.alert for r in got.alerts.collect()) == ["threshold"]  # armed again


def test_rows_of_disabled_providers_are_not_stored(feed):
    feed(NOW, burst([40, 50]), [(NOW - HOUR, 1000)], cfg=replace(QUICK, claude=replace(QUICK.claude, enabled=False)))
    assert feed.store.samples().count() == 0 and feed.store.token_events().count() == 0


def saved(feed, spark, made, used=73.0, status="OK", eta=None, p90=None):
    at = NOW - 1_000 * SECOND
    rows = [("a", "claude", "w5h", "montecarlo", NOW + made * SECOND, used, status, 1.0, eta and NOW + eta * SECOND, p90 and NOW + p90 * SECOND, None, None, "medium")]
    ticks.Store(spark, feed.store.path, NOW + made * SECOND).write("forecasts", spark.createDataFrame(rows, SAVED), "made_us")
    return at


def band(feed, now, used=73.0):
    got = feed(now, [("claude", "w5h", NOW - 1_000 * SECOND, used, None)])
    assert {r.status for r in got.all_forecasts.collect()} == {"IDLE"}
    return [(r.used, r.eta_us, r.p90_us) for r in got.retained.collect()]


def test_an_idle_tick_recovers_the_saved_band_after_a_restart(feed, spark):
    saved(feed, spark, -500, eta=1_000, p90=2_000)
    want = [(73.0, NOW + 1_000 * SECOND, NOW + 2_000 * SECOND)]
    assert band(feed, NOW) == want
    assert band(feed, NOW + 60 * SECOND) == want  # blank idle rows don't bury it


def test_a_newer_pending_row_hides_the_band(feed, spark):
    saved(feed, spark, -600, eta=1_000, p90=2_000)
    saved(feed, spark, -500, status="RESET_PENDING")
    assert band(feed, NOW) == []


def test_a_band_needs_the_same_level_and_a_coming_eta(feed, spark):
    saved(feed, spark, -500, used=72.0, eta=1_000, p90=2_000)
    assert band(feed, NOW) == []
    assert band(feed, NOW + 1_001 * SECOND, 72.0) == []


def test_a_censored_answer_beats_the_saved_band(feed, spark):
    """A simulation that ran and found no exhaustion is an answer: no older band replaces it."""
    saved(feed, spark, -500, used=10.0, eta=1_000, p90=2_000)
    rows = [("claude", "w5h", NOW - (6 - i) * HOUR // 4 - 1_000 * SECOND, 10.0, NOW + HOUR) for i in range(7)]
    got = feed(NOW, rows)
    sim = got.all_forecasts.where("model = 'montecarlo'").first()
    assert (sim.status, sim.eta_us) == ("IDLE", None) and sim.confidence is not None
    assert got.retained.count() == 0
