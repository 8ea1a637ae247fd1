"""Clocks of any zone under sessions of any zone, over both clock changes of a year."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from burnline.dims import HOUR
from burnline.functions import times
from burnline.operators import montecarlo, projection

SESSIONS = ["UTC", "America/New_York", "Asia/Kolkata"]
ZONES = ["UTC", "Europe/Berlin", "America/New_York"]
#: Hours around the changes of 2026 in Berlin (29 March, 25 October) and New York (8 March, 1 November).
MOMENTS = [int(datetime(2026, m, d, tzinfo=timezone.utc).timestamp()) + h * 1800 for m, d in ((3, 8), (3, 29), (10, 25), (11, 1)) for h in range(0, 30)] + [0, -86_400, 1_785_000_017]
EPOCH = datetime(1970, 1, 1)


@pytest.fixture(params=SESSIONS)
def session(request, spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


def moments(spark):
    return spark.createDataFrame([(s * 1_000_000,) for s in MOMENTS], "us bigint")


@pytest.mark.parametrize("zone", ZONES)
def test_clocks(session, zone):
    rows = moments(session).select("us", montecarlo.hour_of_week(F.col("us"), zone).alias("hour"), times.day_and_time(F.col("us"), zone).alias("text"), times.utc_text(F.expr("us div 1000000")).alias("utc")).collect()
    for r in rows:
        at = datetime.fromtimestamp(r.us / 1e6, timezone.utc)
        local = at.astimezone(ZoneInfo(zone))
        assert (r.hour, r.text, r.utc) == (local.weekday() * 24 + local.hour, local.strftime("%a %H:%M"), at.strftime("%Y-%m-%dT%H:%M:%SZ"))


@pytest.mark.parametrize("zone", ZONES)
def test_days_on_the_wall(session, zone):
    rows = moments(session).select("us", projection.wall_clock(F.col("us"), F.lit(24.0), zone).alias("later")).collect()
    for r in rows:
        local = datetime.fromtimestamp(r.us / 1e6, ZoneInfo(zone)).replace(tzinfo=None) + timedelta(days=1)
        real = [local.replace(tzinfo=ZoneInfo(zone), fold=f).timestamp() for f in (0, 1)]
        assert r.later / 1e6 in real


def test_work_hours_over_the_change(session):
    """Friday 15:00 in Berlin and 10 hours of work: two on Friday, eight on Monday, after the clocks changed on Sunday."""
    zone = ZoneInfo("Europe/Berlin")
    now = datetime(2026, 3, 27, 15, tzinfo=zone)
    row = session.createDataFrame([("a", int(now.timestamp() * 1e6), 10.0, int((now + timedelta(days=6)).timestamp() * 1e6), 1)], "k string, now_us bigint, hours double, horizon_us bigint, eta_us bigint")
    got = projection.work_hours_eta(row, ["k"], "Europe/Berlin", 9.0, 17.0, frozenset(range(5))).first()
    assert got.work_us == int(datetime(2026, 3, 30, 17, tzinfo=zone).timestamp() * 1e6)


def test_texts_and_phrases(session):
    texts = ["2026-03-29T01:30:00Z", "2026-03-29T01:30:00", "2026-03-29", "2026-03-29T01:30", "2026-03-29 01:30:00.25", "2026-03-29T03:30:00+02:00", "soon", None]
    got = [r.us for r in session.createDataFrame([(t,) for t in texts], "t string").select(times.iso_to_us(F.col("t")).alias("us")).collect()]
    at = int(datetime(2026, 3, 29, 1, 30, tzinfo=timezone.utc).timestamp() * 1e6)
    assert got == [at, at, at - HOUR * 3 // 2, at, at + 250_000, at, None, None]
    now = int(datetime(2026, 10, 24, 20, tzinfo=timezone.utc).timestamp() * 1e6)
    phrases = [("Oct 26 at 9am", "Europe/Berlin", (10, 26, 9)), ("5:30pm", "America/New_York", (10, 24, 17.5)), ("Jan 2 at 12am", "Europe/Berlin", (1, 2, 0)), ("Feb 30 at 1am", "UTC", None), ("9am", "Mars/Base", None)]
    rows = session.createDataFrame([(p, z, now) for p, z, _ in phrases], "p string, z string, now bigint").select(times.reset_phrase_us(F.col("p"), F.col("z"), F.col("now")).alias("us")).collect()
    for r, (_, zone, want) in zip(rows, phrases, strict=True):
        if want is None:
            assert r.us is None
        else:
            m, d, h = want
            local = datetime(2027 if m == 1 else 2026, m, d, int(h), 30 * (h != int(h)), tzinfo=ZoneInfo(zone))
            assert r.us == int(local.timestamp() * 1e6)


def test_timestamps_without_a_zone(session):
    got = session.sql("SELECT timestamp_ntz'2026-03-29 02:30:00.000001' AS a, timestamp_ntz'1969-12-31 23:59:59.5' AS b").select(times.naive_us(F.col("a")).alias("a"), times.naive_us(F.col("b")).alias("b")).first()
    assert (got.a, got.b) == (int((datetime(2026, 3, 29, 2, 30) - EPOCH).total_seconds()) * 1_000_000 + 1, -500_000)
