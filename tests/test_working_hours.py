"""Working hours are counted within a row: against a plain loop."""

import random

from burnline.dims import DAY, HOUR
from burnline.operators import projection


def test_working_hours_are_laid_within_the_row(spark):
    """Days were rows of their own, dealt out by moment and joined to it again."""
    rng, rows = random.Random(5), []
    for i in range(300):
        now = 19_700 * DAY + rng.randrange(14 * DAY)
        rows.append((i, now, rng.choice([None, 0.0, -1.0, rng.uniform(0, 60)]), float(now + rng.randrange(-DAY, 8 * DAY)), None))
    out = projection.work_hours_eta(spark.createDataFrame(rows, "k int, now_us bigint, hours double, horizon_us double, eta_us bigint"), ["k"], "UTC", 9.0, 17.0, frozenset(range(5)))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    seen = 0
    for r in out.collect():
        want, left = None, None if r.hours is None else round(r.hours * HOUR)
        if r.hours is not None and r.hours <= 0:
            want = r.now_us
        elif left:
            for day in range(r.now_us // DAY, int(r.horizon_us) // DAY + 1):
                a, b = max(day * DAY + 9 * HOUR, r.now_us), day * DAY + 17 * HOUR
                if (day + 3) % 7 < 5 and b > a:
                    if b - a >= left:
                        want = a + left
                        break
                    left -= b - a
        want = want if want is not None and want < r.horizon_us else None
        seen += want is not None and r.hours > 0
        assert r.work_us == want, r
    assert seen > 20
