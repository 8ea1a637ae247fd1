"""The linear model: status ladder, projection, caps and working hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnline.dims import DAY, DENSE_US, DURATION_US, HOUR, STALE_US, by_kind
from burnline.functions.times import clock_us, day_of, instant_us, weekday_of
from burnline.operators.cycles import rate_is_stale


def wall_clock(now_us: Column, hours: Column, tz: str) -> Column:
    """now + hours on the zone's wall clock, in epoch micros: a day is 24 clock hours whatever the season does.

    ETAs follow the clock on the wall, as calendar arithmetic within one zone does."""
    return instant_us(clock_us(now_us, tz) + F.round(hours * HOUR).cast("bigint"), tz)


def confidence(n: Column, coverage: Column | None = None) -> Column:
    rank = F.when(n >= 10, 2).when(n >= 3, 1).otherwise(0)
    if coverage is not None:
        rank = F.when(coverage < 0.5, 0).when(coverage < 0.8, F.least(rank, F.lit(1))).otherwise(rank)
    return rank


def rated(rank: Column) -> Column:
    return F.when(rank == 2, "high").when(rank == 1, "medium").when(rank == 0, "low")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def linear(facts: DataFrame, tz: str = "UTC", stale_us: dict[str, int] = STALE_US) -> DataFrame:
    """`facts` (with burn and resets_us) judged by the linear model."""
    status = F.when(rate_is_stale(stale_us), "IDLE").when(F.col("started_us").isNotNull() & (F.col("n_block") < 2), "RESET_PENDING").otherwise("OK")
    out = facts.withColumn("status", status)
    projects = (F.col("status") == "OK") & (F.col("n_block") >= 2)
    horizon = F.coalesce(F.col("resets_us"), F.col("now_us") + by_kind(DURATION_US))
    rate = F.when(projects, F.col("burn"))
    hours = F.when(projects & (F.col("burn") > 0), F.greatest(F.lit(0.0), 100.0 - F.col("used")) / F.col("burn"))
    # Anything as far off as the horizon is no answer, so far hours need no date.
    near = F.when(hours * HOUR < 400 * 24 * HOUR, hours)
    out = out.withColumn("burn_per_hour", F.coalesce(rate, F.lit(0.0))).withColumn("hours", near).withColumn("horizon_us", horizon)
    out = out.withColumn("eta_us", wall_clock(F.col("now_us"), F.col("hours"), tz)).withColumn("eta_us", F.when(F.col("eta_us") < F.col("horizon_us"), F.col("eta_us")))
    ahead = by_kind(DENSE_US)
    predicted = F.when(projects & (F.col("resets_us").isNull() | (F.col("resets_us") >= F.col("now_us") + ahead)), clamp(F.col("used") + F.col("burn") * ahead / HOUR))
    out = out.withColumn("predicted_used", predicted)
    out = out.withColumn("exhausts", F.col("eta_us").isNotNull() & F.col("resets_us").isNotNull())
    out = out.withColumn("confidence", F.when(projects & (F.col("burn") > 0), rated(confidence(F.col("n_rate")))))
    return out.withColumn("time_to_reset_h", (F.col("resets_us") - F.col("now_us")) / HOUR).withColumn("model", F.lit("linear"))


def work_hours_eta(rows: DataFrame, keys: list[str], tz: str, start_h: float, end_h: float, days: frozenset[int], enabled: bool = True) -> DataFrame:
    """work_us of each row: when `hours` of burn have passed, counting only working hours from now_us, before horizon_us.

    Only days up to the horizon are laid out (a week at most), within the row, their hours summed
    in order; the first interval that covers the budget holds the answer."""
    if not enabled:
        return rows.withColumn("work_us", F.col("eta_us"))
    clock, need = clock_us(F.col("now_us"), tz), F.round(F.col("hours") * HOUR).cast("bigint")
    none = F.lit(None).cast("bigint")

    def pass_day(state: Column, day: Column) -> Column:
        midnight = day.cast("bigint") * DAY
        a, b = F.greatest(midnight + int(start_h * HOUR), F.col("_from")), midnight + int(end_h * HOUR)
        upto = state["upto"] + F.when(weekday_of(midnight).isin(*days) & (b > a), b - a).otherwise(0)
        covers = (upto > state["upto"]) & (upto >= F.col("_need")) & (F.col("_need") > 0)
        return F.struct(upto.alias("upto"), F.coalesce(state["at"], F.when(covers, b - (upto - F.col("_need")))).alias("at"))

    laid = F.when(F.col("_need") > 0, F.sequence(day_of(F.col("_from")), day_of(clock_us(F.col("horizon_us"), tz))))
    at = F.aggregate(laid, F.struct(F.lit(0).cast("bigint").alias("upto"), none.alias("at")), pass_day)["at"]
    out = rows.withColumn("_from", clock).withColumn("_need", need)
    out = out.withColumn("work_us", F.when(F.col("hours") <= 0, F.col("now_us")).otherwise(instant_us(at, tz)))
    return out.withColumn("work_us", F.when(F.col("work_us") < F.col("horizon_us"), F.col("work_us"))).drop("_from", "_need")


def no_data(watch: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every watched pair: those without a reading get a placeholder status that is never stored."""
    return watch.join(rows, keys, "left").withColumn("status", F.coalesce("status", F.lit("NO_DATA")))
