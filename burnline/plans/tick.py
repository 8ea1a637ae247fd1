"""One tick of the monitor over many accounts: read, store, forecast with all models, retain, alert, prune.

A store is a folder of Parquet tables in the shared file system: samples, token_events, forecasts, alert_state, floor,
and what grading came to (grades, graded). Rows lie in folders of their day and of the tick that wrote them. A tick reads what earlier ticks wrote and
writes its own folders over, so a tick that is run again, whole or after it broke off, leaves what one run leaves.
Days below retention are dropped folder by folder; `reset` sets a floor, below which no row is read or written again.
`tick` is a batch, and the body of `foreachBatch`."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from burnline.config import Config, priced, time_zone
from burnline.dims import DAY, DENSE_US, DURATION_US, PARTS, SERIES, by_kind
from burnline.operators import alerts, burn, grading, montecarlo, projection, scoring, store
from burnline.plans.forecast import KEYS, facts
from burnline.sources.increments import EventLog
from burnline.sources.providers import READINGS, Provider
from burnline.storage import settle

SAMPLES = "account string, provider string, kind string, ts_us bigint, used double, resets_us bigint, is_estimated boolean, captured_us bigint"
EVENTS = "account string, provider string, request_id string, message_id string, ts_us bigint, model string, " + ", ".join(f"{p} bigint" for p in PARTS) + ", total_tokens bigint, captured_us bigint, gone boolean"
FORECASTS = "account string, provider string, kind string, model string, made_us bigint, used double, status string, burn_per_hour double, eta_us bigint, p90_us bigint, risk double, predicted_used double, confidence string"
STATE = alerts.STATE + ", seen_us bigint, made_us bigint"
GRADED = grading.FRONTIER + ", made_us bigint"


@dataclass(frozen=True)
class Ticked:
    """What a tick made: forecasts of the chosen model (with placeholders), of all models, saved bands and alerts."""

    forecasts: DataFrame
    all_forecasts: DataFrame
    retained: DataFrame
    alerts: DataFrame


class Store:
    """The tables below `path`, as a tick at `now_us` finds them: without its own rows or later ones. Without `now_us`, all of them.

    A table that was never written is empty."""

    TABLES = ("samples", "token_events", "forecasts", "alert_state")
    DERIVED = ("grades", "graded")

    def __init__(self, spark: SparkSession, path: str, now_us: int | None = None):
        self.spark, self.path, self.now_us = spark, path, now_us

    def _folder(self, *names: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _listed(self, *names: str, prefix: str) -> list[int]:
        """The numbers of the folders `prefix`=n there."""
        fs, at = self._folder(*names)
        found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return [int(n.removeprefix(prefix)) for n in found if n.startswith(prefix) and n.removeprefix(prefix).lstrip("-").isdigit()]

    def days(self, name: str) -> list[int]:
        return sorted(self._listed(name, prefix="day="))

    def read(self, name: str, ddl: str, days: tuple[int, int] | None = None, own: bool = False) -> DataFrame:
        """A table, or some of its days; columns that older files lack are null. own: with the rows of this tick."""
        fs, at = self._folder(name)
        if not fs.exists(at):
            return self.spark.createDataFrame([], ddl)
        rows = self.spark.read.schema(StructType.fromDDL(f"{ddl}, day bigint, tick bigint")).parquet(f"{self.path}/{name}")
        if days:
            rows = rows.where(F.col("day").between(*days))
        if self.now_us is not None:
            rows = rows.where(F.col("tick") <= self.now_us if own else F.col("tick") < self.now_us)
        return rows.drop("day", "tick")

    def floor(self) -> int:
        """The moment below which nothing counts (0 without one)."""
        return self.read("floor", "floor_us bigint").agg(F.max("floor_us").alias("f")).first().f or 0

    def write(self, name: str, rows: DataFrame, ts: str) -> None:
        """This tick's rows of a table, in place of any that it wrote before; rows below the floor aren't stored."""
        kept = rows.where(F.col(ts) >= self.floor())
        out = kept.withColumn("day", F.floor(F.col(ts) / DAY).cast("bigint")).withColumn("tick", F.lit(self.now_us).cast("bigint"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "tick").parquet(f"{self.path}/{name}")

    def prune(self, cutoff_us: int) -> None:
        """Drop the days that lie below the cutoff as a whole."""
        for name in self.TABLES + self.DERIVED:
            for day in self.days(name):
                if (day + 1) * DAY <= cutoff_us:
                    fs, at = self._folder(name, f"day={day}")
                    fs.delete(at, True)

    def reset(self, now_us: int) -> int:
        """Forget what was learnt: the rows of all tables go, and the floor is now. How many rows went.

        The floor comes first and is one file, so a reset that breaks off has happened: readers pass over what it left."""
        gone = sum(self.read(name, "x int").count() for name in self.TABLES)
        Store(self.spark, self.path, now_us).write("floor", self.spark.createDataFrame([(now_us,)], "floor_us bigint"), "floor_us")
        for name in self.TABLES + self.DERIVED:
            fs, at = self._folder(name)
            fs.delete(at, True)
        return gone

    def samples(self, days: tuple[int, int] | None = None, own: bool = False) -> DataFrame:
        return self.read("samples", SAMPLES, days, own).where(F.col("ts_us") >= self.floor())

    def token_events(self, days: tuple[int, int] | None = None, own: bool = False) -> DataFrame:
        """The last row written of each event, unless it takes the event back."""
        rows = self.read("token_events", EVENTS, days, own).where(F.col("ts_us") >= self.floor())
        return store.keep_last(rows, store.EVENT_KEY, F.col("captured_us")).where(~F.coalesce("gone", F.lit(False))).drop("captured_us", "gone")

    def forecasts(self, days: tuple[int, int] | None = None, own: bool = False) -> DataFrame:
        return self.read("forecasts", FORECASTS, days, own).where(F.col("made_us") >= self.floor())

    def _newest(self, name: str, ddl: str) -> DataFrame:
        """A table of which every tick writes all rows: those of the last tick that wrote it."""
        days = [d for d in self.days(name) if self.now_us is None or d <= self.now_us // DAY]
        for day in reversed(days):
            ticks = [t for t in self._listed(name, f"day={day}", prefix="tick=") if self.now_us is None or t < self.now_us]
            if ticks:
                rows = self.spark.read.schema(ddl).parquet(f"{self.path}/{name}/day={day}/tick={max(ticks)}")
                return rows.where(F.col("made_us") >= self.floor())
        return self.spark.createDataFrame([], ddl)

    def alert_state(self) -> DataFrame:
        """Each alert's state after the last tick."""
        return self._newest("alert_state", STATE)

    def grades(self) -> DataFrame:
        """What ticks graded, as sums that add up."""
        return self.read("grades", grading.SUMS).where(F.col("made_us") >= self.floor())

    def graded(self) -> DataFrame:
        """How far each series has been graded."""
        return self._newest("graded", GRADED)


def grade(kept: Store, touched: DataFrame | None = None) -> DataFrame:
    """Both models' scores by kind over all stored forecasts that can be decided.

    Only what earlier ticks have not decided is graded, for the series in `touched` (None: all); a tick's store keeps
    the sums and the frontier. Days are read from a horizon before the oldest frontier of these series on."""
    frontier, horizon = settle(kept.graded().drop("made_us")), by_kind(DENSE_US)
    samples, forecasts = kept.samples(own=True), kept.forecasts(own=True)
    going = frontier
    if touched is not None:
        touched = settle(touched.select(*SERIES).distinct())
        since = touched.join(frontier, SERIES, "left").agg(F.min(F.coalesce(F.col("upto_us") - horizon, F.lit(0))).alias("t")).first().t
        days = (since or 0) // DAY, (1 << 62) // DAY
        samples = kept.samples(days, own=True).join(touched, SERIES, "left_semi")
        forecasts = kept.forecasts(days, own=True).join(touched, SERIES, "left_semi")
        going = frontier.join(touched, SERIES, "left_semi")
    sums, after = map(settle, grading.advance(going, samples, forecasts, list(scoring.MODELS), horizon))
    after = after.unionByName(frontier.join(after, SERIES, "left_anti"))
    every = kept.grades().unionByName(sums)
    if kept.now_us is not None:
        kept.write("grades", sums, "made_us")
        kept.write("graded", after.withColumn("made_us", F.lit(kept.now_us)), "made_us")
    return grading.merged_scores(every, after, ["kind"])


def choose(spark: SparkSession, kept: Store, cfg: Config, touched: DataFrame | None = None) -> tuple[str, str]:
    """The model of the settings; `auto` grades what is stored, both models at the same moments."""
    if cfg.predictor.model != "auto":
        return scoring.select_model(cfg.predictor.model, None)
    if kept.forecasts(own=True).isEmpty():
        return scoring.select_model("auto", None)
    row = scoring.graded_choice(settle(grade(kept, touched))).first()
    return row.chosen, row.reason


def tick(spark: SparkSession, path: str, readings: DataFrame, tokens: DataFrame, now_us: int, cfg: Config = Config(), model: str | None = None) -> Ticked:
    """Judge every watched series at `now_us`, which is also the tick's name: the same moment again is the same tick.

    `readings` (series, ts_us, used, resets_us, is_estimated) and `tokens` (token events) are what was read since the
    last tick; an event with `gone` true takes a stored one back. Rows that are stored already change nothing, nor do those of providers that aren't enabled, or below
    retention or the floor. `model` spares the grading where it is known."""
    kept, tz = Store(spark, path, now_us), time_zone(cfg)
    enabled = [p for p, on in (("claude", cfg.claude.enabled), ("codex", cfg.codex.enabled)) if on]
    readings = readings.where(F.col("provider").isin(enabled))
    new = readings.select(*SERIES, "ts_us", F.col("used").cast("double").alias("used"), F.col("resets_us").cast("bigint").alias("resets_us"), "is_estimated", F.lit(now_us).alias("captured_us"))
    floor = max(now_us - cfg.predictor.retention_us(), kept.floor() - 1)
    kept.prune(floor)
    days = floor // DAY, now_us // DAY + 1
    new, tokens = new.where(F.col("ts_us") > floor), tokens.where(F.col("provider").isin(enabled) & (F.col("ts_us") > floor))
    # What is read again is looked for in the days that the new readings are of.
    span = new.agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b")).first()
    known = kept.samples((span.a // DAY, span.b // DAY)) if span.a is not None else None
    kept.write("samples", settle(store.keep_first(new, known, store.SAMPLE_KEY, "captured_us")), "ts_us")
    tokens = tokens if "gone" in tokens.columns else tokens.withColumn("gone", F.lit(False))
    kept.write("token_events", settle(store.keep_last(tokens, store.EVENT_KEY, F.col("ts_us")).withColumn("captured_us", F.lit(now_us))), "ts_us")
    samples = kept.samples(days, own=True).where(F.col("ts_us") > floor).drop("captured_us")
    events = kept.token_events(days, own=True).where(F.col("ts_us") > floor)

    # A series' latest reading of this tick is the one that is judged.
    last = readings.groupBy(*SERIES).agg(F.max_by(F.struct("ts_us", "used", "resets_us", "is_estimated"), "ts_us").alias("r"))
    last = last.where(F.col("kind").isin(*cfg.windows.watch))
    origins = settle(last.select(*SERIES, F.lit(now_us).alias("now_us"), F.col("r.ts_us").alias("source_us"), F.col("r.used").cast("double").alias("used"), F.col("r.resets_us").cast("bigint").alias("given_us"), F.col("r.is_estimated").alias("is_estimated")))
    near = samples.where(F.col("ts_us") >= now_us - max(cfg.predictor.lookback_us().values()))
    judged, stale = settle(facts(samples, events, origins, cfg.predictor, near)), cfg.thresholds.stale_us()
    lin = projection.linear(judged, tz, stale)
    lin = projection.work_hours_eta(lin, KEYS, tz, *cfg.working_hours.hours(), cfg.working_hours.weekdays(), cfg.working_hours.enabled)
    sim = montecarlo.montecarlo(judged, samples, events, KEYS, cfg.predictor.mc_runs, tz, 0, cfg.predictor.bucket_decay_halflife_days, stale)
    lin = lin.withColumn("p90_us", F.lit(None).cast("bigint")).withColumn("risk", F.lit(None).cast("double"))
    extra = [burn.overage_tokens(F.col("used")).alias("over_tokens"), burn.overage_cost(F.col("used"), priced(cfg)).alias("cost_usd")]
    columns = [*KEYS, "model", "source_us", "used", "is_estimated", "resets_us", "status", "burn_per_hour", "eta_us", "p90_us", "work_us", "risk", "predicted_used", "confidence", "exhausts"]
    both = settle(reduce(DataFrame.unionByName, [f.select(*columns, *extra) for f in (lin, sim)]))
    longest = max(DURATION_US.values())  # no band of an older forecast is kept
    saved = kept.forecasts(((now_us - longest) // DAY, now_us // DAY))
    idle = both.where("model = 'montecarlo'")
    retained = settle(alerts.retained(idle, saved.withColumn("id", F.col("made_us")), by_kind(DURATION_US)))
    stored = [c.split()[0] for c in FORECASTS.split(", ")]
    kept.write("forecasts", both.withColumn("made_us", F.col("now_us")).select(stored), "made_us")

    chosen = model or choose(spark, kept, cfg, readings)[0]
    mine = both.where(F.col("model") == chosen)
    pairs = spark.createDataFrame([(p, k) for p in enabled for k in cfg.windows.watch], "provider string, kind string")
    accounts = samples.select("account").distinct()
    grid = accounts.crossJoin(F.broadcast(pairs))  # four rows at most
    out = projection.no_data(grid, mine, SERIES).withColumn("now_us", F.coalesce("now_us", F.lit(now_us)))

    before = kept.alert_state()
    step = settle(alerts.alert_step(mine, before, cfg.thresholds))
    state = step.select(*SERIES, "alert", "armed", "at", F.lit(now_us).alias("seen_us"), F.lit(now_us).alias("made_us"))
    # States of series that were not judged go on, until nothing was heard of them for the whole of retention.
    others = before.where(F.col("seen_us") > floor).join(step.select(*SERIES, "alert"), [*SERIES, "alert"], "left_anti").withColumn("made_us", F.lit(now_us))
    kept.write("alert_state", settle(state.unionByName(others)), "made_us")
    fired = step.where("fired").select(*SERIES, "alert", "fired_us", "used")
    return Ticked(out, both, retained, fired)


def poll(spark: SparkSession, path: str, providers: list[Provider], now_us: int, cfg: Config = Config(), model: str | None = None) -> Ticked:
    """A tick over what the enabled providers read; their logs are read from where the last poll began to."""
    log = EventLog(spark, f"{path}/logs")
    enabled = [p for p in providers if getattr(cfg, p.name).enabled]
    none = spark.createDataFrame([], SAMPLES).drop("captured_us").select(READINGS)
    readings = settle(reduce(DataFrame.unionByName, [p.read(spark, cfg, log, now_us) for p in enabled], none))
    return tick(spark, path, readings, log.changes(now_us, own=True).drop("log", "scan"), now_us, cfg, model)


def notify(ticked: Ticked, send) -> None:
    """Hand every alert of a tick to `send(rows)`, a partition at a time, where it was made; a failing sender fails no tick."""

    def each(rows) -> None:
        try:
            send(list(rows))
        except Exception as e:
            print(f"notification failed: {e}")

    ticked.alerts.foreachPartition(each)
