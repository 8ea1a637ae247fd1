"""Grading by increments gives what grading everything at once gives."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from burnline.config import Config, Predictor
from burnline.dims import DENSE_US, HOUR, SECOND, SERIES, by_kind
from burnline.operators import cycles, grading, scoring
from burnline.plans import tick as ticks

MINUTE = 60 * SECOND
SAMPLE = "account string, provider string, kind string, ts_us bigint, used double, resets_us bigint, is_estimated boolean"
STORED = "account string, provider string, kind string, model string, made_us bigint, used double, status string, burn_per_hour double, predicted_used double"
MODELS = ["linear", "flat"]


def history(seed, hours=60):
    """Series with resets, gaps, silences and one that is too short; forecasts of which some lack a model or a prediction."""
    rng, samples, made = random.Random(seed), [], []
    for account, provider, kind in (("a", "claude", "w5h"), ("a", "codex", "weekly"), ("b", "codex", "w5h"), ("b", "claude", "weekly"), ("c", "claude", "w5h")):
        t, used, span = rng.randrange(HOUR), 0.0, 5 * HOUR if kind == "w5h" else 40 * HOUR
        reset = span
        while t < hours * HOUR and not (account == "c" and len([s for s in samples if s[0] == "c"]) == 2):
            if t > reset or rng.random() < HOUR / span / 10:
                used, reset = rng.choice([0.0, 2.0, 20.0]), t + span
            used = min(100.0, used + rng.choice([0, 0, 1, 3, 9]))
            samples.append((account, provider, kind, t, used, reset if provider == "codex" else None, rng.random() < 0.2))
            at = t + rng.choice([0, 0, MINUTE])
            for model in MODELS:
                if rng.random() < 0.95:
                    told = None if rng.random() < 0.1 else min(100.0, used + rng.random() * 20)
                    made.append((account, provider, kind, model, at, used, rng.choice(["OK"] * 9 + ["IDLE"]), rng.random() * 3, told))
            t += rng.choice([7, 20, 45, 400 if rng.random() < 0.1 else 30]) * MINUTE
    return samples, made


def rounded(scores):
    return {(r.kind, r.model): (r.moments, round(r.mae, 9), round(r.bias, 9), round(r.persistence_mae, 9)) for r in scores.collect()}


def test_any_split_into_ticks_gives_the_same(spark):
    samples, made = history(1)
    s, f = spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(made, STORED)
    whole = rounded(scoring.dense_scores(scoring.gradable(f, s), cycles.segment(s, SERIES), MODELS, by_kind(DENSE_US), ["kind"]))
    assert sum(v[0] for v in whole.values()) > 50 and len(whole) == 4
    rng = random.Random(7)
    for cuts in ([], sorted(rng.randrange(60 * HOUR) for _ in range(2))):
        frontier, sums, last = spark.createDataFrame([], grading.FRONTIER), spark.createDataFrame([], grading.SUMS), -1
        for cut in [*cuts, 100 * HOUR]:
            # A tick sees a horizon before the frontier and what is new, and nothing older.
            far = {tuple(r[k] for k in SERIES): r.upto_us for r in frontier.collect()}
            near = [x for x in samples if x[3] <= cut and x[3] > far.get(x[:3], -1) - DENSE_US[x[2]]]
            told = [x for x in made if x[4] <= cut and x[4] > far.get(x[:3], -1) - DENSE_US[x[2]]]
            more, frontier = grading.advance(frontier, spark.createDataFrame(near, SAMPLE), spark.createDataFrame(told, STORED), MODELS, by_kind(DENSE_US))
            sums, frontier = sums.unionByName(spark.createDataFrame(more.collect(), grading.SUMS)), spark.createDataFrame(frontier.collect(), grading.FRONTIER)
        assert rounded(grading.merged_scores(sums, frontier, ["kind"])) == whole
        assert {tuple(r[k] for k in SERIES): r.n for r in frontier.collect()} == {k: sum(x[:3] == k for x in samples) for k in {x[:3] for x in samples}}


def test_nothing_new_decides_nothing(spark):
    samples, made = history(3, 20)
    s, f = spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(made, STORED)
    _, frontier = grading.advance(spark.createDataFrame([], grading.FRONTIER), s, f, MODELS, by_kind(DENSE_US))
    frontier = spark.createDataFrame(frontier.collect(), grading.FRONTIER)
    more, after = grading.advance(frontier, s, f, MODELS, by_kind(DENSE_US))
    assert more.count() == 0 and sorted(after.collect()) == sorted(frontier.collect())
    more, after = grading.advance(frontier, s.limit(0), f.limit(0), MODELS, by_kind(DENSE_US))
    assert more.count() == 0 and sorted(after.collect()) == sorted(frontier.collect())


def test_ticks_grade_once_and_can_be_run_again(spark, tmp_path):
    cfg = replace(Config(), timezone="UTC", predictor=Predictor(model="auto", mc_runs=20))
    start, path = 1_785_000_000 * SECOND, str(tmp_path / "store")

    def one(i):
        now = start + i * 40 * MINUTE
        rows = [("a", "claude", "w5h", now - 5 * MINUTE * j, 30.0 + 5 * i - j, start + 9 * HOUR, False) for j in range(3)]
        rows += [("b", "codex", "w5h", now, 10.0 + i, None, False)] if i in (0, 2) else []
        none = spark.createDataFrame([], "account string, provider string, request_id string, message_id string, ts_us bigint, model string, input_tokens bigint, output_tokens bigint, cache_creation bigint, cache_read bigint, total_tokens bigint")
        ticks.tick(spark, path, spark.createDataFrame(rows, SAMPLE), none, now, cfg)

    def state():
        kept = ticks.Store(spark, path)
        return sorted(map(str, kept.grades().collect())), sorted(map(str, kept.graded().collect()))

    for i in range(3):
        one(i)
    kept = ticks.Store(spark, path)
    samples = kept.samples()
    whole = scoring.dense_scores(scoring.gradable(kept.forecasts(), samples), cycles.segment(samples, SERIES), list(scoring.MODELS), by_kind(DENSE_US), ["kind"])
    assert rounded(ticks.grade(kept)) == rounded(whole) and whole.count() > 0
    assert kept.grades().where("account = 'a'").agg(F.sum("moments")).first()[0] == whole.agg(F.sum("moments")).first()[0]
    before = state()
    one(2)
    assert state() == before
    kept.reset(start + 200 * MINUTE)
    assert kept.grades().count() == 0 and kept.graded().count() == 0
