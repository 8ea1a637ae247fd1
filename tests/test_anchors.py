"""Block anchors by shards against the fold in time order."""

import random

import pytest

from burnline.operators.tokens import running_anchors


def fold(times: list[int], length: int) -> dict[int, int]:
    out, anchor = {}, None
    for t in sorted(times):
        if anchor is None or t - anchor >= length:
            anchor = t
        out[t] = anchor
    return out


@pytest.mark.parametrize("shard", [50, 160, 7000])
def test_shards_equal_the_fold(spark, shard):
    """Dense, regular, bursty, sparse and repeated times, before and after 0; a hot key holds most rows."""
    rng = random.Random(shard)
    series = {
        "hot": [rng.randrange(-2000, 20_000) for _ in range(6000)],
        "regular": list(range(3, 9000, 7)),
        "at the length": list(range(0, 5000, 50)),
        "bursts": [c + rng.randrange(30) for c in rng.sample(range(0, 100_000, 90), 60) for _ in range(9)],
        "sparse": rng.sample(range(10**6), 40),
        "one": [5],
        "repeats": [7] * 30 + [57] * 3 + [56],
    }
    rows = [(k, i, t) for k, ts in series.items() for i, t in enumerate(ts)]
    got = running_anchors(spark.createDataFrame(rows, "k string, i bigint, ts_us bigint"), ["k"], 50, shard)
    assert got.columns == ["k", "i", "ts_us", "anchor_us"]
    want = {k: fold(ts, 50) for k, ts in series.items()}
    found = {(r.k, r.i): (r.ts_us, r.anchor_us) for r in got.collect()}
    assert found == {(k, i): (t, want[k][t]) for k, i, t in rows}


def test_no_task_holds_a_hot_key(spark):
    """As dealt by the shuffle: the adaptive plan would join small partitions again."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        got = running_anchors(spark.range(40_000).selectExpr("'hot' AS k", "id * 3 AS ts_us"), ["k"], 50)
        parts = [r["count"] for r in got.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    finally:
        spark.conf.unset(name)
    assert sum(parts) == 40_000 and max(parts) < 20_000


def test_no_events(spark):
    got = running_anchors(spark.createDataFrame([], "k string, ts_us bigint"), ["k"], 50)
    assert got.columns == ["k", "ts_us", "anchor_us"] and not got.collect()
