"""What moments share is asked once, and probes that find nothing are not dealt out."""

from pyspark.sql import functions as F

from burnline.dims import HOUR
from burnline.operators import burn, lookups
from burnline.queries import Q

SF = "/root/testdata/sf0.001"


def test_a_block_asks_for_its_tokens_once(spark, monkeypatch):
    """Every moment asked for the tokens at its block's start, cap and edge: six probes each, which are dealt out twice."""
    asked, each = [], lookups.as_of_each

    def counted(moments, ids, rows, keys, at, *more, **named):
        asked.append((moments.count(), len(at)))
        return each(moments, ids, rows, keys, at, *more, **named)

    monkeypatch.setattr(burn, "as_of_each", counted)
    n = Q["percent_per_token"](spark, SF).count()
    assert n and sum(m * k for m, k in asked) < 4 * n


def test_early_probes_find_nothing_and_are_not_dealt(spark):
    s = spark.range(1000, 1500).select(F.lit("a").alias("k"), (F.col("id") * HOUR).alias("ts_us"), F.col("id").alias("v"))
    m = spark.range(900, 1600).select(F.lit("a").alias("k"), (F.col("id") * HOUR).alias("at"))
    probes = {"x": F.col("at"), "y": F.col("at") - 400 * HOUR}
    out = {e: lookups.as_of_each(m, ["k", "at"], s, ["k"], probes, {"x": ["v"], "y": ["v", "ts_us"]}, early=e) for e in (False, True)}
    rows = {e: sorted(map(tuple, df.collect())) for e, df in out.items()}
    assert rows[True] == rows[False] and len(rows[True]) == 700
    for _, at, x, y in rows[True]:
        i = at // HOUR
        assert (x and x.v) == (min(i, 1499) if i >= 1000 else None) and (y and tuple(y)) == ((i - 400, (i - 400) * HOUR) if i >= 1400 else None)
