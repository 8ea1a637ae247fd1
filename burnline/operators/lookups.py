"""As-of lookups: the newest row at or before a moment, without inequality joins; and time cut into shards.

What runs along a key in order of time is worked out within shards of it, each dealt to any task; a shard's last value
goes on to the shards after it by a pass over one row a shard. So a hot key is spread over as many tasks as it has shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from burnline.dims import HOUR

#: A shard's length.
SHARD_US = 6 * HOUR
#: Rows of a task, and from how many rows on they are dealt out by that. Fewer are left to Spark's own number.
TASK_ROWS, MANY_ROWS = 50_000, 400_000


def tasks(rows: int) -> int | None:
    """How many tasks `rows` are dealt to, so that a task's memory doesn't grow with them; None leaves it to Spark."""
    return -(-rows // TASK_ROWS) if rows > MANY_ROWS else None


def spread(rows: DataFrame, n: int | None, *by: str) -> DataFrame:
    """`rows` dealt by some columns to n tasks."""
    return rows.repartition(n, *by) if n else rows.repartition(*by)


def shard_key(keys: list[str], time: str) -> Column:
    """Keys and shard as one struct: equal in joins too where a key is null."""
    return F.struct(*keys, F.floor(F.col(time) / SHARD_US).cast("bigint").alias("_shard"))


def dealt(rows: DataFrame, keys: list[str], time: str, n: int | None = None) -> DataFrame:
    """`rows` with `_key`, by which they are dealt out, to n tasks."""
    return spread(rows.withColumn("_key", shard_key(keys, time)), n, "_key")


def over_shards(keys: list[str], forward: bool = False) -> WindowSpec:
    """The shards of a key in order of time (forward: the last one first), one row each."""
    at = F.col("_key._shard")
    return Window.partitionBy(*(F.col(f"_key.{k}") for k in keys)).orderBy(at.desc() if forward else at)


def carried(rows: DataFrame, keys: list[str], time: str, order: list, value: str, name: str, forward: bool = False, n: int | None = None) -> DataFrame:
    """`rows` with `name`: the last `value` that is not null, up to each row in `order` (of `time` first; forward: descending)."""
    w = Window.partitionBy("_key").orderBy(*order)
    upto = (Window.unboundedPreceding, 0)
    local = dealt(rows, keys, time, n).withColumn(name, F.last(value, ignorenulls=True).over(w.rowsBetween(*upto)))
    ends = local.withColumn("_more", F.lead(F.lit(1)).over(w)).where("_more IS NULL").select("_key", name)
    before = over_shards(keys, forward).rowsBetween(Window.unboundedPreceding, -1)
    came = ends.select("_key", F.last(name, ignorenulls=True).over(before).alias("_came"))
    return local.join(came, "_key", "left").withColumn(name, F.coalesce(name, "_came")).drop("_key", "_came")


def as_of(moments: DataFrame, samples: DataFrame, keys: list[str], at: str, columns: list[str], name: str, forward: bool = False, n: int | None = None) -> DataFrame:
    """`moments` with `name`: the newest sample at or before `at` (forward: the oldest at or after it).

    Both sides are dealt and sorted by series and shards of time; a running last value
    carries the sample to the moments, so no inequality join is planned."""
    row = F.struct("ts_us", *columns)
    s = samples.select(*keys, F.col("ts_us").alias("_t"), row.alias("_row"), F.lit(None).cast(moments.select(F.struct("*")).schema[0].dataType).alias("_m"), F.lit(0).alias("_side"))
    m = moments.select(*keys, F.col(at).alias("_t"), F.lit(None).cast(s.schema["_row"].dataType).alias("_row"), F.struct("*").alias("_m"), F.lit(1).alias("_side"))
    order = [F.desc("_t"), "_side"] if forward else ["_t", "_side"]
    rows = carried(s.unionByName(m), keys, "_t", order, "_row", "_found", forward, n and 2 * n).where("_side = 1")
    return rows.select("_m.*", F.col("_found").alias(name))


def as_of_each(moments: DataFrame, ids: list[str], rows: DataFrame, keys: list[str], at: dict[str, Column], columns: list[str] | dict[str, list[str]], time: str = "ts_us", n: int | None = None, early: bool = False) -> DataFrame:
    """`ids` of each of `moments`, and for each name in `at` the newest of `rows` (a struct of `columns`, which may be given
    for each name) at or before that moment.

    All probes of all moments are dealt and sorted with the rows by shards of time; a running
    last value carries rows to probes, and a grouping by `ids` brings a moment's
    probes together again. Work follows rows plus probes. `ids` hold `keys` and tell
    moments apart; a probe at null finds null. Rows at one time of a key should be one row.
    Where many probes may be `early`, those before the first of all rows are left out; `rows` are then read once more."""
    probe = F.explode(F.array(*(F.struct(F.lit(i).alias("_which"), c.cast("bigint").alias("_t")) for i, c in enumerate(at.values()))))
    # Probes at null find nothing; one of each moment stays, so that no moment is lost.
    probes = moments.select(*ids, probe.alias("_p")).select(*ids, "_p._which", "_p._t").where("_t IS NOT NULL OR _which = 0")
    if early:
        first = rows.agg(F.min(time).cast("bigint").alias("_first"))
        probes = probes.crossJoin(F.broadcast(first)).where("_t >= _first OR _which = 0").drop("_first")  # one row
    of = columns if isinstance(columns, dict) else dict.fromkeys(at, columns)
    every = list(dict.fromkeys(c for cs in of.values() for c in cs))
    found = rows.select(*keys, F.col(time).cast("bigint").alias("_t"), F.struct(*every).alias("_row"), F.lit(-1).alias("_which"))
    both = carried(found.unionByName(probes, allowMissingColumns=True), keys, "_t", ["_t", "_which"], "_row", "_found", n=n and n * (1 + len(at))).where("_which >= 0")
    here = lambda i: (F.col("_which") == i) & F.col("_t").isNotNull()
    deal = lambda some: spread(some, n * len(at), *ids) if n else some
    if all(isinstance(found.schema["_row"].dataType[c].dataType, NumericType) for c in every):
        # Numbers are grouped one by one, which takes no sort as structs do.
        told = both.select(*ids, "_which", "_t", F.when(F.col("_found").isNotNull(), F.lit(1)).alias("_has"), *(F.col(f"_found.{c}").alias(f"_c{j}") for j, c in enumerate(every)))
        part = lambda i, c: F.first(F.when(here(i), F.col(c)), ignorenulls=True).alias(f"{c}_{i}")
        one = [part(i, c) for i, name in enumerate(at) for c in ("_has", *(f"_c{every.index(c)}" for c in of[name]))]
        whole = lambda i, name: F.when(F.col(f"_has_{i}").isNotNull(), F.struct(*(F.col(f"_c{every.index(c)}_{i}").alias(c) for c in of[name]))).alias(name)
        return deal(told).groupBy(*ids).agg(*one).select(*ids, *(whole(i, name) for i, name in enumerate(at)))
    pruned = lambda name: F.when(F.col("_found").isNotNull(), F.struct(*(F.col(f"_found.{c}").alias(c) for c in of[name])))
    if len(at) == 1:
        both = both.withColumn("_found", pruned(*at))
    return deal(both.select(*ids, "_which", "_t", "_found")).groupBy(*ids).agg(*(F.first(F.when(here(i), pruned(name)), ignorenulls=True).alias(name) for i, name in enumerate(at)))
