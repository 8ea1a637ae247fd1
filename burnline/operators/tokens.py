"""Token-compute aggregations: block anchors, sliding maxima, limits and token-based readings."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from burnline.dims import DAY, DEFAULT_LIMIT, DURATION_US, HOUR, MIN_HISTORY_US, PARTS, SAFETY
from burnline.operators.folds import ordered_fold
from burnline.operators.lookups import as_of_each


def by_moment(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key and instant: the sums of its events, and how many there are."""
    sums = [F.sum(c).alias(c) for c in ("total_tokens", *PARTS) if c in events.columns]
    return events.groupBy(*keys, "ts_us").agg(*sums, F.count(F.lit(1)).alias("n"))


#: A shard's length, in block lengths.
SHARD_BLOCKS = 16
_BEFORE_ALL = -(1 << 62)


def _shard_exits(rows: DataFrame, keys: list[str], length_us: int, shard_us: int) -> DataFrame:
    """(keys, _shard, upto, went): a chain of blocks that enters the shard after the last `upto` and by this one leaves it with anchor `went`.

    Blocks reach into a shard by less than their length, so the chain enters at an event of the shard's first length or at the next
    one after it. All these chains go through the sorted events together; those that meet at an anchor go on as one."""
    schema = StructType([*(rows.schema[k] for k in keys), StructField("_shard", LongType()), StructField("upto", LongType()), StructField("went", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, entries, into, chains = None, [], {}, deque()  # chains: (anchor, number), the oldest anchor first
        open_, made = True, {n: [] for n in arrow.names}

        def close() -> None:
            ends = {number: anchor for anchor, number in chains}
            for i, at in enumerate(entries):
                root = i
                while root in into:
                    root = into[root]
                if i in into:
                    into[i] = root
                if i and made["went"][-1] == ends[root]:
                    made["upto"][-1] = at
                    continue
                for n, v in zip(arrow.names, (*group, at, ends[root]), strict=True):
                    made[n].append(v)

        for b in batches:
            ts = b.column(b.schema.get_field_index("ts_us")).to_numpy()
            times, columns = ts.tolist(), [b.column(b.schema.get_field_index(k)) for k in (*keys, "_shard")]
            ends = sorted(set().union(*(pc.run_end_encode(c).run_ends.to_pylist() for c in columns)))
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                name = tuple(c[lo].as_py() for c in columns)
                if name != group:
                    if group is not None:
                        close()
                    group, entries, into, chains, open_ = name, [], {}, deque(), True
                while lo < hi:
                    if not open_ and times[lo] < chains[0][0] + length_us:  # nothing happens before the oldest block has ended
                        lo += int(np.searchsorted(ts[lo:hi], chains[0][0] + length_us))
                        continue
                    at, number = times[lo], None
                    while chains and chains[0][0] + length_us <= at:
                        ended = chains.popleft()[1]
                        if number is None:
                            number = ended
                        else:
                            into[ended] = number
                    if open_ and not (entries and entries[-1] == at):
                        entries.append(at)
                        if number is None:
                            number = len(entries) - 1
                        else:
                            into[len(entries) - 1] = number
                        open_ = at < group[-1] * shard_us + length_us
                    if number is not None:
                        chains.append((at, number))
                    lo += 1
            if len(made["upto"]) > 10_000:
                yield pa.RecordBatch.from_pydict(made, schema=arrow)
                made = {n: [] for n in arrow.names}
        if group is not None:
            close()
        yield pa.RecordBatch.from_pydict(made, schema=arrow)

    return rows.repartition(*keys, "_shard").sortWithinPartitions(*keys, "_shard", "ts_us").mapInArrow(run, schema)


def running_anchors(events: DataFrame, keys: list[str], length_us: int, shard_us: int | None = None) -> DataFrame:
    """`events` (keys, ts_us, ...) with anchor_us: the start of the fixed block that each falls in.

    A block starts with the first event that is its length or more after the last
    start, a fold in time order. Time is cut into shards, dealt by key and shard: each
    works out with which anchor it would be left for every way to enter it; a fold
    over these few rows a shard says how each is entered; then shards number their own
    events by bisection. A hot key is so spread over as many tasks as it has shards.
    Events of one time are in one block, and ts_us is never null."""
    span = shard_us or SHARD_BLOCKS * length_us
    rows = events.withColumn("_shard", F.expr(f"ts_us div {span}"))

    def enter(state: tuple, row: dict) -> tuple[tuple, dict | None]:
        shard, came, went, through = state
        out = None
        if row["_shard"] != shard:
            shard, came, through = row["_shard"], went, False
            out = {"_shard": shard, "_came": came}
        if not through and (came is None or came + length_us <= row["upto"]):
            went, through = row["went"], True
        return (shard, came, went, through), out

    exits = _shard_exits(rows.select(*keys, "_shard", "ts_us"), keys, length_us, span)
    entered = ordered_fold(exits, keys, ["_shard", "upto"], (None, None, None, False), enter, "_shard bigint, _came bigint")
    marks = entered.select(*keys, "_shard", F.lit(_BEFORE_ALL).cast("bigint").alias("ts_us"), "_came", F.lit(True).alias("_mark"))
    both = rows.withColumn("_came", F.lit(None).cast("bigint")).withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    out, events_names = StructType([*events.schema.fields, StructField("anchor_us", LongType())]), list(events.columns)
    width, at, came_at, mark_at = len(events.columns), events.columns.index("ts_us"), both.columns.index("_came"), both.columns.index("_mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = None
        for b in batches:
            ts, anchors, mark = b.column(at).to_numpy(), np.empty(b.num_rows, np.int64), b.column(mark_at).to_numpy(zero_copy_only=False)
            heads = [int(i) for i in np.flatnonzero(mark)]
            for lo, hi in zip([0, *heads], [*heads, b.num_rows], strict=True):
                if lo < hi and mark[lo]:
                    anchor, lo = b.column(came_at)[lo].as_py(), lo + 1
                while lo < hi:
                    if anchor is None:
                        anchor = int(ts[lo])
                    to = lo + int(np.searchsorted(ts[lo:hi], anchor + length_us))
                    anchors[lo:to] = anchor
                    if to < hi:
                        anchor = int(ts[to])
                    lo = to
            kept = pa.array(~mark)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(anchors)], names=[*events_names, "anchor_us"]).filter(kept)

    return both.repartition(*keys, "_shard").sortWithinPartitions(*keys, "_shard", "ts_us").mapInArrow(run, out)


def block_anchors(events: DataFrame, keys: list[str], length_us: int) -> DataFrame:
    """Start of each key's current fixed block, null where it has ended by now_us."""
    last = running_anchors(events.select(*keys, "ts_us", F.col("now_us").alias("_now")), keys, length_us)
    last = last.groupBy(*keys).agg(F.max("anchor_us").alias("a"), F.max("_now").alias("_now"))
    return last.select(*keys, F.when(F.col("_now") - F.col("a") < length_us, F.col("a")).alias("anchor_us"))


def trailing_tokens(events: DataFrame, keys: list[str], length_us: int) -> DataFrame:
    """`events` with the tokens of the window of `length_us` that ends at each, both ends included.

    A window's sum is the difference of two running sums, each looked up as of a moment."""
    sums = by_moment(events, keys)
    rising = sums.withColumn("upto", F.sum("total_tokens").over(Window.partitionBy(*keys).orderBy("ts_us").rowsBetween(Window.unboundedPreceding, 0)))
    before = as_of_each(rising.select(*keys, "ts_us", "upto"), [*keys, "ts_us", "upto"], rising, keys, {"_old": F.col("ts_us") - length_us - 1}, ["upto"], "ts_us")
    at = before.select(*keys, "ts_us", (F.col("upto") - F.coalesce("_old.upto", F.lit(0))).alias("trailing"))
    return events.join(at, [*keys, "ts_us"])


def sliding_max(events: DataFrame, keys: list[str], length_us: int) -> DataFrame:
    return trailing_tokens(events.select(*keys, "ts_us", "total_tokens"), keys, length_us).groupBy(*keys).agg(F.max("trailing").alias("max_tokens"))


def limit_estimates(events: DataFrame, keys: list[str], kind: str, window_start: Column) -> DataFrame:
    """The tokens that a window of `kind` seems to allow, from events before `window_start`.

    The busiest window so far over the safety factor; with too short a history the
    default for the 5-hour window, and none for the weekly one."""
    past = events.where(F.col("ts_us") < window_start)
    seen = trailing_tokens(past, keys, DURATION_US[kind]).groupBy(*keys).agg(F.max("trailing").alias("m"), (F.max("ts_us") - F.min("ts_us")).alias("span"))
    default = F.lit(DEFAULT_LIMIT if kind == "w5h" else None).cast("bigint")
    out = events.select(*keys).distinct().join(seen, keys, "left")
    return out.select(*keys, F.when(F.col("span") >= MIN_HISTORY_US[kind], F.floor(F.col("m") / SAFETY).cast("bigint")).otherwise(default).alias("limit_tokens"))


def plan_limit(kind: Column, tier: Column, tiers: dict[str, int]) -> Column:
    """Plan mode: the tier's tokens, else the default for w5h, else none."""
    out = F.lit(None).cast("bigint")
    for name, tokens in tiers.items():
        out = F.when(tier == name, F.lit(tokens).cast("bigint")).otherwise(out)
    return F.when(kind == "w5h", F.coalesce(out, F.lit(DEFAULT_LIMIT).cast("bigint")))


def used_percent(tokens: Column, limit: Column) -> Column:
    return F.when(limit <= 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), tokens * F.lit(100.0) / limit))


def token_readings(events: DataFrame, keys: list[str], plan: dict[str, int | None] | None = None) -> DataFrame:
    """Estimated readings of both kinds at now_us from tokens alone; kinds without a limit are left out.

    The limits are those of a `plan` by kind, or else estimated."""
    anchors = block_anchors(events, keys, DURATION_US["w5h"])
    rows = events.join(anchors, keys, "left")
    start = {"w5h": F.coalesce("anchor_us", "now_us"), "weekly": F.col("now_us") - 7 * DAY}
    out = None
    for kind, from_us in start.items():
        seen = rows.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("ts_us") >= from_us, F.col("total_tokens"))), F.lit(0)).alias("tokens"), F.max("ts_us").alias("source_us"), F.max("anchor_us").alias("anchor_us"))
        if plan is None:
            one = seen.join(limit_estimates(rows, keys, kind, from_us), keys).where("limit_tokens IS NOT NULL")
        else:
            one = seen.withColumn("limit_tokens", F.lit(plan[kind]).cast("bigint")).where("limit_tokens IS NOT NULL")
        resets = F.col("anchor_us") + 5 * HOUR if kind == "w5h" else F.lit(None).cast("bigint")
        one = one.select(*keys, F.lit(kind).alias("kind"), used_percent(F.col("tokens"), F.col("limit_tokens")).alias("used"), resets.alias("resets_us"), "source_us", F.lit(True).alias("is_estimated"), "tokens", "limit_tokens")
        out = one if out is None else out.unionByName(one)
    return out
