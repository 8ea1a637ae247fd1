"""Alert arming on a stream: keyed state for each series and alert kind.

Late ticks within retention are accepted; a tick older than the last one seen for
its key is judged when it comes, as in a live run. State is two values a key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from burnline.config import Thresholds
from burnline.dims import SERIES
from burnline.operators.alerts import alert_inputs, arming
from burnline.storage import shared_folder

OUT = "account string, provider string, kind string, alert string, fired_us bigint, used double"
STATE = "armed boolean, at double"


READ = ["now_us", "used", "resets_us", "rolling", "condition", "cleared"]


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """One key's ticks of a micro-batch, in time order, against its state (armed, reset at the last fire).

    The ticks are held as arrays of what arming reads, 27 bytes each, and walked by an index in time order."""
    armed, at = state.get if state.exists else (True, float("nan"))
    held, fired = (armed, None if pd.isna(at) else at), []
    parts = [[b[c].to_numpy() for c in READ] for b in batches]
    now, used, resets, rolling, condition, cleared = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    for i in np.argsort(now, kind="stable"):
        reset = None if pd.isna(resets[i]) else float(resets[i])
        held, fires = arming(held, {"resets_us": reset, "rolling": bool(rolling[i]), "condition": bool(condition[i]), "cleared": bool(cleared[i])})
        if fires:
            fired.append((*key, int(now[i]), float(used[i])))
    state.update((bool(held[0]), float("nan") if held[1] is None else float(held[1])))
    if fired:
        yield pd.DataFrame(fired, columns=[*SERIES, "alert", "fired_us", "used"])


def alert_stream(ticks: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Alerts of a stream of ticks."""
    rows = alert_inputs(ticks, t)
    return rows.groupBy(*SERIES, "alert").applyInPandasWithState(fold, OUT, STATE, "append", "NoTimeout")


def replay_stream(spark: SparkSession, ticks: DataFrame) -> DataFrame:
    """Ticks written to a folder and run through the stream to its end; the alerts it wrote."""
    root = shared_folder(spark)
    at = f"{root}/alerts-{uuid.uuid4().hex}"
    cols = ticks.select(*SERIES, "now_us", "source_us", "used", "resets_us", "status", "exhausts", "eta_us")
    cols.write.parquet(f"{at}/ticks")
    stream = alert_stream(spark.readStream.schema(cols.schema).parquet(f"{at}/ticks"))
    run = stream.writeStream.format("parquet").option("path", f"{at}/alerts").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{at}/alerts")
