"""Constants of the domain, the window-kind and provider facts, and columns over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000
SERIES = ["account", "provider", "kind"]
PARTS = ("input_tokens", "output_tokens", "cache_creation", "cache_read")
PROVIDERS, KINDS = ("claude", "codex"), ("w5h", "weekly")

# Fixed values.
DURATION_US = {"w5h": 5 * HOUR, "weekly": 7 * DAY}
LOOKBACK_US = {"w5h": HOUR, "weekly": 6 * HOUR}
STALE_US = {"w5h": 600 * SECOND, "weekly": 10_800 * SECOND}
DENSE_US = {"w5h": HOUR, "weekly": 24 * HOUR}
RETENTION_US = 56 * DAY
RESET_DROP, NEAR_ZERO, MIN_CALIBRATION, EXHAUSTED = 5.0, 10.0, 3.0, 100.0
PAIR_GAP_US, BUCKETS = 3 * HOUR, 168
LIVE_HALFLIFE_H, DECAY_HALFLIFE_DAYS = 0.5, 21.0
DEFAULT_LIMIT, SAFETY, MIN_HISTORY_US = 88_000, 0.9, {"w5h": 2 * HOUR, "weekly": 24 * HOUR}
MIN_MOMENTS, MIN_GAIN = 500, 0.15
RESET_TIE_US, CANDIDATE_FILES = 60 * SECOND, 5


def by_kind(values: dict[str, int], kind: str | Column = "kind") -> Column:
    """The value of a row's kind, as a bigint."""
    col = F.col(kind) if isinstance(kind, str) else kind
    return F.when(col == "w5h", F.lit(values["w5h"])).when(col == "weekly", F.lit(values["weekly"])).cast("bigint")


def is_rolling() -> Column:
    """Only codex's weekly window rolls; all others are fixed blocks."""
    return (F.col("provider") == "codex") & (F.col("kind") == "weekly")
