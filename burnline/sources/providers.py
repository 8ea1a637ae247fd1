"""Providers: what a tick reads of one account, behind one protocol.

`read` brings the account's token events into the log of events and returns its readings (READINGS). Live text and RPC
results come as tables from whoever asks for them."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnline.config import Config
from burnline.operators import tokens
from burnline.operators.arbitration import arbitrate
from burnline.sources import files
from burnline.sources.increments import EventLog, Logs, exists, rollouts, transcripts

READINGS = ["account", "provider", "kind", "ts_us", "used", "resets_us", "is_estimated"]


class Provider(Protocol):
    name: str

    def read(self, spark: SparkSession, cfg: Config, log: EventLog, now_us: int) -> DataFrame: ...


def resolve(setting: str, variable: str, default: str) -> str:
    """A folder by its setting, else by the environment, else by default; ~ is the home."""
    return os.path.expanduser(setting or os.environ.get(variable) or default)


def codex_home(cfg: Config) -> str:
    return resolve(cfg.codex.home, "CODEX_HOME", "~/.codex")


def claude_folder(cfg: Config) -> str:
    return resolve(cfg.claude.config_dir, "CLAUDE_CONFIG_DIR", "~/.claude")


def rate_limit_tier(spark: SparkSession, path: str, default: str = "default") -> str:
    """The plan's tier in an account file, where it is text; nothing else of the file is read out."""
    if not exists(spark, path):
        return default
    tier = F.expr("variant_get(try_parse_json(value), '$.oauthAccount.userRateLimitTier', 'variant')")
    row = spark.read.text(path, wholetext=True).select(F.when(F.schema_of_variant(tier) == "STRING", F.variant_get(tier, "$", "string")).alias("tier")).first()
    return row.tier if row and row.tier is not None else default


def _readings(rows: DataFrame, account: str, provider: str, estimated: bool = False) -> DataFrame:
    return rows.withColumns({"account": F.lit(account), "provider": F.lit(provider), "is_estimated": F.lit(estimated)}).select(READINGS)


@dataclass(frozen=True)
class Codex:
    """Rollouts below `home` and RPC results (now_us, body), if any, which compete with the newest files' last snapshots."""

    account: str
    home: str | None = None
    rpc: DataFrame | None = None
    name: str = field(default="codex", init=False)

    def logs(self, cfg: Config) -> Logs:
        return rollouts(self.account, self.home or codex_home(cfg))

    def read(self, spark: SparkSession, cfg: Config, log: EventLog, now_us: int) -> DataFrame:
        logs = self.logs(cfg)
        log.scan(logs, now_us, cfg.predictor.retention_us())
        found = []
        newest = files.newest_files(spark, logs.present(spark), logs.name)
        if newest:
            found.append(files.rollout_candidates(files.rollout_events(files.lines(spark, newest, "*"))))
        if self.rpc is not None:
            found.append(files.rpc_readings(self.rpc).select(F.lit(0).alias("rank"), F.col("now_us").alias("ts_us"), "kind", "used", "resets_us"))
        if not found:
            return spark.createDataFrame([], "account string, provider string, kind string, ts_us bigint, used double, resets_us bigint, is_estimated boolean")
        rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        return _readings(arbitrate(rows, ["kind"]), self.account, self.name)


@dataclass(frozen=True)
class Claude:
    """Transcripts below `folder`, the desktop file, live text (now_us, line) and the account file; `tiers` are the plans' tokens.

    The setting `claude.source` names one source. By default the desktop's history and live text count together, and tokens
    are used where there is neither; `limit_mode` says whether their limit is the plan's or what the busiest window showed."""

    account: str
    folder: str | None = None
    desktop: str | None = None
    texts: DataFrame | None = None
    account_file: str | None = None
    tiers: dict[str, int] = field(default_factory=dict)
    name: str = field(default="claude", init=False)

    def logs(self, cfg: Config) -> Logs:
        return transcripts(self.account, self.folder or claude_folder(cfg))

    def _from_tokens(self, spark: SparkSession, cfg: Config, log: EventLog, now_us: int) -> DataFrame:
        since = now_us - cfg.predictor.retention_us()
        mine = log.events(now_us).where((F.col("account") == self.account) & (F.col("provider") == self.name) & (F.col("ts_us") >= since)).withColumn("now_us", F.lit(now_us))
        plan = None
        if cfg.claude.limit_mode == "plan":
            tier = rate_limit_tier(spark, self.account_file) if self.account_file else "default"
            known, other = self.tiers.get(tier), cfg.claude.plan_limit_tokens
            plan = {"w5h": other if known is None else known, "weekly": known}
        rows = tokens.token_readings(mine, ["account", "provider", "now_us"], plan)
        return _readings(rows.withColumnRenamed("source_us", "ts_us"), self.account, self.name, True)

    def read(self, spark: SparkSession, cfg: Config, log: EventLog, now_us: int) -> DataFrame:
        log.scan(self.logs(cfg), now_us, cfg.predictor.retention_us())
        mode, found = cfg.claude.source, []
        if mode in ("auto", "desktop") and self.desktop and exists(spark, self.desktop):
            found.append(files.desktop_readings(spark, self.desktop))
        if mode in ("auto", "cli") and self.texts is not None:
            found.append(files.cli_readings(self.texts).withColumnRenamed("now_us", "ts_us"))
        none = spark.createDataFrame([], "kind string, ts_us bigint, used double, resets_us bigint")
        for rows in found:
            none = none.unionByName(rows.select(none.columns))
        if mode == "tokens" or mode == "auto" and none.isEmpty():
            return self._from_tokens(spark, cfg, log, now_us)
        return _readings(none, self.account, self.name)
