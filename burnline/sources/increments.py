"""Growing logs read by increments: what changed since the last scan began is read again whole, and what it takes back is deleted.

Spark's file stream passes over a file that it has seen, however much it has grown since, so the
modification time decides here. A scan is named by the moment at which it began, and its folder is its
commit: a scan that breaks off leaves no commit and is done again by the next one, and a scan that is
run again writes its own folder over."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from burnline.dims import PARTS, SECOND
from burnline.operators.store import EVENT_KEY, total_tokens
from burnline.sources import files

CHANGES = "account string, provider string, request_id string, message_id string, ts_us bigint, model string, " + ", ".join(f"{p} bigint" for p in PARTS) + ", total_tokens bigint, gone boolean"
#: Some file systems give modification times in whole seconds; to read a file once more changes nothing.
SLACK_US = SECOND


@dataclass(frozen=True)
class Logs:
    """The log files of one account below `root`: `folders` of it hold files named `name`, which `parse` turns into changes.

    A changed `version` reads all of retention again, as another root or account does."""

    account: str
    root: str
    folders: tuple[str, ...]
    name: str
    parse: Callable[[DataFrame], DataFrame]
    version: int = 1

    def key(self) -> str:
        return hashlib.sha256(f"{self.account}\n{self.version}\n{self.root}\n{self.name}".encode()).hexdigest()[:16]

    def present(self, spark: SparkSession) -> list[str]:
        """Those of the folders that are there."""
        paths = [f"{self.root}/{f}" for f in self.folders]
        return [p for p in paths if exists(spark, p)]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def transcripts(account: str, root: str) -> Logs:
    return Logs(account, root, ("projects",), "*.jsonl", lambda rows: files.transcript_token_events(rows).withColumn("gone", F.lit(False)))


def rollouts(account: str, root: str) -> Logs:
    return Logs(account, root, ("sessions", "archived_sessions"), "rollout-*.jsonl", lambda rows: files.rollout_changes(files.rollout_events(rows)).withColumn("model", F.lit("codex")), 2)


class EventLog:
    """The token events of all logs below `path`, as changes in a folder for each log and scan."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, logs: Logs, scan: int | None = None) -> str:
        return f"{self.path}/log={logs.key()}" + ("" if scan is None else f"/scan={scan}")

    def cursor(self, logs: Logs, now_us: int) -> int | None:
        """When the last whole scan before `now_us` began; None without one."""
        if not exists(self.spark, self._folder(logs)):
            return None
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(logs))
        names = [f.getPath().getName() for f in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)]
        scans = sorted((n for n in (int(n.removeprefix("scan=")) for n in names if n.startswith("scan=")) if n < now_us), reverse=True)
        return next((n for n in scans if exists(self.spark, f"{self._folder(logs, n)}/_SUCCESS")), None)

    def scan(self, logs: Logs, now_us: int, retention_us: int) -> bool:
        """Read what was modified after the last scan began, the first time what retention holds; whether there was anything to scan.

        Folders that aren't there yet leave no cursor, so that files of any age which come later are read."""
        paths = logs.present(self.spark)
        if not exists(self.spark, logs.root) or not paths:
            return False
        since = self.cursor(logs, now_us)
        since = now_us - retention_us if since is None else since - SLACK_US
        after = datetime.fromtimestamp(since // SECOND, UTC).strftime("%Y-%m-%dT%H:%M:%S") + f".{since % SECOND:06d}"
        rows = logs.parse(files.lines(self.spark, paths, logs.name, after)).withColumn("account", F.lit(logs.account)).withColumn("total_tokens", total_tokens())
        rows.select(StructType.fromDDL(CHANGES).fieldNames()).write.mode("overwrite").parquet(self._folder(logs, now_us))
        return True

    def changes(self, now_us: int | None = None, own: bool = False) -> DataFrame:
        """What the scans up to `now_us` found, or only the scans of that moment; `gone` rows take an event back."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], f"{CHANGES}, log string, scan bigint")
        rows = self.spark.read.schema(StructType.fromDDL(f"{CHANGES}, log string, scan bigint")).parquet(self.path)
        if now_us is not None:
            rows = rows.where(F.col("scan") == now_us if own else F.col("scan") <= now_us)
        return rows

    def events(self, now_us: int | None = None) -> DataFrame:
        """Every event as its last change left it."""
        rows = self.changes(now_us)
        last = rows.groupBy("account", *EVENT_KEY).agg(F.max_by(F.struct("*"), "scan").alias("r")).select("r.*")
        return last.where(~F.col("gone")).drop("gone", "log", "scan")
