"""Logs read by increments, providers, and polls of both."""

import json
import os
from dataclasses import replace

from burnline.config import Claude as ClaudeSettings
from burnline.config import Config
from burnline.dims import DAY, HOUR, SECOND
from burnline.plans.tick import Store, poll
from burnline.sources import files, providers
from burnline.sources.increments import EventLog, rollouts, transcripts

T0 = 1_767_323_045_000_000  # 2026-01-02T03:04:05Z
RETENTION = 56 * DAY


def stamp(second: int) -> str:
    return f"2026-01-02T03:04:{second:02d}Z"


def step(second: int, out: int, total: int | None, limits=None) -> str:
    info = {"last_token_usage": {"input_tokens": 1, "output_tokens": out}} | ({} if total is None else {"total_token_usage": {"total_tokens": total}})
    return json.dumps({"timestamp": stamp(second), "payload": {"type": "token_count", "info": info, "rate_limits": limits}})


def write(path, rows: list[str], mtime_us: int) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(rows))
    os.utime(path, ns=(mtime_us * 1000, mtime_us * 1000))


def held(log: EventLog) -> dict:
    return {(r.request_id, r.message_id): r.output_tokens for r in log.events().collect()}


def test_a_growing_rollout_ends_as_if_read_once(spark, tmp_path):
    """A total that comes again across two scans is no event; a total that is missing hides nothing."""
    file = tmp_path / "home" / "sessions" / "2026" / "rollout-a.jsonl"
    logs, log = rollouts("me", str(tmp_path / "home")), EventLog(spark, str(tmp_path / "log"))
    rows = [step(1, 5, 10), step(2, 6, 20)]
    write(file, rows, T0)
    assert log.scan(logs, T0 + HOUR, RETENTION)
    assert held(log) == {("rollout-a", stamp(1)): 5, ("rollout-a", stamp(2)): 6}
    rows += [step(3, 6, 20), step(4, 1, None), step(5, 6, 20), "{broken", step(6, 7, 30)]
    write(file, rows, T0 + 2 * HOUR)
    log.scan(logs, T0 + 3 * HOUR, RETENTION)
    once = EventLog(spark, str(tmp_path / "once"))
    once.scan(logs, T0 + 3 * HOUR, RETENTION)
    assert held(log) == held(once) == {("rollout-a", stamp(s)): n for s, n in ((1, 5), (2, 6), (4, 1), (6, 7))}


def test_repeats_that_are_stored_are_taken_back(spark, tmp_path):
    """An earlier version that took repeats for events: the next version reads all again and deletes just these."""
    root, log = str(tmp_path / "home"), EventLog(spark, str(tmp_path / "log"))
    write(tmp_path / "home" / "sessions" / "rollout-a.jsonl", [step(1, 5, 10), step(2, 5, 10), step(3, 6, 16)], T0)
    new = rollouts("me", root)
    old = replace(new, version=1, parse=lambda rows: new.parse(rows).withColumn("gone", files.F.lit(False)).fillna(0))
    log.scan(old, T0 + HOUR, RETENTION)
    assert len(held(log)) == 3
    log.scan(new, T0 + 2 * HOUR, RETENTION)
    assert held(log) == {("rollout-a", stamp(1)): 5, ("rollout-a", stamp(3)): 6}


def test_only_what_changed_is_read(spark, tmp_path):
    """A file over a second older than the last scan's start isn't opened; the first scan stops at retention; a scan may be run again."""
    at = lambda n: tmp_path / "home" / "sessions" / f"rollout-{n}.jsonl"
    logs, log = rollouts("me", str(tmp_path / "home")), EventLog(spark, str(tmp_path / "log"))
    write(at("old"), [step(1, 1, 1)], T0 - RETENTION)
    write(at("new"), [step(1, 2, 1)], T0)
    log.scan(logs, T0 + HOUR, RETENTION)
    assert held(log) == {("rollout-new", stamp(1)): 2}
    write(at("new"), [step(1, 99, 1)], T0 + HOUR - SECOND)
    write(at("next"), [step(1, 3, 1)], T0 + HOUR)  # times may be whole seconds
    for _ in range(2):
        log.scan(logs, T0 + 2 * HOUR, RETENTION)
        assert held(log) == {("rollout-new", stamp(1)): 2, ("rollout-next", stamp(1)): 3}
        assert log.changes(T0 + 2 * HOUR, own=True).count() == 1
    assert log.cursor(logs, T0 + 2 * HOUR) == T0 + HOUR and log.cursor(logs, T0 + HOUR) is None
    assert log.cursor(replace(logs, root="/elsewhere"), T0 + 3 * HOUR) is None


def test_a_scan_that_broke_off_is_no_cursor(spark, tmp_path):
    logs, log = rollouts("me", str(tmp_path / "home")), EventLog(spark, str(tmp_path / "log"))
    write(tmp_path / "home" / "sessions" / "rollout-a.jsonl", [step(1, 5, 10)], T0)
    log.scan(logs, T0 + HOUR, RETENTION)
    os.remove(tmp_path / "log" / f"log={logs.key()}" / f"scan={T0 + HOUR}" / "_SUCCESS")
    assert log.cursor(logs, T0 + 2 * HOUR) is None
    log.scan(logs, T0 + 2 * HOUR, RETENTION)
    assert held(log) == {("rollout-a", stamp(1)): 5}


def test_folders_that_are_not_there_leave_no_cursor(spark, tmp_path):
    logs, log = transcripts("me", str(tmp_path / "home")), EventLog(spark, str(tmp_path / "log"))
    assert not log.scan(logs, T0 + HOUR, RETENTION) and not held(log)
    usage = {"timestamp": stamp(1), "requestId": "r", "message": {"id": "m", "role": "assistant", "model": "x", "usage": {"output_tokens": 4}}}
    write(tmp_path / "home" / "projects" / "p" / "a.jsonl", [json.dumps(usage)], T0)
    assert log.scan(logs, T0 + 2 * HOUR, RETENTION)
    assert held(log) == {("r", "m"): 4}


def test_newest_files(spark, tmp_path):
    for i in range(7):
        write(tmp_path / f"rollout-{i}.jsonl", ["x"], T0 + i * SECOND)
    write(tmp_path / "other.jsonl", ["x"], T0 + DAY)
    got = [p.rsplit("-", 1)[1] for p in files.newest_files(spark, [str(tmp_path)], "rollout-*.jsonl")]
    assert got == [f"{i}.jsonl" for i in (6, 5, 4, 3, 2)] and files.newest_files(spark, [], "*") == []


def test_account_file(spark, tmp_path):
    """Only text counts as a tier; anything else is the default."""
    path = tmp_path / "account.json"
    assert providers.rate_limit_tier(spark, str(path)) == "default"
    for body, want in (('{"oauthAccount": {"userRateLimitTier": "large"}}', "large"), ('{"oauthAccount": {"userRateLimitTier": 5}}', "default"), ('{"oauthAccount": "x"}', "default"), ("{broken", "default"), ("", "default")):
        path.write_text(body)
        assert providers.rate_limit_tier(spark, str(path)) == want


def test_paths(monkeypatch):
    """The setting, else the environment, else the home's folder."""
    monkeypatch.delenv("CODEX_HOME", raising=False)
    cfg = Config()
    assert providers.codex_home(cfg) == os.path.expanduser("~/.codex")
    monkeypatch.setenv("CODEX_HOME", "/env")
    assert providers.codex_home(cfg) == "/env"
    assert providers.codex_home(replace(cfg, codex=replace(cfg.codex, home="~/own"))) == os.path.expanduser("~/own")


def test_sources_of_claude(spark, tmp_path):
    """Tokens only where nothing else is read; a named source stands alone; the plan's limit where it is asked for."""
    usage = {"timestamp": stamp(1), "requestId": "r", "message": {"id": "m", "role": "assistant", "model": "x", "usage": {"output_tokens": 11_000}}}
    write(tmp_path / "projects" / "a.jsonl", [json.dumps(usage)], T0)
    desktop = tmp_path / "usage.json"
    desktop.write_text(json.dumps({"samples": [{"t": T0 / 1000, "org": "b", "u": {"fh": 30}}]}))
    account = tmp_path / "account.json"
    account.write_text('{"oauthAccount": {"userRateLimitTier": "large"}}')
    texts = spark.createDataFrame([(T0 + HOUR, "Current session: 40% used")], "now_us bigint, line string")
    log, now = EventLog(spark, str(tmp_path / "log")), T0 + HOUR

    def read(desk=None, text=None, **settings):
        p = providers.Claude("me", str(tmp_path), desk, text, str(account), {"large": 220_000})
        return sorted((r.kind, r.used, r.is_estimated) for r in p.read(spark, replace(Config(), claude=ClaudeSettings(**settings)), log, now).collect())

    assert read() == read(str(desktop), texts, source="tokens") == [("w5h", 12.5, True)]
    assert read(limit_mode="plan") == [("w5h", 5.0, True), ("weekly", 5.0, True)]
    assert read(str(desktop), texts) == [("w5h", 30.0, False), ("w5h", 40.0, False)]
    assert read(str(desktop), texts, source="cli") == [("w5h", 40.0, False)]
    assert read(str(desktop), texts, source="desktop") == [("w5h", 30.0, False)]
    assert read(str(tmp_path / "none.json"), source="desktop") == []


def test_poll(spark, tmp_path):
    """A tick over what providers read: newest snapshot against RPC, events stored, and taken back when a later read says so."""
    limits = {"primary": {"used_percent": 20.0, "window_minutes": 300, "resets_at": T0 / SECOND + 9000}, "secondary": None}
    file = tmp_path / "home" / "sessions" / "rollout-a.jsonl"
    write(file, [step(1, 5, 10, limits), step(2, 6, 20, limits)], T0 + 10 * SECOND)
    store, cfg = str(tmp_path / "store"), replace(Config(), timezone="UTC")
    codex = providers.Codex("me", str(tmp_path / "home"))
    out = poll(spark, store, [codex], T0 + 60 * SECOND, cfg, "linear")
    rows = {r.kind: (r.used, r.status) for r in out.forecasts.where("provider = 'codex'").collect()}
    assert rows["w5h"][0] == 20.0 and rows["weekly"][1] == "NO_DATA"
    kept = lambda: {r.message_id for r in Store(spark, store).token_events().collect()}
    assert kept() == {stamp(1), stamp(2)}
    write(file, [step(1, 5, 10, limits), step(2, 6, 10, limits), step(3, 6, 20, limits)], T0 + 70 * SECOND)
    later = T0 / SECOND + 90_000
    rpc = spark.createDataFrame([(T0 + 80 * SECOND, json.dumps({"rateLimits": {"primary": {"usedPercent": 3, "windowDurationMins": 300, "resetsAt": later}}}))], "now_us bigint, body string")
    out = poll(spark, store, [replace(codex, rpc=rpc)], T0 + 120 * SECOND, cfg, "linear")
    assert kept() == {stamp(1), stamp(3)}
    assert out.forecasts.where("kind = 'w5h' AND provider = 'codex'").first().used == 3.0
