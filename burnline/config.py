"""Settings: TOML into frozen dataclasses; unknown names and values out of range are refused."""

from __future__ import annotations

import difflib
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from datetime import datetime, time
from pathlib import Path
from zoneinfo import ZoneInfo


class ConfigError(ValueError):
    """A setting that can't be used."""


@dataclass(frozen=True)
class Prices:
    input_per_million: float = 0.0
    output_per_million: float = 0.0
    cache_creation_per_million: float = 0.0
    cache_read_per_million: float = 0.0


def priced(cfg: "Config") -> dict[str, tuple[float, float, float, float]]:
    """Dollars a million tokens by provider: input, output, cache creation, cache read."""
    return {name: (q.input_per_million, q.output_per_million, q.cache_creation_per_million, q.cache_read_per_million) for name, q in (("claude", cfg.claude.prices), ("codex", cfg.codex.prices))}


@dataclass(frozen=True)
class Claude:
    enabled: bool = True
    source: str = "auto"
    limit_mode: str = "p90"
    plan_limit_tokens: int = 88_000
    config_dir: str = ""
    prices: Prices = field(default_factory=Prices)


@dataclass(frozen=True)
class Codex:
    enabled: bool = True
    home: str = ""
    prices: Prices = field(default_factory=Prices)


@dataclass(frozen=True)
class Windows:
    watch: tuple[str, ...] = ("weekly", "w5h")


@dataclass(frozen=True)
class Thresholds:
    warn_percent: float = 90.0
    threshold_hysteresis: float = 10.0
    burn_min_percent: float = 25.0
    burn_alert_within_hours: float = 1.0
    stale_after_minutes_w5h: float = 10.0
    stale_after_minutes_weekly: float = 180.0

    def stale_us(self) -> dict[str, int]:
        return {"w5h": round(self.stale_after_minutes_w5h * 60e6), "weekly": round(self.stale_after_minutes_weekly * 60e6)}


@dataclass(frozen=True)
class Predictor:
    model: str = "auto"
    lookback_minutes_weekly: float = 360.0
    lookback_minutes_w5h: float = 60.0
    history_retention_weeks: int = 8
    mc_runs: int = 2000
    bucket_decay_halflife_days: float = 21.0

    def lookback_us(self) -> dict[str, int]:
        return {"w5h": round(self.lookback_minutes_w5h * 60e6), "weekly": round(self.lookback_minutes_weekly * 60e6)}

    def retention_us(self) -> int:
        return self.history_retention_weeks * 7 * 86_400_000_000


@dataclass(frozen=True)
class WorkingHours:
    enabled: bool = True
    start: str = "09:00"
    end: str = "17:00"
    days: tuple[str, ...] = ("mon", "tue", "wed", "thu", "fri")

    def hours(self) -> tuple[float, float]:
        """The day's start and end as hours."""
        a, b = self.bounds()
        return a.hour + a.minute / 60, b.hour + b.minute / 60

    def bounds(self) -> tuple[time, time]:
        return time.fromisoformat(self.start), time.fromisoformat(self.end)

    def weekdays(self) -> frozenset[int]:
        """Monday is 0."""
        return frozenset("mon tue wed thu fri sat sun".split().index(d) for d in self.days)


@dataclass(frozen=True)
class Config:
    poll_interval_seconds: float = 60.0
    timezone: str = "system"
    claude: Claude = field(default_factory=Claude)
    codex: Codex = field(default_factory=Codex)
    windows: Windows = field(default_factory=Windows)
    thresholds: Thresholds = field(default_factory=Thresholds)
    predictor: Predictor = field(default_factory=Predictor)
    working_hours: WorkingHours = field(default_factory=WorkingHours)


def _build(kind: type, raw: dict, where: str):
    known = {f.name: f for f in fields(kind)}
    for name in raw:
        if name not in known:
            close = difflib.get_close_matches(name, known, 1)
            raise ConfigError(f"unknown setting {where}{name}" + (f"; did you mean {close[0]}?" if close else ""))
    values = {}
    for name, value in raw.items():
        default = getattr(kind(), name)
        if is_dataclass(default):
            if not isinstance(value, dict):
                raise ConfigError(f"{where}{name} must be a table")
            value = _build(type(default), value, f"{where}{name}.")
        elif isinstance(default, tuple):
            value = tuple(value)
        elif isinstance(default, bool) != isinstance(value, bool):
            raise ConfigError(f"{where}{name} has the wrong type")
        elif isinstance(default, (int, float)) and not isinstance(value, (int, float)):
            raise ConfigError(f"{where}{name} must be a number")
        elif isinstance(default, str) and not isinstance(value, str):
            raise ConfigError(f"{where}{name} must be text")
        values[name] = value
    return kind(**values)


def validate(cfg: Config) -> Config:
    t, p, w = cfg.thresholds, cfg.predictor, cfg.working_hours
    checks = [
        (cfg.poll_interval_seconds > 0, "poll_interval_seconds must be positive"),
        (0 <= t.warn_percent <= 100, "warn_percent must be in [0, 100]"),
        (0 <= t.threshold_hysteresis, "threshold_hysteresis can't be negative"),
        (0 <= t.burn_min_percent <= 100, "burn_min_percent must be in [0, 100]"),
        (t.burn_alert_within_hours > 0, "burn_alert_within_hours must be positive"),
        (t.stale_after_minutes_w5h > 0 and t.stale_after_minutes_weekly > 0, "stale_after_minutes must be positive"),
        (p.lookback_minutes_weekly > 0 and p.lookback_minutes_w5h > 0, "lookback minutes must be positive"),
        (p.history_retention_weeks >= 1, "history_retention_weeks must be 1 or more"),
        (p.mc_runs >= 1, "mc_runs must be 1 or more"),
        (p.model in ("auto", "linear", "montecarlo"), f"unknown model {p.model!r}"),
        (cfg.claude.limit_mode in ("p90", "plan"), "limit_mode must be p90 or plan"),
        (cfg.claude.source in ("auto", "tokens", "cli", "desktop"), "claude.source must be auto, tokens, cli or desktop"),
        (set(cfg.windows.watch) <= {"w5h", "weekly"}, "windows.watch may hold w5h and weekly"),
        (all(x >= 0 for q in (cfg.claude.prices, cfg.codex.prices) for x in vars(q).values()), "prices can't be negative"),
    ]
    for ok, message in checks:
        if not ok:
            raise ConfigError(message)
    try:
        start, end = w.bounds()
        w.weekdays()
    except ValueError as e:
        raise ConfigError(f"working_hours: {e}") from e
    if w.enabled and start >= end:
        raise ConfigError("working_hours.start must be before end")
    if cfg.timezone != "system":
        try:
            ZoneInfo(cfg.timezone)
        except Exception as e:
            raise ConfigError(f"unknown timezone {cfg.timezone!r}") from e
    return cfg


def load_config(path: str | None = None) -> Config:
    """The settings of a TOML file, or the defaults where there is none."""
    if path is None or not Path(path).exists():
        return Config()
    with open(path, "rb") as f:
        return validate(_build(Config, tomllib.load(f), ""))


def time_zone(cfg: Config) -> str:
    """The IANA zone to plan in; where none is set the system's link, else its offset of today."""
    if cfg.timezone != "system":
        return cfg.timezone
    link = Path("/etc/localtime")
    name = str(link.resolve()).partition("zoneinfo/")[2] if link.is_symlink() else ""
    if name:
        return name
    minutes = round(datetime.now().astimezone().utcoffset().total_seconds() / 60)
    return "UTC" if not minutes else f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"


def default_text() -> str:
    """A config file that states the defaults."""

    def lines(value, head: str) -> list[str]:
        own, nested = [], []
        for f in fields(value):
            x = getattr(value, f.name)
            if is_dataclass(x):
                nested += lines(x, f"{head}{'.' if head else ''}{f.name}")
            else:
                shown = str(x).lower() if isinstance(x, bool) else str(list(x)).replace("'", '"') if isinstance(x, tuple) else f'"{x}"' if isinstance(x, str) else str(x)
                own.append(f"{f.name} = {shown}")
        return ([f"\n[{head}]"] if head and own else []) + own + nested

    return "\n".join(lines(Config(), "")).lstrip() + "\n"


def write_default(path: str) -> bool:
    """Write the default file unless there is one."""
    p = Path(path)
    if p.exists():
        return False
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(default_text())
    return True
