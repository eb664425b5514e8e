"""Strict settings of an alignment run, and the policy table that operators read.

Settings are read on the driver. Unknown keys, policies that contradict each other and
empty ranges are errors. `policy_rows` turns them into one row for each series; operators take
these rows as a DataFrame, so a plan never loops over series.
"""

from __future__ import annotations

import datetime as dt
import os
import types
import typing
from dataclasses import MISSING, dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import store

#: Fixed values of the data model: required and optional columns, groups, output order.
REQUIRED = ["usdjpy", "us2y", "us10y", "jgb2y", "jgb10y"]
OPTIONAL = ["us10y_real"]
GROUPS = {"usdjpy": "fx", "us2y": "us", "us10y": "us", "us10y_real": "us", "jgb2y": "jgb", "jgb10y": "jgb"}
SPREADS = {"spread2y": ("us2y", "jgb2y"), "spread10y": ("us10y", "jgb10y")}
LAGS = {"fx_lag_days": "fx", "us_lag_days": "us", "jgb_lag_days": "jgb"}
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
CONVENTIONS = {"ny_close": {"fx": "none", "us": "none", "jgb": "none"}, "tokyo_close": {"fx": "previous", "us": "previous", "jgb": "none"}}
POLICY_SCHEMA = "series string, grp string, market string, max_lag int, shift string, required boolean, exact boolean"
WARM_UP_DAYS = 31


class ConfigError(ValueError):
    """Settings that can't be used."""


@dataclass(frozen=True)
class Project:
    start_date: dt.date
    name: str = "daily"
    end_date: dt.date | None = None

    @property
    def end(self) -> dt.date:
        return self.end_date or dt.datetime.now(dt.timezone.utc).date()


@dataclass(frozen=True)
class Paths:
    raw_dir: str = "data/raw"
    processed_dir: str = "data/processed"
    reports_dir: str = "reports"
    signals_dir: str = "signals"


@dataclass(frozen=True)
class Fred:
    series: dict[str, str]
    csv_url_template: str = "https://fred.stlouisfed.org/graph/fredgraph.csv?id={series}"
    api_key_env: str = "FRED_API_KEY"
    snapshot_note: str = ""


@dataclass(frozen=True)
class Mof:
    tenors: dict[str, str]
    all_history_url: str = ""
    current_year_url: str = ""
    encoding_candidates: tuple[str, ...] = ("utf-8", "cp932", "latin-1")
    snapshot_note: str = ""


@dataclass(frozen=True)
class Fx:
    provider: str = "yahoo"
    yahoo_ticker: str = "USDJPY=X"
    yahoo_field: str = "Close"
    snapshot_note: str = ""


@dataclass(frozen=True)
class Spot:
    symbol: str = "USD"
    currency: str = "JPY"
    exchange: str = "IDEALPRO"
    what_to_show: str = "MIDPOINT"


@dataclass(frozen=True)
class Futures:
    symbol: str = "JPY"
    exchange: str = "CME"


@dataclass(frozen=True)
class Ibkr:
    host_env: str = "IBKR_HOST"
    port_env: str = "IBKR_PORT"
    client_id_env: str = "IBKR_CLIENT_ID"
    spot: Spot = field(default_factory=Spot)
    futures: Futures = field(default_factory=Futures)
    bar_size: str = "1 day"
    use_rth: bool = False
    live_account_confirmed: bool = False


@dataclass(frozen=True)
class Sources:
    fred: Fred
    mof: Mof
    fx: Fx = field(default_factory=Fx)
    ibkr: Ibkr = field(default_factory=Ibkr)


@dataclass(frozen=True)
class Alignment:
    drop_if_missing: tuple[str, ...]
    asof_max_lag_days: dict[str, int]
    convention: str = "ny_close"
    weekmask: str = "Mon Tue Wed Thu Fri"
    publication_lag_days: int = 3


@dataclass(frozen=True)
class Validation:
    bounds: dict[str, tuple[float, float]]
    required_start_before: dt.date
    max_gap_business_days: int = 5
    min_rows: int = 2500
    max_days_stale_end: int = 10


@dataclass(frozen=True)
class Config:
    project: Project
    sources: Sources
    alignment: Alignment
    validation: Validation
    paths: Paths = field(default_factory=Paths)
    #: The folder that `paths` start from, set by `load`.
    root: str = "."

    def folder(self, kind: str) -> Path | str:
        """The raw, processed, reports or signals folder: a path, or a URI if the root is one."""
        name = getattr(self.paths, f"{kind}_dir")
        return store.join(self.root, name) if store.is_uri(self.root) else Path(self.root) / name


def _value(kind: Any, value: Any, where: str) -> Any:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if is_dataclass(kind):
        return _build(kind, value, where)
    if origin in (types.UnionType, typing.Union):
        return None if value is None else _value(next(a for a in args if a is not type(None)), value, where)
    if origin is dict:
        if not isinstance(value, dict):
            raise ConfigError(f"{where}: a mapping is needed")
        return {str(k): _value(args[1], v, f"{where}.{k}") for k, v in value.items()}
    if origin is tuple:
        if not isinstance(value, (list, tuple)) or args[-1] is not ... and len(value) != len(args):
            raise ConfigError(f"{where}: a list{'' if args[-1] is ... else f' of {len(args)}'} is needed")
        return tuple(_value(args[0], v, f"{where}[{i}]") for i, v in enumerate(value))
    if kind is dt.date:
        try:
            return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value))
        except ValueError:
            raise ConfigError(f"{where}: {value!r} is no date") from None
    if kind is float and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind) or kind is int and isinstance(value, bool):
        raise ConfigError(f"{where}: {value!r} is no {kind.__name__}")
    return value


def _build(kind: type, data: Any, where: str) -> Any:
    if not isinstance(data, dict):
        raise ConfigError(f"{where}: a mapping is needed")
    hints, known = typing.get_type_hints(kind), {f.name: f for f in fields(kind)}
    if unknown := sorted(set(data) - set(known)):
        raise ConfigError(f"{where}: unknown keys {', '.join(unknown)}")
    missing = [n for n, f in known.items() if n not in data and f.default is MISSING and f.default_factory is MISSING]
    if missing:
        raise ConfigError(f"{where}: missing keys {', '.join(missing)}")
    return kind(**{k: _value(hints[k], v, f"{where}.{k}") for k, v in data.items()})


def parse(data: dict) -> Config:
    """A checked Config from nested mappings."""
    config = _build(Config, data, "config")
    a, v = config.alignment, config.validation
    problems = [
        (a.convention not in CONVENTIONS, f"convention is one of {', '.join(CONVENTIONS)}"),
        (bool(set(a.drop_if_missing) & set(a.asof_max_lag_days)), "a column is either exact or as-of"),
        (any(x < 0 for x in a.asof_max_lag_days.values()), "as-of lags are 0 or more"),
        (a.publication_lag_days < 0, "publication_lag_days is 0 or more"),
        (not a.weekmask.split() or not set(a.weekmask.split()) <= set(WEEKDAYS), f"weekmask has names of {' '.join(WEEKDAYS)}"),
        (any(lo >= hi for lo, hi in v.bounds.values()), "bounds are lower than they are high"),
        (v.max_gap_business_days < 1, "max_gap_business_days is 1 or more"),
        (v.min_rows < 1, "min_rows is 1 or more"),
        (v.max_days_stale_end < 0, "max_days_stale_end is 0 or more"),
        (config.sources.fx.provider not in ("yahoo", "ibkr"), "provider is yahoo or ibkr"),
        (config.project.end < config.project.start_date, "end_date is not before start_date"),
    ]
    for wrong, what in problems:
        if wrong:
            raise ConfigError(what)
    return config


DEFAULT_PATH = "configs/default.yaml"


def resolve_root(root: str | Path | None = None) -> Path | str:
    """The folder that relative paths start from: the argument, DRIFTGRID_ROOT, or the current one; a URI stays as it is."""
    found = root or os.environ.get("DRIFTGRID_ROOT") or "."
    return str(found).rstrip("/") if store.is_uri(str(found)) else Path(found).expanduser().resolve()


def load(path: str | Path | None = None, root: str | Path | None = None) -> Config:
    """The settings of a YAML file; a relative path, configs/default.yaml if none is given, starts from the root."""
    import yaml

    base = resolve_root(root)
    name = str(path or DEFAULT_PATH)
    if store.is_uri(name) or isinstance(base, str) and not Path(name).is_absolute():
        text = store.read(name if store.is_uri(name) else store.join(base, name)).decode()
    else:
        text = (Path(name) if isinstance(base, str) else base / name).read_text(encoding="utf-8")
    data = yaml.safe_load(text) or {}
    if isinstance(data, dict) and "root" in data:
        raise ConfigError("config: unknown keys root")
    return replace(parse(data), root=str(base))


def weekdays_of(mask: str) -> list[int]:
    """Weekday numbers, Monday 0."""
    return sorted(WEEKDAYS.index(name) for name in set(mask.split()))


def check_series(found: set[str]) -> None:
    if missing := sorted(set(REQUIRED) - found):
        raise ConfigError(f"missing series: {', '.join(missing)}")
    if unknown := sorted(found - set(GROUPS)):
        raise ConfigError(f"unknown series: {', '.join(unknown)}")


def policy_rows(alignment: Alignment, series: list[str]) -> list[tuple]:
    """(series, grp, market, max_lag, shift, required, exact) for each series; one without a policy is an error."""
    check_series(set(series))
    rows = []
    for name in series:
        exact = name in alignment.drop_if_missing
        if not exact and name not in alignment.asof_max_lag_days:
            raise ConfigError(f"{name} is neither exact nor as-of")
        group = GROUPS[name]
        lag = 0 if exact else alignment.asof_max_lag_days[name]
        rows.append((name, group, "jp" if group == "jgb" else "us", lag, CONVENTIONS[alignment.convention][group], name in REQUIRED, exact))
    return rows


def policy(spark: SparkSession, alignment: Alignment, series: list[str]) -> DataFrame:
    """The policy as a DataFrame; its size is that of the settings, so it may be broadcast."""
    return spark.createDataFrame(policy_rows(alignment, series), POLICY_SCHEMA)
