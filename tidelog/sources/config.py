"""Configuration: ``default.toml``, then ``<environment>.toml``, then ``TIDELOG_SECTION__KEY`` variables; later wins."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

from tidelog.errors import ConfigInvalid

PREFIX = "TIDELOG_"


@dataclass
class Source:
    connection: str = ""
    slot: str = "tidelog"
    publication: str = "tidelog"
    tables: list[dict] = field(default_factory=list)


@dataclass
class Storage:
    path: str = "data/log"
    compression: str = "lz4"
    ttl_secs: int = 0


@dataclass
class Pipeline:
    flush_bytes: int = 4 << 20
    flush_age_us: int = 500
    ring_capacity: int = 65_536
    filters: dict[str, str] = field(default_factory=dict)


@dataclass
class Egress:
    credit_window: int = 1000
    max_consumers: int = 100


@dataclass
class Webhook:
    targets: list[dict] = field(default_factory=list)
    batch_size: int = 100
    max_attempts: int = 5
    initial_backoff_ms: int = 100
    failure_threshold: int = 5
    open_timeout_ms: int = 30_000


@dataclass
class Memory:
    budget_bytes: int = 1 << 30
    warn_ratio: float = 0.8


@dataclass
class Slot:
    lag_cap_bytes: int = 10 << 30
    check_interval_secs: int = 10


@dataclass
class EngineConfig:
    source: Source = field(default_factory=Source)
    storage: Storage = field(default_factory=Storage)
    pipeline: Pipeline = field(default_factory=Pipeline)
    egress: Egress = field(default_factory=Egress)
    webhook: Webhook = field(default_factory=Webhook)
    memory: Memory = field(default_factory=Memory)
    slot: Slot = field(default_factory=Slot)


#: Names of codecs and what Parquet calls them.
CODECS = {"none": "uncompressed", "snappy": "snappy", "zstd": "zstd"}


def parquet_codec(name: str) -> str:
    """Any other name means LZ4."""
    return CODECS.get(name, "lz4_raw")


def merged(low: dict, high: dict) -> dict:
    out = dict(low)
    for k, v in high.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _from_environment(environment: dict[str, str]) -> dict:
    out: dict = {}
    for name, value in environment.items():
        if name.startswith(PREFIX):
            *path, last = name.removeprefix(PREFIX).lower().split("__")
            at = out
            for k in path:
                at = at.setdefault(k, {})
            at[last] = value
    return out


def _filled(kind: type, data: dict, where: str):
    known = {f.name: f for f in fields(kind)}
    values = {}
    for k, v in data.items():
        if k not in known:
            continue
        default = known[k].default_factory() if callable(known[k].default_factory) else known[k].default
        try:
            if is_dataclass(default):
                values[k] = _filled(type(default), v, f"{where}{k}.")
            elif isinstance(default, (int, float)) and not isinstance(v, (int, float)):
                values[k] = type(default)(v)
            else:
                values[k] = v
        except (TypeError, ValueError, AttributeError):
            raise ConfigInvalid(f"{where}{k}: {v!r}") from None
    return kind(**values)


def load(folder: str | Path, environment: str = "development", variables: dict[str, str] | None = None) -> EngineConfig:
    folder = Path(folder)
    try:
        data = tomllib.loads((folder / "default.toml").read_text())
        own = folder / f"{environment}.toml"
        if own.exists():
            data = merged(data, tomllib.loads(own.read_text()))
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ConfigInvalid(str(e)) from e
    data = merged(data, _from_environment(dict(os.environ) if variables is None else variables))
    return _filled(EngineConfig, data, "")
