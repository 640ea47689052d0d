"""Settings: defaults, then a TOML file, then the environment, then arguments; each overrides the ones before."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from dataclasses import dataclass, field
from typing import Any

PREFIX = "FACTLAKE_"


@dataclass(frozen=True)
class Retrieval:
    k: int = 3
    threshold: float = 0.35
    max_inject_chars: int = 600


@dataclass(frozen=True)
class Lexical:
    k1: float = 1.2
    b: float = 0.75
    midpoint: float = 1.0
    steepness: float = 1.0
    stemmed: bool = True


@dataclass(frozen=True)
class Ledger:
    enabled: bool = True
    pool_k: int = 12
    min_overlap: int = 3
    overlap_fraction: float = 0.15


@dataclass(frozen=True)
class Manifest:
    full_below: int = 300
    max_topics: int = 100
    token_budget: int = 200


@dataclass(frozen=True)
class Archival:
    main_max_mb: float = 200.0
    archive_max_mb: float = 100.0
    superseded_after_days: int = 90
    quarantined_after_days: int = 60
    decay_min_age_days: int = 30
    keep_tag: str = "keep"


@dataclass(frozen=True)
class Maintenance:
    log_keep_days: int = 14
    backup_keep: int = 5
    candidates_keep: int = 20_000
    tune_min_attributed: int = 20


@dataclass(frozen=True)
class Config:
    data_dir: str = "memory"
    retrieval: Retrieval = field(default_factory=Retrieval)
    lexical: Lexical = field(default_factory=Lexical)
    ledger: Ledger = field(default_factory=Ledger)
    manifest: Manifest = field(default_factory=Manifest)
    archival: Archival = field(default_factory=Archival)
    maintenance: Maintenance = field(default_factory=Maintenance)


def _coerce(raw: Any, like: Any) -> Any:
    if isinstance(like, bool):
        return raw if isinstance(raw, bool) else str(raw).strip().lower() in ("1", "true", "yes", "on")
    return type(like)(raw)


def _build(default: Any, values: dict[str, Any]) -> Any:
    known = {f.name: getattr(default, f.name) for f in dataclasses.fields(default)}
    return dataclasses.replace(default, **{k: _build(known[k], v) if dataclasses.is_dataclass(known[k]) else _coerce(v, known[k]) for k, v in values.items() if k in known})


def _merged(a: dict, b: dict) -> dict:
    return a | {k: _merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


def _environment() -> dict[str, Any]:
    """FACTLAKE_RETRIEVAL__K=5 sets retrieval.k."""
    out: dict[str, Any] = {}
    for name, value in os.environ.items():
        if name.startswith(PREFIX):
            at = out
            *path, last = name[len(PREFIX) :].lower().split("__")
            for p in path:
                at = at.setdefault(p, {})
            at[last] = value
    return out


def load(path: str | None = None, overrides: dict[str, Any] | None = None) -> Config:
    """The settings in force; a file that is missing counts as empty."""
    file: dict[str, Any] = {}
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            file = tomllib.load(f)
    return _build(Config(), _merged(_merged(file, _environment()), overrides or {}))


def render(config: Config) -> str:
    """The settings as TOML, all of them."""
    def value(v: Any) -> str:
        return str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else repr(v)

    top = [f"{f.name} = {value(getattr(config, f.name))}" for f in dataclasses.fields(config) if not dataclasses.is_dataclass(getattr(config, f.name))]
    for f in dataclasses.fields(config):
        section = getattr(config, f.name)
        if dataclasses.is_dataclass(section):
            top += ["", f"[{f.name}]", *[f"{g.name} = {value(getattr(section, g.name))}" for g in dataclasses.fields(section)]]
    return "\n".join(top) + "\n"
