"""Typed options with defaults; ``Options.overlay`` merges a nested dict over them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

from .functions import fixed


@dataclass(frozen=True)
class NoiseOptions:
    enabled: bool = True
    static_extensions: tuple[str, ...] = fixed.STATIC_EXTENSIONS
    health_paths: tuple[str, ...] = fixed.HEALTH_PATHS
    known_bots: tuple[str, ...] = fixed.KNOWN_BOTS
    ignore_status_codes: tuple[int, ...] = ()
    # off by default: also call small successful GETs noise
    small_get_below: int | None = None


@dataclass(frozen=True)
class MaskOptions:
    enabled: bool = True
    salt: str = ""
    token_ttl: int = 3600
    # pattern name -> enabled; names left out are enabled
    patterns: dict[str, bool] = field(default_factory=dict)


@dataclass(frozen=True)
class RuleOptions:
    enabled: bool = True
    brute_force_threshold: int = 5
    path_fuzz_threshold: int = 5
    brute_force_paths: tuple[str, ...] = fixed.BRUTE_PATHS
    sqli_patterns: tuple[str, ...] = fixed.SQLI_PATTERNS
    traversal_patterns: tuple[str, ...] = fixed.TRAVERSAL_PATTERNS
    scanner_agents: tuple[str, ...] = fixed.SCANNER_AGENTS
    decode_path: bool = False
    # parity switches: report one actor per scope, drop fuzzing where a scanner was seen,
    # attach every actor of the scope to row-rule findings
    first_only: bool = False
    suppress_fuzz_on_scanner: bool = False
    actor_scope: str = "matched"  # or "scope"


@dataclass(frozen=True)
class BatchOptions:
    size: int = 5
    interval_seconds: int = 30
    context_rows: int = 30
    # leave rows that a rule took out of the contexts a scorer gets
    consume: bool = False


@dataclass(frozen=True)
class ScoreOptions:
    escalation_confidence: float = 0.6
    doubtful_confidence: float = 0.8


@dataclass(frozen=True)
class AlertOptions:
    enabled: bool = True
    min_severity: str = "medium"
    channels: tuple[str, ...] = ("console",)


@dataclass(frozen=True)
class ResponseOptions:
    enabled: bool = True
    dry_run: bool = True
    auto_approve_severity: tuple[str, ...] = ()
    timeout_seconds: int = 300
    ufw_command: str = "sudo ufw"


@dataclass(frozen=True)
class IngestOptions:
    syslog_year: int = 2024
    accept_rfc5424: bool = False


@dataclass(frozen=True)
class Options:
    ingest: IngestOptions = IngestOptions()
    noise: NoiseOptions = NoiseOptions()
    mask: MaskOptions = field(default_factory=MaskOptions)
    rules: RuleOptions = RuleOptions()
    batch: BatchOptions = BatchOptions()
    score: ScoreOptions = ScoreOptions()
    alerts: AlertOptions = AlertOptions()
    response: ResponseOptions = ResponseOptions()

    def overlay(self, changes: dict[str, Any]) -> "Options":
        return _overlay(self, changes)


def _overlay(base: Any, changes: dict[str, Any]) -> Any:
    known = {f.name for f in fields(base)}
    unknown = set(changes) - known
    if unknown:
        raise KeyError(f"unknown options: {sorted(unknown)}")
    merged = {}
    for name, value in changes.items():
        current = getattr(base, name)
        if is_dataclass(current):
            merged[name] = _overlay(current, value)
        elif isinstance(current, dict):
            merged[name] = {**current, **value}
        elif isinstance(current, tuple):
            merged[name] = tuple(value)
        else:
            merged[name] = value
    return replace(base, **merged)
