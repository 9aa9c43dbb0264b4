"""Configuration as dataclasses: every section and key has a default, unknown keys are ignored, TOML both ways."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints

from .errors import ConfigError


@dataclass
class NamedPattern:
    name: str = ""
    pattern: str = ""


@dataclass
class General:
    log_level: str = "info"
    buffer_size: int = 10_000
    batch_millis: int = 1_000
    checkpoint: str = ""


@dataclass
class Stdin:
    enabled: bool = True


@dataclass
class Tcp:
    enabled: bool = False
    bind_address: str = "127.0.0.1"
    port: int = 9514
    max_connections: int = 100


@dataclass
class Udp:
    enabled: bool = False
    bind_address: str = "127.0.0.1"
    port: int = 9515


@dataclass
class Files:
    enabled: bool = False
    paths: list[str] = field(default_factory=list)
    tail: bool = True


@dataclass
class Ingestion:
    stdin: Stdin = field(default_factory=Stdin)
    tcp: Tcp = field(default_factory=Tcp)
    udp: Udp = field(default_factory=Udp)
    file: Files = field(default_factory=Files)


@dataclass
class PatternDetection:
    enabled: bool = True
    detect_levels: bool = True
    detect_error_codes: bool = True
    custom_patterns: list[NamedPattern] = field(default_factory=list)


@dataclass
class PerformanceMetrics:
    enabled: bool = False
    latency_patterns: list[str] = field(default_factory=lambda: [r"took (?P<duration>\d+)(?P<unit>ms|s|us)", r"latency[=:]\s*(?P<duration>\d+\.?\d*)(?P<unit>ms|s)?"])
    windows: list[str] = field(default_factory=lambda: ["1m", "5m", "15m"])
    percentiles: list[int] = field(default_factory=lambda: [50, 90, 95, 99])
    report_seconds: int = 60


@dataclass
class Security:
    enabled: bool = False
    detect_sql_injection: bool = True
    detect_xss: bool = True
    detect_path_traversal: bool = True
    detect_auth_failures: bool = True
    sensitive_patterns: list[NamedPattern] = field(default_factory=list)


@dataclass
class StructuralParser:
    enabled: bool = False
    auto_detect: bool = True
    format: str = "auto"


@dataclass
class Modules:
    pattern_detection: PatternDetection = field(default_factory=PatternDetection)
    performance_metrics: PerformanceMetrics = field(default_factory=PerformanceMetrics)
    security: Security = field(default_factory=Security)
    structural_parser: StructuralParser = field(default_factory=StructuralParser)


@dataclass
class Stdout:
    enabled: bool = True
    format: str = "pretty"


@dataclass
class FileOutput:
    enabled: bool = False
    path: str = "output.jsonl"
    format: str = "jsonl"
    rotation: str = "daily"
    max_size: str = "100MB"
    max_files: int = 7
    compress: bool = True
    zone: str = "UTC"


@dataclass
class Loki:
    enabled: bool = False
    url: str = "http://localhost:3100/loki/api/v1/push"
    batch_size: int = 100
    flush_interval_seconds: int = 5
    timeout_seconds: int = 30
    labels: dict[str, str] = field(default_factory=dict)
    job: str = "logloom"


@dataclass
class Prometheus:
    enabled: bool = False
    bind_address: str = "127.0.0.1"
    port: int = 9090
    path: str = "/metrics"
    prefix: str = "logloom"


@dataclass
class Grafana:
    loki: Loki = field(default_factory=Loki)
    prometheus: Prometheus = field(default_factory=Prometheus)


@dataclass
class Output:
    stdout: Stdout = field(default_factory=Stdout)
    file: FileOutput = field(default_factory=FileOutput)
    grafana: Grafana = field(default_factory=Grafana)


@dataclass
class Config:
    general: General = field(default_factory=General)
    ingestion: Ingestion = field(default_factory=Ingestion)
    modules: Modules = field(default_factory=Modules)
    output: Output = field(default_factory=Output)

    @classmethod
    def from_text(cls, text: str) -> Config:
        try:
            return _build(cls, tomllib.loads(text))
        except (tomllib.TOMLDecodeError, TypeError, ValueError) as e:
            raise ConfigError(str(e)) from e

    @classmethod
    def from_file(cls, path: str | Path) -> Config:
        try:
            return cls.from_text(Path(path).read_text("utf-8"))
        except OSError as e:
            raise ConfigError(f"{path}: {e}") from e

    def to_toml(self) -> str:
        return "\n".join(_lines(self, ())).strip() + "\n"


def _build(kind: type, data: Any) -> Any:
    """A dataclass from a table: missing keys by default, unknown ones left out, wrong types an error."""
    if not isinstance(data, dict):
        raise TypeError(f"{kind.__name__} must be a table")
    hints = get_type_hints(kind)
    out = {}
    for f in fields(kind):
        if f.name not in data:
            continue
        want, v = hints[f.name], data[f.name]
        if is_dataclass(want):
            out[f.name] = _build(want, v)
        elif want == list[NamedPattern]:
            out[f.name] = [_build(NamedPattern, x) for x in v]
        elif want in (bool, int, str):
            if type(v) is not want:
                raise TypeError(f"{f.name} must be {want.__name__}")
            out[f.name] = v
        else:
            out[f.name] = v
    return kind(**out)


def _value(v: Any) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int | float):
        return str(v)
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'
    if isinstance(v, list):
        return "[" + ", ".join(map(_value, v)) + "]"
    if is_dataclass(v):
        return "{ " + ", ".join(f"{f.name} = {_value(getattr(v, f.name))}" for f in fields(v)) + " }"
    return "{ " + ", ".join(f"{_value(k)} = {_value(x)}" for k, x in v.items()) + " }"


def _lines(v: Any, path: tuple[str, ...]) -> list[str]:
    plain = [f for f in fields(v) if not is_dataclass(getattr(v, f.name))]
    out = [f"[{'.'.join(path)}]"] if path and plain else []
    out += [f"{f.name} = {_value(getattr(v, f.name))}" for f in plain]
    for f in fields(v):
        if is_dataclass(getattr(v, f.name)):
            out += ["", *_lines(getattr(v, f.name), (*path, f.name))]
    return out
