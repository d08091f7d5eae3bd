"""Configuration: defaults, JSON or YAML files, validation."""

from __future__ import annotations

import copy
import json

from quarry.functions.dialects import ALIASES, DIALECTS
from quarry.sources.schema_files import parse

# Names and defaults.
DEFAULTS = {
    "parser": {"strict_mode": False, "max_query_size": 1_000_000, "dialect": "sqlserver"},
    "analyzer": {"enable_optimizations": True, "complexity_threshold": 10, "detailed_analysis": True},
    "logger": {"default_format": "profiler", "max_file_size_mb": 100, "filters": {"min_duration_ms": 0, "max_duration_ms": 0, "query_types": [], "exclude_system": True}},
    "output": {"format": "json", "pretty_json": True, "include_timestamps": True, "output_file": ""},
}


def merged(base: dict, more: dict | None) -> dict:
    out = copy.deepcopy(base)
    for k, v in (more or {}).items():
        out[k] = merged(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def errors(config: dict) -> list[str]:
    p, a, lg, o = (config[k] for k in ("parser", "analyzer", "logger", "output"))
    f = lg["filters"]
    checks = [
        (p["max_query_size"] > 0, "parser.max_query_size must be positive"), (p["dialect"].lower() in {*DIALECTS, *ALIASES}, f"unknown dialect {p['dialect']}"), (a["complexity_threshold"] >= 0, "analyzer.complexity_threshold must not be negative"), (lg["max_file_size_mb"] > 0, "logger.max_file_size_mb must be positive"),
        (f["min_duration_ms"] >= 0 and f["max_duration_ms"] >= 0, "durations must not be negative"), (not f["max_duration_ms"] or f["min_duration_ms"] <= f["max_duration_ms"], "logger.filters.min_duration_ms is over max_duration_ms"), (o["format"] in ("json", "table", "csv"), f"unknown output format {o['format']}"),
    ]
    return [message for ok, message in checks if not ok]


def load(text: str = "", kind: str = "") -> dict:
    """Defaults overlaid with a document; ValueError names what doesn't fit."""
    config = merged(DEFAULTS, parse(text, kind) if text.strip() else {})
    if bad := errors(config):
        raise ValueError("; ".join(bad))
    return config


def dump(config: dict, kind: str = "json") -> str:
    if kind == "json":
        return json.dumps(config, indent=2)
    import yaml

    return yaml.safe_dump(config, sort_keys=False)
