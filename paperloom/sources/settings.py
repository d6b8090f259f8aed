"""Layered settings: base, overrides and environment merged into one dictionary on the driver."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path


def load(path: str) -> dict:
    """A JSON file's dictionary; empty if it is missing or broken."""
    try:
        got = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return got if isinstance(got, dict) else {}


def merged(base: dict, over: dict) -> dict:
    """Dictionaries merge key by key; anything else is replaced.  Neither input changes."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


#: Environment variables and where they go.
ENVIRONMENT = {
    "API_MAX_UPLOAD_MB": (("api", "max_upload_mb"), int),
    "OCR_ENGINE": (("ocr", "engine"), str),
    "MIN_CONFIDENCE_SCORE": (("confidence", "min_score"), float),
}


def layered(layers: list[dict], environment: dict[str, str] | None = None) -> dict:
    out: dict = {}
    for layer in layers:
        out = merged(out, layer)
    for name, (path, kind) in ENVIRONMENT.items():
        if name in (environment or {}):
            nest: object = kind(environment[name])
            for key in reversed(path):
                nest = {key: nest}
            out = merged(out, nest)
    return out


def steps_in_order(steps: dict[str, dict]) -> list[str]:
    """Names of enabled steps by their order (999 where none is given), then by name."""
    on = [(s.get("order", 999), name) for name, s in steps.items() if s.get("enabled")]
    return [name for _, name in sorted(on)]


DEFAULT_ENGINE = "paddleocr"


def engine_name(settings: dict) -> str:
    """The recogniser that settings name, else the default one."""
    return section(settings, "ocr").get("engine") or settings.get("ocr_engine") or DEFAULT_ENGINE


def section(settings: dict, name: str) -> dict:
    """One section of settings; empty if it is missing."""
    got = settings.get(name, {})
    return got if isinstance(got, dict) else {}


class Settings:
    """Settings by template, loaded once; a reload that fails leaves the old ones in place."""

    def __init__(self, read: Callable[[str | None], dict], expected_version: str = "1.0.0"):
        self._read, self._expected, self._known = read, expected_version, {}

    def get(self, template: str | None = None, reload: bool = False) -> dict:
        key = template or "default"
        if reload or key not in self._known:
            self._known[key] = self._read(template)
        return self._known[key]

    def section(self, name: str, template: str | None = None) -> dict:
        return section(self.get(template), name)

    def reload(self, template: str | None = None, actor: str = "system") -> dict:
        """New settings with who asked, when, and the version before; ValueError if their major version is another one."""
        key = template or "default"
        before = self._known.get(key, {}).get("config_version", "unknown")
        new = dict(self._read(template))
        if str(new.get("config_version", self._expected)).split(".")[0] != self._expected.split(".")[0]:
            raise ValueError(f"settings of version {new['config_version']} where {self._expected} is expected")
        new["reload_metadata"] = {"actor": actor, "timestamp": datetime.now(UTC).isoformat(), "previous_version": before}
        self._known[key] = new
        return new
