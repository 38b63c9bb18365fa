"""Configuration: JSON files with required paths, layers, typed values. Plain Python; no Spark."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any


def load(path: str, required: tuple[str, ...] = ()) -> dict[str, Any]:
    """A JSON object in which every required dotted path has a value that isn't blank."""
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    missing = [p for p in required if value(config, p) in (None, "")]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return config


def value(config: dict[str, Any], path: str, default: Any = None) -> Any:
    """The value at a dotted path; blank and null count as absent."""
    here: Any = config
    for part in path.split("."):
        if not isinstance(here, dict) or part not in here:
            return default
        here = here[part]
    return default if here is None or here == "" else here


def number(config: dict[str, Any], path: str, default: float, kind: type = float) -> Any:
    found = value(config, path)
    return default if found is None else kind(found)


def keyword(config: dict[str, Any], path: str) -> str | None:
    """A keyword, or None for "no filter"; the text "null" means that too."""
    found = value(config, path)
    return None if found is None or str(found).strip().lower() in ("", "null", "none") else str(found).strip()


def layered(defaults: dict[str, Any], *files: str, env: dict[str, str] | None = None, environ: dict[str, str] | None = None) -> dict[str, Any]:
    """Defaults under the files in order (absent ones are skipped) under environment variables (key -> variable)."""
    out = dict(defaults)
    for path in files:
        if Path(path).exists():
            out |= {k: v for k, v in load(path).items() if v not in (None, "")}
    environ = dict(os.environ) if environ is None else environ
    return out | {k: environ[name] for k, name in (env or {}).items() if environ.get(name)}
