"""Settings in layers, and where a knowledge base is."""

from __future__ import annotations

import os
from collections.abc import Mapping
from pathlib import Path

BUILTIN = {"limit": 20, "budget": 8_000, "include_expired": False, "view": "context", "harvest_patterns": ["*.md"], "retention_days": 30}
#: Environment variables that set a key begin with this.
PREFIX = "LOREKEEP_"


def merge(layers: list[tuple[str, Mapping[str, object]]], env: Mapping[str, str] | None = None) -> tuple[dict[str, object], dict[str, str], list[str]]:
    """(settings, the layer each came from, warnings): later layers win, then the environment; unknown keys and wrong types are left out with a warning."""
    settings, origin, warnings = dict(BUILTIN), dict.fromkeys(BUILTIN, "builtin"), []
    said = {k[len(PREFIX) :].lower(): v for k, v in (env or {}).items() if k.startswith(PREFIX)}
    read = {k: _as(type(BUILTIN[k]), v) if k in BUILTIN else v for k, v in said.items()}
    for name, layer in [*layers, ("environment", read)]:
        for key, value in layer.items():
            if key not in BUILTIN:
                warnings.append(f"{name}: unknown key {key}")
            elif type(value) is not type(BUILTIN[key]):
                warnings.append(f"{name}: {key} is no {type(BUILTIN[key]).__name__}")
            else:
                settings[key], origin[key] = value, name
    return settings, origin, warnings


def _as(kind: type, text: str) -> object:
    if kind is bool:
        return {"1": True, "true": True, "0": False, "false": False}.get(text.lower(), text)
    if kind is int:
        return int(text) if text.lstrip("-").isdigit() else text
    return text.split(",") if kind is list else text


def resolve_root(given: str | None, env: Mapping[str, str] | None = None, start: str | None = None, marker: str = ".lorekeep") -> str:
    """The folder of a knowledge base: the given one, the environment's, or the nearest above the start that has the marker."""
    if given:
        return os.path.abspath(given)
    if (env or {}).get(f"{PREFIX}ROOT"):
        return os.path.abspath(env[f"{PREFIX}ROOT"])
    here = Path(start or os.getcwd()).resolve()
    for folder in (here, *here.parents):
        if (folder / marker).is_dir():
            return str(folder)
    raise LookupError("no knowledge base here or above; name its folder")
