"""Settings of runs and steps: defaults, layers and their validation."""

from __future__ import annotations

import re
from typing import Any

from ..functions.parsing import defined, merge, quoted_list
from ..model import MARKER

DEFAULTS: dict[str, Any] = {
    "include": [], "exclude": [], "extensions": None, "scope": [], "gitignore": ".gitignore", "ignore_marker": MARKER,
    "bail": True, "concurrency": 4, "reporter": "default", "scan_mode": "all", "steps": [], "only": [], "skip": [],
    "enable": [], "disable": [], "step_order": [], "optimize": False, "large_diff_threshold": 20, "cache": True,
}
REPORTERS, SCAN_MODES = ("default", "compact", "json"), ("all", "changed", "staged")
_LISTS = ("include", "exclude", "scope", "only", "skip", "enable", "disable", "step_order")
_ID = re.compile(r"check_[a-z0-9]+(_[a-z0-9]+)*")


class ConfigError(ValueError):
    """Message begins with the path of the setting."""


def validate(config: Any) -> dict[str, Any]:
    if not isinstance(config, dict):
        raise ConfigError("config: has to be a mapping")
    for name in _LISTS:
        v = config.get(name)
        if v is not None and not (isinstance(v, list) and all(isinstance(x, str) and x for x in v)):
            raise ConfigError(f"{name}: has to be a list of texts")
    for name, allowed in (("reporter", REPORTERS), ("scan_mode", SCAN_MODES)):
        if config.get(name) is not None and config[name] not in allowed:
            raise ConfigError(f"{name}: has to be one of {', '.join(allowed)}")
    for name in ("bail", "optimize", "cache"):
        if config.get(name) is not None and not isinstance(config[name], bool):
            raise ConfigError(f"{name}: has to be true or false")
    for name in ("concurrency", "large_diff_threshold"):
        v = config.get(name)
        if v is not None and (isinstance(v, bool) or not isinstance(v, int) or v < 1):
            raise ConfigError(f"{name}: has to be a positive whole number")
    for i, step in enumerate(config.get("steps") or []):
        if not isinstance(step, dict) or not isinstance(step.get("id"), str):
            raise ConfigError(f"steps[{i}].id: is missing")
        if not _ID.fullmatch(step["id"]):
            raise ConfigError(f"steps[{i}].id: has to be check_ and lower-case words joined by _")
        if step.get("step") is not None and (isinstance(step["step"], bool) or not isinstance(step["step"], int) or step["step"] < 1):
            raise ConfigError(f"steps[{i}].step: has to be a positive whole number")
    return config


def resolve(file: dict[str, Any] | None, flags: dict[str, Any] | None = None) -> dict[str, Any]:
    """Defaults, then the file's, then the flags'."""
    return validate(merge(merge(DEFAULTS, file or {}), flags or {}))


def step_config(config: dict[str, Any], step: dict[str, Any]) -> dict[str, Any]:
    """A step's own settings over the run's; excludes add up."""
    out = merge(config, {k: v for k, v in defined(step).items() if k != "exclude"})
    return out | {"exclude": [*(config.get("exclude") or []), *(step.get("exclude") or [])]}


def flags(argv: list[str]) -> dict[str, Any]:
    """Settings from words like --only a,b --no-bail --reporter=json."""
    out: dict[str, Any] = {}
    i = 0
    while i < len(argv):
        word = argv[i]
        i += 1
        if not word.startswith("--"):
            continue
        name, eq, value = word[2:].replace("-", "_").partition("=") if "=" not in word else (word[2:].split("=", 1)[0].replace("-", "_"), "=", word.split("=", 1)[1])
        if name.startswith("no_"):
            out[name[3:]] = None if name == "no_gitignore" else False
        elif name in ("bail", "optimize", "cache"):
            out[name] = not eq or value.strip().lower() in ("true", "1", "yes")
        elif name in ("changed", "staged"):
            out["scan_mode"] = name
        else:
            if not eq and i < len(argv):
                value, i = argv[i], i + 1
            out[name] = quoted_list(value) if name in _LISTS or name == "extensions" else int(value) if name in ("concurrency", "large_diff_threshold") else value
    return out
