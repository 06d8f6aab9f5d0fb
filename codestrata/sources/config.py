"""Settings of a map: which files, languages and packages it covers, and how its diagrams are split."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from codestrata.functions.ids import LANG_BY_EXTENSION, LANG_BY_NAME

LANGUAGES = frozenset({*LANG_BY_EXTENSION.values(), *LANG_BY_NAME.values()})


class ConfigError(ValueError):
    """The settings' file is broken or a setting has the wrong shape."""


@dataclass
class Config:
    """Every setting has a default; unknown ones are ignored."""

    include: list[str] = field(default_factory=lambda: ["**/*"])
    exclude: list[str] = field(default_factory=lambda: ["**/node_modules/**", "**/vendor/**", "**/dist/**", "**/*_test.go"])
    languages: list[str] = field(default_factory=lambda: sorted(LANGUAGES))
    package_roots: list[str] = field(default_factory=list)
    diagram_nodes: int = 25


def validate(value: object) -> Config:
    """Settings over the defaults; null means none."""
    if value is None:
        return Config()
    if not isinstance(value, dict):
        raise ConfigError("settings must be an object")
    known = {f.name for f in fields(Config)}
    given = {k: v for k, v in value.items() if k in known}
    for name, setting in given.items():
        if name == "diagram_nodes":
            if isinstance(setting, bool) or not isinstance(setting, int) or setting < 1:
                raise ConfigError("diagram_nodes must be a positive integer")
        elif not isinstance(setting, list) or not all(isinstance(x, str) for x in setting):
            raise ConfigError(f"{name} must be a list of strings")
    if unknown := set(given.get("languages", ())) - LANGUAGES:
        raise ConfigError(f"unknown languages: {sorted(unknown)}")
    return Config(**given)


def load(path: str) -> Config:
    """The settings of a JSON file; the defaults where there is none. A byte order mark is skipped."""
    file = Path(path)
    if not file.exists():
        return Config()
    try:
        return validate(json.loads(file.read_text("utf-8-sig")))
    except json.JSONDecodeError as error:
        raise ConfigError(f"{path} is no JSON: {error}") from error


def contained(root: str, relative: str) -> str:
    """The path of an artifact under `root`; one that would leave it, by `..`, as absolute path or through a link, is refused."""
    base = Path(root).resolve()
    target = (base / relative).resolve()
    if not relative or Path(relative).is_absolute() or not target.is_relative_to(base) or target == base:
        raise ConfigError(f"{relative!r} lies outside {root}")
    return str(target)
