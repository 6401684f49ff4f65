"""Project configuration: one TOML file a directory, read along the chain of directories above.

Lists accumulate, nearest first; single settings are taken from the nearest file that has them.
A file that cannot be read is a row with an error, which only counts if something asks for it.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

CONFIG = "tidemark.toml"


class ConfigError(ValueError):
    pass


@dataclass
class Declared:
    """What one file says; paths and globs are relative to its directory."""

    dir: str
    aliases: dict[str, list[str]] = field(default_factory=dict)
    style_aliases: dict[str, list[str]] = field(default_factory=dict)
    outputs: dict[str, list[str]] = field(default_factory=dict)
    pure: list[str] = field(default_factory=list)
    builtin_pure: bool | None = None
    inline_requires: bool | None = None
    conditions: list[str] | None = None
    main_fields: list[str] | None = None


def _strings(value, what: str) -> list[str]:
    value = [value] if isinstance(value, str) else value
    if not isinstance(value, list) or not all(isinstance(x, str) and x for x in value):
        raise ConfigError(f"{what} is no list of strings")
    return value


def _table(value, what: str) -> dict[str, list[str]]:
    if not isinstance(value, dict):
        raise ConfigError(f"{what} is no table")
    return {k: _strings(v, f"{what}.{k}") for k, v in value.items()}


def _flag(value, what: str) -> bool | None:
    if value is not None and not isinstance(value, bool):
        raise ConfigError(f"{what} is neither true nor false")
    return value


def read_config(directory: str, text: str) -> Declared:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    style, resolve = raw.get("style", {}), raw.get("resolve", {})
    if not isinstance(style, dict) or not isinstance(resolve, dict):
        raise ConfigError("style and resolve are tables")
    if unknown := set(resolve) - {"conditions", "main-fields"}:
        raise ConfigError(f"resolve has no {sorted(unknown)[0]}")
    return Declared(
        directory,
        _table({k: v for k, v in raw.get("aliases", {}).items()} if isinstance(raw.get("aliases", {}), dict) else None, "aliases"),
        _table(style.get("aliases", {}), "style.aliases"),
        _table(raw.get("outputs", {}), "outputs"),
        _strings(raw.get("pure", []), "pure"),
        _flag(raw.get("builtin-pure"), "builtin-pure"),
        _flag(raw.get("inline-requires"), "inline-requires"),
        _strings(resolve["conditions"], "conditions") if "conditions" in resolve else None,
        _strings(resolve["main-fields"], "main-fields") if "main-fields" in resolve else None,
    )


def above(directory: str) -> list[str]:
    """The directory and those above it, nearest first; the root is the empty string."""
    parts = directory.split("/") if directory else []
    return ["/".join(parts[:n]) for n in range(len(parts), -1, -1)]


def nearest(chain: list[Declared], name: str, default):
    return next((v for d in chain if (v := getattr(d, name)) is not None), default)
