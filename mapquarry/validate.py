"""Checks of arguments, with messages that name the argument."""

from __future__ import annotations

import re

# Boundary types that can be asked for.
BOUNDARIES = "administrative national_park political postal_code protected_area aboriginal_lands maritime lot parcel tract marker all".split()


def flag(name: str, value) -> bool:
    if not isinstance(value, bool):
        raise ValueError(f"{name} should be True or False, not {value!r}")
    return value


def keys(name: str, value) -> list[str] | None:
    """Text or a list of text, as a list."""
    if value is None:
        return None
    value = [value] if isinstance(value, str) else value
    if not isinstance(value, (list, tuple)) or not all(isinstance(v, str) for v in value):
        raise ValueError(f"{name} should be a list of text, not {value!r}")
    return list(value)


def boundary(value) -> str:
    found = value.strip().lower() if isinstance(value, str) else value
    if found not in BOUNDARIES:
        raise ValueError(f"boundary_type {value!r} is none of {', '.join(BOUNDARIES)}")
    return found


def pattern(name: str, value) -> str | None:
    if value is None:
        return None
    try:
        re.compile(value)
    except (re.error, TypeError) as e:
        raise ValueError(f"{name} should be a pattern: {e}") from e
    return value


def map_file(path) -> str:
    if not isinstance(path, str) or not path.lower().endswith(".pbf"):
        raise ValueError(f"a map file's name should end with .pbf: {path!r}")
    return path


def choice(name: str, value, choices) -> str:
    if not isinstance(value, str) or value.lower() not in choices:
        raise ValueError(f"{name} should be one of {', '.join(choices)}, not {value!r}")
    return value.lower()
