"""Arguments of calls from outside: clamped numbers, required texts and digests, closed sets of fields."""

from __future__ import annotations

import re

#: Each clamped argument's least, most and default value.
BOUNDS = {"limit": (1, 100, 20), "hops": (0, 4, 1), "trace_hops": (1, 8, 3), "as_of_limit": (1, 200, 50)}


class ArgumentError(ValueError):
    """A call that can't be carried out as it is."""


def clamped(name: str, value: int | None) -> int:
    """The value held to its argument's bounds; the default for none."""
    least, most, default = BOUNDS[name]
    if value is None:
        return default
    if isinstance(value, bool) or not isinstance(value, int):
        raise ArgumentError(f"{name} must be a whole number")
    return max(least, min(most, value))


def required_text(arguments: dict, name: str) -> str:
    value = arguments.get(name)
    if not isinstance(value, str) or not value.strip():
        raise ArgumentError(f"{name} must be a text that isn't blank")
    return value


def required_digest(arguments: dict, name: str) -> str:
    value = arguments.get(name)
    if not isinstance(value, str) or not re.fullmatch("[0-9a-f]{64}", value):
        raise ArgumentError(f"{name} must be 64 hexadecimal digits in lower case")
    return value


def only_fields(arguments: dict, allowed: set[str]) -> None:
    """Refuses fields that the action doesn't have."""
    if unknown := sorted(arguments.keys() - allowed):
        raise ArgumentError(f"unknown fields: {', '.join(unknown)}")
