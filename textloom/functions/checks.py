"""Parameter checks on the driver, and the engine's exceptions."""

from __future__ import annotations

import math
from numbers import Real


class TextloomError(Exception):
    """Root of the engine's errors."""


class ParameterError(TextloomError, ValueError):
    pass


class SourceError(TextloomError, ValueError):
    pass


class SourceTypeError(TextloomError, TypeError):
    pass


class UnknownStatError(TextloomError, KeyError):
    pass


def check_integer(value, what: str, least: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise ParameterError(f"{what} must be an integer")
    if least is not None and value < least:
        raise ParameterError(f"{what} must be {least} or more")
    return value


def check_number(value, what: str, least: float | None = None, most: float | None = None) -> float:
    if isinstance(value, bool) or not isinstance(value, Real) or not math.isfinite(value):
        raise ParameterError(f"{what} must be a finite number")
    if least is not None and value < least or most is not None and value > most:
        raise ParameterError(f"{what} is out of range")
    return float(value)


def check_bool(value, what: str) -> bool:
    if not isinstance(value, bool):
        raise ParameterError(f"{what} must be true or false")
    return value


def check_stats(names, known) -> None:
    for n in names:
        if n not in known:
            raise UnknownStatError(n)
