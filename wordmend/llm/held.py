"""What a Python worker keeps from one task to the next."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

_Kept = TypeVar("_Kept")
_held: dict[str, object] = {}


def held(name: str, make: Callable[[], _Kept]) -> _Kept:
    """``make()``, kept for later tasks of the same step.

    A worker serves many steps, and models are large: it keeps that of one step only, and forgets
    it as soon as another one asks.
    """
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def forget() -> None:
    """Called by tasks of steps without a model: a worker that served a step with one lets it go."""
    _held.clear()
