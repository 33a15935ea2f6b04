"""What a Python worker holds between tasks: one thing at a time.

Spark reuses its workers. A model or a cache is kept for the next task of the same operator, and given back as soon as
a task of another one starts, so that the operators of a pipeline do not add up in a worker's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar

Held = TypeVar("Held")
_held: dict[Hashable, object] = {}


def hold(key: Hashable, make: Callable[[], Held]) -> Held:
    """The thing of that key, made if it is not the one that is held; any other is given back."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """For tasks that hold nothing."""
    _held.clear()
