"""What a Python worker keeps from task to task."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType
from typing import Any


def kept(name: str, make: Callable[[], Any]) -> Any:
    """The object made under this name in this process, made now if there is none.

    Task functions arrive by value, so their globals are new in every task; a
    module entry lasts as long as the process.
    """
    store = sys.modules.setdefault("coursemill_worker_store", ModuleType("coursemill_worker_store"))
    if name not in store.__dict__:
        store.__dict__[name] = make()
    return store.__dict__[name]
