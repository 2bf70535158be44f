"""Named queries. ``load()`` imports every module that registers some and returns the catalogue."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

#: Modules that register queries.
MODULES = ["audit", "scores", "risk", "resampling", "protocols", "series", "streams", "sources"]


def load() -> ModuleType:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.catalog")
