"""Named factories with options from a config, and the values that a config gives by name."""

from __future__ import annotations

import copy
import inspect
from collections.abc import Callable
from typing import Any

from ..functions import projection


def merged(base: dict, over: dict) -> dict:
    """Deep merge; the second wins."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def system_of(value: str | int) -> str:
    """A coordinate system by code or name, as ``projection`` knows it."""
    name = f"EPSG:{value}" if isinstance(value, int) or str(value).isdigit() else str(value).upper()
    if not projection.known(name):
        raise ValueError(f"unknown coordinate system {value!r}")
    return name


def seed_of(value: int | None) -> int:
    """A seed of hashes; none is the seed 0, so that a run can be repeated."""
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
        raise ValueError(f"a random state must be a whole number from 0, not {value!r}")
    return value or 0


#: What values under a key become, wherever in a config they stand.
VALUES: dict[str, Callable[[Any], Any]] = {"crs": system_of, "target_crs": system_of, "random_state": seed_of}


def parsed(config: dict) -> dict:
    """The config with the values of VALUES checked and in one form."""

    def of(key: str, value: Any) -> Any:
        if isinstance(value, dict):
            return parsed(value)
        return VALUES[key](value) if key in VALUES and (value is not None or key == "random_state") else value

    return {k: of(k, v) for k, v in config.items()}


class Services:
    """Factories by name. A factory's options are its own defaults, then what the config says under its
    name, then what the caller gives; ``version`` in the config names another factory to take instead."""

    def __init__(self, config: dict | None = None):
        self.config = parsed(config or {})
        self.factories: dict[str, tuple[Callable | None, bool]] = {}
        self.made: dict[str, Any] = {}

    def register(self, name: str, factory: Callable | None = None, shared: bool = False) -> None:
        """``shared``: one instance serves all. A name without a factory needs a version."""
        self.factories[name] = (factory, shared)
        self.made.pop(name, None)

    def options(self, name: str, own: dict | None = None) -> dict:
        factory = self.factories[name][0]
        try:
            known = inspect.signature(factory).parameters
        except ValueError:  # written in another language
            known = {}
        defaults = {k: p.default for k, p in known.items() if isinstance(p.default, dict)}
        said = {k: v for k, v in self.config.get(name, {}).items() if k != "version"} if isinstance(self.config.get(name), dict) else {}
        return merged(merged(defaults, said), own or {})

    def get(self, name: str, version: str | None = None, **own: Any) -> Any:
        said = self.config.get(name)
        name = version or (said.get("version") if isinstance(said, dict) else None) or name
        factory, shared = self.factories.get(name, (None, False))
        if factory is None:
            raise ValueError(f"no service {name!r} is registered")
        if shared and name in self.made:
            return self.made[name]
        out = factory(**self.options(name, own))
        if shared:
            self.made[name] = out
        return out
