"""Settings of the estimators as checked, described mappings.

``of(function)`` holds the keyword parameters of a function with their defaults. Calling it with overrides gives a checked copy; as a mapping it is passed
on with ``**``:

    how = settings.of(interacted.slopes)(method="hful", c=2.0)
    interacted.slopes(events, **how)
"""

from __future__ import annotations

import inspect
import types
import typing
from collections.abc import Callable, Iterator, Mapping
from typing import Any


def _at_least(low: float) -> tuple[Callable[[Any], bool], str]:
    return lambda x: x is None or x >= low, f"at least {low}"


def _above(low: float) -> tuple[Callable[[Any], bool], str]:
    return lambda x: x is None or x > low, f"above {low}"


def _one_of(*values: Any) -> tuple[Callable[[Any], bool], str]:
    return lambda x: x in values, "one of " + ", ".join(map(repr, values))


#: Limits of parameters that mean the same in every function.
LIMITS = {
    "tolerance": _above(0), "most": _at_least(1), "draws": _at_least(1), "n_best": _at_least(1), "fraction": _above(0), "least": _above(0), "prior": _at_least(0), "tikhonov": _at_least(0), "coarse": _at_least(0),
    "normalised": _at_least(0), "c": _at_least(0), "classes": _at_least(1), "min_movers": _at_least(0), "n_periods": _at_least(1), "firm_size": _above(0), "movers": _at_least(1),
    "sd_lambda": _above(0), "sd_mu": _above(0), "sd_wage": _above(0), "worker_mean": _above(0), "firm_mean": _above(0),
}
#: Limits of single functions.
CHOICES = {
    ("interacted.slopes", "method"): _one_of("linear", "liml", "kclass", "iv", "hful"),
    ("interacted.slopes", "instrument"): _one_of("firm_pairs", "worker_ids"),
    ("interacted.fixed_point_slopes", "split"): _one_of("income", "enter_exit"),
    ("blm.bootstrap", "method"): _one_of("parametric", "standard"),
    ("dynamic_fits.bootstrap", "method"): _one_of("parametric", "standard"),
    ("fe.corrected", "stayers"): _one_of("firm_mean", "upper_bound"),
    ("corrections.corrected", "stayers"): _one_of("firm_mean", "upper_bound"),
    ("corrections.corrected", "centre"): _one_of("panel", "worker"),
}


def _fits(value: Any, kind: Any) -> bool:
    """Whether a value is of an annotated type; containers are checked by their outer type, and annotations without one allow all."""
    if kind in (Any, inspect.Parameter.empty):
        return True
    origin = typing.get_origin(kind)
    if origin in (typing.Union, types.UnionType):
        return any(_fits(value, k) for k in typing.get_args(kind))
    kind = origin or kind
    if not isinstance(kind, type):
        return True
    if kind in (int, float) and isinstance(value, bool):
        return False
    return isinstance(value, {float: (int, float), list: (list, tuple), tuple: (list, tuple)}.get(kind, kind))


class Settings(Mapping):
    """Checked values of a function's keyword parameters. Copies share nothing that changes."""

    def __init__(self, function: Callable, values: Mapping[str, Any] | None = None):
        self.function = function
        self.name = f"{function.__module__.rsplit('.', 1)[-1]}.{function.__name__}"
        self._parameters = {k: p for k, p in inspect.signature(function).parameters.items() if p.default is not p.empty}
        self._kinds = typing.get_type_hints(function)
        self._values = {k: p.default for k, p in self._parameters.items()}
        for key, value in (values or {}).items():
            self._check(key, value)
            self._values[key] = value

    def _check(self, key: str, value: Any) -> None:
        if key not in self._parameters:
            raise KeyError(f"{self.name} has no setting {key!r}; it has {', '.join(self._parameters)}")
        default = self._parameters[key].default
        if not (value is None and default is None) and not _fits(value, self._kinds.get(key, Any)):
            raise TypeError(f"{self.name}: {key} must be {self._type(key)}, not {type(value).__name__}")
        limit = self._limit(key)
        if limit and not limit[0](value):
            raise ValueError(f"{self.name}: {key} must be {limit[1]}, not {value!r}")

    def _limit(self, key: str) -> tuple[Callable[[Any], bool], str] | None:
        return CHOICES.get((self.name, key)) or LIMITS.get(key)

    def _type(self, key: str) -> str:
        kind = self._kinds.get(key, Any)
        return kind.__name__ if isinstance(kind, type) and not typing.get_args(kind) else str(kind).replace("typing.", "")

    def __call__(self, **changes: Any) -> Settings:
        return Settings(self.function, {**self._values, **changes})

    def copy(self) -> Settings:
        return self()

    def __getitem__(self, key: str) -> Any:
        return self._values[key]

    def __iter__(self) -> Iterator[str]:
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def several(self, *keys: str) -> tuple:
        return tuple(self[k] for k in keys)

    def describe(self, key: str) -> str:
        """Name, type, value, default and limit of a setting."""
        if key not in self._parameters:
            raise KeyError(key)
        limit = self._limit(key)
        return f"{key} ({self._type(key)}): {self[key]!r}, default {self._parameters[key].default!r}" + (f", {limit[1]}" if limit else "")

    def describe_all(self) -> str:
        """All settings, under what the function says of itself."""
        return "\n".join([self.name, inspect.getdoc(self.function) or "", *map(self.describe, self)])

    def __repr__(self) -> str:
        changed = {k: v for k, v in self._values.items() if v is not self._parameters[k].default}
        return f"Settings({self.name}, {changed})"


def of(function: Callable, **changes: Any) -> Settings:
    """The settings of a function, with changes."""
    return Settings(function, changes)
