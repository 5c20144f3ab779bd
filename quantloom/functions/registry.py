"""Registry of feature functions, macros and derived variables."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from quantloom.functions.feature import Feature


@dataclass(frozen=True)
class FunctionInfo:
    name: str
    build: Callable[..., Feature]
    category: str
    min_args: int
    max_args: int | None
    macro: bool = False

    def __call__(self, *args, **kwargs) -> Feature:
        n = len(args) + len(kwargs)
        if n < self.min_args or (self.max_args is not None and n > self.max_args):
            raise TypeError(f"{self.name} takes {self.min_args}..{self.max_args} arguments, got {n}")
        return self.build(*args, **kwargs)


FUNCTIONS: dict[str, FunctionInfo] = {}
VARIABLES: dict[str, Callable[[], Feature] | None] = {}
PREFIXES: set[str] = {"REL_", "BENCH_"}


def _arity(build: Callable) -> tuple[int, int | None]:
    ps = list(inspect.signature(build).parameters.values())
    if any(p.kind is p.VAR_POSITIONAL for p in ps):
        return sum(p.kind is p.POSITIONAL_OR_KEYWORD for p in ps), None
    return sum(p.default is p.empty for p in ps), len(ps)


def register(name: str, build: Callable[..., Feature], category: str = "custom", *,
             macro: bool = False, replace: bool = False) -> FunctionInfo:
    if name in FUNCTIONS and not replace:
        raise ValueError(f"{name} is already registered")
    low, high = _arity(build)
    info = FunctionInfo(name, build, category, low, high, macro)
    FUNCTIONS[name] = info
    return info


def function(category: str, *aliases: str):
    """Decorator: register under its own name and ``aliases``."""
    def wrap(build):
        for name in (build.__name__.rstrip("_"), *aliases):
            register(name, build, category)
        return build
    return wrap


def register_macro(name: str, build: Callable[..., Feature], replace: bool = False) -> FunctionInfo:
    """A macro is a function composed of other feature functions."""
    return register(name, build, "macro", macro=True, replace=replace)


def unregister(name: str) -> bool:
    return FUNCTIONS.pop(name, None) is not None


def macros() -> list[str]:
    return sorted(n for n, i in FUNCTIONS.items() if i.macro)


def by_category(category: str) -> list[str]:
    return sorted(n for n, i in FUNCTIONS.items() if i.category == category)


def call(name: str, *args, **kwargs) -> Feature:
    if name not in FUNCTIONS:
        raise KeyError(f"unknown function {name}")
    return FUNCTIONS[name](*args, **kwargs)


def register_variable(name: str, build: Callable[[], Feature] | None = None) -> None:
    """A variable is a plain column (``build=None``) or a derived feature."""
    VARIABLES[name.upper()] = build


def unregister_variable(name: str) -> bool:
    return VARIABLES.pop(name.upper(), "absent") != "absent"


def is_variable(name: str) -> bool:
    up = name.upper()
    return up in VARIABLES or any(up.startswith(p) and len(up) > len(p) for p in PREFIXES)


# -- whole-table factors ---------------------------------------------------------------------------------
FACTORS: dict[str, Callable] = {}


def factor(name: str):
    """Decorator for a factor that needs a whole table: ``bars DataFrame -> (ts, symbol, value)``."""
    def wrap(fn):
        if name in FACTORS:
            raise ValueError(f"factor {name} is already registered")
        FACTORS[name] = fn
        return fn
    return wrap


def evaluate_factors(bars, names: list[str] | None = None):
    """Long ``(factor_id, ts, symbol, value)`` of registered factors."""
    parts = [FACTORS[n](bars).select(F.lit(n).alias("factor_id"), "ts", "symbol", "value")
             for n in (names or sorted(FACTORS))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
