"""Features: named, reusable recipes for one panel column.

A ``Feature`` is a small immutable recipe (inputs + a function from Columns to a Column).
Nothing runs until :func:`quantloom.plans.panel.with_features` attaches features to a
DataFrame, where identical recipes are computed once and shared by name.

Missing values are NULL. Arithmetic, comparison and conditional operators follow fixed rules
for small divisors and missing inputs:

* a divisor that is missing or within 1e-10 of zero gives 0.0 (``/``, ``//``, ``%``);
* a comparison with a missing side gives 0.0, otherwise 0.0 / 1.0;
* ``where(c, a, b)`` takes ``b`` when the condition is missing;
* ``all_of`` / ``any_of`` are running minimum / maximum and stay missing when an input is.
"""

from __future__ import annotations

import functools
import hashlib
import math
import types
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


def _identity(x) -> str:
    """What a function does, as text: its code and the values it holds. Others are told apart by their ``repr``."""
    if isinstance(x, Feature):
        return x.key
    if isinstance(x, functools.partial):
        return f"{_identity(x.func)}{[_identity(a) for a in x.args]}{ {k: _identity(v) for k, v in x.keywords.items()} }"
    code = getattr(x, "__code__", None)
    if code is None:
        owner = getattr(x, "__self__", None)
        return repr(x) if owner is None or isinstance(owner, types.ModuleType) else f"{_identity(x.__func__)}{owner!r}"
    held = [_identity(c.cell_contents) for c in x.__closure__ or () if not _empty(c)]
    known = [_identity(d) for d in x.__defaults__ or ()]
    named = {k: _identity(v) for k, v in (x.__kwdefaults__ or {}).items()}
    return f"{x.__module__}.{x.__qualname__}:{_code(code)}{held}{known}{named}"


def _empty(cell) -> bool:
    try:
        cell.cell_contents
    except ValueError:
        return True
    return False


@functools.lru_cache(maxsize=None)
def _code(code: types.CodeType) -> str:
    inner = [_code(c) if isinstance(c, types.CodeType) else repr(c) for c in code.co_consts]
    return hashlib.md5(repr((code.co_code, code.co_names, inner)).encode()).hexdigest()


class Feature:
    """Recipe for one panel column.

    axis: ``row`` (scalar), ``symbol`` (window along time) or ``date`` (window across symbols).
    lookback: how many earlier rows of the symbol the value needs, ``None`` when unbounded.
    uses: how often ``build`` repeats each input (guards repeat their operand).
    """

    __slots__ = ("op", "params", "inputs", "build", "axis", "lookback", "uses", "key")

    def __init__(self, op: str, inputs: tuple[Feature, ...], build: Callable[..., Column], *,
                 params: tuple = (), axis: str = "row", lookback: int | None = 0, uses: int = 1):
        self.op, self.inputs, self.build = op, inputs, build
        self.params, self.axis, self.lookback, self.uses = params, axis, lookback, uses
        text = "|".join([op, repr(params), axis, _identity(build), *(i.key for i in inputs)])
        self.key = hashlib.md5(text.encode()).hexdigest()[:16]

    # -- description ---------------------------------------------------------------------
    def walk(self) -> Iterator[Feature]:
        """Every distinct recipe below and including this one, inputs first."""
        seen: set[str] = set()
        stack = [(self, False)]
        while stack:
            node, ready = stack.pop()
            if node.key in seen:
                continue
            if ready:
                seen.add(node.key)
                yield node
            else:
                stack.append((node, True))
                stack.extend((i, False) for i in reversed(node.inputs))

    def variables(self) -> list[str]:
        return sorted({n.params[0] for n in self.walk() if n.op == "col"})

    def functions(self) -> list[str]:
        return sorted({n.op for n in self.walk() if n.op not in ("col", "lit")})

    def depth(self) -> int:
        level: dict[str, int] = {}
        for n in self.walk():
            level[n.key] = 1 + max((level[i.key] for i in n.inputs), default=0)
        return level[self.key]

    def describe(self) -> dict:
        """Variables, functions, depth, size and the axes a feature touches."""
        nodes = list(self.walk())
        return {
            "variables": self.variables(),
            "functions": self.functions(),
            "depth": self.depth(),
            "nodes": len(nodes),
            "axes": sorted({n.axis for n in nodes}),
        }

    def missing_variables(self, columns: list[str]) -> list[str]:
        have = {c.lower() for c in columns}
        return [v for v in self.variables() if v.lower() not in have]

    def __str__(self) -> str:
        if self.op == "col":
            return self.params[0]
        if self.op == "lit":
            return repr(self.params[0])
        args = [str(i) for i in self.inputs] + [repr(p) for p in self.params]
        return f"{self.op}({', '.join(args)})"

    __repr__ = __str__

    # -- operators -------------------------------------------------------------------------
    def __add__(self, o): return row("add", lambda a, b: a + b, self, o)
    def __radd__(self, o): return row("add", lambda a, b: a + b, o, self)
    def __sub__(self, o): return row("sub", lambda a, b: a - b, self, o)
    def __rsub__(self, o): return row("sub", lambda a, b: a - b, o, self)
    def __mul__(self, o): return row("mul", lambda a, b: a * b, self, o)
    def __rmul__(self, o): return row("mul", lambda a, b: a * b, o, self)
    def __truediv__(self, o): return row("div", safe_div, self, o, uses=2)
    def __rtruediv__(self, o): return row("div", safe_div, o, self, uses=2)
    def __floordiv__(self, o): return row("floordiv", safe_floordiv, self, o, uses=2)
    def __rfloordiv__(self, o): return row("floordiv", safe_floordiv, o, self, uses=2)
    def __mod__(self, o): return row("mod", safe_mod, self, o, uses=3)
    def __rmod__(self, o): return row("mod", safe_mod, o, self, uses=3)
    def __pow__(self, o): return row("pow", clipped_pow, self, o, uses=2)
    def __rpow__(self, o): return row("pow", clipped_pow, o, self, uses=2)
    def __neg__(self): return row("neg", lambda a: -a, self)
    def __pos__(self): return self
    def __gt__(self, o): return row("gt", lambda a, b: flag(a > b), self, o)
    def __ge__(self, o): return row("ge", lambda a, b: flag(a >= b), self, o)
    def __lt__(self, o): return row("lt", lambda a, b: flag(a < b), self, o)
    def __le__(self, o): return row("le", lambda a, b: flag(a <= b), self, o)
    def __and__(self, o): return all_of(self, o)
    def __or__(self, o): return any_of(self, o)

    def eq(self, o) -> Feature:
        return row("eq", lambda a, b: flag(F.abs(a - b) < TINY), self, o)

    def ne(self, o) -> Feature:
        return row("ne", lambda a, b: flag(F.abs(a - b) >= TINY), self, o)


def col(name: str) -> Feature:
    """A DataFrame column, matched without regard to case."""
    return Feature("col", (), lambda: F.col(name), params=(name,))


def lit(value: float | bool | None) -> Feature:
    value = math.nan if value is None else float(value)
    return Feature("lit", (), lambda: F.lit(None if math.isnan(value) else value).cast("double"),
                   params=(value,))


def as_feature(x) -> Feature:
    if isinstance(x, Feature):
        return x
    if isinstance(x, str):
        return col(x)
    return lit(x)


def row(op: str, build: Callable[..., Column], *inputs, params: tuple = (), uses: int = 1) -> Feature:
    """Feature computed from values of the same row."""
    return Feature(op, tuple(as_feature(i) for i in inputs), build, params=params, uses=uses)


# -- Column-level rules -----------------------------------------------------------------------
def flag(condition: Column) -> Column:
    """1.0 / 0.0, missing counts as 0.0."""
    return F.when(condition, 1.0).otherwise(0.0)


def safe_div(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > TINY, a / b).otherwise(0.0)


def safe_floordiv(a: Column, b: Column) -> Column:
    return F.floor(safe_div(a, b)).cast("double")


def safe_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return F.when(F.abs(b) > TINY, a - b * F.floor(a / b)).otherwise(0.0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def clipped_pow(a: Column, b: Column) -> Column:
    p = F.pow(clip(a, -1e6, 1e6), clip(b, -10.0, 10.0))
    return finite(p)


def finite(x: Column) -> Column:
    """NULL in place of NaN and infinities."""
    return F.when(F.abs(x) < F.lit(math.inf), x)


def ratio(a: Column, b: Column) -> Column:
    """Plain division: a zero divisor gives NULL."""
    return F.when(b != 0, a / b)


def where(condition, a, b) -> Feature:
    return row("where", lambda c, x, y: F.when(c > 0, x).otherwise(y), condition, a, b)


def all_of(*xs) -> Feature:
    def build(*cs):
        return F.when(_all_present(cs), F.least(F.lit(1.0), *cs))
    return row("all_of", build, *xs, uses=2)


def any_of(*xs) -> Feature:
    def build(*cs):
        return F.when(_all_present(cs), F.greatest(F.lit(0.0), *cs))
    return row("any_of", build, *xs, uses=2)


def not_(x) -> Feature:
    return row("not", lambda a: flag(a == 0), x)


def _all_present(cs) -> Column:
    present = cs[0].isNotNull()
    for c in cs[1:]:
        present = present & c.isNotNull()
    return present


PI, E = lit(math.pi), lit(math.e)
TRUE, FALSE, MISSING = lit(1.0), lit(0.0), lit(None)
