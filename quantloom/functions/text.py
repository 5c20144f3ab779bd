"""Symbol classes, lot sizes and small text helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: suffixes of index and stock codes
INDEX_SUFFIXES = (".SI", ".SL", ".SWI", ".TI", ".CSI")
STOCK_SUFFIX = ".BJ"


def classify_symbol(symbol: Column, exact: Mapping[str, str] | None = None) -> Column:
    """index / stock / etf / NULL: suffix rules, then exact codes, then digit rules."""
    s = F.upper(F.trim(symbol))
    out = F.when(s.rlike("(" + "|".join(x.replace(".", r"\.") for x in INDEX_SUFFIXES) + ")$"), "index")
    out = out.when(s.endswith(STOCK_SUFFIX), "stock")
    if exact:
        known = F.create_map(*[F.lit(v) for pair in exact.items() for v in pair])
        out = out.when(F.try_element_at(known, s).isNotNull(), F.try_element_at(known, s))
    code = s.rlike(r"^\d+\.(SH|SZ)$")
    return (out.when(code & s.rlike("^[51]"), "etf").when(code & s.rlike(r"^000\d*\.SH$"), "index")
            .when(code & s.rlike("^399"), "index").when(code & s.rlike(r"^6\d*\.SH$"), "stock")
            .when(code & s.rlike(r"^[023]\d*\.SZ$"), "stock"))


def lot_size(kind: Column, override: float | None = None) -> Column:
    if override is not None:
        return F.lit(float(override))
    return F.when(kind.isin("stock", "etf"), 100.0).when(kind == "index", 1.0).otherwise(0.1)


def percent(x: Column, digits: int = 2) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", x * 100), F.lit("%"))


def fill_template(template: str, *params) -> str:
    """Replace each ``?`` in turn."""
    for p in params:
        template = template.replace("?", str(p), 1)
    return template
