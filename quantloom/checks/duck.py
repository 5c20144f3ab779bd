"""Plain SQL for features, written per function and independent of the Spark builders.

Each recipe becomes a column of a chain of common table expressions ``t0 -> t1 -> ...``.
"""

from __future__ import annotations

from collections.abc import Mapping

from quantloom.checks.base import rsql
from quantloom.functions.feature import Feature

P = "PARTITION BY symbol ORDER BY ts"


def last(d: int) -> str:
    return f"OVER ({P} ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


SOFAR = f"OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
DAY = "OVER (PARTITION BY ts)"


def _agg(expr):
    """A rolling aggregate; ``{0}``, ``{1}`` are inputs after the row number, ``{w}`` the window."""
    def sql(params, cols):
        d = params[0]
        data = [c for c in cols if c != "rn"]
        body = expr.format(*data, w=last(d), d=d, rn="rn")
        return f"CASE WHEN rn >= {d} THEN {body} END"
    return sql


def _row(expr):
    return lambda params, cols: "(" + expr.format(*cols, **{f"p{i}": v for i, v in
                                                            enumerate(params)}) + ")"


def _cmp(op):
    return _row(f"CASE WHEN {{0}} {op} {{1}} THEN 1.0 ELSE 0.0 END")


TEMPLATES = {
    # one row
    "add": _row("{0} + {1}"), "sub": _row("{0} - {1}"), "mul": _row("{0} * {1}"),
    "div": _row("CASE WHEN abs({1}) > 1e-10 THEN {0} / {1} ELSE 0.0 END"),
    "floordiv": _row("floor(CASE WHEN abs({1}) > 1e-10 THEN {0} / {1} ELSE 0.0 END)"),
    "mod": _row("CASE WHEN abs({1}) > 1e-10 THEN {0} - {1} * floor({0} / {1}) ELSE 0.0 END"),
    "pow": _row("CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN "
                "CASE WHEN isfinite(pow(least(greatest({0}, -1e6), 1e6), least(greatest({1}, -10), 10))) "
                "THEN pow(least(greatest({0}, -1e6), 1e6), least(greatest({1}, -10), 10)) END END"),
    "neg": _row("-({0})"), "gt": _cmp(">"), "ge": _cmp(">="), "lt": _cmp("<"), "le": _cmp("<="),
    "eq": _row("CASE WHEN abs({0} - {1}) < 1e-10 THEN 1.0 ELSE 0.0 END"),
    "ne": _row("CASE WHEN abs({0} - {1}) >= 1e-10 THEN 1.0 ELSE 0.0 END"),
    "where": _row("CASE WHEN {0} > 0 THEN {1} ELSE {2} END"),
    "not": _row("CASE WHEN {0} = 0 THEN 1.0 ELSE 0.0 END"),
    "all_of": lambda p, c: ("(CASE WHEN " + " AND ".join(f"{x} IS NOT NULL" for x in c)
                            + f" THEN least(1.0, {', '.join(c)}) END)"),
    "any_of": lambda p, c: ("(CASE WHEN " + " AND ".join(f"{x} IS NOT NULL" for x in c)
                            + f" THEN greatest(0.0, {', '.join(c)}) END)"),
    "truthy_and": _row("CASE WHEN abs({0}) > 1e-10 AND abs({1}) > 1e-10 THEN 1.0 ELSE 0.0 END"),
    "truthy_or": _row("CASE WHEN abs({0}) > 1e-10 OR abs({1}) > 1e-10 THEN 1.0 ELSE 0.0 END"),
    "abs": _row("abs({0})"), "sign": _row("CAST(sign({0}) AS DOUBLE)"),
    "log": _row("CASE WHEN {0} > 1e-10 THEN ln({0}) END"),
    "sqrt": _row("CASE WHEN {0} < 0 THEN 0.0 WHEN {0} IS NOT NULL THEN sqrt(abs({0})) END"),
    "exp": _row("CASE WHEN {0} IS NOT NULL THEN exp(least(greatest({0}, -50.0), 50.0)) END"),
    "tanh": _row("tanh({0})"), "sin": _row("sin({0})"), "cos": _row("cos({0})"),
    "sigmoid": _row("CASE WHEN {0} IS NOT NULL THEN 1 / (1 + exp(-least(greatest({0}, -500.0), 500.0))) END"),
    "relu": _row("CASE WHEN {0} < 0 THEN 0.0 ELSE {0} END"),
    "gauss": _row("exp(-({0} * {0}))"), "p4": _row("exp(-pow({0}, 4))"),
    "softsign": _row("{0} / (1 + abs({0}))"),
    "square_sigmoid": _row("({0} * {0}) / (1 + {0} * {0})"), "square": _row("{0} * {0}"),
    "signed_power": _row("CASE WHEN {0} = 0 AND {1} < 0 THEN NULL WHEN isfinite(pow(abs({0}), {1})) "
                         "THEN sign({0}) * pow(abs({0}), {1}) END"),
    "max": _row("CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN greatest({0}, {1}) END"),
    "min": _row("CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN least({0}, {1}) END"),
    "plain_ratio": _row("CASE WHEN {1} <> 0 THEN {0} / {1} END"),
    "guarded_ratio": _row("CASE WHEN {1} > 0 THEN {0} / {1} END"),
    "coalesce0": _row("coalesce({0}, 0.0)"),
    "present_with": _row("CASE WHEN {1} IS NOT NULL THEN {0} END"),
    "rate_of_change": _row("CASE WHEN abs({1}) > 1e-10 THEN ({0} - {1}) / {1} END"),
    # along time
    "row_number": lambda p, c: f"row_number() OVER ({P})",
    "ts_mean": _agg("avg({0}) {w}"), "ts_sum": _agg("sum({0}) {w}"),
    "ts_std": _agg("stddev_samp({0}) {w}"), "ts_var": _agg("var_samp({0}) {w}"),
    "ts_max": _agg("max({0}) {w}"), "ts_min": _agg("min({0}) {w}"),
    "ts_median": _agg("quantile_cont({0}, 0.5) {w}"), "ts_product": _agg("product({0}) {w}"),
    "ts_delay": lambda p, c: f"lag({c[0]}, {p[0]}) OVER ({P})",
    "window_values": _agg("list({0}) {w}"),
    "ts_rank": _agg("CASE WHEN {0} IS NOT NULL THEN (len(list_filter(list({0}) {w}, lambda v: v < {0})) + 1.0) / count({0}) {w} END"),
    "ts_rank0": _agg("CASE WHEN {0} IS NOT NULL THEN len(list_filter(list({0}) {w}, lambda v: v < {0})) * 1.0 / count({0}) {w} END"),
    "ts_quantile": lambda p, c: (
        f"CASE WHEN rn >= {p[0]} THEN list_sort(list({c[1]}) FILTER (WHERE {c[1]} IS NOT NULL) {last(p[0])})"
        f"[greatest(1, CAST(ceil({p[1]} * count({c[1]}) {last(p[0])}) AS BIGINT))] END"),
    "ts_argmax": _agg("rn - arg_max(rn, CASE WHEN {0} IS NOT NULL THEN row({0}, -rn) END) {w}"),
    "ts_argmin": _agg("rn - arg_min(rn, CASE WHEN {0} IS NOT NULL THEN row({0}, rn) END) {w}"),
    "ts_skew": _agg("CASE WHEN count({0}) {w} >= 3 AND stddev_pop({0}) {w} > 1e-10 "
                    "THEN skewness({0}) {w} END"),
    "ts_kurt": _agg("CASE WHEN count({0}) {w} >= 4 AND stddev_pop({0}) {w} > 1e-10 "
                    "THEN kurtosis({0}) {w} END"),
    "ts_zscore": _agg("CASE WHEN stddev_samp({0}) {w} > 1e-10 "
                      "THEN ({0} - avg({0}) {w}) / stddev_samp({0}) {w} END"),
    "ts_scale": _agg("CASE WHEN sum(abs({0})) {w} > 1e-10 THEN {0} / sum(abs({0})) {w} "
                     "WHEN {0} IS NOT NULL THEN 0.0 END"),
    "ts_corr": _agg("CASE WHEN count({0}) {w} >= 3 AND stddev_samp({0}) {w} > 1e-10 "
                    "AND stddev_samp({1}) {w} > 1e-10 THEN covar_samp({0}, {1}) {w} / "
                    "(stddev_samp({0}) {w} * stddev_samp({1}) {w}) END"),
    "ts_cov": _agg("CASE WHEN count({0}) {w} >= 3 THEN covar_samp({0}, {1}) {w} END"),
    "ts_step": _agg("CASE WHEN coalesce(min({0}) {w}, 0.0) >= 0 THEN 1.0 ELSE 0.0 END"),
    "ts_hump": lambda p, c: (
        f"CASE WHEN rn >= {p[0]} AND count({c[1]}) {last(p[0])} >= 3 THEN CASE WHEN "
        f"arg_max(rn, CASE WHEN {c[1]} IS NOT NULL THEN row({c[1]}, -rn) END) {last(p[0])} - (rn - {p[0]} + 1)"
        f" BETWEEN {int(p[0] * .3)} AND {int(p[0] * .7)}"
        f" AND max({c[1]}) {last(p[0])} > first_value({c[1]}) {last(p[0])}"
        f" AND max({c[1]}) {last(p[0])} > {c[1]} THEN 1.0 ELSE 0.0 END END"),
    "ts_decay_linear": _agg("(sum({0} * rn) {w} - (rn - {d}) * sum({0}) {w}) / "
                            "nullif(sum(CASE WHEN {0} IS NOT NULL THEN rn END) {w}"
                            " - (rn - {d}) * count({0}) {w}, 0)"),
    "sma": lambda p, c: (f"CASE WHEN rn >= {p[0] + p[1]} THEN avg({c[1]}) OVER ({P} ROWS BETWEEN "
                         f"{p[0] - 1 + p[1]} PRECEDING AND {p[1]} PRECEDING) END"),
    "trend_slope": _agg("CASE WHEN {0} IS NOT NULL AND count({0}) {w} >= 3 "
                        "THEN regr_slope({0}, rn) {w} END"),
    "trend_level": _agg("CASE WHEN {0} IS NOT NULL AND count({0}) {w} >= 3 THEN avg({0}) {w} + "
                        "regr_slope({0}, rn) {w} * (rn - avg(CASE WHEN {0} IS NOT NULL THEN rn END) {w}) END"),
    "trend_rsq": _agg("CASE WHEN {0} IS NOT NULL AND count({0}) {w} >= 3 THEN CASE WHEN "
                      "regr_syy({0}, rn) {w} > 1e-10 THEN regr_r2({0}, rn) {w} ELSE 0.0 END END"),
    "reg_slope": _agg("CASE WHEN count({1}) {w} >= 3 AND var_samp({1}) {w} > 1e-15 "
                      "THEN regr_slope({0}, {1}) {w} END"),
    "reg_intercept": _agg("CASE WHEN count({1}) {w} >= 3 AND var_samp({1}) {w} > 1e-15 "
                          "THEN regr_intercept({0}, {1}) {w} END"),
    "reg_rsq": _agg("CASE WHEN count({1}) {w} >= 3 AND var_samp({1}) {w} > 1e-15 THEN CASE WHEN "
                    "regr_syy({0}, {1}) {w} > 1e-10 THEN regr_r2({0}, {1}) {w} ELSE 0.0 END END"),
    "regbeta": _agg("CASE WHEN count({1}) {w} >= 3 AND var_samp({1}) {w} >= 1e-10 "
                    "THEN regr_slope({0}, {1}) {w} END"),
    # smoothed averages and the older feature space
    "recurrence": lambda p, c: (
        f"CASE WHEN rn >= {p[2] + p[3]} AND len(list_filter(list_slice(list({c[1]}) {SOFAR}, {p[3] + 1}, rn), lambda v: v IS NULL)) = 0 THEN list_reduce(list_prepend("
        f"list_{'avg' if p[4] == 'mean' else 'sum'}(list_slice(list({c[1]}) {SOFAR}, {p[3] + 1}, {p[2] + p[3]})), list_slice(list({c[1]}) {SOFAR}, {p[2] + p[3] + 1}, rn)),"
        f" lambda s, v: {p[0]!r} * s + {p[1]!r} * v) END"),
    "plus_dm": _row("CASE WHEN {0} > 0 AND {0} > {1} THEN {0} WHEN {0} + {1} IS NOT NULL THEN 0.0 END"),
    "minus_dm": _row("CASE WHEN {0} > 0 AND {0} > {1} THEN {0} WHEN {0} + {1} IS NOT NULL THEN 0.0 END"),
    "true_range": _row("CASE WHEN {2} IS NOT NULL THEN greatest({0} - {1}, abs({0} - {2}), abs({1} - {2})) END"),
    "dx": _row("CASE WHEN {0} > {p0} THEN CASE WHEN {3} > 0 AND {1} + {2} > 0 THEN 100.0 * abs({1} - {2}) / ({1} + {2}) "
               "WHEN {1} + {2} + {3} IS NOT NULL THEN 0.0 END END"),
    "by_close": _row("CASE WHEN {1} > 0 THEN {0} / {1} ELSE {0} END"),
    "least": _row("CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN least({0}, {1}) END"),
    "ratio_else_zero": _row("CASE WHEN {1} > {p0} THEN {0} / {1} ELSE 0.0 END"),
    "change": _row("CASE WHEN {1} > 0 THEN {0} / {1} - 1 END"), "raw_change": _row("CASE WHEN {1} <> 0 THEN ({0} - {1}) / {1} END"),
    "full_mean": _agg("CASE WHEN count({0}) {w} = {d} THEN avg({0}) {w} END"),
    "stddev": _agg("CASE WHEN count({0}) {w} = {d} THEN stddev_pop({0}) {w} END"), "var": _agg("CASE WHEN count({0}) {w} = {d} THEN var_pop({0}) {w} END"),
    "bb_width": _agg("CASE WHEN count({0}) {w} = {d} AND avg({0}) {w} > 0 THEN 4 * stddev_pop({0}) {w} / avg({0}) {w} END"),
    "tsf": lambda p, c: f"CASE WHEN rn >= {p[0]} AND count({c[1]}) {last(p[0])} = {p[0]} THEN regr_intercept({c[1]}, rn) {last(p[0])} + regr_slope({c[1]}, rn) {last(p[0])} * (rn + {p[1]}) END",
    "linearreg": lambda p, c: f"CASE WHEN rn >= {p[0]} AND count({c[1]}) {last(p[0])} = {p[0]} THEN regr_intercept({c[1]}, rn) {last(p[0])} + regr_slope({c[1]}, rn) {last(p[0])} * (rn + {p[1]}) END",
    "cci": _row("CASE WHEN {1} IS NULL THEN NULL WHEN list_sum(list_transform({0}, lambda e: abs(e - {1}))) > 0 AND {2} <> {1} "
                "THEN ({2} - {1}) / (0.015 * list_sum(list_transform({0}, lambda e: abs(e - {1}))) / {p0}) ELSE 0.0 END"),
    "correl": _agg("CASE WHEN count({0}) {w} = {d} THEN CASE WHEN stddev_samp({0}) {w} > 1e-10 THEN corr({0}, rn) {w} ELSE 0.0 END END"),
    "mom_chg": _row("CASE WHEN abs({1}) > 1e-10 THEN {0} - {1} ELSE 0.0 END"),
    "mom_ratio": _row("CASE WHEN abs({1}) > 1e-10 THEN {0} / abs({1}) ELSE 0.0 END"),
    "natr": _row("CASE WHEN {1} <> 0 THEN {0} / {1} * 100.0 WHEN {0} IS NOT NULL THEN 0.0 END"),
    "move": _row("CASE WHEN {1} IS NULL THEN 0.0 ELSE CAST(sign({0} - {1}) AS DOUBLE) END"),
    "obv": _row("CASE WHEN {1} <> 0 THEN ({0} / {1} - 1) * 100.0 WHEN {1} = 0 THEN 0.0 END"),
    "gain": _row("CASE WHEN {0} IS NOT NULL THEN greatest({0}, 0.0) END"), "loss": _row("CASE WHEN {0} IS NOT NULL THEN greatest(-{0}, 0.0) END"),
    "rsi": _row("(CASE WHEN {0} + {1} > 0 THEN 100.0 * {0} / ({0} + {1}) WHEN {0} + {1} IS NOT NULL THEN 0.0 END - 50.0) / 50.0"),
    "vol_chg": _row("CASE WHEN {1} > 1e-10 THEN {0} / {1} - 1.0 ELSE 0.0 END"), "from_long": _row("CASE WHEN {0} >= {p0} THEN {1} END"),
    "steady": _row("round({0}, 9) + 0.0"), "log_size": _row("CAST(sign({0}) AS DOUBLE) * ln(1 + abs({0}))"),
    # expanding
    "expanding_mean": lambda p, c: f"CASE WHEN rn >= {p[0]} THEN avg({c[1]}) {SOFAR} END",
    "expanding_median": lambda p, c: f"CASE WHEN rn >= {p[0]} THEN quantile_cont({c[1]}, 0.5) {SOFAR} END",
    "expanding_std": lambda p, c: f"CASE WHEN rn >= {p[0]} THEN stddev_samp({c[1]}) {SOFAR} END",
    "expanding_percentile_linear": lambda p, c: (
        f"CASE WHEN rn >= {p[0]} THEN quantile_cont({c[1]}, {p[1]}) {SOFAR} END"),
    "expanding_percentile": lambda p, c: (
        f"CASE WHEN rn >= {p[0]} THEN list_sort(list({c[1]}) FILTER (WHERE {c[1]} IS NOT NULL) {SOFAR})"
        f"[greatest(1, CAST(ceil({p[1]} * count({c[1]}) {SOFAR}) AS BIGINT))] END"),
    "expanding_max": lambda p, c: f"max({c[0]}) {SOFAR}",
    "expanding_sum": lambda p, c: f"sum({c[0]}) {SOFAR}",
    "expanding_zscore": lambda p, c: (
        f"CASE WHEN rn > {p[0]} THEN least(greatest(({c[1]} - avg({c[1]}) {SOFAR}) / "
        f"sqrt(greatest(var_pop({c[1]}) {SOFAR}, 1e-10)), -3.0), 3.0) ELSE 0.0 END"),
    "expanding_rank": lambda p, c: (
        f"CASE WHEN rn >= {p[0]} THEN len(list_filter(list({c[1]}) {SOFAR}, lambda v: v <= {c[1]})) * 1.0 / rn END"),
    "half_before": _row("coalesce({0}, 0.5)"),
    # across symbols
    "cs_rank": lambda p, c: (f"CASE WHEN {c[0]} IS NOT NULL THEN rank() OVER (PARTITION BY ts ORDER BY "
                             f"{c[0]} NULLS LAST) * 1.0 / count({c[0]}) {DAY} END"),
    "cs_rank0": lambda p, c: (f"CASE WHEN {c[0]} IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY "
                              f"{c[0]} NULLS LAST) - 1.0) / count({c[0]}) {DAY} END"),
    "cs_rank_average": lambda p, c: (
        f"CASE WHEN {c[0]} IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY {c[0]} NULLS LAST) + "
        f"(count(*) OVER (PARTITION BY ts, {c[0]}) - 1) / 2.0) / count({c[0]}) {DAY} END"),
    "cs_zscore": lambda p, c: (
        f"CASE WHEN stddev_samp({c[0]}) {DAY} > 1e-10 THEN ({c[0]} - avg({c[0]}) {DAY}) / "
        f"stddev_samp({c[0]}) {DAY} WHEN {c[0]} IS NOT NULL AND count({c[0]}) {DAY} > 1 THEN 0.0 END"),
    "cs_zscore_unit": lambda p, c: (
        f"({c[0]} - avg({c[0]}) {DAY}) / CASE WHEN stddev_samp({c[0]}) {DAY} = 0 THEN 1.0 "
        f"ELSE stddev_samp({c[0]}) {DAY} END"),
    "cs_scale": lambda p, c: (f"CASE WHEN sum(abs({c[0]})) {DAY} > 1e-10 THEN {c[0]} / sum(abs({c[0]})) {DAY}"
                              f" * {p[0]} WHEN {c[0]} IS NOT NULL THEN 0.0 END"),
    "cs_winsorize": lambda p, c: (
        f"CASE WHEN {c[0]} IS NULL OR count({c[0]}) {DAY} <= 1 THEN {c[0]} ELSE least(greatest({c[0]}, "
        f"avg({c[0]}) {DAY} - {p[0]} * stddev_samp({c[0]}) {DAY}), "
        f"avg({c[0]}) {DAY} + {p[0]} * stddev_samp({c[0]}) {DAY}) END"),
    "winsorize": lambda p, c: (
        f"CASE WHEN {c[0]} IS NOT NULL THEN least(greatest({c[0]}, "
        f"avg({c[0]}) {DAY} - {p[0]} * stddev_pop({c[0]}) {DAY}), "
        f"avg({c[0]}) {DAY} + {p[0]} * stddev_pop({c[0]}) {DAY}) END"),
    "cs_quantile": lambda p, c: f"quantile_cont({c[0]}, {p[0]}) {DAY}",
    "cs_mean": lambda p, c: f"avg({c[0]}) {DAY}",
    "cs_sum": lambda p, c: f"sum({c[0]}) {DAY}",
}


def feature_ctes(features: Mapping[str, Feature], source: str = "t0") -> tuple[str, dict[str, str]]:
    """CTEs on top of ``source`` and the column expression of each feature."""
    nodes: dict[str, Feature] = {}
    for f in features.values():
        for n in f.walk():
            nodes.setdefault(n.key, n)
    level: dict[str, int] = {}
    name: dict[str, str] = {}
    steps: dict[int, list[str]] = {}
    for key, n in nodes.items():
        if n.op == "col":
            level[key], name[key] = 0, n.params[0]
        elif n.op == "lit":
            v = n.params[0]
            level[key], name[key] = 0, "CAST(NULL AS DOUBLE)" if v != v else f"CAST({v!r} AS DOUBLE)"
        else:
            cols = [name[i.key] for i in n.inputs]
            level[key] = 1 + max((level[i.key] for i in n.inputs), default=0)
            name[key] = "rn" if n.op == "row_number" else f"n{len(name)}"
            steps.setdefault(level[key], []).append(
                f"{TEMPLATES[n.op](n.params, cols)} AS {name[key]}")
    ctes, below = [], source
    for lv in sorted(steps):
        ctes.append(f"{source}_{lv} AS (SELECT *, {', '.join(steps[lv])} FROM {below})")
        below = f"{source}_{lv}"
    out = {f: f"CASE WHEN isfinite(CAST({name[x.key]} AS DOUBLE)) THEN {name[x.key]} END"
           for f, x in features.items()}
    out["__from__"] = below
    return ",\n".join(ctes), out


def feature_sql(features: Mapping[str, Feature], prelude: str, digits: int = 6,
                special: Mapping[str, int] | None = None, keys: str = "symbol, ts",
                offset: float = 0.0) -> str:
    ctes, out = feature_ctes(features)
    below = out.pop("__from__")
    cols = ", ".join(f"{rsql(f'({e}) + {offset}' if offset else e, (special or {}).get(n, digits))} AS {n}"
                     for n, e in out.items())
    parts = [prelude] + ([ctes] if ctes else [])
    return f"WITH {', '.join(parts)}\nSELECT {keys}, {cols} FROM {below}"
