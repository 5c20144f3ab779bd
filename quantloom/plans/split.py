"""Exact windows and ranks for series or dates that are too big for one task.

``with_features`` gives each series to one task, which suits bars: a series has at most one row
per bar time. Tick-like tables, where one symbol can hold a third of all rows, go through
:func:`with_features_split`; dates with very many symbols through :func:`cs_rank_split`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.feature import Feature, col
from quantloom.functions.indicators import recurrence_maps, recurrence_value
from quantloom.plans.panel import with_features
from quantloom.plans.passes import Request, add_passes
from quantloom.sources.store import materialize, scratch


def lookback(features: Mapping[str, Feature]) -> int:
    """Rows before the current one that the features need together."""
    need: dict[str, int] = {}
    for f in features.values():
        for n in f.walk():
            below = max((need[i.key] for i in n.inputs), default=0)
            if n.op == "row_number":
                need[n.key] = 0
                continue
            if n.axis == "date":
                raise ValueError(f"{n.op} looks across symbols and cannot be split along time")
            if n.lookback is None:
                raise ValueError(f"{n.op} needs the whole history and cannot be split")
            need[n.key] = below + n.lookback
    return max((need[f.key] for f in features.values()), default=0)


def numbered(df: DataFrame, *, symbol: str = "symbol", ts: str = "ts", order: Sequence[str] = (),
             bucket: str = "day", output: str = "rn") -> DataFrame:
    """1-based row number per series without sorting a series in one task.

    Rows are counted per series and calendar bucket, the counts are summed up in order, and only
    the rows of one bucket are numbered together.
    """
    x = df.withColumn("_bucket", F.date_trunc(bucket, ts))
    counts = x.groupBy(symbol, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(W.partitionBy(symbol).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(symbol, "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    local = F.row_number().over(W.partitionBy(symbol, "_bucket").orderBy(ts, *order))
    return x.join(starts, [symbol, "_bucket"]).withColumn(output, F.col("_start") + local).drop("_bucket", "_start")


def with_features_split(df: DataFrame, features: Mapping[str, Feature], *, symbol: str = "symbol", ts: str = "ts",
                        order: Sequence[str] = (), rows: int = 1_000_000, bucket: str = "day",
                        keep: Sequence[str] | None = None) -> DataFrame:
    """Features on series of any length: those of bounded lookback and smoothed averages of any kind.

    A series is cut into parts of ``rows`` rows; each part also gets the rows before it that its windows reach back
    to, so results equal the unsplit ones. Recurrences are prefix scans over the parts (:func:`affine_split`), one
    after the other where they build on each other. ``order`` breaks ties of ``ts``.
    """
    keep = list(df.columns if keep is None else keep)
    x = numbered(df, symbol=symbol, ts=ts, order=order, bucket=bucket, output="_rn")
    made: dict[str, Feature] = {}
    scans = {n.key: n for f in features.values() for n in f.walk() if n.op in ("recurrence", "affine_scan")}
    level: dict[str, int] = {}
    for f in features.values():  # scans that do not need each other go together
        for n in f.walk():
            level[n.key] = max((level[i.key] for i in n.inputs), default=0) + (n.key in scans)
    for depth in sorted({level[k] for k in scans}):
        maps, names = {}, []
        for k in (k for k in scans if level[k] == depth):
            keeps, puts = recurrence_maps(scans[k]) if scans[k].op == "recurrence" else scans[k].inputs[1:]
            name = f"_scan_{k}"
            maps |= {f"{name}_keep": _replace(keeps, made), f"{name}_put": _replace(puts, made)}
            names.append(name)
        x = _parts(x, maps, symbol, rows, [c for c in x.columns])
        x = affine_split(x, names, series=symbol, rn="_rn", rows=rows)
        for k in (k for k in scans if level[k] == depth):
            y = col(f"_scan_{k}")
            made[k] = recurrence_value(scans[k], y) if scans[k].op == "recurrence" else y
    return _parts(x, {n: _replace(f, made) for n, f in features.items()}, symbol, rows, keep)


def _parts(x: DataFrame, features: Mapping[str, Feature], symbol: str, rows: int, keep: Sequence[str]) -> DataFrame:
    need = lookback(features)
    part = F.floor((F.col("_rn") - 1) / rows)
    reach = F.floor((F.col("_rn") - 1 + need) / rows)
    x = x.select("*", part.alias("_own"), F.explode(F.sequence(part, reach)).alias("_part"))
    out = with_features(x, features, symbol=[symbol, "_part"], ts="_rn", rn="_rn", keep=[*keep, "_own", "_part"])
    return out.filter(F.col("_own") == F.col("_part")).drop("_own", "_part")


def _replace(f: Feature, made: Mapping[str, Feature]) -> Feature:
    """The recipe with parts of it read from columns."""
    if f.key in made:
        return made[f.key]
    inputs = tuple(_replace(i, made) for i in f.inputs)
    if all(a is b for a, b in zip(inputs, f.inputs)):
        return f
    return Feature(f.op, inputs, f.build, params=f.params, axis=f.axis, lookback=f.lookback, uses=f.uses)


def affine_split(df: DataFrame, names: Sequence[str], *, series: str, rn: str, rows: int) -> DataFrame:
    """Columns ``name`` of ``y = keep*y + put`` from ``name_keep`` and ``name_put``, on series of any length.

    The maps of each part's rows are composed inside the part. The parts' last maps, one row a part, are composed along
    the series, and every row takes what stood before its part through its own map: nothing is cut off.
    """
    part = F.floor((F.col(rn) - 1) / rows)
    x = df.withColumn("_part", part)
    inner = [Request(f"_{op}_{n}", f"affine_{op}", (), pairs) for n in names
             for op, pairs in (("scan", [(f"{n}_keep", F.col(f"{n}_keep")), (f"{n}_put", F.col(f"{n}_put"))]),
                               ("run", [(f"{n}_keep", F.col(f"{n}_keep"))]))]
    x = materialize(add_passes(x, [series, "_part"], rn, F.col(rn), inner).drop(*[f"{n}_{c}" for n in names for c in ("keep", "put")]), "parts")
    last = F.max_by(F.struct(*[f"_{op}_{n}" for n in names for op in ("scan", "run")]), rn)
    ends = x.groupBy(series, "_part").agg(last.alias("_l")).select(series, "_part", "_l.*")
    whole = [Request(f"_end_{n}", "affine_scan", (), [(f"_run_{n}", F.col(f"_run_{n}")), (f"_scan_{n}", F.col(f"_scan_{n}"))]) for n in names]
    ends = add_passes(ends, [series], "_part", F.col("_part") + 1, whole)
    carry = ends.select(series, (F.col("_part") + 1).alias("_part"), *[f"_end_{n}" for n in names])
    x = x.join(carry, [series, "_part"], "left")
    before = {n: F.when(F.col("_part") == 0, 0.0).otherwise(F.col(f"_end_{n}")) for n in names}
    out = x.withColumns({n: F.col(f"_scan_{n}") + F.col(f"_run_{n}") * before[n] for n in names})
    return out.drop("_part", *[f"_{op}_{n}" for n in names for op in ("scan", "run", "end")])


def cs_rank_split(df: DataFrame, value: str, *, ts: str = "ts", parts: int = 64, output: str = "rank") -> DataFrame:
    """Competition rank / count per date like ``cs_rank``, for dates of any size.

    Equal values are counted together first. The distinct values of a date are spread over
    ``parts`` value ranges by approximate quantiles; ranks are exact whatever the quantiles are,
    which are written once so that a retried task sees the same ones.
    """
    spark = df.sparkSession
    counts = df.filter(F.col(value).isNotNull()).groupBy(ts, value).agg(F.count(F.lit(1)).alias("_c"))
    cuts = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    folder = scratch(spark, "cuts")
    counts.groupBy(ts).agg(F.percentile_approx(value, cuts, 1000).alias("_q")).write.parquet(f"{folder}/q")
    bounds = spark.read.schema(df.select(ts, F.array(value).alias("_q")).schema).parquet(f"{folder}/q")
    x = counts.join(bounds, ts).withColumn("_part", F.size(F.filter("_q", lambda q: q < F.col(value)))).drop("_q")
    sums = x.groupBy(ts, "_part").agg(F.sum("_c").alias("_n"))
    day = W.partitionBy(ts)
    sums = sums.select(ts, "_part", F.sum("_n").over(day).alias("_total"), F.coalesce(F.sum("_n").over(
        day.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_c").over(W.partitionBy(ts, "_part").orderBy(value).rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0))
    ranks = (x.withColumn("_in", inside).join(sums, [ts, "_part"])
             .select(ts, value, ((F.col("_start") + F.col("_in") + 1) / F.col("_total")).alias(output)))
    return df.join(ranks, [ts, value], "left")
