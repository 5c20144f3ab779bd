"""Experiment log, feature library and signal registry as relations.

Log records: ``(category, template, seq, params_grid map<string,array<double>>, params_explored,
best_params map, metrics map<string,double>, exhausted, parent_templates array, note)``; ``seq``
orders the records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.sources.store import materialize

NODE = ("category", "template")
MISSING = -999.0


def metric(name: str, default: float = MISSING) -> Column:
    return F.coalesce(F.try_element_at("metrics", F.lit(name)), F.lit(default))


def with_totals(records: DataFrame) -> DataFrame:
    """params_total: the product of the grid sizes."""
    sizes = F.transform(F.map_values("params_grid"), lambda v: F.size(v))
    return records.withColumn("params_total", F.aggregate(sizes, F.lit(1), lambda a, n: a * n))


def unknown_categories(records: DataFrame, categories: DataFrame) -> DataFrame:
    """Records whose category is not an allowed label."""
    return records.join(categories.select("category"), "category", "left_anti")


def nodes(records: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row per template: best record (first of equals), status, explored ratio, latest notes.

    The last record decides between EXHAUSTED and PARTIAL; ``overrides(category, template,
    status)`` replaces it.
    """
    best = F.max_by(F.struct("best_params", "metrics"), F.struct(metric("sharpe_ratio_d"), -F.col("seq")))
    total = F.sum(F.when(F.col("params_total") > 0, F.col("params_total")).otherwise(F.col("params_explored")))
    n = records.groupBy(*NODE).agg(
        best.alias("_b"), F.max_by(F.when(F.col("exhausted"), "EXHAUSTED").otherwise("PARTIAL"), "seq").alias("status"),
        F.count(F.lit(1)).alias("records"),
        F.when(total > 0, F.least(F.sum("params_explored") / total, F.lit(1.0))).otherwise(0.0).alias("explored_ratio"),
        F.max_by("note", "seq").alias("note"), F.max_by("parent_templates", "seq").alias("parent_templates"))
    n = n.select(*NODE, "status", "records", "explored_ratio", "note", "parent_templates",
                 F.col("_b.best_params").alias("best_params"), F.col("_b.metrics").alias("metrics"))
    if overrides is not None:
        o = overrides.select(*NODE, F.col("status").alias("_s"))
        n = n.join(o, list(NODE), "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")
    return n


def explored_grid(records: DataFrame) -> DataFrame:
    """Union of the values tried per template and parameter."""
    flat = records.select(*NODE, F.explode("params_grid").alias("param", "_v"))
    return flat.select(*NODE, "param", F.explode("_v").alias("value")).distinct()


def query(tree: DataFrame, *, category: str | None = None, status: str | None = None,
          min_value: float | None = None, sort_by: str = "sharpe_ratio_d", limit: int = 20) -> DataFrame:
    """Templates filtered and sorted by a metric (missing last); a report of ``limit`` rows."""
    x = tree.withColumn("_m", metric(sort_by))
    if category is not None:
        x = x.filter(F.col("category") == category)
    if status is not None:
        x = x.filter(F.col("status") == status)
    if min_value is not None:
        x = x.filter((F.col("_m") != MISSING) & (F.col("_m") >= min_value))
    return x.orderBy(F.desc("_m"), *NODE).limit(limit).drop("_m")


def roots(records: DataFrame) -> DataFrame:
    return records.filter(F.coalesce(F.size("parent_templates"), F.lit(0)) <= 0)


def fusion_candidates(records: DataFrame) -> DataFrame:
    """Categories with at least two root records, best first: count and the two best templates."""
    r = roots(records).withColumn("_m", metric("sharpe_ratio_d", 0.0))
    w = W.partitionBy("category").orderBy(F.desc("_m"), "seq")
    x = r.withColumn("_k", F.row_number().over(w))
    g = x.groupBy("category").agg(
        F.count(F.lit(1)).alias("count"), F.max("_m").alias("high"), F.min("_m").alias("low"),
        F.max(F.when(F.col("_k") == 1, F.col("template"))).alias("first"),
        F.max(F.when(F.col("_k") == 2, F.col("template"))).alias("second"))
    return g.filter(F.col("count") >= 2).orderBy(F.desc("count"), "category")


def suggest(records: DataFrame, tree: DataFrame, categories: DataFrame, top_k: int = 5, strongest: int = 3) -> DataFrame:
    """What to try next: thin categories first, then partial templates, the ``strongest`` templates
    if weak in falling markets, and categories with roots to combine."""
    counts = tree.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")

    def rows(df, rule, reason, template=None):
        return df.select("category", (none if template is None else F.col(template)).alias("template"),
                         F.lit(rule).alias("rule"), F.lit(reason).alias("reason"), F.lit(0 if rule == 1 else 1).alias("priority"))
    thin = categories.join(counts, "category", "left").filter(F.coalesce("n", F.lit(0)) < 3)
    partial = tree.filter(F.col("status") == "PARTIAL")
    strong = tree.filter(F.col("status") != "REDUNDANT").orderBy(metric("sharpe_ratio_d").desc(), *NODE).limit(strongest)
    weak = strong.filter(metric("bear_sharpe", 0.0) < 0.1)
    out = rows(thin, 1, "fewer than three templates")
    for df, rule, reason, t in ((partial, 2, "best parameters may lie at the edge", "template"),
                                (weak, 3, "weak in falling markets", "template"),
                                (fusion_candidates(records), 4, "independent roots to combine", None)):
        out = out.unionByName(rows(df, rule, reason, t))
    return out.orderBy("priority", "rule", "category", "template").limit(top_k)


def category_statistics(tree: DataFrame) -> DataFrame:
    def n(s):
        return F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s.lower())
    m = metric("sharpe_ratio_d")
    return tree.groupBy("category").agg(
        F.count(F.lit(1)).alias("total_templates"), n("EXHAUSTED"), n("PARTIAL"), n("REDUNDANT"),
        F.max(m).alias("best_sharpe"), F.max_by("template", F.struct(m, "template")).alias("best_template"))


def status_rollup(tree: DataFrame) -> DataFrame:
    """Counts per (category, status), per category and in total."""
    return tree.rollup("category", "status").agg(F.count(F.lit(1)).alias("templates"))


def tree_state(records: DataFrame, tree: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("total_records")).join(
        F.broadcast(tree.agg(F.count(F.lit(1)).alias("total_templates"), F.count_distinct("category").alias("categories"))))


def lineage(records: DataFrame, wanted: DataFrame | None = None, *, full: bool = False) -> DataFrame:
    """Ancestors of templates with their distance, through the first parent (or all with ``full``).

    A template is described by its latest record. Each ancestor is listed once, at its smallest distance, itself
    at 0, so cycles end. Every round doubles the known distance and is written once, so the number of rounds is
    the logarithm of the longest chain. A nearest path that is longer than what is known passes an ancestor at just
    that distance: only from those ancestors the next round goes on. Stored pairs are far smaller than in memory, so the
    join is never a broadcast.
    """
    latest = records.groupBy("template").agg(F.max_by("parent_templates", "seq").alias("_p"))
    parent = F.explode("_p") if full else F.get("_p", F.lit(0))
    edges = latest.select("template", parent.alias("ancestor")).filter(F.col("ancestor").isNotNull())
    own = latest.select("template", F.col("template").alias("ancestor"), F.lit(0).alias("distance"))
    known, reach = materialize(_nearest(own.union(edges.withColumn("distance", F.lit(1)))), "lineage"), 1
    while not (edge := known.filter(F.col("distance") == reach)).isEmpty():
        far = known.filter("distance > 0").select(F.col("template").alias("ancestor"), F.col("ancestor").alias("_a"), F.col("distance").alias("_d"))
        on = edge.join(far.hint("merge"), "ancestor").select("template", F.col("_a").alias("ancestor"), (F.col("distance") + F.col("_d")).alias("distance"))
        known, reach = materialize(_nearest(known.union(on)), "lineage"), 2 * reach
    if wanted is None:
        return known
    asked = wanted.select("template")
    return known.join(asked, "template", "left_semi").union(
        asked.join(known, "template", "left_anti").select("template", "template", F.lit(0)))


def _nearest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("template", "ancestor").agg(F.min("distance").alias("distance"))


# -- library ----------------------------------------------------------------------------------------------
def register_new(library: DataFrame, batch: DataFrame, key: str = "alpha_id") -> DataFrame:
    """Library plus the entries of the batch whose key is new (the first of equal keys wins)."""
    fields = [c for c in batch.columns if c != key]
    once = batch.groupBy(key).agg(F.min_by(F.struct(*fields), "created_at").alias("_r")).select(key, "_r.*")
    return library.unionByName(once.join(library.select(key), key, "left_anti"))


def count_new(library: DataFrame, found: DataFrame, key: str = "alpha_id") -> DataFrame:
    return found.select(key).distinct().join(library.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("new"))


def library_top(library: DataFrame, n: int, *, by: str = "fitness", **equals) -> DataFrame:
    """Best n entries, optionally of one source / category / round; a report."""
    x = library
    for c, v in equals.items():
        x = x.filter(F.col(c) == v)
    return x.orderBy(F.desc(by), "alpha_id").limit(n)


def library_between(library: DataFrame, start: str, end: str) -> DataFrame:
    return library.filter(F.col("created_at").between(start, end))


# -- signal registry --------------------------------------------------------------------------------------
def select_best(registry: DataFrame, k: int = 1, *, by: str = "test_sharpe", regime: str | None = None) -> DataFrame:
    x = registry
    if regime is not None:
        x = x.filter(F.array_contains("suitable_regimes", regime))
    return x.orderBy(metric(by, 0.0).desc(), "name").limit(k)


def regime_summary(registry: DataFrame, by: str = "test_sharpe") -> DataFrame:
    """Signals and best signal per regime; a missing metric counts as 0."""
    m = metric(by, 0.0)
    x = registry.select("name", "metrics", F.explode("suitable_regimes").alias("regime"))
    return x.groupBy("regime").agg(F.count(F.lit(1)).alias("signals"), F.max(m).alias("best"),
                                   F.max_by("name", F.struct(m, "name")).alias("best_name"))


def regime_names(registry: DataFrame) -> DataFrame:
    """``regime, names``: the signals tagged with a regime, and once more those whose ``suitable_for`` it is."""
    named = F.concat(F.coalesce("suitable_regimes", F.array().cast("array<string>")),
                     F.when(F.col("suitable_for") != "", F.array("suitable_for")).otherwise(F.array().cast("array<string>")))
    x = registry.select("name", F.explode(named).alias("regime"))
    return x.groupBy("regime").agg(F.array_sort(F.collect_list("name")).alias("names"))


def fingerprints(registry: DataFrame, text: str = "expression", features: str = "features") -> DataFrame:
    return registry.withColumn("fingerprint", F.md5(F.concat_ws("|", F.col(text), F.concat_ws(",", F.array_sort(features)))))


def duplicates(registry: DataFrame, **kw) -> DataFrame:
    g = fingerprints(registry, **kw).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))
    return g.filter(F.col("n") > 1)


# -- formula texts ------------------------------------------------------------------------------------------
def skeleton(text: Column) -> Column:
    """Structure only: variables become X, numbers become C."""
    return F.regexp_replace(F.regexp_replace(text, r"\b[A-Z][A-Z_0-9]+\b", "X"), r"\b\d+(\.\d+)?\b", "C")


def used_functions(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([a-z_]+)\("), 1)))


def used_variables(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z_0-9]+)\b"), 1)))


def signature(text: Column, math: Sequence[str], *, variables: int | None = 4, length: int = 80) -> Column:
    """Scalar functions, other functions, variables with their counts and skeleton in one text.

    The ``variables`` most frequent ones are named (None: all), the earlier one first where counts are equal.
    A skeleton of more than ``length`` characters is its first half and a hash.
    """
    known = F.array(*[F.lit(m) for m in math])
    fs = used_functions(text)
    every = F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z_0-9]+)\b"), 1)
    counted = F.array_sort(F.transform(F.array_distinct(every), lambda v, i: F.struct(
        (-F.size(F.filter(every, lambda x: x == v))).alias("n"), i.alias("i"), v.alias("v"))))
    named = F.transform(counted, lambda c: F.concat(c["v"], F.lit(":"), (-c["n"]).cast("string")))
    shape = skeleton(text)
    short = F.when(F.length(shape) > length, F.concat(
        F.substring(shape, 1, length // 2), F.lit(".."), F.substring(F.md5(shape.cast("binary")), 1, 8))).otherwise(shape)

    def part(a):
        return F.when(F.size(a) > 0, F.array_join(a, "+")).otherwise("none")
    return F.concat(F.lit("m:"), part(F.array_intersect(fs, known)), F.lit("|t:"), part(F.array_except(fs, known)),
                    F.lit("|v:"), part(named if variables is None else F.slice(named, 1, variables)), F.lit("|s:"), short)


def usable_formula(text: Column) -> Column:
    """Cheap check: no window of one row, some variable, no constant as first argument of a window
    function, and a function where only one or two variables occur."""
    return (~text.rlike(r"ts_\w+\([^,]+, 1\)") & (F.size(used_variables(text)) > 0)
            & ~text.rlike(r"ts_\w+\(-?\d+\.?\d*,")
            & ((F.size(used_functions(text)) > 0) | (F.size(used_variables(text)) > 2)))


def best_per_signature(scored: DataFrame, min_fitness: float = 0.3) -> DataFrame:
    """Best, count and latest fitness per signature ``(signature, seq, fitness, formula)``."""
    return scored.groupBy("signature").agg(
        F.max("fitness").alias("best"), F.count(F.lit(1)).alias("n"), F.max_by("fitness", "seq").alias("latest"),
        F.max_by("formula", F.struct("fitness", -F.col("seq"))).alias("formula")).filter(F.col("best") >= min_fitness)
