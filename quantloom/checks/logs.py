"""Experiment-log, library, registry, text and storage queries on records derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom import col, with_features
from quantloom.checks.base import PANEL_SQL, WEEK_SQL, check, panel, rounded, rsql, table, week_bars
from quantloom.functions import text as tx
from quantloom.functions.rolling import ts_roc
from quantloom.operators import explog as ex
from quantloom.sources import cache, store
from quantloom.sources.store import materialize, scratch

# every order is one experiment record
REC = """rec AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS category0, o_orderpriority AS category,
  'T' || (o_custkey % 40)::VARCHAR AS template, o_orderkey AS seq, o_custkey % 7 + 1 AS a_n, o_custkey % 3 + 1 AS b_n, o_custkey % 5 AS explored,
  o_totalprice / 100003 AS sharpe, o_totalprice / 1000003 - 0.2 AS bear, o_orderstatus = 'F' AS exhausted,
  CASE WHEN o_custkey % 40 >= 4 THEN 'T' || ((o_custkey % 40) // 2)::VARCHAR END AS parent FROM orders)"""


def records(spark, path):
    o = table(spark, path, "orders")
    k = F.col("o_custkey")

    def grid(n):
        return F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: i.cast("double"))
    r = o.select(
        F.col("o_orderpriority").alias("category"), F.concat(F.lit("T"), (k % 40).cast("string")).alias("template"),
        F.col("o_orderkey").alias("seq"), F.create_map(F.lit("a"), grid(k % 7 + 1), F.lit("b"), grid(k % 3 + 1)).alias("params_grid"),
        (k % 5).alias("params_explored"), F.create_map(F.lit("a"), (k % 7).cast("double")).alias("best_params"),
        F.create_map(F.lit("sharpe_ratio_d"), F.col("o_totalprice") / 100003, F.lit("bear_sharpe"), F.col("o_totalprice") / 1000003 - 0.2).alias("metrics"),
        (F.col("o_orderstatus") == "F").alias("exhausted"),
        F.when(k % 40 >= 4, F.array(F.concat(F.lit("T"), F.floor((k % 40) / 2).cast("string")))).otherwise(
            F.array().cast("array<string>")).alias("parent_templates"), F.lit("").alias("note"))
    return ex.with_totals(r)


_N = f"""WITH {REC}, nd AS (SELECT category, template, arg_max(sharpe, row(sharpe, -seq)) AS sharpe, arg_max(bear, row(sharpe, -seq)) AS bear,
  arg_max(CASE WHEN exhausted THEN 'EXHAUSTED' ELSE 'PARTIAL' END, seq) AS status, count(*) AS records,
  least(sum(explored) * 1.0 / sum(a_n * b_n), 1.0) AS explored_ratio FROM rec GROUP BY 1, 2)"""
def _m():
    return F.col("metrics")["sharpe_ratio_d"].alias("sharpe")



def tree(s, p):
    return ex.nodes(records(s, p))


check("log_record_totals", f"WITH {REC} SELECT seq, CAST(a_n * b_n AS INTEGER) AS params_total FROM rec")(
    lambda s, p: records(s, p).select("seq", "params_total"))
check("log_unknown_categories", f"WITH {REC} SELECT seq, category FROM rec WHERE category NOT IN ('1-URGENT', '2-HIGH')")(
    lambda s, p: ex.unknown_categories(records(s, p), records(s, p).select("category").distinct().filter(
        F.col("category").isin("1-URGENT", "2-HIGH"))).select("seq", "category"))
check("log_nodes", f"{_N} SELECT category, template, status, records, {rsql('explored_ratio')} AS explored_ratio, {rsql('sharpe')} AS sharpe FROM nd")(
    lambda s, p: rounded(tree(s, p).select("category", "template", "status", "records", "explored_ratio", _m())))
check("log_status_override", f"{_N} SELECT category, template, CASE WHEN template = 'T3' THEN 'REDUNDANT' ELSE status END AS status FROM nd")(
    lambda s, p: ex.nodes(records(s, p), records(s, p).filter(F.col("template") == "T3").select("category", "template").distinct()
                          .withColumn("status", F.lit("REDUNDANT"))).select("category", "template", "status"))
check("log_explored_grid", f"""WITH {REC} SELECT DISTINCT category, template, 'a' AS param, unnest(range(1, a_n + 1))::DOUBLE AS value FROM rec
  UNION SELECT DISTINCT category, template, 'b', unnest(range(1, b_n + 1))::DOUBLE FROM rec""")(lambda s, p: ex.explored_grid(records(s, p)))
check("log_query", f"{_N} SELECT category, template, {rsql('sharpe')} AS sharpe FROM nd WHERE status = 'PARTIAL' AND sharpe >= 1 ORDER BY nd.sharpe DESC, category, template LIMIT 20")(
    lambda s, p: rounded(ex.query(tree(s, p), status="PARTIAL", min_value=1.0).select("category", "template", _m())))
_FC = f"""fc AS (SELECT category, count(*) AS count, max(sharpe) AS high, min(sharpe) AS low, list(template ORDER BY sharpe DESC, seq) AS l FROM rec WHERE parent IS NULL GROUP BY 1 HAVING count(*) >= 2)"""
check("log_fusion_candidates", f"WITH {REC}, {_FC} SELECT category, count, {rsql('high')} AS high, {rsql('low')} AS low, l[1] AS first, l[2] AS second FROM fc")(
    lambda s, p: rounded(ex.fusion_candidates(records(s, p))))
check("log_suggestions", f"""{_N}, {_FC}, cats AS (SELECT DISTINCT category FROM rec UNION SELECT 'NEW'),
sg AS (SELECT category, NULL AS template, 1 AS rule, 0 AS pr FROM cats WHERE (SELECT count(*) FROM nd WHERE nd.category = cats.category) < 3
  UNION ALL SELECT category, template, 2, 1 FROM nd WHERE status = 'PARTIAL'
  UNION ALL SELECT category, template, 3, 1 FROM (SELECT * FROM nd ORDER BY sharpe DESC, category, template LIMIT 3) WHERE bear < 0.1 UNION ALL SELECT category, NULL, 4, 1 FROM fc)
SELECT category, template, rule FROM sg ORDER BY pr, rule, category, template NULLS FIRST LIMIT 10""")(
    lambda s, p: (lambda r: ex.suggest(r, ex.nodes(r), r.select("category").union(r.agg(F.lit("NEW"))).distinct(), 10)
                  .select("category", "template", "rule"))(records(s, p)))
check("log_category_statistics", f"""{_N} SELECT category, count(*) AS total_templates, count(*) FILTER (WHERE status = 'EXHAUSTED') AS exhausted, count(*) FILTER (WHERE status = 'PARTIAL') AS partial,
  count(*) FILTER (WHERE status = 'REDUNDANT') AS redundant, {rsql('max(sharpe)')} AS best_sharpe, arg_max(template, row(sharpe, template)) AS best_template FROM nd GROUP BY 1""")(
    lambda s, p: rounded(ex.category_statistics(tree(s, p))))
check("log_status_rollup", f"{_N} SELECT category, status, count(*) AS templates FROM nd GROUP BY ROLLUP (category, status)")(
    lambda s, p: ex.status_rollup(tree(s, p)))
check("log_tree_state", f"{_N} SELECT (SELECT count(*) FROM rec) AS total_records, count(*) AS total_templates, count(DISTINCT category) AS categories FROM nd")(
    lambda s, p: ex.tree_state(records(s, p), tree(s, p)))
check("log_lineage", f"""WITH RECURSIVE {REC}, e AS (SELECT template, arg_max(coalesce(parent, ''), seq) AS parent FROM rec GROUP BY 1),
c(template, ancestor, distance) AS (SELECT template, template, 0 FROM e UNION ALL SELECT c.template, e.parent, c.distance + 1 FROM c JOIN e ON e.template = c.ancestor WHERE e.parent <> '')
SELECT * FROM c""")(lambda s, p: ex.lineage(records(s, p)))
check("log_full_ancestry", f"""WITH RECURSIVE e AS (SELECT 'P' || p_partkey AS template, unnest(['P' || (p_partkey // 3), 'P' || (p_partkey // 4)]) AS parent FROM part WHERE p_partkey >= 3),
c(template, ancestor, distance) AS (SELECT 'P' || p_partkey, 'P' || p_partkey, 0 FROM part UNION SELECT c.template, e.parent, c.distance + 1 FROM c JOIN e ON e.template = c.ancestor)
SELECT template, ancestor, min(distance) AS distance FROM c GROUP BY 1, 2""")(lambda s, p: ex.lineage(table(s, p, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey")).alias("template"), F.lit(1).alias("seq"), F.when(F.col("p_partkey") >= 3, F.array(
            F.concat(F.lit("P"), F.floor(F.col("p_partkey") / 3)), F.concat(F.lit("P"), F.floor(F.col("p_partkey") / 4)))).alias("parent_templates")), full=True))

# -- library ------------------------------------------------------------------------------------------------
LIB = """lib AS (SELECT 'A' || p_partkey AS alpha_id, p_retailprice AS fitness, p_brand AS category, p_type AS source, p_size AS round, lpad(p_partkey::VARCHAR, 9, '0') AS created_at FROM part)"""


def library(s, p):
    x = table(s, p, "part")
    return x.select(F.concat(F.lit("A"), F.col("p_partkey")).alias("alpha_id"), F.col("p_retailprice").alias("fitness"), F.col("p_brand").alias("category"),
                    F.col("p_type").alias("source"), F.col("p_size").alias("round"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("created_at"))


def found(s, p):
    c = table(s, p, "customer")
    return c.select(F.concat(F.lit("A"), F.col("c_custkey") * 2).alias("alpha_id"), F.col("c_acctbal").alias("fitness"), F.col("c_mktsegment").alias("category"),
                    F.lit("found").alias("source"), F.lit(1).alias("round"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("created_at"))


check("library_register", f"WITH {LIB} SELECT alpha_id, fitness, category FROM lib UNION ALL SELECT 'A' || (c_custkey * 2), c_acctbal, c_mktsegment FROM customer WHERE 'A' || (c_custkey * 2) NOT IN (SELECT alpha_id FROM lib)")(
    lambda s, p: ex.register_new(library(s, p), found(s, p)).select("alpha_id", "fitness", "category"))
check("library_count_new", f"WITH {LIB} SELECT count(*) AS \"new\" FROM customer WHERE 'A' || (c_custkey * 2) NOT IN (SELECT alpha_id FROM lib)")(
    lambda s, p: ex.count_new(library(s, p), found(s, p)))
check("library_top", f"WITH {LIB} SELECT alpha_id, fitness FROM lib ORDER BY fitness DESC, alpha_id LIMIT 15")(lambda s, p: ex.library_top(library(s, p), 15).select("alpha_id", "fitness"))
for _c, _v in (("source", "ECONOMY"), ("category", "Brand#2"), ("round", 13)):
    check(f"library_top_by_{_c}", f"WITH {LIB} SELECT alpha_id, fitness FROM lib WHERE {_c} = {_v!r} ORDER BY fitness DESC, alpha_id LIMIT 15")(
        lambda s, p, c=_c, v=_v: ex.library_top(library(s, p), 15, **{c: v}).select("alpha_id", "fitness"))
check("library_by_time", f"WITH {LIB} SELECT alpha_id FROM lib WHERE created_at BETWEEN '000000100' AND '000000499'")(
    lambda s, p: ex.library_between(library(s, p), "000000100", "000000499").select("alpha_id"))


# -- signal registry ------------------------------------------------------------------------------------------
REG = """reg AS (SELECT s_name AS name, s_acctbal AS sharpe, s_suppkey AS k, list_filter(['bull', 'bear', 'flat'], lambda r: (r = 'bull' AND s_suppkey % 2 = 0) OR (r = 'bear' AND s_suppkey % 3 = 0)
  OR (r = 'flat' AND s_suppkey % 5 = 0)) AS regimes FROM supplier)"""


def registry(s, p):
    x, k = table(s, p, "supplier"), F.col("s_suppkey")
    reg = F.filter(F.array(F.when(k % 2 == 0, F.lit("bull")), F.when(k % 3 == 0, F.lit("bear")), F.when(k % 5 == 0, F.lit("flat"))), lambda r: r.isNotNull())
    return x.select(F.col("s_name").alias("name"), reg.alias("suitable_regimes"), F.create_map(F.lit("test_sharpe"), F.col("s_acctbal")).alias("metrics"),
                    F.concat(F.lit("thr_mean(ATR{"), (k % 10).cast("string"), F.lit("})")).alias("expression"), F.array(F.lit("ATR"), (k % 2).cast("string")).alias("features"))


check("registry_select_best", f"WITH {REG} SELECT name FROM reg WHERE list_contains(regimes, 'bear') ORDER BY sharpe DESC, name LIMIT 5")(
    lambda s, p: ex.select_best(registry(s, p), 5, regime="bear").select("name"))
check("registry_regime_summary", f"WITH {REG}, u AS (SELECT name, sharpe, unnest(regimes) AS regime FROM reg) SELECT regime, count(*) AS signals, max(sharpe) AS best, arg_max(name, row(sharpe, name)) AS best_name FROM u GROUP BY 1")(
    lambda s, p: ex.regime_summary(registry(s, p)))
check("registry_regime_names", f"""WITH {REG}, u AS (SELECT name, unnest(regimes) AS regime FROM reg
  UNION ALL SELECT name, CASE k % 4 WHEN 0 THEN 'bull' WHEN 1 THEN 'storm' WHEN 2 THEN '' END FROM reg)
SELECT regime, array_to_string(list(name ORDER BY name), ',') AS names FROM u WHERE regime <> '' GROUP BY 1""")(
    lambda s, p: ex.regime_names(registry(s, p).join(table(s, p, "supplier").select(F.col("s_name").alias("name"), F.expr(
        "CASE s_suppkey % 4 WHEN 0 THEN 'bull' WHEN 1 THEN 'storm' WHEN 2 THEN '' END").alias("suitable_for")), "name")).withColumn("names", F.array_join("names", ",")))
@check("store_interval_cache", f"""WITH {PANEL_SQL}, e AS (SELECT min(ts) AS lo, max(ts) AS hi FROM t0),
v AS (SELECT symbol, ts, CASE WHEN abs(lag(close, 4) OVER (PARTITION BY symbol ORDER BY ts)) > 1e-10 THEN close / lag(close, 4) OVER (PARTITION BY symbol ORDER BY ts) - 1 END AS value FROM t0)
SELECT symbol, ts, {rsql('value')} AS value, 4 AS computed FROM v, e WHERE ts >= lo AND ts < hi""")
def _(spark, path):
    # a first request, an overlapping one, one around both, and one that is all there
    x = materialize(panel(spark, path), "panel")
    ends = x.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    at = [ends.lo + (ends.hi - ends.lo) * k / 8 for k in range(9)]
    folder, asked = scratch(spark, "cache"), []

    def compute(a, b):
        asked.append((a, b))
        return with_features(x, {"value": ts_roc(col("close"), 4)}, keep=["symbol", "ts"])
    for a, b in ((2, 4), (3, 6), (0, 8), (0, 8)):
        out = cache.cached(spark, folder, "momentum", 4, at[a], at[b], compute)
    return rounded(out).withColumn("computed", F.lit(len(asked)))


check("registry_duplicates", """WITH f AS (SELECT s_name AS name, md5('thr_mean(ATR{' || (s_suppkey % 10) || '})|' || array_to_string(list_sort(['ATR', (s_suppkey % 2)::VARCHAR]), ',')) AS fingerprint FROM supplier)
SELECT fingerprint, count(*) AS n, min(name) AS first_name FROM f GROUP BY 1 HAVING count(*) > 1""")(lambda s, p: ex.duplicates(registry(s, p)))

# -- formula texts --------------------------------------------------------------------------------------------
_LONG = "log(abs(VOLUME - HIGH) + ts_corr(LOW, VOLUME, 9) * ts_sum(AMOUNT / OPEN_INTEREST, 12.5) - ts_delta(LOW, 4) / ts_max(CLOSE, 30))"
FORM = f"""fm AS (SELECT p_partkey AS k, p_retailprice / 2000 AS fitness, CASE WHEN p_partkey % 7 = 3 THEN '{_LONG}' ELSE CASE p_partkey % 5 WHEN 0 THEN 'ts_mean(CLOSE, ' || p_size || ')' WHEN 1 THEN 'log(VOLUME / ts_std(HIGH, ' || p_size || '))'
  WHEN 2 THEN 'ts_rank(CLOSE, 1)' WHEN 3 THEN 'ts_max(3.5, 10) + OPEN' ELSE 'abs(CLOSE - OPEN) * ' || p_size END END AS f FROM part)"""


def formulas(s, p):
    n = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 5
    f = (F.when(k == 0, F.concat(F.lit("ts_mean(CLOSE, "), n, F.lit(")"))).when(k == 1, F.concat(F.lit("log(VOLUME / ts_std(HIGH, "), n, F.lit("))")))
         .when(k == 2, F.lit("ts_rank(CLOSE, 1)")).when(k == 3, F.lit("ts_max(3.5, 10) + OPEN")).otherwise(F.concat(F.lit("abs(CLOSE - OPEN) * "), n)))
    f = F.when(F.col("p_partkey") % 7 == 3, F.lit(_LONG)).otherwise(f)
    return table(s, p, "part").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") / 2000).alias("fitness"), f.alias("f"))


_SK = r"regexp_replace(regexp_replace(f, '\b[A-Z][A-Z_0-9]+\b', 'X', 'g'), '\b\d+(\.\d+)?\b', 'C', 'g')"
check("formula_skeleton", f"WITH {FORM} SELECT k, {_SK} AS skeleton FROM fm")(lambda s, p: formulas(s, p).select("k", ex.skeleton(F.col("f")).alias("skeleton")))
check("formula_filter", f"""WITH {FORM} SELECT k, NOT regexp_matches(f, 'ts_\\w+\\([^,]+, 1\\)') AND regexp_matches(f, '\\b[A-Z][A-Z_0-9]+\\b') AND NOT regexp_matches(f, 'ts_\\w+\\(-?\\d+\\.?\\d*,') AS usable FROM fm""")(
    lambda s, p: formulas(s, p).select("k", ex.usable_formula(F.col("f")).alias("usable")))
_SG = f"""fn AS (SELECT k, x, x IN ('abs', 'exp', 'log', 'sign', 'sqrt') AS math FROM (SELECT DISTINCT k, unnest(regexp_extract_all(f, '([a-z_]+)\\(', 1)) AS x FROM fm)),
fs AS (SELECT k, string_agg(x, '+' ORDER BY x) FILTER (math) AS m, string_agg(x, '+' ORDER BY x) FILTER (NOT math) AS t FROM fn GROUP BY 1),
vo AS (SELECT k, unnest(v) AS v, unnest(range(len(v))) AS i FROM (SELECT k, regexp_extract_all(f, '\\b([A-Z][A-Z_0-9]+)\\b', 1) AS v FROM fm)),
vc AS (SELECT k, v, count(*) AS c, min(i) AS i, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, min(i)) AS r FROM vo GROUP BY 1, 2),
vs AS (SELECT k, string_agg(v || ':' || c, '+' ORDER BY r) AS v FROM vc WHERE r <= 4 GROUP BY 1), sk AS (SELECT k, {_SK} AS s FROM fm),
sg AS (SELECT fm.k, fitness, f, 'm:' || coalesce(m, 'none') || '|t:' || coalesce(t, 'none') || '|v:' || coalesce(v, 'none') || '|s:'
  || CASE WHEN length(s) > 80 THEN s[1:40] || '..' || md5(s)[1:8] ELSE s END AS signature FROM fm JOIN sk USING (k) LEFT JOIN fs USING (k) LEFT JOIN vs USING (k))"""
_MATH = ["abs", "exp", "log", "sign", "sqrt"]
check("formula_signature", f"WITH {FORM}, {_SG} SELECT k, signature FROM sg")(lambda s, p: formulas(s, p).select("k", ex.signature(F.col("f"), _MATH).alias("signature")))
check("formula_best_per_signature", f"""WITH {FORM}, {_SG} SELECT signature, {rsql('max(fitness)')} AS best, count(*) AS n, {rsql('arg_max(fitness, k)')} AS latest, arg_max(f, row(fitness, -k)) AS formula FROM sg GROUP BY 1 HAVING max(fitness) >= 0.3""")(
    lambda s, p: rounded(ex.best_per_signature(formulas(s, p).select(ex.signature(F.col("f"), _MATH).alias("signature"), F.col("k").alias("seq"), "fitness", F.col("f").alias("formula")))))

# -- symbols and text -----------------------------------------------------------------------------------------
SYM = """sy AS (SELECT o_orderkey AS k, lpad((o_orderkey * 7919 % 1000000)::VARCHAR, 6, '0') || (['.SH', '.SZ', '.SI', '.BJ', '.sz ', '.XX'])[o_custkey % 6 + 1] AS symbol FROM orders),
cl AS (SELECT k, symbol, upper(trim(symbol)) AS u FROM sy), kd AS (SELECT k, symbol, CASE WHEN regexp_matches(u, '\\.(SI|SL|SWI|TI|CSI)$') THEN 'index' WHEN u LIKE '%.BJ' THEN 'stock'
  WHEN NOT regexp_matches(u, '^\\d+\\.(SH|SZ)$') THEN NULL WHEN u[1] IN ('5', '1') THEN 'etf' WHEN u LIKE '000%.SH' THEN 'index' WHEN u LIKE '399%' THEN 'index' WHEN u LIKE '6%.SH' THEN 'stock'
  WHEN u[1] IN ('0', '2', '3') AND u LIKE '%.SZ' THEN 'stock' END AS kind FROM cl)"""


def symbols(s, p):
    suffix = F.array(*[F.lit(x) for x in (".SH", ".SZ", ".SI", ".BJ", ".sz ", ".XX")])[(F.col("o_custkey") % 6).cast("int")]
    code = F.lpad((F.col("o_orderkey") * 7919 % 1000000).cast("string"), 6, "0")
    return table(s, p, "orders").select(F.col("o_orderkey").alias("k"), F.concat(code, suffix).alias("symbol"))


def kinds(s, p):
    return symbols(s, p).withColumn("kind", tx.classify_symbol(F.col("symbol")))


check("symbol_classes", f"WITH {SYM} SELECT k, kind FROM kd")(lambda s, p: kinds(s, p).select("k", "kind"))
check("symbol_lot_size", f"WITH {SYM} SELECT k, CAST(CASE WHEN kind IN ('stock', 'etf') THEN 100 WHEN kind = 'index' THEN 1 ELSE 0.1 END AS DOUBLE) AS lot FROM kd")(
    lambda s, p: kinds(s, p).select("k", tx.lot_size(F.col("kind")).alias("lot")))
check("symbol_class_members", f"WITH {SYM} SELECT kind, count(DISTINCT symbol) AS symbols, min(symbol) AS first_symbol FROM kd GROUP BY 1")(
    lambda s, p: kinds(s, p).groupBy("kind").agg(F.count_distinct("symbol").alias("symbols"), F.min("symbol").alias("first_symbol")))
check("text_percent", f"SELECT l_discount, printf('%.2f', l_discount * 100) || '%' AS pct, count(*) AS n FROM lineitem GROUP BY 1, 2")(
    lambda s, p: table(s, p, "lineitem").groupBy("l_discount").agg(F.count(F.lit(1)).alias("n")).select("l_discount", tx.percent(F.col("l_discount")).alias("pct"), "n"))
check("date_period_keys", """SELECT o_orderkey, CAST(isoyear(o_orderdate) * 100 + weekofyear(o_orderdate) AS INTEGER) AS iso_week, strftime(o_orderdate, '%Y-%m') AS month FROM orders""")(
    lambda s, p: table(s, p, "orders").select("o_orderkey", (F.extract(F.lit("YEAROFWEEK"), "o_orderdate") * 100 + F.weekofyear("o_orderdate")).alias("iso_week"),
                                              F.date_format("o_orderdate", "yyyy-MM").alias("month")))
check("json_properties", """SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1""")(
    lambda s, p: table(s, p, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k bigint")["k"]).alias("total"), F.count(F.lit(1)).alias("n")))


# -- storage ----------------------------------------------------------------------------------------------------
@check("store_factor_cache", f"""WITH bars AS ({WEEK_SQL}) SELECT symbol, ts, volume AS value FROM bars WHERE ts >= TIMESTAMP '1999-01-01'""")
def _(spark, path):
    b = week_bars(spark, path)
    long = b.select("symbol", "ts", F.explode(F.array(F.struct(F.lit("vol").alias("factor"), F.lit(1).alias("lookback"), F.col("volume").alias("value")),
                                                      F.struct(F.lit("amt").alias("factor"), F.lit(5).alias("lookback"), F.col("amount").alias("value")))).alias("f")).select("symbol", "ts", "f.*")
    folder = store.scratch(spark, "factors")
    store.save_factors(long, f"{folder}/v")
    return store.load_factors(spark, f"{folder}/v", "vol", 1, start="1999-01-01").select("symbol", "ts", "value")


@check("store_record_log", f"WITH {REC} SELECT template, count(*) AS n, {rsql('max(sharpe)')} AS best FROM rec GROUP BY 1")
def _(spark, path):
    folder = store.scratch(spark, "log")
    names = [f.name for f in store.RECORD_SCHEMA.fields]
    r = records(spark, path)
    store.append_records(r.select(*[c for c in names if c in r.columns]), f"{folder}/log")
    broken = r.select(F.concat(F.lit('{"template": "T'), F.col("seq").cast("string"), F.lit('", "metrics": {')).alias("value"))
    broken.write.mode("append").text(f"{folder}/log")
    back = store.read_records(spark, f"{folder}/log")
    return rounded(back.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("metrics")["sharpe_ratio_d"]).alias("best")))


@check("store_library_folder", f"WITH {LIB} SELECT alpha_id, fitness, source FROM lib")
def _(spark, path):
    folder = store.scratch(spark, "library")
    schema = T.StructType([T.StructField("alpha_id", T.StringType()), T.StructField("fitness", T.DoubleType()), T.StructField("source", T.StringType())])
    lib = library(spark, path).select("alpha_id", "fitness", "source")
    store.save_library(lib, f"{folder}/all")
    return store.load_library_folder(spark, f"{folder}/all", schema)
