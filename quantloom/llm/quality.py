"""Quality rules: a table of thresholds compiled into one native projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import any_columns

#: Frequent short words of the languages of the corpus, as they stand in text.
STOP_WORDS = (
    "the of and to in is that for on with as by at an be this are was or it from not but have a "
    "der die das und ist nicht ein eine zu mit von den im für auf sich des dem auch in "
    "le la les de des et est un une que pour dans par sur pas qui avec en du il elle au "
    "el los las y es un una que por con para se del al no en su lo más"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= measure / per <= high``; ``per`` None takes the measure itself. A zero divisor passes."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None


#: The production thresholds.
RULES = (
    Rule("length", "n_words", None, 50, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.3),
    Rule("shouts", "n_shouts", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("line_repeats", "n_dup_lines", "n_lines", None, 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.5),
)

_SPACE = "[\\x20\\x09-\\x0D]"


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts", "n_stop_words",
          "n_lines", "n_ellipsis_lines")


def _same(a: str, b: str) -> str:
    """Whether two keys' windows are equal word by word."""
    place = "cast({} & (shiftleft(1L, _bits) - 1) as int)"
    return "(" + " and ".join(f"_words[{place.format(a)} + {d}] = _words[{place.format(b)} + {d}]" for d in range(3)) + ")"


#: Places of windows that have an equal window beside them in key order.
_REPEATED = f"""transform(filter(_keys, (k, j) ->
  (j > 0 and shiftright(k, _bits) = shiftright(_keys[j - 1], _bits) and {_same("k", "_keys[j - 1]")})
  or (j < size(_keys) - 1 and shiftright(k, _bits) = shiftright(_keys[j + 1], _bits) and {_same("k", "_keys[j + 1]")})),
  k -> cast(k & (shiftleft(1L, _bits) - 1) as int))"""
#: Each place covers three words, less what the place before covers already.
_COVERED = """if(size(_places) > 0, aggregate(_places, named_struct('n', 0L, 'last', -3),
  (s, p) -> named_struct('n', s.n + if(p - s.last >= 3, 3L, cast(p - s.last as bigint)), 'last', p), s -> s.n), 0L)"""


def _verdict(r: Rule) -> Column:
    value = F.col(r.measure).cast("double")
    by = F.col(r.per).cast("double") if r.per else F.lit(1.0)
    ok = F.lit(True)
    if r.low is not None:
        ok = ok & (value >= F.lit(float(r.low)) * by)
    if r.high is not None:
        ok = ok & (value <= F.lit(float(r.high)) * by)
    return ok


def measures(text: Column) -> dict[str, Column]:
    """Columns of counts; all are functions of the whole text and use native expressions only."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, f"{_SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda line: F.regexp_like(line, F.lit("[^\\x20\\x09-\\x0D]")))
    stop = sorted({w for s in STOP_WORDS for w in (s, s[0].upper() + s[1:])})
    return {
        "_words": words, "_lines": lines,
        "word_chars": F.char_length(t).cast("long") - F.regexp_count(t, F.lit(_SPACE)),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_shouts": F.regexp_count(t, F.lit("[!?]")).cast("long"),
        "_stop": F.size(F.filter(F.col("_words"), lambda w: w.isin(*stop))).cast("long"),
    }


def repeat_words(words: str) -> tuple[Column, Column]:
    """Words inside 3-word windows found twice or more: (sorted keys, count from the keys).

    A key holds a window's hash in its high bits and its place in the low ones, so one primitive sort brings
    equal windows together; neighbours of equal hash are compared word by word before they count.
    """
    w = F.col(words)
    bits = F.ceil(F.log2(F.greatest(F.size(w), F.lit(2)))).cast("int")
    keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.call_function(
        "shiftleft", F.xxhash64(w[i], w[i + 1], w[i + 2]), bits).bitwiseOR(i.cast("long")))
    return F.when(F.size(w) >= 4, F.sort_array(keys)), bits


@any_columns("text")
def quality_rules(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """All columns of ``df`` with the counts, ``base_failed``, one ``rule_<name>`` per rule, and ``kept``.

    A null text counts as empty: no words, ``base_failed`` true. Columns of ``df`` with the name of an output
    column are replaced, others may have any name; repeated rows are judged each by itself; an empty table gives an
    empty result; a very long text is a row like others, its words and lines in one array each.
    ``kept`` is false where ``base_failed`` or a rule fails. Everything is one projection without a shuffle.
    """
    unknown = {m for r in rules for m in (r.measure, r.per) if m} - set(COUNTS)
    if unknown:
        raise ValueError(f"unknown measures {sorted(unknown)}; known are {sorted(COUNTS)}")
    own = {*COUNTS, "base_failed", "kept", *(f"rule_{r.name}" for r in rules)}
    keep = [F.col(f"`{c}`") for c in df.columns if c not in own]
    m = measures(F.col(f"`{text}`"))
    a = df.select(*keep, *[m[c].alias(c) for c in ("_words", "_lines", "word_chars", "n_symbols", "n_shouts")])
    keys, bits = repeat_words("_words")
    a = a.select("*", F.size("_words").cast("long").alias("n_words"), m["_stop"].alias("n_stop_words"),
                 keys.alias("_keys"), bits.alias("_bits"), F.size("_lines").cast("long").alias("n_lines"),
                 (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                 F.size(F.filter(F.col("_lines"), lambda x: F.regexp_like(x, F.lit("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))))
                 .cast("long").alias("n_ellipsis_lines"))
    a = a.withColumn("_places", F.when(F.size("_keys") > 0, F.sort_array(F.expr(_REPEATED))))
    a = a.withColumn("n_repeat_words", F.coalesce(F.expr(_COVERED), F.lit(0)).cast("long"))
    a = a.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    verdicts = [_verdict(r).alias(f"rule_{r.name}") for r in rules]
    a = a.select(*keep, *COUNTS, "base_failed", *verdicts)
    passed = ~F.col("base_failed")
    for r in rules:
        passed = passed & F.col(f"rule_{r.name}")
    return a.withColumn("kept", passed)



def oracle_sql(rules: Sequence[Rule] = RULES) -> str:
    """The query's result in DuckDB SQL over ``documents``."""
    stop = ", ".join("'" + w + "'" for w in sorted({w for s in STOP_WORDS for w in (s, s[0].upper() + s[1:])}))

    def verdict(r: Rule) -> str:
        value, by = f"CAST({r.measure} AS DOUBLE)", f"CAST({r.per} AS DOUBLE)" if r.per else "1.0"
        tests = [f"{value} {sign} CAST({limit} AS DOUBLE) * {by}"
                 for sign, limit in ((">=", r.low), ("<=", r.high)) if limit is not None]
        return " AND ".join(tests) or "true"

    passed = " AND ".join(["NOT base_failed", *(f"rule_{r.name}" for r in rules)])
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
p AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM p)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
counts AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS word_chars_,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(regexp_extract_all(t, '[!?]')) AS BIGINT) AS n_shouts,
  CAST(len(list_filter(w, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words,
  CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines
  FROM p LEFT JOIN covered USING (rid)),
base AS (SELECT * EXCLUDE (word_chars_), coalesce(word_chars_, 0) AS word_chars,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
ruled AS (SELECT *, {", ".join(f"{verdict(r)} AS rule_{r.name}" for r in rules)} FROM base)
SELECT doc_id, {", ".join(COUNTS)}, base_failed, {", ".join(f"rule_{r.name}" for r in rules)}, {passed} AS kept FROM ruled"""
