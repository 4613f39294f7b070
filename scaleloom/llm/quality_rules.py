"""Quality rules with thresholds learnt per language and source (DataFrame functions only).

Edge cases: a null text counts as empty (no words, base_failed); null lang or source form a group of
their own; repeated rows each get their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, stash

#: Metric: least spread that a threshold allows beyond the upper quartile (and below the lower, where both sides count).
SLACK = {"symbols": 0.02, "dup_lines": 0.35, "repeats": 0.25, "bangs": 0.05, "word_length": 1.5}
TWO_SIDED = ("word_length",)
#: Interquartile ranges beyond the quartile; rows that a group needs for thresholds of its own; relative error of the sketch.
REACH, LEAST_ROWS, GAMMA = 4.0, 200, 1.02
#: Pairs of language and source whose thresholds are broadcast at most; more are joined.
BROADCAST_GROUPS = 200_000

#: A string literal of SQL takes one level of backslashes away.
_WS_SQL = WS.replace("\\", "\\\\")

#: The let-bindings (one-element arrays) keep Spark from evaluating an array again for each of its elements.
_COUNTS = rf"""
transform(array(filter(split(text, '{_WS_SQL}'), x -> x <> '')), w -> named_struct(
  'n_words', cast(size(w) AS bigint),
  'word_chars', cast(length(array_join(w, '')) AS bigint),
  'n_repeat_words', if(size(w) < 4, 0L, transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
    if(size(array_distinct(h)) = size(h), 0L,
      transform(array(sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))), g ->
        aggregate(sort_array(transform(
            filter(sequence(0, size(g) - 1), j -> (j > 0 AND g[j].h = g[greatest(j - 1, 0)].h) OR (j < size(g) - 1 AND g[j].h = g[least(j + 1, size(g) - 1)].h)),
            j -> g[j].i)),
          named_struct('last', -3, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n))[0]))[0])
))[0]"""
_LINES = r"""
transform(array(filter(split(text, '\n', -1), x -> btrim(x, ' \t\n\u000B\u000C\r') <> '')), l -> named_struct(
  'n_lines', size(l), 'n_dup_lines', cast(size(l) - size(array_distinct(l)) AS bigint)))[0]"""


def base_counts(docs: DataFrame) -> DataFrame:
    """One narrow pass: the contract's counts, with what the metrics need beside them.

    Three-word windows are compared by a 64-bit hash within one document.
    """
    d = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select(
        "doc_id", "lang", "source", F.expr(_COUNTS).alias("c"), F.expr(_LINES).alias("l"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
    )
    return d.select("doc_id", "lang", "source", "c.n_words", "c.word_chars", "n_symbols", "l.n_dup_lines", "c.n_repeat_words", "n_bangs", "l.n_lines")


def thresholds(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """lo_<metric> and hi_<metric> per group from a logarithmic quantile sketch.

    The sketch is a count for each bucket of values within GAMMA of each other: it merges by addition
    in any order, so it is combined before the shuffle and a hot group costs no more than others.
    """
    names = list(SLACK)
    x = F.col("m.value")
    bucket = F.when(x > 0, F.ceil(F.round(F.log(x) / F.log(F.lit(GAMMA)), 6)).cast("int")).otherwise(F.lit(-100_000))
    long = metrics.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("metric"), F.col(m).alias("value")) for i, m in enumerate(names)])).alias("m"))
    sketch = long.groupBy(*keys, F.col("m.metric").alias("metric"), bucket.alias("bucket")).count()
    w = Window.partitionBy(*keys, "metric")
    sketch = sketch.withColumns({"below": F.sum("count").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("count").over(w)})
    value = F.when(F.col("bucket") == -100_000, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket").cast("double")))
    at = lambda q: F.min(F.when(F.col("below") >= q * F.col("total"), value))
    q = sketch.groupBy(*keys, "metric").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("total").alias("total"))
    pick = lambda i, c: F.max(F.when(F.col("metric") == i, c))
    out = [F.max("total").alias("total")]
    for i, m in enumerate(names):
        reach = REACH * (F.col("q3") - F.col("q1")) + SLACK[m]
        out.append(pick(i, F.col("q3") + reach).alias(f"hi_{m}"))
        if m in TWO_SIDED:
            out.append(pick(i, F.col("q1") - reach).alias(f"lo_{m}"))
    return q.groupBy(*keys).agg(*out)


def apply_rules(docs: DataFrame) -> DataFrame:
    """Counts, base_failed and kept for every row of ``docs`` (doc_id, text, lang, source).

    Thresholds are learnt on the documents that pass the base rules, per (lang, source) where that
    has LEAST_ROWS of them, else per language, else over all.
    """
    base = base_counts(docs)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = base.withColumns({
        "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit("")), "base_failed": failed,
        "symbols": ratio("n_symbols", "word_chars"), "dup_lines": ratio("n_dup_lines", "n_lines"), "repeats": ratio("n_repeat_words", "n_words"),
        "bangs": ratio("n_bangs", "n_words"), "word_length": ratio("word_chars", "n_words"),
    })
    base = stash(base, "quality")
    sound = base.where("NOT base_failed")
    near = thresholds(sound, ["lang", "source"]).where(F.col("total") >= LEAST_ROWS).drop("total")
    mid = thresholds(sound, ["lang"]).where(F.col("total") >= LEAST_ROWS).drop("total")
    far = thresholds(sound.withColumn("one", F.lit(1)), ["one"]).drop("one", "total")
    limits = far.columns
    over_all = far.first() or dict.fromkeys(limits)  # one row
    as_ = lambda t, p, keys: t.select(*keys, *[F.col(c).alias(p + c) for c in limits])
    groups = base.select("lang", "source").distinct().join(as_(near, "n_", ["lang", "source"]), ["lang", "source"], "left").join(as_(mid, "m_", ["lang"]), "lang", "left")
    groups = stash(groups.select("lang", "source", *[F.coalesce(f"n_{c}", f"m_{c}", F.lit(over_all[c]).cast("double")).alias(c) for c in limits]), "limits")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    ok = ~F.col("base_failed")
    for c in limits:
        side, m = c[:2], c[3:]
        ok = ok & (F.col(m) <= F.col(c) if side == "hi" else F.col(m) >= F.col(c))
    out = base.join(groups, ["lang", "source"], "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(ok, F.lit(False)).alias("kept"))
