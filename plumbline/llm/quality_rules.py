"""Quality rules: plain text statistics, and robust multivariate outliers among them.

Base rules: a text fails with under ``MIN_WORDS`` words, or with over 30 % of its
words in 8-word windows that occur twice or more in it.

Outliers: each text that passes gets a vector of transformed statistics (see
``VECTOR``), held as fixed-point numbers. For each language and source the minimum
covariance determinant estimate of their centre and scatter is found: from the
medians and interquartile ranges, concentration steps take the ``H`` share of rows
nearest by Mahalanobis distance and estimate anew; a group's estimate is replaced as
long as the determinant of its scatter falls by over ``FALL`` of itself, and steps end
when no group's does. There is this one start, so the minimum is a local one. A text whose distance from its
group's estimate exceeds the chi-square bound ``CUTOFF`` is rejected. Each scatter
has ``FLOOR``, the spread of a statistic that is never an error, added to its
diagonal; so a statistic that is constant in a group still has a scale.

A group of under ``MIN_GROUP`` texts is judged by the estimate for all texts of its
language; a language of as few by that for all texts; where there are fewer in all, by
the base rules alone. All sums are of integers and the nearest rows are cut on a fixed
grid of distances (a bin is taken whole), so reruns and ties agree whatever the order
of rows; no task holds a group.

Nulls: a null text has no words; a null language or source is a value of its own.
Texts of any length are taken whole; columns beside those named are not read, whatever
their names. Repeated rows get a row each, an empty table an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS, WORD, Scratch, is_empty, let, settle

MIN_WORDS = 20
REPEAT_WINDOW = 8
MIN_GROUP = 60
H = 0.75
FALL = 1e-2
#: Name of each transformed statistic and the spread (in its own unit) that is never an error.
VECTOR = {
    "word_length": 0.15,  # log of the mean word length
    "symbols": 0.30,  # log(1 + 10 * symbols per word)
    "repeats": 0.10,  # root of the share of words in repeated windows
    "variety": 0.15,  # distinct words over the count expected of a text of that length
    "capitals": 0.10,  # root of the share of capital letters
}
SCALE = 1024
SPAN = 8 * SCALE
_P = len(VECTOR)
_D_BINS = 16


def chi2_cdf(x: float, k: int) -> float:
    """P(chi-square with ``k`` degrees <= x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


CUTOFF = chi2_quantile(1 - 1e-6, _P)


def statistics(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The carried columns, the base statistics, ``base_failed`` and the fixed-point vector ``z``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(*carry, text.alias("__text"))
    df = settle(df, words=F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("__text", "\n"), lambda s: s.rlike(WORD))
    df = df.select(
        *carry, "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
    )
    distinct = F.size(F.array_distinct("words")).cast("long")
    df = settle(df.select("*", distinct.alias("n_distinct"), F.transform("words", lambda w: F.xxhash64(w)).alias("h")).drop("words"), windows=_windows(F.col("h")))
    df = df.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows"))).otherwise(F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = df.drop("h", "windows").withColumn("base_failed", failed)
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    z = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(10 * F.col("n_symbols") / n),
        F.sqrt(F.col("n_repeat_words") / n),
        F.log(F.greatest(F.col("n_distinct"), F.lit(1)) / F.pow(n, F.lit(0.97))),
        F.sqrt(F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))),
    ]
    fixed = [F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.round(x * SCALE))).cast("int") for x in z]
    return df.withColumn("z", F.array(*fixed)).drop("n_distinct", "n_capitals")


def _paired(a: Column, k: int) -> Column:
    """A hash of each element with the one ``k`` further on; ``a`` is evaluated once."""
    return let(a, lambda o: F.zip_with(o, F.slice(o, F.lit(k + 1), F.greatest(F.size(o) - k, F.lit(0))), lambda x, y: F.xxhash64(x, y)))


def _windows(h: Column) -> Column:
    """A hash of each run of ``REPEAT_WINDOW`` (a power of two) hashes."""
    out, width = h, 1
    while width < REPEAT_WINDOW:
        out = _paired(out, width)
        width *= 2
    return F.slice(out, F.lit(1), F.greatest(F.size(h) - (REPEAT_WINDOW - 1), F.lit(0)))


def _covered(windows: Column) -> Column:
    """Words covered by the windows that occur twice or more."""
    k = REPEAT_WINDOW
    ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def again(s):
        same = lambda a, j: F.coalesce(F.get(s, j).x == a.x, F.lit(False))
        return F.transform(F.filter(s, lambda a, j: same(a, j - 1) | same(a, j + 1)), lambda a: a.i)

    at = F.sort_array(let(ordered, again))
    start = F.struct(F.lit(0).alias("total"), F.lit(-k).alias("last"))
    return F.aggregate(at, start, lambda acc, i: F.struct((acc.total + F.least(F.lit(k), i - acc["last"])).alias("total"), i.alias("last"))).total


def _cholesky(group: DataFrame) -> DataFrame:
    """Adds the factor l_i_j of the scatter s_i_j, row by row, as columns."""
    for i in range(_P):
        for j in range(i + 1):
            rest = F.col(f"s_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            group = group.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return group


def _distance(rows: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance of ``z`` by the columns m_i and l_i_j."""
    for i in range(_P):
        x = F.col("z")[i] / float(SCALE) - F.col(f"m_{i}")
        rows = rows.withColumn(f"y_{i}", (x - sum((F.col(f"l_{i}_{k}") * F.col(f"y_{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l_{i}_{i}"))
    rows = rows.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(_P)), F.lit(0.0)))
    return rows.drop(*(f"y_{i}" for i in range(_P)))


_KEY = ["level", "lang", "source"]


def _on(a: str, b: str) -> Column:
    return F.expr(" and ".join(f"{a}.{k} <=> {b}.{k}" for k in _KEY))


def _with(rows: DataFrame, group: DataFrame) -> DataFrame:
    """Rows with their group's columns; the table of groups is sent whole only when it is small."""
    few = F.broadcast(group) if group.count() <= BROADCAST_ROWS else group
    return rows.alias("r").join(few.alias("g"), _on("r", "g")).select("r.*", *(F.col(f"g.{c}") for c in group.columns if c not in _KEY))


def _finish(group: DataFrame, factor: float) -> DataFrame:
    """Centre and factored scatter from the columns n, t_i and t_i_j (fixed-point sums)."""
    n = F.col("k").cast("double")
    for i in range(_P):
        group = group.withColumn(f"m_{i}", F.col(f"t_{i}") / n / SCALE)
    floors = list(VECTOR.values())
    for i in range(_P):
        for j in range(i + 1):
            s = (F.col(f"t_{i}_{j}") / n / SCALE / SCALE - F.col(f"m_{i}") * F.col(f"m_{j}")) * factor
            group = group.withColumn(f"s_{i}_{j}", s + floors[i] ** 2 if i == j else s)
    group = _cholesky(group)
    det = sum((2 * F.log(f"l_{i}_{i}") for i in range(_P)), F.lit(0.0)).alias("det")
    return group.select(*_KEY, "n", *(f"m_{i}" for i in range(_P)), *(f"l_{i}_{j}" for i in range(_P) for j in range(i + 1)), det)


def estimates(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """The estimate of each (lang, source), level 0, of each lang, level 1, and of all, level 2, of MIN_GROUP rows or more.

    ``vectors`` has lang, source and z.
    """
    none = F.lit(None).cast("string")
    level = lambda k, lang, source: F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"))
    levels = F.array(level(0, F.col("lang"), F.col("source")), level(1, F.col("lang"), none), level(2, none, none))
    rows = vectors.select("z", F.explode(levels).alias("x")).select("x.*", "z")
    # medians and quartiles of each statistic from exact counts of its fixed-point values
    bins = rows.select(*_KEY, F.posexplode("z").alias("i", "v")).groupBy(*_KEY, "i", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*_KEY, "i").orderBy("v")
    bins = bins.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("v")))
    quart = bins.groupBy(*_KEY, "i").agg(F.max("n").alias("n"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    first = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    group = quart.where(F.col("n") >= MIN_GROUP).groupBy(*_KEY).agg(
        F.max("n").alias("n"),
        *(first("q2", i).alias(f"q2_{i}") for i in range(_P)),
        *((first("q3", i) - first("q1", i)).alias(f"r_{i}") for i in range(_P)),
    )
    floors = list(VECTOR.values())
    for i in range(_P):
        group = group.withColumn(f"m_{i}", F.col(f"q2_{i}") / float(SCALE))
        for j in range(i + 1):
            spread = F.pow(F.col(f"r_{i}") / SCALE / 1.349, F.lit(2.0)) + floors[i] ** 2 if i == j else F.lit(0.0)
            group = group.withColumn(f"s_{i}_{j}", spread)
    group = _cholesky(group).select(*_KEY, "n", *(f"m_{i}" for i in range(_P)), *(f"l_{i}_{j}" for i in range(_P) for j in range(i + 1)))
    group = scratch.keep(group, "start")
    factor = H / chi2_cdf(chi2_quantile(H, _P), _P + 2)
    best = None
    while True:
        near = _distance(_with(rows, group)).select(*_KEY, "z", "n", F.floor(F.log2(F.col("d2") + 1e-9) * _D_BINS).cast("int").alias("bin"))
        counts = near.groupBy(*_KEY, "bin").agg(F.count("*").alias("c"), F.max("n").alias("n"))
        upto = F.sum("c").over(Window.partitionBy(*_KEY).orderBy("bin"))
        cut = counts.withColumn("upto", upto).where(F.col("upto") >= F.ceil(H * F.col("n"))).groupBy(*_KEY).agg(F.min("bin").alias("cut"))
        cut = scratch.keep(cut, "cut")
        chosen = _with(near, cut).where("bin <= cut")
        zi = lambda i: F.col("z")[i].cast("long")
        step = chosen.groupBy(*_KEY).agg(
            F.max("n").alias("n"), F.count("*").alias("k"),
            *(F.sum(zi(i)).alias(f"t_{i}") for i in range(_P)),
            *(F.sum(zi(i) * zi(j)).alias(f"t_{i}_{j}") for i in range(_P) for j in range(i + 1)),
        )
        step = _finish(step, factor)
        if best is None:
            best = scratch.keep(step, "estimate")
        else:
            falls = F.coalesce(F.col("s.det") < F.col("b.det") + math.log1p(-FALL), F.lit(False))
            both = best.alias("b").join(step.alias("s"), _on("b", "s"), "left")
            names = [c for c in step.columns if c not in _KEY]
            both = both.select(*(f"b.{c}" for c in _KEY), *(F.when(falls, F.col(f"s.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in names), falls.alias("falls"))
            both = scratch.keep(both, "estimate")
            if is_empty(both.where("falls")):
                return both.drop("falls", "det")
            best = both.drop("falls")
        group = best.drop("det")


def judge(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The base statistics of every row with ``distance2`` (null: not judged) and ``kept``."""
    scratch = Scratch(docs.sparkSession, "outliers")
    named = docs.select(*carry, F.col(lang_col).cast("string").alias("__lang"), F.col(source_col).cast("string").alias("__source"), text_col)
    rows = scratch.keep(statistics(named, text_col, (*carry, "__lang", "__source")), "statistics")
    rows = rows.withColumnRenamed("__lang", "lang").withColumnRenamed("__source", "source")
    group = estimates(rows.where(~F.col("base_failed")).select("lang", "source", "z"), scratch)
    own = group.where("level = 0").drop("level", "n")
    wide = group.where("level = 1").drop("level", "n", "source")
    whole = group.where("level = 2").drop("level", "n", "source", "lang")
    send = (lambda g: F.broadcast(g)) if group.count() <= BROADCAST_ROWS else (lambda g: g)
    params = [f"m_{i}" for i in range(_P)] + [f"l_{i}_{j}" for i in range(_P) for j in range(i + 1)]
    out = rows.alias("r").join(send(own).alias("o"), F.expr("r.lang <=> o.lang and r.source <=> o.source"), "left")
    out = out.join(send(wide).alias("w"), F.expr("r.lang <=> w.lang"), "left")
    out = out.join(F.broadcast(whole).alias("a"), F.lit(True), "left")  # one row at most
    out = out.select("r.*", *(F.coalesce(F.col(f"o.{c}"), F.col(f"w.{c}"), F.col(f"a.{c}")).alias(c) for c in params))
    out = _distance(out).drop(*params)
    far = F.coalesce(F.col("d2") > CUTOFF, F.lit(False))
    return out.select(*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(~F.col("base_failed"), F.col("d2")).alias("distance2"), (~F.col("base_failed") & ~far).alias("kept"))
