"""URL filters: prefix rules, and logistic regression on hashed character n-grams.

A rule (action, host, path prefix) fits its host and all subdomains where the path
starts with the rule's; the longest fitting rule decides. Urls that no rule fits
are judged by a logistic model over the distinct character n-grams of host and
path, hashed to ``BUCKETS`` weights; digits count as one character. The model is
trained by full-batch gradient steps: each step is one aggregation of the labelled
table, which gives a gradient of at most ``BUCKETS`` numbers. Scoring is a
projection: no shuffle, no join.

A null url, or one without ``://``, has an empty host and path, which no rule fits
and the model sees as without features. Repeated rows get a row each; empty tables
give empty results (an empty labelled table an untrained model, which allows all).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, let

BUCKETS = 4096
GRAMS = (3, 4, 5)
STEPS = 40
RATE = 4.0
MOMENTUM = 0.8
RIDGE = 1e-4
THRESHOLD = 0.5

# Words that mark hosts of the two classes in the default labelled table.
UNWANTED = (
    "casino poker slots jackpot betting bets lottery bonus win prize pills pharma viagra loans payday cheap replica "
    "free porn xxx adult escort dating ads adserver banner popup clicks track tracker tracking pixel affiliate spam "
    "warez torrent crack keygen malware phish"
).split()
WANTED = (
    "news blog wiki school library science museum garden recipes travel university docs forum weather history music "
    "books research city sport art nature health kitchen letters village theatre river mountain bridge "
    "reading cooking gardening painting learning planning housing singing"
).split()
SYLLABLES = "th er on an re he in ed nd ha en st ti es or te of it at ou".split()
LANGS = "en de fr es".split()
TLDS = "com org net".split()
SUBS = ("", "www.", "m.", "blog.")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table ``(url, label)``, label 1 for unwanted: a few hundred rows made by rule."""
    rows = []

    def add(name: str, i: int, label: int):
        path = (f"/{LANGS[i % 4]}/{(i * 7919) % 10000}", ".html" if i % 5 == 0 else "/" if i % 5 == 1 else "")
        rows.append((f"{'https' if i % 2 else 'http'}://{SUBS[i % 4]}{name}.example.{TLDS[i % 3]}{''.join(path)}", label))

    for i, word in enumerate(UNWANTED):
        other = UNWANTED[(i * 7 + 3) % len(UNWANTED)]
        for j, name in enumerate((f"{word}-{other}", f"{other}-{word}", word, f"{word}{i}", f"best-{word}")):
            add(name, i * 5 + j, 1)
    for i, word in enumerate(WANTED):
        other = WANTED[(i * 7 + 3) % len(WANTED)]
        for j, name in enumerate((f"{word}-{other}", word, f"{word}{i}")):
            add(name, i * 3 + j, 0)
    n = len(SYLLABLES)
    for i in range(240):
        add(SYLLABLES[i % n] + SYLLABLES[(i * 3 + 1) % n] + (SYLLABLES[(i // n * 7 + i) % n] if i % 3 else ""), i, 0)
    return spark.createDataFrame(rows, "url string, label int").coalesce(1)


def host_of(url: Column) -> Column:
    return _part(url, r"^[^/?#]*", 0, lower=True)


def path_of(url: Column) -> Column:
    return _part(url, r"^[^/?#]*([^?#]*)", 1)


def _part(url: Column, pattern: str, group: int, lower: bool = False) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    out = F.regexp_extract(rest, pattern, group)
    if lower:
        out = F.translate(out, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(out, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """``(rule, action)`` of the longest fitting rule ``(action, host, path prefix)``; null where none fits."""
    text = action = None
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (text, action) if rules else (none, none)


def _grams(text: Column, mark: str) -> Column:
    """Hash buckets of the n-grams of a text, in linear time."""
    chars = F.filter(F.split(F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$")), ""), lambda c: c != "")

    def run(c):
        gram, out = c, F.array().cast("array<string>")
        for n in range(2, max(GRAMS) + 1):
            shifted = F.slice(c, F.lit(n), F.greatest(F.size(c) - (n - 1), F.lit(0)))
            gram = F.filter(F.zip_with(gram, shifted, lambda a, b: F.concat(a, b)), lambda g: g.isNotNull())
            if n in GRAMS:
                out = F.concat(out, gram)
        return F.transform(out, lambda g: F.pmod(F.xxhash64(F.lit(mark), g), F.lit(BUCKETS)).cast("int"))

    return F.when(text == "", F.array().cast("array<int>")).otherwise(let(chars, run))


def features(host: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(_grams(host, "h"), _grams(path, "p")))


def _margin(buckets: Column, weights: list[float], bias: float) -> Column:
    table = F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return F.lit(bias) + F.when(F.size(buckets) > 0, total / F.sqrt(F.size(buckets))).otherwise(F.lit(0.0))


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """``(weights, bias)`` from ``labelled(url, label)``."""
    scratch = Scratch(labelled.sparkSession, "url-model")
    rows = labelled.select(F.col("label").cast("double").alias("y"), features(host_of(F.col("url")), path_of(F.col("url"))).alias("b"))
    rows = scratch.keep(rows.where("y is not null"), "features")
    n, positive = rows.agg(F.count("*"), F.sum("y")).first()
    weights, bias = [0.0] * BUCKETS, 0.0
    if not n or not 0 < positive < n:
        return weights, -1.0
    speed, speed_b = [0.0] * BUCKETS, 0.0
    for _ in range(STEPS):
        err = F.lit(1.0) / (F.lit(1.0) + F.exp(-_margin(F.col("b"), weights, bias))) - F.col("y")
        # balanced classes: each weighs a half
        err = err * F.when(F.col("y") > 0, 0.5 / positive).otherwise(0.5 / (n - positive))
        step = rows.select("b", err.alias("e")).select(F.explode_outer(F.concat(F.col("b"), F.array(F.lit(-1)))).alias("j"), F.when(F.size("b") > 0, F.sqrt(F.size("b"))).otherwise(F.lit(1.0)).alias("s"), "e")
        grad = step.groupBy("j").agg(F.sum(F.when(F.col("j") < 0, F.col("e")).otherwise(F.col("e") / F.col("s"))).alias("g")).collect()
        grad = {r.j: r.g for r in grad}  # at most BUCKETS + 1 numbers
        speed_b = MOMENTUM * speed_b - RATE * grad.get(-1, 0.0)
        bias += speed_b
        for j in range(BUCKETS):
            speed[j] = MOMENTUM * speed[j] - RATE * 8 * (grad.get(j, 0.0) + RIDGE * weights[j])
            weights[j] += speed[j]
    return [round(w, 6) for w in weights], round(bias, 6) if math.isfinite(bias) else 0.0


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame, url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """Every row's columns beside ``host, path, rule, verdict, score``; ``score`` is the model's for label 1."""
    weights, bias = train(labelled)
    out = pages.select("*", host_of(F.col(url_col)).alias("__host"), path_of(F.col(url_col)).alias("__path"))
    rule, action = rule_of(F.col("__host"), F.col("__path"), rules)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-_margin(features(F.col("__host"), F.col("__path")), weights, bias)))
    out = out.select(F.struct(*(c for c in pages.columns)).alias("row"), F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), action.alias("__action"), F.round(score, 6).alias("score"))
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.select("row", "host", "path", "rule", F.coalesce("__action", by_model).alias("verdict"), "score")
