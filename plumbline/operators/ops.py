"""Operational aggregates: counters, histograms, latencies, breaker and retry state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.measures import cost_usd

# The upper edges of the latency histograms of requests and of model calls, in seconds.
REQUEST_EDGES = (0.25, 0.5, 1, 2, 4, 8, 16, 32, 64)
CALL_EDGES = (0.1, 0.25, 0.5, 1, 2, 4, 8, 16, 32)


def field_counters(results: DataFrame) -> DataFrame:
    """Fields by schema and outcome: extracted, abstained (ungrounded or low_confidence), and ungrounded once more.

    Fields not present are counted nowhere.
    """
    ungrounded = F.coalesce(~F.col("provenance.grounded"), F.lit(False))
    held = F.col("status") == "abstained"
    names = F.array_compact(F.array(
        F.when(F.col("status") == "extracted", F.struct(F.lit("extracted").alias("counter"), F.lit("").alias("reason"))),
        F.when(held, F.struct(F.lit("abstained").alias("counter"), F.when(ungrounded, "ungrounded").otherwise("low_confidence").alias("reason"))),
        F.when(held & ungrounded, F.struct(F.lit("ungrounded").alias("counter"), F.lit("").alias("reason"))),
    ))
    return results.select("schema_name", F.explode(names).alias("c")).groupBy("schema_name", "c.counter", "c.reason").agg(F.count("*").alias("n"))


def request_counters(requests: DataFrame) -> DataFrame:
    """Requests by schema and outcome: success or the error's code."""
    return requests.groupBy("schema_name", F.coalesce("error_code", F.lit("success")).alias("outcome")).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, value: str, *by: str, edges=REQUEST_EDGES) -> DataFrame:
    """Cumulative counts up to each edge, with the last for all: ``by, le, n``."""
    counts = rows.groupBy(*by).agg(*(F.count_if(F.col(value) <= e).alias(f"e{i}") for i, e in enumerate(edges)), F.count(value).alias("all"))
    pairs = F.array(*(F.struct(F.lit(str(e)).alias("le"), F.col(f"e{i}").alias("n")) for i, e in enumerate(edges)), F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return counts.select(*by, F.explode(pairs).alias("b")).select(*by, "b.le", "b.n")


RANK_BINS = 4096


def nearest_ranks(rows: DataFrame, value: str, fractions: dict[str, float], *by: str) -> DataFrame:
    """Percentiles by nearest rank (half-even, no interpolation), by group.

    A group may be of any size: its values are counted in RANK_BINS bins of equal
    width, the bins that hold the wanted ranks are found from the counts, and only
    the values of those bins are ranked, by counts of distinct values.
    """
    v = rows.where(F.col(value).isNotNull()).select(F.struct(F.lit(0), *by).alias("__g"), F.col(value).alias("__v"))
    span = v.groupBy("__g").agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("*").alias("__n"))
    width = F.nullif(F.col("__hi").cast("double") - F.col("__lo"), F.lit(0.0))
    place = F.floor((F.col("__v").cast("double") - F.col("__lo")) / width * RANK_BINS)
    b = v.join(span, "__g").withColumn("__bin", F.coalesce(F.least(F.lit(RANK_BINS - 1), place), F.lit(0)).cast("int"))
    w = Window.partitionBy("__g").orderBy("__bin")
    bins = b.groupBy("__g", "__bin").agg(F.count("*").alias("__c"), F.max("__n").alias("__n")).withColumn("__upto", F.sum("__c").over(w))
    rank = lambda f: F.least(F.col("__n") - 1, F.rint(f * (F.col("__n") - 1)).cast("long"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(f).alias("rank")) for name, f in fractions.items()))).alias("w")
    picks = bins.select("__g", "__bin", "__c", "__upto", wanted).where("w.rank < __upto and w.rank >= __upto - __c")
    picks = picks.select("__g", "__bin", F.col("w.name").alias("__name"), (F.col("w.rank") - F.col("__upto") + F.col("__c")).alias("__at"))
    values = b.select("__g", "__bin", "__v").join(picks, ["__g", "__bin"]).groupBy("__g", "__name", "__v").agg(F.count("*").alias("__c"), F.max("__at").alias("__at"))
    upto = F.sum("__c").over(Window.partitionBy("__g", "__name").orderBy("__v"))
    found = values.withColumn("__upto", upto).where("__upto > __at").groupBy("__g", "__name").agg(F.min("__v").alias("__v"))
    one = lambda name: F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name)
    return found.groupBy("__g").agg(*map(one, fractions)).select(*(F.col(f"__g.{c}").alias(c) for c in by), *fractions)


def bench_summary(runs: DataFrame, wall_seconds: float, hourly_rate: float) -> DataFrame:
    """One row over timed runs (latency_ms, tokens, ok): latencies of the good ones, rates, errors, cost."""
    good = runs.where("ok")
    ranks = nearest_ranks(good, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    s = runs.agg(F.count("*").alias("requests"), F.count_if("ok").alias("succeeded"), F.avg(F.when(F.col("ok"), F.col("latency_ms"))).alias("mean_ms"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"))
    per = lambda x: x / wall_seconds if wall_seconds > 0 else F.lit(0.0)
    s = s.withColumns({"throughput": per(F.col("succeeded")), "tokens_per_second": per(F.col("total_tokens")), "error_rate": F.when(F.col("requests") > 0, 1 - F.col("succeeded") / F.col("requests")).otherwise(0.0)})
    cost = cost_usd(F.col("total_tokens"), hourly_rate, F.col("tokens_per_second"))
    s = s.withColumn("cost_per_1k", F.when(F.col("succeeded") > 0, cost / F.col("succeeded") * 1000).otherwise(0.0))
    return s.join(F.broadcast(ranks))


def breaker_states(calls: DataFrame, threshold: int, reset_seconds: float) -> DataFrame:
    """Consecutive failures after each call of an endpoint, and whether the breaker is then open.

    ``calls``: endpoint, ts (seconds), call_id, ok. A success starts a new run, so a
    failure's place in its run is the count; open from ``threshold`` failures on, until
    ``reset_seconds`` have gone by without another. ``half_open`` marks a call let
    through after that.
    """
    w = Window.partitionBy("endpoint").orderBy("ts", "call_id")
    c = calls.withColumn("run", F.sum(F.col("ok").cast("int")).over(w))
    in_run = Window.partitionBy("endpoint", "run").orderBy("ts", "call_id")
    c = c.withColumn("failures", F.sum((~F.col("ok")).cast("int")).over(in_run))
    before, last = F.lag("failures").over(w), F.lag("ts").over(w)
    half = F.coalesce((before >= threshold) & (F.col("ts") - last >= reset_seconds), F.lit(False))
    return c.select("endpoint", "ts", "call_id", "ok", "failures", (F.col("failures") >= threshold).alias("is_open"), half.alias("half_open"))


def last_attempts(attempts: DataFrame, most: int = 3) -> DataFrame:
    """What retrying makes of the attempts (call_id, attempt from 0, status) of each call.

    Transport errors (null status) and 5xx are tried again, ``most`` times in all; a
    4xx ends the call at once and is no failure to the breaker.
    """
    final = F.coalesce(F.col("status") < 500, F.lit(False))
    tried = attempts.where(F.col("attempt") < most)
    stop = tried.groupBy("call_id").agg(F.min(F.when(final, F.col("attempt"))).alias("stop"))
    used = tried.join(stop, "call_id").where(F.col("stop").isNull() | (F.col("attempt") <= F.col("stop")))
    return used.groupBy("call_id").agg(
        F.count("*").alias("attempts"), F.max_by("status", "attempt").alias("status"),
        F.count_if(~final).alias("breaker_failures"), F.coalesce(F.max_by("status", "attempt").between(200, 299), F.lit(False)).alias("ok"),
    )


def ready(checks: DataFrame) -> DataFrame:
    """One row: whether every check's text starts with ok."""
    return checks.agg(F.coalesce(F.bool_and(F.startswith("outcome", F.lit("ok"))), F.lit(True)).alias("ready"))
