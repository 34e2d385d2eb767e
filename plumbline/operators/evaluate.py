"""Field results against labelled truth: outcomes, quality metrics, sweeps over settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.measures import character_error_rate, config_label, cost_usd, round_even
from plumbline.functions.text import canonical_text, normalize_value
from plumbline.operators.scoring import EXTRACTED


def compared(results: DataFrame, truth: DataFrame, keys=("document_id", "field"), fold=canonical_text, value: str = "value") -> DataFrame:
    """A row for each labelled field that has a result, with what hangs on no threshold.

    ``same``: the value's folded normal form is the truth's; ``untold``: the truth has
    none; ``cer``: the character error rate between the normal forms.
    """
    on = [k for k in keys if k in truth.columns]
    j = results.join(truth.select(*on, "expected"), on)
    kind = F.coalesce("kind", F.lit("string"))
    j = j.withColumn("__p", normalize_value(F.col(value), kind)).withColumn("__e", normalize_value(F.col("expected"), kind))
    same = F.coalesce(fold(F.col("__p")) == fold(F.col("__e")), F.lit(False))
    return j.withColumns({"same": same, "untold": F.col("__e").isNull(), "cer": character_error_rate(F.col("__p"), F.col("__e"))}).drop("__p", "__e")


def judged(rows: DataFrame) -> DataFrame:
    """Rows of ``compared`` with a status: an extracted value is correct if it is the truth's, a declined one if the truth has none."""
    answered = F.col("status") == EXTRACTED
    j = rows.withColumns({"answered": answered, "correct": F.when(answered, F.col("same")).otherwise(F.col("untold"))}).drop("same", "untold")
    return j.withColumns({
        "hallucinated": F.col("answered") & ~F.col("correct"),
        "justified": ~F.col("answered") & (F.col("expected").isNull() | ~F.col("correct")),
    })


def outcomes(results: DataFrame, truth: DataFrame, keys=("document_id", "field"), fold=canonical_text) -> DataFrame:
    """A row for each labelled field that has a result.

    ``results``: keys, kind (null: string), value, status; ``truth``: document_id,
    field, expected. An extracted value is correct if its folded normal form is the
    truth's; a declined one if the truth has none.
    """
    return judged(compared(results, truth, keys, fold))


def share(part, whole, empty: float = 0.0):
    """A share of four places; ``empty`` where there is nothing to share."""
    return F.when(whole > 0, round_even(part / whole)).otherwise(float(empty))


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    """The seven report metrics with field accuracy and strict abstention precision, by group.

    ``abstention_precision`` follows the report's rule, by which a wrongly declined
    field counts as justified; ``abstention_precision_strict`` counts only fields
    without truth.
    """
    declined = ~F.col("answered")
    out = (rows.groupBy(*by) if by else rows.groupBy()).agg(
        F.count("*").alias("fields"), F.count_if("answered").alias("answered_"), F.count_if(F.col("answered") & F.col("correct")).alias("right"),
        F.count_if("hallucinated").alias("wrong"), F.count_if("justified").alias("just"), F.count_if(declined & F.col("correct")).alias("strict"),
        F.avg(F.when(F.col("answered"), F.col("cer"))).alias("cer_"),
    )
    n, a = F.col("fields"), F.col("answered_")
    d = n - a
    return out.select(
        *by, "fields", a.alias("answered"), share(a, n).alias("coverage"), share(F.col("right"), a).alias("precision"),
        share(F.col("wrong"), a).alias("hallucination_rate"), share(F.col("just"), d, 1.0).alias("abstention_precision"),
        round_even(F.coalesce("cer_", F.lit(0.0))).alias("mean_cer"), share(F.col("right"), n).alias("field_accuracy"),
        share(F.col("strict"), d, 1.0).alias("abstention_precision_strict"),
    )


def grid(cases: DataFrame, configs: DataFrame) -> DataFrame:
    """Every case under every setting of a small table of settings."""
    return cases.join(F.broadcast(configs.withColumn("label", config_label(F.col("prompt_version"), F.col("passes"), F.col("abstain_below")))))


def reports(metric_rows: DataFrame, runs: DataFrame, hourly_rate: float, tokens_per_second: float, *by: str) -> DataFrame:
    """Metrics beside documents, failures, tokens, cost and cost per thousand documents of each run.

    ``runs``: by, document_id, failed, total_tokens, latency_ms.
    """
    r = runs.groupBy(*by).agg(
        F.count_if(~F.col("failed")).alias("documents"), F.count_if("failed").alias("failures"),
        F.coalesce(F.sum(F.when(~F.col("failed"), F.col("total_tokens"))), F.lit(0)).alias("total_tokens"),
        F.round(F.sum("latency_ms") / 1000.0, 3).alias("wall_seconds"),
    )
    cost = cost_usd(F.col("total_tokens"), hourly_rate, tokens_per_second)
    per_1k = F.when(F.col("documents") > 0, cost / F.col("documents") * 1000).otherwise(0.0)
    return metric_rows.join(r, list(by)).withColumns({"cost_usd": F.round(cost, 6), "cost_per_1k": F.round(per_1k, 6)})


def document_summary(results: DataFrame) -> DataFrame:
    """Abstention rate and mean confidence of each document; fields not present are no abstentions."""
    answered = F.col("status") == EXTRACTED
    return results.groupBy("document_id").agg(
        F.count("*").alias("fields"), (F.count_if(F.col("status") == "abstained") / F.count("*")).alias("abstention_rate"),
        F.coalesce(F.avg(F.when(answered, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"),
    )
