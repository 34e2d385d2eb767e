"""Field results: vote, grounding and format weighed into a status with its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.boxes import BOX
from plumbline.functions.measures import confidence_weights, round_even
from plumbline.functions.text import canonical_text, validate_format
from plumbline.operators.consensus import vote
from plumbline.operators.grounding import MIN_RATIO, ground

EXTRACTED, ABSTAINED, NOT_PRESENT = "extracted", "abstained", "not_present"
WEIGHTS = (0.5, 0.35, 0.15)
ABSTAIN_BELOW = 0.62


def reasons(grounded, score, agreement, format_ok):
    """Why a value was held back, the causes in order, joined by "; "."""
    two = lambda x: F.format_string("%.2f", x)
    causes = F.array_compact(F.array(
        F.when(~grounded, F.concat(F.lit("value not located in page text (score "), two(score), F.lit(")"))),
        F.when(agreement < 1.0, F.concat(F.lit("decoding passes disagreed (agreement "), two(agreement), F.lit(")"))),
        F.when(~format_ok, F.lit("value failed format validation")),
    ))
    return F.when(F.size(causes) == 0, "confidence below threshold").otherwise(F.array_join(causes, "; "))


def evidence(observations: DataFrame, expected: DataFrame, weights=WEIGHTS, min_ratio: float = MIN_RATIO, fold=canonical_text) -> DataFrame:
    """Everything about a field but the verdict, which hangs on the threshold alone.

    ``expected``: a row for each (document_id, field) that its schema declares, with
    kind, required and reference_text. A field that nothing was read of stays.
    """
    w = confidence_weights(*weights)
    votes = vote(observations, fold)
    e = expected.join(votes, ["document_id", "field"], "left")
    e = e.withColumn("__value", F.coalesce(F.nullif("display", F.lit("")), "normalized"))
    e = ground(e, "__value", "reference_text", min_ratio, fold=fold).drop("__value")
    e = e.withColumn("format_ok", validate_format(F.col("display"), F.col("kind")))
    c = w[0] * F.col("agreement") + w[1] * F.col("grounding_score") + w[2] * F.col("format_ok").cast("double")
    c = F.when(F.col("grounded"), c).otherwise(c * F.col("grounding_score"))
    return e.withColumn("confidence", F.coalesce(round_even(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))), F.lit(0.0)))


def verdicts(evidence: DataFrame, abstain_below=ABSTAIN_BELOW) -> DataFrame:
    """Field results: status, value, confidence, agreement, provenance and reason.

    ``abstain_below`` may be a column, so that one table of evidence serves a sweep.
    """
    read = F.col("normalized").isNotNull()
    has_text = F.coalesce(F.col("reference_text").rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))
    limit = F.lit(float(abstain_below)) if isinstance(abstain_below, (int, float)) else abstain_below
    held = (has_text & ~F.col("grounded")) | (F.col("confidence") < limit)
    missing = F.when(F.col("required"), ABSTAINED).otherwise(NOT_PRESENT)
    status = F.when(~read, missing).when(held, ABSTAINED).otherwise(EXTRACTED)
    why = F.when(~read & F.col("required"), "required field not read by any decoding pass").when(~read, "field absent from document")
    why = why.when(held, reasons(F.col("grounded"), F.col("grounding_score"), F.col("agreement"), F.col("format_ok")))
    provenance = F.when(read, F.struct(
        F.lit(1).alias("page"), F.col("bbox").cast(BOX).alias("bbox"), F.coalesce("grounding_quote", "quote").alias("quote"),
        F.col("grounded").alias("grounded"), F.col("grounding_score").alias("grounding_score"),
    ))
    out = evidence.withColumns({"status": status, "reason": why, "provenance": provenance, "value": F.when(status == EXTRACTED, F.col("display"))})
    out = out.withColumns({"confidence": F.when(read, F.col("confidence")).otherwise(0.0), "agreement": F.coalesce("agreement", F.lit(0.0))})
    return out.drop("normalized", "display", "quote", "votes", "bbox", "grounded", "grounding_score", "grounding_quote", "format_ok", "reference_text")


def score_fields(observations: DataFrame, expected: DataFrame, weights=WEIGHTS, abstain_below: float = ABSTAIN_BELOW, min_ratio: float = MIN_RATIO, fold=canonical_text) -> DataFrame:
    return verdicts(evidence(observations, expected, weights, min_ratio, fold), abstain_below)


def is_consistent(status, value):
    """A field that is not extracted carries no value."""
    return (status == EXTRACTED) | value.isNull()
