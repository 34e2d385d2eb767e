"""The three entry points as plans: document extraction, evaluation grid, image reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.json_text import extract_json_object, parse_reading
from plumbline.functions.plates import canonical_kind
from plumbline.functions.text import canonical_text
from plumbline.operators import ballot, evaluate, observe, scoring
from plumbline.sources.datasets import Settings


def extract(requests: DataFrame, responses: DataFrame, fields: DataFrame, settings: Settings = Settings(), fold=canonical_text) -> tuple[DataFrame, DataFrame]:
    """``(field results, document usage)`` of requests and the replies of their passes.

    ``requests``: document_id, schema_name, reference_text (may be blank), transcript
    (null, or the text of a transcription call). Documents without a usable pass have
    ``failed`` set and no field results.
    """
    parsed = observe.parse_passes(responses.join(requests.select("document_id", "schema_name"), "document_id"))
    used = observe.usage(parsed)
    obs = observe.observations(parsed, fields).join(used.select("document_id", "total_passes"), "document_id")
    docs = requests.join(used.where("not failed").select("document_id"), "document_id", "left_semi")
    docs = docs.select("document_id", "schema_name", observe.reference_text(F.col("reference_text"), F.col("transcript")).alias("reference_text"))
    expected = observe.expected_fields(docs, fields)
    results = scoring.score_fields(obs, expected, settings.weights, settings.abstain_below, settings.grounding_min_ratio, fold)
    return results, used


def evaluation_grid(evidence: DataFrame, truth: DataFrame, thresholds: DataFrame, fold=canonical_text) -> DataFrame:
    """Metrics for each threshold from one table of evidence.

    The threshold acts on the verdict alone, so votes, grounding and the comparison with
    the truth are done once and the small table of thresholds is joined last.
    """
    facts = evaluate.compared(evidence, truth, fold=fold, value="display")
    swept = scoring.verdicts(facts.join(F.broadcast(thresholds.select("abstain_below"))), F.col("abstain_below"))
    return evaluate.metrics(evaluate.judged(swept), "abstain_below")


def readings_of(replies: DataFrame) -> DataFrame:
    """Readings from the raw replies of views (image_id, view_ord, weight, reply); a reply that can't be read has none."""
    r = replies.withColumn("r", parse_reading(extract_json_object(F.col("reply")))).where("r is not null")
    return r.select("image_id", "view_ord", "weight", canonical_kind(F.col("r.kind")).alias("kind"), F.col("r.lines").alias("lines"))


# The views of an image in order, with their weights.
VIEWS = (("original", 1.5), ("contrast", 1.0), ("denoised", 1.0), ("equalized", 1.0))


def views_of(images: DataFrame, limit: int = 4) -> DataFrame:
    """A row for each of an image's first views, at least one."""
    views = F.array(*(F.struct(F.lit(i).alias("view_ord"), F.lit(n).alias("view"), F.lit(w).alias("weight")) for i, (n, w) in enumerate(VIEWS)))
    return images.withColumn("v", F.explode(F.slice(views, 1, max(1, limit)))).select(*images.columns, "v.*")


def read_images(images: DataFrame, replies: DataFrame, limit: int = 4) -> DataFrame:
    """A verdict for every image, empty where no view could be read."""
    v = ballot.vote(readings_of(replies.join(views_of(images.select("image_id"), limit), ["image_id", "view_ord"])))
    return images.select("image_id").join(v, "image_id", "left").select(
        "image_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("kind", F.lit("other")).alias("kind")
    )
