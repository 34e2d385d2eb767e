"""From model replies to observations: parsing, warnings, usage, and what was asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.boxes import box_from_array
from plumbline.functions.json_text import as_json_object
from plumbline.functions.measures import total_tokens
from plumbline.functions.text import error_text, optional_text

FIELD = "struct<value:variant,quote:variant,bbox:array<double>>"


def passes_of(requests: DataFrame, passes: str = "passes") -> DataFrame:
    """A row for each decoding pass of each request."""
    return requests.withColumn("pass_idx", F.explode(F.sequence(F.lit(0), F.greatest(F.col(passes), F.lit(1)) - 1)))


def parse_passes(responses: DataFrame) -> DataFrame:
    """Responses beside ``payload`` (JSON object text or null), ``ok`` and, where not, ``warning``.

    ``responses``: document_id, pass_idx, text, prompt_tokens, completion_tokens, error.
    """
    r = responses.withColumn("payload", F.when(F.col("error").isNull(), as_json_object(F.col("text"))))
    why = F.when(F.col("error").isNotNull(), F.col("error")).otherwise("response was not a JSON object")
    return r.withColumn("ok", F.col("payload").isNotNull()).withColumn(
        "warning", F.when(F.col("payload").isNull(), F.concat(F.lit("pass "), F.col("pass_idx").cast("string"), F.lit(" failed: "), why))
    )


def usage(parsed: DataFrame) -> DataFrame:
    """Per document: tokens of usable passes, how many passes went well, warnings in order, failed if none did."""
    return parsed.groupBy("document_id").agg(
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("prompt_tokens"))), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("completion_tokens"))), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum(F.when(F.col("ok"), total_tokens(F.col("prompt_tokens"), F.col("completion_tokens")))), F.lit(0)).alias("total_tokens"),
        F.count_if("ok").alias("total_passes"),
        F.array_sort(F.collect_list("warning")).alias("warnings"),
        (F.count_if("ok") == 0).alias("failed"),
    )


def observations(parsed: DataFrame, fields: DataFrame) -> DataFrame:
    """``document_id, field, kind, ord, pass_id, raw_value, quote, bbox`` of the declared fields that a pass read.

    Keys that the schema ``fields(schema_name, name, kind)`` lacks go; so do null entries and values.
    """
    v = parsed.where("ok").withColumn("v", F.from_json(F.col("payload"), "map<string,variant>"))
    v = v.select("document_id", "schema_name", "pass_idx", F.explode("v").alias("field", "entry"))
    get = lambda path, kind: F.try_variant_get(F.col("entry"), path, kind)
    raw = F.when(F.schema_of_variant(get("$.value", "variant")) == "BOOLEAN", F.initcap(get("$.value", "string"))).otherwise(get("$.value", "string"))
    v = v.withColumn("raw_value", raw).where("raw_value is not null")
    known = fields.select("schema_name", F.col("name").alias("field"), "kind")
    return v.join(F.broadcast(known), ["schema_name", "field"]).select(
        "document_id", "field", "kind", F.col("pass_idx").alias("ord"), F.concat(F.lit("pass-"), F.col("pass_idx").cast("string")).alias("pass_id"),
        "raw_value", optional_text(get("$.quote", "string")).alias("quote"), box_from_array(get("$.bbox", "array<double>")).alias("bbox"),
    )


def expected_fields(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """A row for each document and field of its schema; the small catalogue goes to the documents."""
    f = fields.select("schema_name", F.col("name").alias("field"), "kind", "required", F.col("ordinal").alias("field_ord"))
    return documents.join(F.broadcast(f), "schema_name")


def reference_text(supplied, transcript):
    """The supplied text if it isn't blank, else the transcript."""
    return F.coalesce(F.when(optional_text(supplied).isNotNull(), supplied), transcript, F.lit(""))


REQUEST_RULES = {
    "document_id": "char_length(document_id) between 1 and 128",
    "schema_name": "char_length(schema_name) between 1 and 64",
    "images_b64": "size(images_b64) between 1 and 50 and not exists(images_b64, x -> x is null or x rlike '(?U)^\\\\s*$')",
    "passes": "passes is null or passes between 1 and 5",
}


def check_requests(requests: DataFrame) -> DataFrame:
    """Requests beside ``rejected``: the names of the rules they break."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in REQUEST_RULES.items())))
    return requests.withColumn("rejected", broken)


def error_rows(responses: DataFrame) -> DataFrame:
    """The text of failed responses from their error's code, class and message."""
    return responses.withColumn("error", F.when(F.col("error_class").isNotNull(), error_text(F.col("error_code"), F.col("error_class"), F.col("error_message"))))
