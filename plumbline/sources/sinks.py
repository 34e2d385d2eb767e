"""Where results go: JSON files, report tables, per-image outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.measures import fixed
from plumbline.functions.text import output_name


def write_extractions(documents: DataFrame, path: str) -> None:
    """One JSON object a document, without its pages."""
    documents.drop("pages").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def append_bench(summary: DataFrame, path: str) -> None:
    summary.write.mode("append").json(path)


def image_outputs(verdicts: DataFrame) -> DataFrame:
    """``name, body``: the output file of each image and its JSON (text, confidence)."""
    return verdicts.select(output_name(F.col("image_id")).alias("name"), F.to_json(F.struct("text", "confidence")).alias("body"))


def write_image_outputs(verdicts: DataFrame, directory: str) -> None:
    """The outputs of all images, as a table partitioned by nothing: Spark's commit makes each job's files appear at once."""
    image_outputs(verdicts).write.mode("overwrite").json(directory)


# The columns of the ablation table, and the status of each error code.
COLUMNS = ("configuration", "coverage", "precision", "hallucination", "abstention precision", "mean CER", "tokens", "$/1k docs")
STATUS = {
    "internal_error": 500, "configuration_error": 500, "schema_not_found": 404, "invalid_document": 422,
    "vlm_timeout": 504, "vlm_protocol_error": 502, "upstream_unavailable": 503,
}


def markdown_rows(reports: DataFrame) -> DataFrame:
    """``(ord, line)`` of the ablation table: header, rule, and a line for each report in order of its label."""
    pct = lambda c: F.concat(fixed(F.col(c) * 100, 1), F.lit("%"))
    line = F.concat(F.lit("| "), F.concat_ws(
        " | ", "label", pct("coverage"), pct("precision"), pct("hallucination_rate"), pct("abstention_precision"),
        fixed(F.col("mean_cer"), 3), F.format_number("total_tokens", 0), F.concat(F.lit("$"), F.format_number("cost_per_1k", 2)),
    ), F.lit(" |"))
    head = ["| " + " | ".join(COLUMNS) + " |", "|---|" + "---:|" * (len(COLUMNS) - 1)]
    top = reports.sparkSession.createDataFrame(list(enumerate(head)), "ord int, line string")
    from pyspark.sql import Window

    body = reports.select((F.row_number().over(Window.orderBy("label")) + 1).alias("ord"), line.alias("line"))
    return top.union(body)


def markdown(reports: DataFrame) -> str:
    """The ablation table; a sweep has a handful of reports."""
    return "\n".join(r.line for r in markdown_rows(reports).orderBy("ord").collect())


def error_bodies(rows: DataFrame) -> DataFrame:
    """Rows beside the error's reply: a struct (code, message, detail), null without error, and a status."""
    has = F.col("error_code").isNotNull()
    return rows.withColumn("error", F.when(has, F.struct(F.col("error_code").alias("code"), F.col("error_message").alias("message"), F.col("error_detail").alias("detail")))).withColumn(
        "status", F.when(~has, 200).otherwise(F.coalesce(F.element_at(_statuses(), F.col("error_code")), F.lit(500)))
    )


def _statuses():
    return F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))


def summary_line(documents: DataFrame) -> DataFrame:
    """A line for each document: fields, abstentions, confidence, tokens, time and cost."""
    return documents.select("document_id", F.format_string(
        "%d fields, %.0f%% abstained, mean confidence %.2f, %s tokens, %.0f ms, $%.5f",
        "fields", F.col("abstention_rate") * 100, "mean_confidence", F.format_number("total_tokens", 0), "latency_ms", "cost_usd",
    ).alias("line"))


def field_lines(results: DataFrame) -> DataFrame:
    """A line for each field: OK with its value, or HOLD with the reason."""
    ok = F.col("status") == "extracted"
    return results.select("document_id", "field", F.concat(
        F.when(ok, "OK   ").otherwise("HOLD "), F.col("field"), F.lit(" = "), F.coalesce("value", "reason", F.lit("")), F.format_string(" (%.2f)", "confidence")
    ).alias("line"))
