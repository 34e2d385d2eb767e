"""Command line: ``python -m plumbline.cli version|schemas|extract|evaluate|demo|read-images``."""

from __future__ import annotations

import argparse
import sys

import plumbline


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version", help="the installed version")
    s = sub.add_parser("schemas", help="list the schemas of a directory and the prompts")
    s.add_argument("directory")
    e = sub.add_parser("extract", help="score replies that lie in Parquet or JSON files")
    e.add_argument("--requests", required=True, help="document_id, schema_name, reference_text, transcript")
    e.add_argument("--responses", required=True, help="document_id, pass_idx, text, prompt_tokens, completion_tokens, error")
    e.add_argument("--schemas", required=True)
    e.add_argument("--output", required=True)
    v = sub.add_parser("evaluate", help="sweep thresholds over a labelled set and its replies")
    v.add_argument("--dataset", required=True)
    v.add_argument("--responses", required=True)
    v.add_argument("--schemas", required=True)
    v.add_argument("--thresholds", default="0.50,0.62,0.75")
    v.add_argument("--report", required=True)
    sub.add_parser("demo", help="the worked example")
    i = sub.add_parser("read-images", help="vote over the replies to the views of images")
    i.add_argument("--replies", required=True, help="image_id, view_ord, reply")
    i.add_argument("--output-dir", required=True)
    return p


def _read(spark, path: str):
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "version":
        print(plumbline.__version__)
        return 0
    from pyspark.sql import functions as F

    from plumbline.operators import evaluate, observe, scoring
    from plumbline.plans import extraction, queries
    from plumbline.sources import catalog, datasets, sinks

    spark = _session()
    settings = datasets.Settings.from_env()
    if args.command == "schemas":
        for r in catalog.listing(catalog.read_schemas(spark, args.directory)).collect():
            print(f"{r.schema_name}: {r.n_fields} fields, {r.title}")
        for version, summary, *_ in catalog.PROMPTS:
            print(f"{version}{' (default)' if version == catalog.DEFAULT_PROMPT else ''}: {summary}")
    elif args.command == "demo":
        r = queries.demo_document(spark).withColumn("reason", F.lit("held back"))
        for row in sinks.field_lines(r).collect():
            print(row.line)
    elif args.command == "extract":
        fields = catalog.read_schemas(spark, args.schemas)
        results, used = extraction.extract(_read(spark, args.requests), _read(spark, args.responses), fields, settings)
        per = results.groupBy("document_id").agg(F.collect_list(F.struct("field_ord", "field", "value", "status", "confidence", "agreement", "provenance", "reason")).alias("fields"))
        sinks.write_extractions(used.join(per.withColumn("fields", F.array_sort("fields")), "document_id", "left"), args.output)
    elif args.command == "evaluate":
        fields = catalog.read_schemas(spark, args.schemas)
        cases = datasets.read_cases(spark, args.dataset)
        parsed = observe.parse_passes(_read(spark, args.responses).join(cases.select("document_id", "schema_name"), "document_id"))
        used = observe.usage(parsed)
        obs = observe.observations(parsed, fields).join(used.select("document_id", "total_passes"), "document_id")
        docs = cases.join(used.where("not failed").select("document_id"), "document_id", "left_semi").select("document_id", "schema_name", "reference_text")
        found = scoring.evidence(obs, observe.expected_fields(docs, fields), settings.weights, settings.grounding_min_ratio)
        thresholds = spark.createDataFrame([(catalog.DEFAULT_PROMPT, settings.passes, float(t)) for t in args.thresholds.split(",")], "prompt_version string, passes int, abstain_below double")
        grid = evaluate.grid(used.select("document_id", "failed", "total_tokens", F.lit(0.0).alias("latency_ms")), thresholds)
        metrics = extraction.evaluation_grid(found, datasets.truth_rows(cases), thresholds).join(F.broadcast(grid.select("abstain_below", "label").distinct()), "abstain_below")
        reports = evaluate.reports(metrics, grid, settings.hourly_rate, settings.tokens_per_second, "label")
        sinks.write_reports(reports, args.report)
        print(sinks.markdown(spark.read.json(args.report)))
    else:
        replies = _read(spark, args.replies)
        verdicts = extraction.read_images(replies.select("image_id").distinct(), replies, settings.max_views)
        sinks.write_image_outputs(verdicts, args.output_dir)
    return 0


if __name__ == "__main__":
    sys.exit(main())
