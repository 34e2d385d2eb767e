"""One query for each of the engine's operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import boxes, json_text, measures, text
from plumbline.operators import ballot, consensus, evaluate, grounding, images, observe, ops, scoring
from plumbline.plans import extraction, inputs
from plumbline.plans.inputs import table
from plumbline.sources import catalog, datasets, sinks
from plumbline.streaming import live

PLAIN = text.canonical_plain  # the derived fields are ASCII


def norm_number(spark, d):
    li = inputs.priced(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice")
    raw = F.expr("case l_linenumber % 4 when 0 then p_plain when 1 then p_thousands when 2 then p_comma else p_worded end")
    return li.select("l_orderkey", "l_linenumber", text.normalize_value(raw, "currency").alias("normalized"), text.normalize_value(raw, "integer").alias("whole_part"))


def norm_date(spark, d):
    layouts = ["yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/M/d"]
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    raw = F.lit(None).cast("string")
    for i, layout in enumerate(layouts):
        raw = F.when(F.col("o_orderkey") % 9 == i, F.date_format("o_orderdate", layout)).otherwise(raw)
    return o.select("o_orderkey", text.normalize_value(raw, "date").alias("normalized"), text.validate_format(raw, "date").alias("valid"))


def norm_misc(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    raw = F.expr("""case k % 7 when 0 then concat('+91 80 4123 ', lpad(cast(k % 10000 as string), 4, '0')) when 1 then case when k % 2 = 0 then ' Yes ' else 'unchecked' end
      when 2 then concat('v2.', k % 50, '.1') when 3 then concat(' User', k, '@Example.COM ') when 4 then 'N/A' when 5 then cast(k % 90 as string) else concat('a  b\\t', k) end""")
    kind = F.expr("case k % 7 when 0 then 'phone' when 1 then 'boolean' when 2 then 'version' when 3 then 'email' when 4 then 'string' when 5 then 'phone' else 'text' end")
    return c.select("k", text.normalize_value(raw, kind).alias("normalized"), text.validate_format(raw, kind).alias("valid"))


def canonical_docs(spark, d):
    c = table(spark, d, "documents").select("doc_id", text.canonical_text(F.col("text")).alias("c"))
    return c.select("doc_id", F.char_length("c").alias("length"), F.md5("c").alias("digest"))


def consensus_vote(spark, d):
    v = consensus.vote(inputs.observations(spark, d), PLAIN)
    return v.select("document_id", "field", "normalized", "display", "agreement", "votes")


def _evidence(spark, d):
    return scoring.evidence(inputs.observations(spark, d), inputs.expected(spark, d), fold=PLAIN)


def score_fields(spark, d):
    r = scoring.verdicts(_evidence(spark, d))
    return r.select("document_id", "field", "value", "status", "confidence", "agreement", "reason", F.col("provenance.grounded").alias("grounded"))


def demo_document(spark, d=None):
    """The invoice of the worked example: two scripted passes, one of which makes a purchase order up."""
    page = "ACME INSTRUMENTS PVT LTD\nInvoice INV-2026-0041   Date: 14/03/2026\nPhone: +91 80 4123 9900\nGrand Total: Rs. 1,24,500.00"
    said = {"invoice_number": "INV-2026-0041", "invoice_date": "14/03/2026", "supplier_name": "ACME INSTRUMENTS PVT LTD", "supplier_phone": "+91 80 4123 9900", "total_amount": "1,24,500.00", "currency": "INR"}
    scripts = spark.createDataFrame(
        [("demo", 0, said | {"purchase_order": "PO-88213"}, {}, {}, None), ("demo", 1, said | {"purchase_order": None}, {}, {}, None)],
        "document_id string, ord int, values map<string,string>, quotes map<string,string>, boxes map<string,array<double>>, malformed string",
    )
    requests = spark.createDataFrame([("demo", "invoice", page, None, 2)], "document_id string, schema_name string, reference_text string, transcript string, passes int")
    replies = datasets.scripted_responses(observe.passes_of(requests).select("document_id", "pass_idx"), scripts)
    results, _ = extraction.extract(requests, replies, invoice_fields(spark))
    return results.select("document_id", "field", "value", "status", "confidence", "agreement")


INVOICE = [("invoice_number", "string", True), ("invoice_date", "date", True), ("supplier_name", "string", True), ("supplier_phone", "phone", False), ("total_amount", "currency", True), ("currency", "string", False), ("purchase_order", "string", False)]
RULEBOOK = [("game_name", "string", True), ("player_count", "string", True), ("board_size", "string", True), ("victory_condition", "text", True), ("turn_order", "text", False), ("version", "version", False)]


def invoice_fields(spark):
    return _fields(spark).where("schema_name = 'invoice'")


def _fields(spark):
    rows = [(s, s.title(), i, n, k, r, "", []) for s, fs in (("invoice", INVOICE), ("rulebook", RULEBOOK)) for i, (n, k, r) in enumerate(fs)]
    return spark.createDataFrame(rows, catalog.FIELD)


def schema_catalog(spark, d):
    return catalog.listing(_fields(spark))


def schema_names(spark, d):
    more = table(spark, d, "part").select(F.col("p_brand").alias("schema_name"))
    return catalog.names(_fields(spark), more)


def schema_prompts(spark, d):
    f = catalog.describe_fields(_fields(spark)).join(catalog.json_schema(_fields(spark)), "schema_name")
    n = F.size(F.json_object_keys(F.get_json_object("json_schema", "$.properties")))
    return f.select("schema_name", "description", n.alias("n_properties"))


def grounding_exact(spark, d):
    return grounding.contained_in(table(spark, d, "benchmark"), table(spark, d, "documents"), "text", "text", "item_id", "doc_id")


def grounding_fuzzy(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = c.join(F.broadcast(n), "c_nationkey").withColumn("page", F.concat_ws("\n", "c_name", "n_name", "c_mktsegment"))
    c = c.withColumn("value", F.translate("c_mktsegment", "OI", "01"))
    return grounding.ground(c, "value", "page").select("c_custkey", "value", "grounded", "grounding_score", "grounding_quote")


def cer_parts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(measures.character_error_rate(F.col("p_name"), F.col("p_type")), 9).alias("cer"))


def _outcomes(spark, d):
    return evaluate.outcomes(scoring.verdicts(_evidence(spark, d)), inputs.truth(spark, d), fold=PLAIN)


def eval_metrics(spark, d):
    return evaluate.metrics(_outcomes(spark, d), "field")


def eval_grid(spark, d):
    thresholds = spark.createDataFrame([(0.5,), (0.62,), (0.9,)], "abstain_below double")
    return extraction.evaluation_grid(_evidence(spark, d), inputs.truth(spark, d), thresholds, PLAIN)


def eval_reports(spark, d):
    """Reports of three thresholds with cost, as the lines of the ablation table."""
    thresholds = spark.createDataFrame([("v3", 2, 0.5), ("v3", 2, 0.62), ("v3", 2, 0.9)], "prompt_version string, passes int, abstain_below double")
    o = table(spark, d, "orders")
    runs = evaluate.grid(o.select((F.col("o_orderkey") % 17 == 0).alias("failed"), (F.col("o_orderkey") % 1000).alias("total_tokens"), F.lit(2.0).alias("latency_ms")), thresholds)
    m = eval_grid(spark, d).join(F.broadcast(thresholds), "abstain_below").withColumn("label", measures.config_label(F.col("prompt_version"), F.col("passes"), F.col("abstain_below")))
    r = evaluate.reports(m, runs, 1.99, 1400.0, "label")
    return sinks.markdown_rows(r)


def document_summary(spark, d):
    s = evaluate.document_summary(scoring.verdicts(_evidence(spark, d)))
    return s.select("document_id", "fields", F.round("abstention_rate", 6).alias("abstention_rate"), F.round("mean_confidence", 6).alias("mean_confidence"))


def field_counters(spark, d):
    return ops.field_counters(scoring.verdicts(_evidence(spark, d)))


def request_counters(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("schema_name"), F.when(F.col("value") > 20, "vlm_timeout").alias("error_code"))
    return ops.request_counters(e)


def latency_histogram(spark, d):
    return ops.histogram(table(spark, d, "events"), "value", "event_type")


def latency_percentiles(spark, d):
    return ops.nearest_ranks(table(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "event_type")


def bench_summary(spark, d):
    e = table(spark, d, "events").select(F.col("value").alias("latency_ms"), F.when(F.col("event_type") == "error", 0).otherwise(F.col("event_id") % 100).alias("tokens"), (F.col("event_type") != "error").alias("ok"))
    s = ops.bench_summary(e, 10.0, 1.99)
    return s.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes))


def text_vote(spark, d):
    return ballot.vote(inputs.readings(spark, d))


def char_vote(spark, d):
    return ballot.vote(inputs.disputed(spark, d))


def kind_vote(spark, d):
    return ballot.majority_kind(inputs.readings(spark, d))


def prefix_verdicts(spark, d):
    c = table(spark, d, "conversations")
    r = c.select(F.col("conv_id").alias("image_id"), F.col("turn").alias("arrival"), F.col("turn").cast("int").alias("view_ord"), F.lit(1.0).alias("weight"), F.lit("sign").alias("kind"), F.array("text").alias("lines"))
    return ballot.prefix_votes(r)


def box_measures(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("a")).withColumn("b", boxes.box_from_array(F.col("a")))
    fixed = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.1).alias("x1"), F.lit(0.1).alias("y1"))
    px = boxes.to_pixels(F.col("b"), F.lit(1000), F.lit(500))
    has = F.col("b").isNotNull()
    return e.select("vec_id", has.alias("is_box"), F.round(boxes.area(F.col("b")), 9).alias("area"), F.when(has, F.round(boxes.iou(F.col("b"), fixed), 9)).alias("iou"), F.when(has, px.x0).alias("px0"), F.when(has, px.y1).alias("py1"))


def box_union(spark, d):
    e = table(spark, d, "embeddings").select("label", boxes.box_from_array(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))).alias("b"))
    return e.groupBy("label").agg(boxes.union_box(F.col("b")).alias("u")).select("label", *(F.round(F.col(f"u.{c}"), 9).alias(c) for c in ("x0", "y0", "x1", "y1")))


def parse_props(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 10 == 1, F.concat(F.lit("["), F.col("props"), F.lit("]"))).otherwise(F.col("props")).alias("reply"))
    j = json_text.as_json_object(F.col("reply"))
    return e.select("event_id", j.isNotNull().alias("ok"), F.get_json_object(j, "$.k").cast("int").alias("k"))


def parse_replies(spark, d):
    """Readings out of chatter: thoughts, fences, trailing text, broken objects, lists and texts of lines."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    obj = F.expr("""case when k % 3 = 0 then concat('{"kind": "Stop Sign", "lines": ["', c_mktsegment, '", " "]}') when k % 3 = 1 then concat('{"text": "', c_mktsegment, '"}') else concat('{"lines": "', c_mktsegment, '\\\\nB", "kind": "plate"}') end""")
    reply = F.when(F.col("k") % 5 == 0, F.concat(F.lit('<think>{"a": 1}</think> ok '), obj, F.lit(" done"))).when(F.col("k") % 5 == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(F.col("k") % 5 == 2, F.concat(F.lit("{broken "), obj)).when(F.col("k") % 5 == 3, F.lit("no object")).otherwise(obj)
    r = json_text.parse_reading(json_text.extract_json_object(reply))
    return c.select("k", r.kind.alias("kind"), F.array_join(r.lines, "|").alias("lines"))


def envelopes(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.lit('{"error": "busy"}')).otherwise(F.concat(F.lit('{"choices": [{"message": {"content": "'), F.col("event_type"), F.lit('"}}], "usage": {"prompt_tokens": '), F.col("user_id").cast("string"), F.lit("}}"))).alias("body"))
    p = json_text.parse_envelope(F.col("body"))
    return e.select("event_id", p.text.alias("text"), p.prompt_tokens.alias("prompt_tokens"), p.completion_tokens.alias("completion_tokens"), p.model.alias("model"))


def breaker_states(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("endpoint"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("call_id"), (F.col("event_type") != "error").alias("ok"))
    b = ops.breaker_states(e.withColumn("ts", F.col("us") / 1e6), 2, 3600.0)
    return b.select("call_id", "failures", "is_open", "half_open")


def retry_attempts(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") - F.col("event_id") % 4).alias("call_id"), (F.col("event_id") % 4).alias("attempt"), F.expr("case event_type when 'error' then 503 when 'signup' then null when 'click' then 422 else 200 end").alias("status"))
    return ops.last_attempts(e)


def request_checks(spark, d):
    c = table(spark, d, "customer").select(F.expr("case when c_custkey % 9 = 0 then '' else c_name end").alias("document_id"), "c_custkey", F.lit("invoice").alias("schema_name"), F.expr("case when c_custkey % 4 = 0 then array(' ') when c_custkey % 4 = 1 then array() else array('aGk=') end").alias("images_b64"), F.expr("cast(case when c_custkey % 3 = 0 then null else c_custkey % 8 end as int)").alias("passes"))
    return observe.check_requests(c).select("c_custkey", F.array_join("rejected", ",").alias("rejected"))


def pass_usage(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("document_id"), F.col("event_id").cast("int").alias("pass_idx"), F.when(F.col("event_type") == "signup", "not json").otherwise(F.col("props")).alias("text"), (F.col("event_id") % 7).alias("prompt_tokens"), (F.col("event_id") % 3).alias("completion_tokens"), F.when(F.col("event_type") == "error", "vlm_timeout: late").alias("error"))
    return observe.usage(observe.parse_passes(e)).select("document_id", "prompt_tokens", "completion_tokens", "total_tokens", "total_passes", F.size("warnings").alias("n_warnings"), "failed")


def image_sizes(spark, d):
    s = table(spark, d, "part").select("p_partkey", F.struct((F.col("p_partkey") * 37 % 6000 + 1).alias("width"), (F.col("p_partkey") * 91 % 4000 + 1).alias("height")).alias("s"))
    c, f = images.capped(F.col("s")), images.fitted(F.col("s"))
    return s.select("p_partkey", images.within_ceiling(F.col("s"), 9_000_000).alias("within"), c.width.alias("cw"), c.height.alias("ch"), f.width.alias("fw"), f.height.alias("fh"))


def small_measures(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return s.select(
        "k", F.round(measures.cost_usd(F.col("k") * 10, 1.99, 1400.0), 9).alias("cost"), measures.temperature_for(F.col("k")).alias("temperature"),
        measures.backoff_ceiling(F.col("k") % 6).alias("ceiling"), measures.gpu_memory_fraction(F.col("k") % 50 + 1.0, F.lit(48.0)).alias("fraction"),
        measures.config_label(F.lit("v3"), (F.col("k") % 5 + 1).cast("int"), F.lit(0.62)).alias("label"), text.output_name(F.concat(F.lit("/a/img."), F.col("k").cast("string"), F.lit(".png"))).alias("output"),
    )


def self_check(spark, d):
    v = ballot.vote(inputs.readings(spark, d))
    expect = table(spark, d, "customer").select(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("image_id"), F.expr(inputs.plate("c_custkey")).alias("expected"))
    return ballot.points(v, expect).agg(F.sum("points").cast("long").alias("points"), F.count("*").alias("images"))


def stream_day_counts(spark, d):
    """Daily counts of a stream of the events, run to its end; a last empty day closes no window, so the batch form adds the open ones."""
    import uuid

    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    name = f"days_{uuid.uuid4().hex}"
    counts = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def golden_ablation(spark, d=None):
    """The labelled set under scripts made of its truth: coverage, precision and the rest, for one and two passes."""
    rows = [(f"inv-{i:03}", "invoice", {"invoice_number": f"INV-2026-00{40 + i}", "invoice_date": f"{10 + i}/03/2026", "supplier_name": f"SUPPLIER {i} LTD", "supplier_phone": f"+91 80 4123 99{i:02}", "total_amount": f"{i}24,500.00", "currency": "INR", "purchase_order": {2: "PO-77210", 4: "PO-19042"}.get(i)}) for i in range(1, 6)]
    cases = spark.createDataFrame(rows, "document_id string, schema_name string, truth map<string,string>")
    out = None
    for passes in (1, 2):
        req = cases.select("document_id", "schema_name", datasets.golden_transcript(F.col("truth")).alias("reference_text"), F.lit(None).cast("string").alias("transcript"), F.lit(passes).alias("passes"))
        replies = datasets.scripted_responses(observe.passes_of(req).select("document_id", "pass_idx"), datasets.golden_scripts(cases, passes))
        results, _ = extraction.extract(req, replies, invoice_fields(spark))
        m = evaluate.metrics(evaluate.outcomes(results, datasets.truth_rows(cases))).withColumn("passes", F.lit(passes))
        out = m if out is None else out.union(m)
    return out


def readiness(spark, d):
    """Whether all checks are well, and whether those without the errors are."""
    checks = table(spark, d, "events").select(F.when(F.col("event_type") == "error", "down").otherwise(F.concat(F.lit("ok "), F.col("event_type"))).alias("outcome"))
    return ops.ready(checks).withColumn("which", F.lit("all")).union(ops.ready(checks.where("outcome <> 'down'")).withColumn("which", F.lit("up")))


def case_field_types(spark, d):
    cases = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "invoice").otherwise("unknown").alias("schema_name"))
    return catalog.field_types(_fields(spark), cases)


QUERIES = {
    f.__name__: f
    for f in (
        norm_number, norm_date, norm_misc, canonical_docs, consensus_vote, score_fields, demo_document, golden_ablation, schema_catalog, schema_names, schema_prompts,
        grounding_exact, grounding_fuzzy, cer_parts, eval_metrics, eval_grid, eval_reports, document_summary, field_counters, request_counters,
        latency_histogram, latency_percentiles, bench_summary, text_vote, char_vote, kind_vote, prefix_verdicts, box_measures, box_union, parse_props,
        parse_replies, envelopes, breaker_states, retry_attempts, request_checks, pass_usage, image_sizes, small_measures, self_check, stream_day_counts, readiness, case_field_types,
    )
}
