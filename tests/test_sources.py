"""Sources, sinks, settings and streams."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import measures
from plumbline.operators import ops
from plumbline.plans import extraction, queries
from plumbline.sources import catalog, datasets, sinks
from plumbline.streaming import live


def test_cases(spark, tmp_path):
    p = tmp_path / "set.jsonl"
    p.write_text(json.dumps({"document_id": "a", "schema": "invoice", "image_path": "p/1.png", "truth": {"x": "1", "y": None}}) + "\n\n" + json.dumps({"document_id": "b", "schema": "invoice", "image_b64": "aGk="}) + "\n")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.png").write_bytes(b"img")
    cases = datasets.read_cases(spark, str(p))
    assert cases.count() == 2
    assert sorted(map(tuple, datasets.truth_rows(cases).select("field", "expected").collect()), key=str) == [("x", "1"), ("y", None)]
    got = {r.document_id: r.image_b64 for r in datasets.with_images(spark, cases, str(tmp_path)).collect()}
    assert got == {"a": base64.b64encode(b"img").decode(), "b": "aGk="}
    p.write_text("{broken\n")
    with pytest.raises(ValueError, match="not a case"):
        datasets.read_cases(spark, str(p))
    p.write_text("\n \n")
    with pytest.raises(ValueError, match="no cases"):
        datasets.read_cases(spark, str(p))


def test_schemas(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"title": "B", "fields": [{"name": " x ", "type": "date", "required": True, "examples": ["1"]}, {"name": "y", "type": "text"}]}))
    (tmp_path / "a.json").write_text(json.dumps({"name": "alpha", "title": "A", "fields": [{"name": "x", "type": "number"}]}))
    f = catalog.read_schemas(spark, str(tmp_path))
    assert [r.schema_name for r in catalog.names(f).collect()] == ["alpha", "b"]
    assert [(r.name, r.kind, r.required) for r in catalog.schema(f, "b").orderBy("ordinal").collect()] == [("x", "date", True), ("y", "text", False)]
    with pytest.raises(catalog.CatalogError, match="known: alpha, b"):
        catalog.schema(f, "zzz")
    s = json.loads({r.schema_name: r.json_schema for r in catalog.json_schema(f).collect()}["b"])
    assert s["required"] == ["x", "y"] and s["properties"]["x"]["required"] == ["value", "quote", "bbox"]
    for bad, why in (({"fields": [{"name": "x", "type": "quaternion"}]}, "quaternion"), ({"fields": []}, "no fields"), ({"fields": [{"name": "x", "type": "date"}, {"name": "x", "type": "text"}]}, "twice"), ({"fields": [{"name": " ", "type": "date"}]}, "without a name")):
        (tmp_path / "a.json").write_text(json.dumps(bad))
        with pytest.raises(catalog.CatalogError, match=why):
            catalog.read_schemas(spark, str(tmp_path))
    (tmp_path / "a.json").write_text("{")
    with pytest.raises(catalog.CatalogError, match="not valid JSON"):
        catalog.read_schemas(spark, str(tmp_path))
    with pytest.raises(catalog.CatalogError, match="no schema directory"):
        catalog.read_schemas(spark, str(tmp_path / "none"))


def test_answers_images_and_pages(spark, tmp_path):
    p = tmp_path / "answers.json"
    for data in ({"a/x.png": "1", "y": "2"}, [{"image": "x.jpg", "text": "1"}, {"file": "y", "answer": "2"}]):
        p.write_text(json.dumps(data))
        assert sorted(map(tuple, datasets.read_answers(spark, str(p)).collect())) == [("x", "1"), ("y", "2")]
    for n in ("b.PNG", "a.jpeg", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.stem for r in datasets.read_images(spark, str(tmp_path)).collect()] == ["a", "b"]
    df = spark.createDataFrame([("data:image/png;base64,aGk=",), ("aGk=",), ("a*b=",), ("",), ("aGk",), (None,)], "p string")
    assert [r[0] and bytes(r[0]) for r in df.select(datasets.decode_page(F.col("p"))).collect()] == [b"hi", b"hi", None, None, None, None]


def test_settings():
    s = datasets.Settings.from_env({"PLUMBLINE_PASSES": "3", "PLUMBLINE_TEMPERATURES": "[0.1, 0.2]", "PLUMBLINE_MAX_VIEWS": "0"})
    assert (s.passes, s.temperatures, s.max_views) == (3, (0.1, 0.2), 1)
    assert datasets.Settings.from_env({"PLUMBLINE_PASSES": "x"}, lenient=True).passes == 2
    with pytest.raises(ValueError):
        datasets.Settings.from_env({"PLUMBLINE_PASSES": "x"})
    with pytest.raises(ValueError):
        datasets.Settings(abstain_below=2.0)


def test_prompts(spark):
    assert catalog.prompt(spark).first().version == catalog.DEFAULT_PROMPT
    with pytest.raises(KeyError):
        catalog.prompt(spark, "v9")
    t = catalog.prompt(spark, "v2-schema-locked").select(catalog.render(F.col("template"), F.lit("Invoice"), F.lit("- x"), F.lit("")).alias("t")).first().t
    assert "Invoice" in t and "- x" in t and "None." in t and "{" not in t


def test_scripted_model(spark):
    calls = spark.createDataFrame([("d", i) for i in range(3)], "document_id string, pass_idx int")
    scripts = spark.createDataFrame([("d", 0, {"a": "x", "b": None}, {}, {}, None), ("d", 1, None, None, None, "{")], "document_id string, ord int, values map<string,string>, quotes map<string,string>, boxes map<string,array<double>>, malformed string")
    got = datasets.scripted_responses(calls, scripts).orderBy("pass_idx").collect()
    first = json.loads(got[0].text)
    assert first["a"] == {"value": "x", "quote": "x", "bbox": [0.1, 0.1, 0.4, 0.15]} and first["b"]["bbox"] is None
    assert [r.text for r in got[1:]] == ["{", "{"] and got[1].completion_tokens == 1


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([("x/a.png", "T", 0.5)], "image_id string, text string, confidence double")
    assert tuple(sinks.image_outputs(v).first()) == ("a_output.json", '{"text":"T","confidence":0.5}')
    e = spark.createDataFrame([("schema_not_found", "m", None), (None, None, None), ("odd", "m", "d")], "error_code string, error_message string, error_detail string")
    assert [r.status for r in sinks.error_bodies(e).collect()] == [404, 200, 500]
    d = spark.createDataFrame([("d", [1], "v")], "document_id string, pages array<int>, x string")
    sinks.write_extractions(d, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["document_id", "x"]
    line = sinks.field_lines(spark.createDataFrame([("d", "f", "extracted", "v", None, 1.0), ("d", "g", "abstained", None, "why", 0.1)], "document_id string, field string, status string, value string, reason string, confidence double"))
    assert [r.line for r in line.collect()] == ["OK   f = v (1.00)", "HOLD g = why (0.10)"]


def test_report_lines_round_the_exact_value(spark):
    shares = [0.5455, 0.5345, 0.1255, 0.0005, 0.9985, 0.0625, 1.0, 0.0]
    reports = spark.createDataFrame([(f"r{i}", x, x, x, x, x / 10, 1234567, x * 5) for i, x in enumerate(shares)], "label string, coverage double, precision double, hallucination_rate double, abstention_precision double, mean_cer double, total_tokens bigint, cost_per_1k double")
    want = [f"| r{i} | {x:.1%} | {x:.1%} | {x:.1%} | {x:.1%} | {x / 10:.3f} | 1,234,567 | ${x * 5:,.2f} |" for i, x in enumerate(shares)]
    assert sinks.markdown(reports).split("\n")[2:] == want
    t = spark.createDataFrame([(0.625,), (0.615,), (0.62,), (0.5,)], "t double")
    assert [r[0] for r in t.select(measures.config_label(F.lit("v3"), F.lit(2), F.col("t"))).collect()] == ["v3 | 2p | t=0.62", "v3 | 2p | t=0.61", "v3 | 2p | t=0.62", "v3 | 2p | t=0.50"]


def test_read_images_plan(spark):
    img = spark.createDataFrame([("i",), ("j",)], "image_id string")
    replies = spark.createDataFrame([("i", 0, '{"kind": "sign", "lines": ["STOP"]}'), ("i", 1, "```json\n{\"lines\": \"stop\"}\n```"), ("j", 0, "down")], "image_id string, view_ord int, reply string")
    got = {r.image_id: (r.text, r.confidence, r.kind) for r in extraction.read_images(img, replies).collect()}
    assert got == {"i": ("STOP", 0.99, "sign"), "j": ("", 0.0, "other")}


def test_streaming_breaker_matches_batch(spark, tmp_path):
    rows = [("e", float(t), t, t % 7 in (0, 6)) for t in range(40)] + [("e", 100.0, 40, False), ("f", 1.0, 41, True)]
    src = str(tmp_path / "calls")
    spark.createDataFrame(rows, "endpoint string, ts double, call_id bigint, ok boolean").coalesce(1).write.parquet(src)
    batch = {r.call_id: (r.failures, r.is_open, r.half_open) for r in ops.breaker_states(spark.read.parquet(src), 3, 30.0).collect()}
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = live.breaker(stream, 3, 30.0).writeStream.outputMode("append").format("memory").queryName("brk").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.call_id: (r.failures, r.is_open, r.half_open) for r in spark.table("brk").collect()} == batch
    assert any(v[1] for v in batch.values()) and any(v[2] for v in batch.values())


def test_progressive_verdicts(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "image_id string, view_ord int, weight double, kind string, lines array<string>"
    for i, (image, text) in enumerate((("a", "GO"), ("a", "STOP"), ("b", "X"), ("a", "STOP"))):
        spark.createDataFrame([(image, i, 1.0, "sign", [text])], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        live.progressive_verdicts(stream, out, ck).awaitTermination()
    got = {r.image_id: (r.text, r.n_readings) for r in live.latest(spark, out).collect()}
    assert got == {"a": ("STOP", 3), "b": ("X", 1)}


def test_budgets_and_flagship(spark):
    v = spark.createDataFrame([("i", 0.0, 15.0), ("i", 10.0, 15.0), ("i", 23.0, 1.5)], "image_id string, started_s double, latency_s double")
    assert [r.latency_s for r in live.within_budget(v).collect()] == [15.0, 1.5]
    r = spark.createDataFrame([("i", 0, 10.0, False, 0), ("i", 1, 10.0, True, 0), ("i", 2, 20.0, False, 0), ("i", 3, 5.0, False, 1)], "image_id string, view_ord int, ended_s double, ok boolean, attempt int")
    assert [x.view_ord for x in live.retries(r).collect()] == [0]
    assert queries.score_fields(spark, "/root/testdata/sf0.001").count() == 7500
