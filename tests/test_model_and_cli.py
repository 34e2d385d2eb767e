"""The model connector against a local server, and the command line."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

import plumbline
from plumbline import cli
from plumbline.sources import model


@pytest.fixture()
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code, data):
            body = json.dumps(data).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            self._send(200, {"data": [{"id": "m1"}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = asked["messages"][1]["content"][0]["text"]
            seen.append(asked)
            if text == "bad":
                self._send(404, {})
            elif text == "down" or (text == "flaky" and sum(x["messages"][1]["content"][0]["text"] == "flaky" for x in seen) < 2):
                self._send(503, {})
            elif text == "odd":
                self._send(200, {"choices": []})
            else:
                self._send(200, {"choices": [{"message": {"content": "read " + text}}], "usage": {"prompt_tokens": 3}})

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_calls(spark, server):
    url, seen = server
    assert model.first_model(url) == "m1" and model.first_model("http://127.0.0.1:9", budget_s=0) is None
    texts = ['say "hi"\n', "bad", "down", "flaky", "odd"]
    df = spark.createDataFrame([(str(i), 0, t) for i, t in enumerate(texts)], "document_id string, pass_idx int, t string")
    body = model.request_body("m1", F.lit("sys"), F.col("t"), F.array(F.lit("aGk=")), F.lit(0.35), F.lit('{"type":"object"}'))
    got = {r.document_id: r for r in model.call(df.withColumn("body", body), url, in_flight=1, wait=0.01).collect()}
    assert got["0"].text == 'read say "hi"\n' and (got["0"].prompt_tokens, got["0"].completion_tokens, got["0"].model, got["0"].attempts) == (3, 0, "unknown", 1)
    assert (got["1"].attempts, got["1"].text) == (1, None) and "404" in got["1"].error
    assert got["2"].attempts == 3 and got["2"].error.startswith("upstream_unavailable")
    assert got["3"].text == "read flaky" and got["3"].attempts == 2
    assert got["4"].error.startswith("vlm_protocol_error")
    asked = seen[0]
    assert asked["guided_json"] == asked["extra_body"]["guided_json"] == {"type": "object"} and asked["temperature"] == 0.35
    assert asked["messages"][1]["content"][1]["image_url"]["url"] == "data:image/png;base64,aGk="


def test_version_needs_no_session(capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: 1 / 0)
    assert cli.main(["version"]) == 0
    assert capsys.readouterr().out == f"{plumbline.__version__}\n"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    schemas = tmp_path / "schemas"
    schemas.mkdir()
    (schemas / "invoice.json").write_text(json.dumps({"name": "invoice", "title": "Invoice", "fields": [{"name": "total", "type": "currency", "required": True}, {"name": "po", "type": "string"}]}))
    assert cli.main(["schemas", str(schemas)]) == 0
    assert "invoice: 2 fields, Invoice" in capsys.readouterr().out
    reply = json.dumps({"total": {"value": "1,240.00", "quote": None, "bbox": None}, "po": {"value": None}})
    req, out = tmp_path / "req.jsonl", tmp_path / "out"
    req.write_text(json.dumps({"document_id": "d", "schema_name": "invoice", "reference_text": "Total 1,240.00", "transcript": ""}) + "\n")
    rows = [("d", i, reply, 5, 2, None) for i in range(2)]
    spark.createDataFrame(rows, "document_id string, pass_idx int, text string, prompt_tokens bigint, completion_tokens bigint, error string").write.parquet(str(tmp_path / "res"))
    assert cli.main(["extract", "--requests", str(req), "--responses", str(tmp_path / "res"), "--schemas", str(schemas), "--output", str(out)]) == 0
    row = spark.read.json(str(out)).first()
    assert [(f.field, f.status, f.value) for f in row.fields] == [("total", "extracted", "1,240.00"), ("po", "not_present", None)] and row.total_tokens == 14
    data = tmp_path / "set.jsonl"
    data.write_text(json.dumps({"document_id": "d", "schema": "invoice", "reference_text": "Total 1,240.00", "truth": {"total": "1240", "po": None}}) + "\n")
    assert cli.main(["evaluate", "--dataset", str(data), "--responses", str(tmp_path / "res"), "--schemas", str(schemas), "--report", str(tmp_path / "rep")]) == 0
    assert "| v3-region-guided | 2p | t=0.62 | 50.0% | 100.0% | 0.0% | 100.0% | 0.000 | 14 |" in capsys.readouterr().out
    assert cli.main(["demo"]) == 0
    assert "OK   invoice_number = INV-2026-0041 (1.00)" in capsys.readouterr().out
    views = spark.createDataFrame([("a.png", 0, '{"kind":"sign","lines":["STOP"]}')], "image_id string, view_ord int, reply string")
    views.write.parquet(str(tmp_path / "views"))
    assert cli.main(["read-images", "--replies", str(tmp_path / "views"), "--output-dir", str(tmp_path / "img")]) == 0
    assert spark.read.json(str(tmp_path / "img")).first().name == "a_output.json"
