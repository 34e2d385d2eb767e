"""A model server as a source of reply rows: request bodies, calls from the executors, readiness.

Off unless an address is given. Each partition calls one request at a time, so the
number of partitions bounds the calls in flight.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLY = "document_id string, pass_idx int, text string, prompt_tokens bigint, completion_tokens bigint, model string, latency_ms double, error string, attempts int"


def request_body(model: str, system: Column, user: Column, images_b64: Column, temperature: Column, schema: Column | None = None, max_tokens: int = 2048) -> Column:
    """The JSON body of a chat completion with images; a schema is given both at the top and in ``extra_body``."""
    picture = lambda b: F.concat(F.lit('{"type":"image_url","image_url":{"url":"data:image/png;base64,'), b, F.lit('"}}'))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    parts = F.array_join(F.concat(F.array(F.concat(F.lit('{"type":"text","text":'), quoted(user), F.lit("}"))), F.transform(images_b64, picture)), ",")
    body = F.concat(
        F.lit(f'{{"model":{json.dumps(model)},"max_tokens":{max_tokens},"temperature":'), temperature.cast("string"),
        F.lit(',"messages":[{"role":"system","content":'), quoted(system), F.lit('},{"role":"user","content":['), parts, F.lit("]}]"),
    )
    if schema is not None:
        body = F.concat(body, F.lit(',"guided_json":'), schema, F.lit(',"extra_body":{"guided_json":'), schema, F.lit("}"))
    return F.concat(body, F.lit("}"))


def _post(url: str, body: str, key: str, timeout: float):
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, body.encode(), head), timeout=timeout) as r:
        return json.loads(r.read())


def _reply(data) -> tuple[str, int, int, str]:
    usage = data.get("usage") or {}
    text = data["choices"][0]["message"].get("content") or ""
    return text, int(usage.get("prompt_tokens") or 0), int(usage.get("completion_tokens") or 0), data.get("model") or "unknown"


def call(requests: DataFrame, base_url: str, key: str = "", timeout: float = 60.0, most: int = 3, in_flight: int = 8, wait=0.5) -> DataFrame:
    """Replies to ``requests(document_id, pass_idx, body)``, a row each; a call that fails has ``error`` and no text.

    Transport errors and 5xx are tried again after a random wait; 4xx are not, but a
    refused ``response_format`` is left out and asked once more.
    """
    url = base_url.rstrip("/") + "/chat/completions"

    def ask(body: str):
        for attempt in range(most):
            try:
                return *_reply(_post(url, body, key, timeout)), None, attempt + 1
            except urllib.error.HTTPError as e:
                asked = json.loads(body)
                if e.code == 400 and "response_format" in asked:
                    asked.pop("response_format")
                    body = json.dumps(asked)
                    continue
                error = f"upstream_unavailable: status {e.code}"
                if e.code < 500:
                    return "", 0, 0, "", error, attempt + 1
            except (KeyError, IndexError, TypeError, ValueError):
                return "", 0, 0, "", "vlm_protocol_error: unexpected reply", attempt + 1
            except (urllib.error.URLError, OSError) as e:
                error = "vlm_timeout: no reply in time" if isinstance(e, TimeoutError) else "upstream_unavailable: no connection"
            time.sleep(random.uniform(0, min(8.0, wait * 2**attempt)))
        return "", 0, 0, "", error, most

    def run(batches):
        for batch in batches:
            out = []
            for doc, idx, body in zip(batch["document_id"], batch["pass_idx"], batch["body"], strict=True):
                began = time.perf_counter()
                text, p, c, model, error, attempts = ask(body)
                out.append((doc, idx, None if error else text, p, c, model or None, (time.perf_counter() - began) * 1000, error, attempts))
            yield pd.DataFrame(out, columns=["document_id", "pass_idx", "text", "prompt_tokens", "completion_tokens", "model", "latency_ms", "error", "attempts"])

    return requests.select("document_id", "pass_idx", "body").repartition(in_flight).mapInPandas(run, REPLY)


def first_model(base_url: str, key: str = "", budget_s: float = 0.0) -> str | None:
    """The id of the server's first model, asked for each second until the budget is spent; None without one."""
    until = time.monotonic() + budget_s
    while True:
        try:
            head = {"Authorization": f"Bearer {key}"} if key else {}
            with urllib.request.urlopen(urllib.request.Request(base_url.rstrip("/") + "/models", headers=head), timeout=3) as r:
                data = json.loads(r.read()).get("data") or []
            if data:
                return data[0]["id"]
        except (OSError, ValueError, KeyError):
            pass
        if time.monotonic() >= until:
            return None
        time.sleep(1.0)
