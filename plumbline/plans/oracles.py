"""The queries in SQL, written from the derivation of the inputs rather than from the operators."""

from __future__ import annotations

_CENTS = "CAST(round({p} * 100) AS BIGINT)"
_MONEY = "CASE WHEN c % 100 = 0 THEN CAST(c // 100 AS VARCHAR) WHEN c % 10 = 0 THEN (c // 100) || '.' || (c % 100 // 10) ELSE (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END"

_ORDERS = f"""
o AS (SELECT o_orderkey AS k, 'o-' || o_orderkey AS document_id, o_orderstatus AS st, {_CENTS.format(p='o_totalprice')} AS c,
             CAST(o_orderdate AS DATE) AS dt FROM orders),
p AS (SELECT *, (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS plain, {_MONEY} AS money FROM o),
v AS (
  SELECT document_id, k, 'total' AS field, money AS normalized, plain AS display,
         CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 2 ELSE 3 END AS votes FROM p
  UNION ALL SELECT document_id, k, 'status', st, st, CASE WHEN k % 3 = 0 THEN 2 ELSE 3 END FROM p
  UNION ALL SELECT document_id, k, 'date', CASE WHEN TRUE THEN strftime(dt, '%Y-%m-%d') END, strftime(dt, '%Y-%m-%d'), CASE WHEN k % 4 = 0 THEN 2 ELSE 3 END FROM p),
a AS (SELECT *, round_even(CAST(votes AS DOUBLE) / 3 * 10000, 0) / 10000 AS agreement FROM v),
e AS (
  SELECT document_id, k, field, display, agreement, k % 11 <> 0 AS grounded,
         CASE WHEN k % 11 = 0 THEN 0.0 ELSE round_even((0.5::DOUBLE * agreement + 0.35::DOUBLE * 1.0::DOUBLE + 0.15::DOUBLE * 1.0::DOUBLE) * 10000, 0) / 10000 END AS confidence
  FROM a
  UNION ALL SELECT document_id, k, 'po', NULL, 0.0, NULL, 0.0 FROM p
  UNION ALL SELECT document_id, k, 'ref', NULL, 0.0, NULL, 0.0 FROM p)
"""


def _results(limit: str = "0.62") -> str:
    return f"""
r AS (SELECT e.*, CASE WHEN field = 'po' THEN 'not_present' WHEN field = 'ref' OR NOT grounded OR confidence < {limit} THEN 'abstained' ELSE 'extracted' END AS status,
             CASE WHEN field IN ('po', 'ref') OR NOT grounded OR confidence < {limit} THEN NULL ELSE display END AS value FROM e)
"""


_TRUTH = """
t AS (
  SELECT r.*, CASE WHEN field = 'po' THEN NULL WHEN field = 'ref' THEN 'R' || r.k WHEN field = 'date' AND r.k % 9 = 0 THEN NULL
                   WHEN field = 'total' AND r.k % 13 = 0 THEN (p.c // 100 + 7) || '.' || lpad(CAST(p.c % 100 AS VARCHAR), 2, '0') ELSE r.display END AS expected
  FROM r JOIN p USING (document_id)),
x AS (SELECT *, status = 'extracted' AS ans,
             CASE WHEN status = 'extracted' THEN NOT (field = 'total' AND k % 13 = 0) AND expected IS NOT NULL ELSE expected IS NULL END AS correct FROM t)
"""

_ABSTAINED_BUT_TRUE = "field IN ('total', 'status', 'date')"


def _metrics(by: str, source: str = "x") -> str:
    def share(a: str, b: str, empty: str = "0.0") -> str:
        return f"CASE WHEN {b} > 0 THEN round_even(CAST({a} AS DOUBLE) / {b} * 10000, 0) / 10000 ELSE {empty} END"

    n, a = "count(*)", "count(*) FILTER (WHERE ans)"
    d = f"({n} - {a})"
    return f"""
SELECT {by}, {n} AS fields, {a} AS answered, {share(a, n)} AS coverage, {share("count(*) FILTER (WHERE ans AND correct)", a)} AS precision,
  {share("count(*) FILTER (WHERE ans AND NOT correct)", a)} AS hallucination_rate,
  {share("count(*) FILTER (WHERE NOT ans AND (expected IS NULL OR NOT correct))", d, "1.0")} AS abstention_precision,
  round_even(coalesce(avg(cer) FILTER (WHERE ans), 0.0) * 10000, 0) / 10000 AS mean_cer,
  {share("count(*) FILTER (WHERE ans AND correct)", n)} AS field_accuracy,
  {share("count(*) FILTER (WHERE NOT ans AND correct)", d, "1.0")} AS abstention_precision_strict
FROM {source} GROUP BY {by}"""


_NORM_TOTAL = "regexp_replace(regexp_replace({x}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
_CER = f"""
y AS (SELECT *, CASE WHEN field = 'total' THEN {_NORM_TOTAL.format(x='value')} ELSE value END AS pv, CASE WHEN field = 'total' THEN {_NORM_TOTAL.format(x='expected')} ELSE expected END AS ev FROM x),
z AS (SELECT *, CASE WHEN coalesce(ev, '') = '' THEN CASE WHEN coalesce(pv, '') = '' THEN 0.0 ELSE 1.0 END
                     ELSE least(1.0, CAST(levenshtein(coalesce(pv, ''), ev) AS DOUBLE) / length(ev)) END AS cer FROM y)
"""


def _sweep() -> str:
    """The same outcomes for three thresholds."""
    base = f"WITH {_ORDERS}, th AS (SELECT unnest([0.5, 0.62, 0.9])::DOUBLE AS abstain_below), e2 AS (SELECT e.*, abstain_below FROM e, th),"
    results = _results("abstain_below").replace("SELECT e.*", "SELECT e2.*").replace("FROM e)", "FROM e2)")
    return base + results + "," + _TRUTH + "," + _CER


_PLATE = "chr(CAST(65 + {k} % 26 AS INT)) || chr(CAST(65 + ({k} * 7) % 26 AS INT)) || chr(CAST(65 + ({k} * 11) % 26 AS INT)) || lpad(CAST({k} % 1000 AS VARCHAR), 3, '0')"

_EDGES = "[0.25, 0.5, 1, 2, 4, 8, 16, 32, 64]"

ORACLES: dict[str, str] = {
    "norm_number": f"""
WITH o AS (SELECT l_orderkey, l_linenumber, {_CENTS.format(p='l_extendedprice')} AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, {_MONEY} AS normalized, CAST(c // 100 AS VARCHAR) AS whole_part FROM o""",
    "norm_date": """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 2 AND day(o_orderdate) <= 12 THEN printf('%04d-%02d-%02d', year(o_orderdate), day(o_orderdate), month(o_orderdate))
       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS normalized, TRUE AS valid FROM orders""",
    "norm_misc": """
SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN '+91804123' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END
  WHEN 2 THEN '2.' || c_custkey % 50 || '.1' WHEN 3 THEN 'user' || c_custkey || '@example.com' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 'a b ' || c_custkey END AS normalized,
  c_custkey % 7 NOT IN (4, 5) AS valid FROM customer""",
    "canonical_docs": """
WITH c AS (SELECT doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z]+', '', 'g') AS c FROM documents)
SELECT doc_id, length(c) AS length, md5(c) AS digest FROM c""",
    "consensus_vote": f"WITH {_ORDERS} SELECT document_id, field, normalized, display, agreement, votes FROM a",
    "score_fields": f"""
WITH {_ORDERS}, {_results()}
SELECT document_id, field, value, status, confidence, agreement, grounded,
  CASE WHEN field = 'po' THEN 'field absent from document' WHEN field = 'ref' THEN 'required field not read by any decoding pass'
       WHEN status = 'abstained' THEN 'value not located in page text (score 0.00)' || CASE WHEN agreement < 1 THEN '; decoding passes disagreed (agreement 0.67)' ELSE '' END END AS reason
FROM r""",
    "demo_document": """
SELECT * FROM (VALUES ('demo', 'invoice_number', 'INV-2026-0041', 'extracted', 1.0::DOUBLE, 1.0::DOUBLE), ('demo', 'invoice_date', '14/03/2026', 'extracted', 1.0, 1.0),
  ('demo', 'supplier_name', 'ACME INSTRUMENTS PVT LTD', 'extracted', 1.0, 1.0), ('demo', 'supplier_phone', '+91 80 4123 9900', 'extracted', 1.0, 1.0),
  ('demo', 'total_amount', '1,24,500.00', 'extracted', 1.0, 1.0), ('demo', 'currency', NULL, 'abstained', 0.5889, 1.0), ('demo', 'purchase_order', NULL, 'abstained', 0.1992, 0.5))
  AS t(document_id, field, value, status, confidence, agreement)""",
    "golden_ablation": """
SELECT 35::BIGINT AS fields, 32::BIGINT AS answered, 0.9143::DOUBLE AS coverage, 1.0::DOUBLE AS precision, 0.0::DOUBLE AS hallucination_rate, 1.0::DOUBLE AS abstention_precision,
  0.0::DOUBLE AS mean_cer, 0.9143::DOUBLE AS field_accuracy, 1.0::DOUBLE AS abstention_precision_strict, p::INT AS passes FROM (VALUES (1), (2)) AS t(p)""",
    "schema_prompts": """
SELECT * FROM (VALUES
  ('invoice', '- invoice_number (string) (required)' || chr(10) || '- invoice_date (date) (required)' || chr(10) || '- supplier_name (string) (required)' || chr(10) || '- supplier_phone (phone)' || chr(10) || '- total_amount (currency) (required)' || chr(10) || '- currency (string)' || chr(10) || '- purchase_order (string)', 7::INT),
  ('rulebook', '- game_name (string) (required)' || chr(10) || '- player_count (string) (required)' || chr(10) || '- board_size (string) (required)' || chr(10) || '- victory_condition (text) (required)' || chr(10) || '- turn_order (text)' || chr(10) || '- version (version)', 6))
  AS t(schema_name, description, n_properties)""",
    "readiness": "SELECT bool_and(event_type <> 'error') AS ready, 'all' AS which FROM events UNION ALL SELECT TRUE, 'up'",
    "case_field_types": """
SELECT 'invoice' AS schema_name, * FROM (VALUES ('invoice_number', 'string'), ('invoice_date', 'date'), ('supplier_name', 'string'), ('supplier_phone', 'phone'),
  ('total_amount', 'currency'), ('currency', 'string'), ('purchase_order', 'string')) AS t(field, kind)""",
    "schema_catalog": "SELECT * FROM (VALUES ('invoice', 'Invoice', 7::BIGINT), ('rulebook', 'Rulebook', 6)) AS t(schema_name, title, n_fields)",
    "schema_names": "SELECT DISTINCT schema_name FROM (SELECT p_brand AS schema_name FROM part UNION ALL SELECT 'invoice' UNION ALL SELECT 'rulebook')",
    "grounding_exact": """
WITH f AS (SELECT doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z]+', '', 'g') AS c FROM documents),
b AS (SELECT item_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z]+', '', 'g') AS c FROM benchmark)
SELECT item_id, doc_id FROM b JOIN f ON contains(f.c, b.c) WHERE b.c <> ''""",
    "cer_parts": "SELECT p_partkey, round(least(1.0, CAST(levenshtein(p_name, p_type) AS DOUBLE) / length(p_type)), 9) AS cer FROM part",
    "eval_metrics": f"WITH {_ORDERS}, {_results()}, {_TRUTH}, {_CER} {_metrics('field', 'z')}",
    "eval_grid": _sweep() + _metrics("abstain_below", "z"),
    "document_summary": f"""
WITH {_ORDERS}, {_results()}
SELECT document_id, count(*) AS fields, round(CAST(count(*) FILTER (WHERE status = 'abstained') AS DOUBLE) / count(*), 6) AS abstention_rate,
  round(coalesce(avg(confidence) FILTER (WHERE status = 'extracted'), 0.0), 6) AS mean_confidence FROM r GROUP BY document_id""",
    "field_counters": f"""
WITH {_ORDERS}, {_results()},
c AS (SELECT 'extracted' AS counter, '' AS reason FROM r WHERE status = 'extracted'
  UNION ALL SELECT 'abstained', CASE WHEN grounded = FALSE THEN 'ungrounded' ELSE 'low_confidence' END FROM r WHERE status = 'abstained'
  UNION ALL SELECT 'ungrounded', '' FROM r WHERE status = 'abstained' AND grounded = FALSE)
SELECT 'order' AS schema_name, counter, reason, count(*) AS n FROM c GROUP BY counter, reason""",
    "request_counters": "SELECT event_type AS schema_name, CASE WHEN value > 20 THEN 'vlm_timeout' ELSE 'success' END AS outcome, count(*) AS n FROM events GROUP BY 1, 2",
    "latency_histogram": f"""
WITH e AS (SELECT unnest({_EDGES}) AS edge, unnest(['0.25', '0.5', '1', '2', '4', '8', '16', '32', '64']) AS le)
SELECT event_type, le, count(*) FILTER (WHERE value <= edge) AS n FROM events, e GROUP BY event_type, le
UNION ALL SELECT event_type, '+Inf', count(value) FROM events GROUP BY event_type""",
    "latency_percentiles": """
WITH l AS (SELECT event_type, list(value ORDER BY value) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, v[CAST(round_even(0.5 * (n - 1), 0) AS INT) + 1] AS p50, v[CAST(round_even(0.95 * (n - 1), 0) AS INT) + 1] AS p95, v[CAST(round_even(0.99 * (n - 1), 0) AS INT) + 1] AS p99 FROM l""",
    "bench_summary": """
WITH g AS (SELECT list(value ORDER BY value) AS v, count(*) AS n, avg(value) AS m FROM events WHERE event_type <> 'error'),
s AS (SELECT count(*) AS requests, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 100 END) AS BIGINT) AS total_tokens FROM events)
SELECT requests, succeeded, round(m, 6) AS mean_ms, total_tokens, round(succeeded / 10.0, 6) AS throughput, round(total_tokens / 10.0, 6) AS tokens_per_second,
  round(1 - succeeded / requests, 6) AS error_rate, round(1.99 / 3600 * 10.0 / succeeded * 1000, 6) AS cost_per_1k,
  v[CAST(round_even(0.5 * (n - 1), 0) AS INT) + 1] AS p50_ms, v[CAST(round_even(0.95 * (n - 1), 0) AS INT) + 1] AS p95_ms, v[CAST(round_even(0.99 * (n - 1), 0) AS INT) + 1] AS p99_ms FROM s, g""",
    "text_vote": f"""
WITH c AS (SELECT c_custkey AS k, {_PLATE.format(k='c_custkey')} AS plate FROM customer),
w AS (SELECT k, plate, 2.5 + CASE WHEN k % 4 <> 0 OR right(plate, 1) = 'X' THEN 1 ELSE 0 END + CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END AS won, 3.5 + CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END AS total FROM c)
SELECT 'c-' || k AS image_id, plate AS text, round_even(least(0.99, 0.35 + 0.64 * (won / total)::DOUBLE) * 100, 0) / 100 AS confidence, 'us_plate' AS kind FROM w""",
    "char_vote": f"SELECT 'c-' || c_custkey AS image_id, {_PLATE.format(k='c_custkey')} AS text, 0.56::DOUBLE AS confidence, 'us_plate' AS kind FROM customer",
    "kind_vote": "SELECT 'c-' || c_custkey AS image_id, 'us_plate' AS kind FROM customer",
    "box_measures": """
WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: least(1.0, greatest(0.0, x::DOUBLE))) AS a FROM embeddings),
b AS (SELECT vec_id, least(a[1], a[3]) AS x0, least(a[2], a[4]) AS y0, greatest(a[1], a[3]) AS x1, greatest(a[2], a[4]) AS y1 FROM e),
g AS (SELECT *, x1 - x0 > 1e-6 AND y1 - y0 > 1e-6 AS ok, least(x1, 0.1) - greatest(x0, 0.0) AS w, least(y1, 0.1) - greatest(y0, 0.0) AS h FROM b)
SELECT vec_id, ok AS is_box, CASE WHEN ok THEN round((x1 - x0) * (y1 - y0), 9) END AS area,
  CASE WHEN ok THEN CASE WHEN w > 0 AND h > 0 THEN round(w * h / ((x1 - x0) * (y1 - y0) + 0.1::DOUBLE * 0.1::DOUBLE - w * h), 9) ELSE 0.0 END END AS iou,
  CASE WHEN ok THEN CAST(round_even(x0 * 1000, 0) AS INT) END AS px0, CASE WHEN ok THEN CAST(round_even(y1 * 500, 0) AS INT) END AS py1 FROM g""",
    "box_union": """
WITH e AS (SELECT label, list_transform(embedding[1:4], lambda x: least(1.0, greatest(0.0, x::DOUBLE))) AS a FROM embeddings),
b AS (SELECT label, least(a[1], a[3]) AS x0, least(a[2], a[4]) AS y0, greatest(a[1], a[3]) AS x1, greatest(a[2], a[4]) AS y1 FROM e)
SELECT l.label, round(x0, 9) AS x0, round(y0, 9) AS y0, round(x1, 9) AS x1, round(y1, 9) AS y1 FROM (SELECT DISTINCT label FROM embeddings) l
LEFT JOIN (SELECT label, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b WHERE x1 - x0 > 1e-6 AND y1 - y0 > 1e-6 GROUP BY label) u USING (label)""",
    "parse_props": "SELECT event_id, event_id % 10 <> 1 AS ok, CASE WHEN event_id % 10 <> 1 THEN CAST(json_extract(props, '$.k') AS INT) END AS k FROM events",
    "parse_replies": """
SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 3 THEN NULL WHEN c_custkey % 3 = 0 THEN 'Stop Sign' WHEN c_custkey % 3 = 1 THEN 'other' ELSE 'plate' END AS kind,
  CASE WHEN c_custkey % 5 = 3 THEN NULL WHEN c_custkey % 3 = 2 THEN c_mktsegment || '|B' ELSE c_mktsegment END AS lines FROM customer""",
    "envelopes": """
SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS text, CASE WHEN event_id % 4 <> 0 THEN user_id END AS prompt_tokens,
  CASE WHEN event_id % 4 <> 0 THEN 0::BIGINT END AS completion_tokens, CASE WHEN event_id % 4 <> 0 THEN 'unknown' END AS model FROM events""",
    "breaker_states": """
WITH e AS (SELECT *, event_type <> 'error' AS ok, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
f AS (SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS BIGINT) AS failures FROM e)
SELECT event_id AS call_id, failures, failures >= 2 AS is_open,
  coalesce(lag(failures) OVER w >= 2 AND epoch(ts) - epoch(lag(ts) OVER w) >= 3600, FALSE) AS half_open FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "retry_attempts": """
WITH a AS (SELECT event_id // 4 * 4 AS call_id, event_id % 4 AS attempt, CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN NULL WHEN 'click' THEN 422 ELSE 200 END AS status FROM events WHERE event_id % 4 < 3),
s AS (SELECT call_id, min(attempt) FILTER (WHERE status < 500) AS stop FROM a GROUP BY call_id),
u AS (SELECT a.* FROM a JOIN s USING (call_id) WHERE stop IS NULL OR attempt <= stop)
SELECT call_id, count(*) AS attempts, last(status ORDER BY attempt) AS status, count(*) FILTER (WHERE status IS NULL OR status >= 500) AS breaker_failures,
  coalesce(last(status ORDER BY attempt) BETWEEN 200 AND 299, FALSE) AS ok FROM u GROUP BY call_id""",
    "request_checks": """
SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 9 = 0 THEN 'document_id' END, CASE WHEN c_custkey % 4 IN (0, 1) THEN 'images_b64' END,
  CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 8 NOT BETWEEN 1 AND 5 THEN 'passes' END) AS rejected FROM customer""",
    "pass_usage": """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS document_id, event_type NOT IN ('error', 'signup') AS ok, event_id % 7 AS p, event_id % 3 AS c FROM events)
SELECT document_id, CAST(coalesce(sum(p) FILTER (WHERE ok), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(c) FILTER (WHERE ok), 0) AS BIGINT) AS completion_tokens,
  CAST(coalesce(sum(p + c) FILTER (WHERE ok), 0) AS BIGINT) AS total_tokens, count(*) FILTER (WHERE ok) AS total_passes, CAST(count(*) FILTER (WHERE NOT ok) AS INT) AS n_warnings, bool_and(NOT ok) AS failed
FROM e GROUP BY document_id""",
    "image_sizes": """
WITH s AS (SELECT p_partkey, p_partkey * 37 % 6000 + 1 AS w, p_partkey * 91 % 4000 + 1 AS h FROM part), l AS (SELECT *, greatest(w, h) AS m FROM s),
f AS (SELECT *, CASE WHEN m > 1600 THEN 1600::DOUBLE / m WHEN m < 640 THEN 640::DOUBLE / m ELSE 1.0 END AS f FROM l)
SELECT p_partkey, w * h <= 9000000 AS within, CASE WHEN m <= 2048 THEN w ELSE greatest(1, CAST(floor(w * (2048::DOUBLE / m)) AS BIGINT)) END AS cw,
  CASE WHEN m <= 2048 THEN h ELSE greatest(1, CAST(floor(h * (2048::DOUBLE / m)) AS BIGINT)) END AS ch,
  greatest(1, CAST(round_even(w * f, 0) AS BIGINT)) AS fw, greatest(1, CAST(round_even(h * f, 0) AS BIGINT)) AS fh FROM f""",
    "small_measures": """
SELECT s_suppkey AS k, round(1.99::DOUBLE / 3600.0 * (s_suppkey * 10 / 1400.0::DOUBLE), 9) AS cost, CASE WHEN s_suppkey % 2 = 0 THEN 0.0 ELSE 0.35 END::DOUBLE AS temperature,
  least(8.0, 0.5 * pow(2.0, s_suppkey % 6))::DOUBLE AS ceiling, round_even(greatest(0.05, least(0.92, (s_suppkey % 50 + 1)::DOUBLE / 48.0)) * 1000, 0) / 1000 AS fraction,
  'v3 | ' || (s_suppkey % 5 + 1) || 'p | t=0.62' AS label, 'img.' || s_suppkey || '_output.json' AS output FROM supplier""",
    "self_check": "SELECT CAST(20 * count(*) AS BIGINT) AS points, count(*) AS images FROM customer",
    "stream_day_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}

ORACLES["eval_reports"] = f"""
WITH m AS ({_sweep() + _metrics("abstain_below", "z")}),
u AS (SELECT count(*) FILTER (WHERE o_orderkey % 17 <> 0) AS documents, CAST(coalesce(sum(o_orderkey % 1000) FILTER (WHERE o_orderkey % 17 <> 0), 0) AS BIGINT) AS tokens FROM orders),
r AS (SELECT m.*, tokens, round(1.99 / 3600.0 * (tokens / 1400.0) / documents * 1000, 6) AS per_1k, printf('v3 | 2p | t=%.2f', abstain_below) AS label FROM m, u)
SELECT 0 AS ord, '| configuration | coverage | precision | hallucination | abstention precision | mean CER | tokens | $/1k docs |' AS line
UNION ALL SELECT 1, '|---|' || repeat('---:|', 7)
UNION ALL SELECT CAST(row_number() OVER (ORDER BY label) + 1 AS INT), '| ' || label || ' | ' || printf('%.1f%% | %.1f%% | %.1f%% | %.1f%% | %.3f', coverage * 100, precision * 100, hallucination_rate * 100, abstention_precision * 100, mean_cer)
  || ' | ' || format('{{:,}}', tokens) || ' | $' || printf('%.2f', per_1k) || ' |' FROM r"""
