"""Voting, grounding, scoring and evaluation on golden cases."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import similarity
from plumbline.operators import consensus, evaluate, grounding, observe, ops, scoring
from plumbline.plans import queries

PAGE = "ACME INSTRUMENTS PVT LTD\nInvoice INV-2026-0041   Date: 14/03/2026\nPhone: +91 80 4123 9900\nGrand Total: Rs. 1,24,500.00"
OBS = "document_id string, field string, kind string, ord int, pass_id string, raw_value string, quote string, bbox struct<x0:double,y0:double,x1:double,y1:double>, total_passes int"


def obs(spark, *fields):
    rows = []
    for name, kind, total, values in fields:
        for i, v in enumerate(values):
            value, pass_id = v if isinstance(v, tuple) else (v, f"pass-{i}")
            rows.append(("d", name, kind, i, pass_id, value, f"q{i}", (0.1 * i, 0.1, 0.2 + 0.1 * i, 0.5), total))
    return spark.createDataFrame(rows, OBS)


def test_votes(spark):
    o = obs(
        spark, ("money", "currency", None, ["1,24,500.00", "124500", "124.500"]), ("half", "string", 2, ["INV-1"]), ("blank", "string", None, ["  "]),
        ("tie", "string", None, [("B", "pass-3"), ("A", "pass-1")]), ("full_tie", "string", None, [("B", "p"), ("A", "p")]), ("kanji", "string", None, ["日本", "日本", "x"]),
        ("signs", "number", None, ["12.5", "125", "7"]),
    )
    got = {r.field: r for r in consensus.vote(o).collect()}
    assert (got["money"].normalized, got["money"].agreement, got["money"].display) == ("124500", 0.6667, "1,24,500.00")
    assert got["half"].agreement == 0.5 and "blank" not in got
    assert got["tie"].display == "A" and got["full_tie"].display == "B" and got["kanji"].display == "日本"
    assert got["signs"].votes == 2  # folding drops the point
    assert (got["money"].bbox.x0, round(got["money"].bbox.x1, 6)) == (0.0, 0.3)


@pytest.mark.parametrize(("value", "grounded", "score"), [
    ("+91 80 4123 9900", True, 1.0), ("ACME INSTRUMENTS PVT LTO", True, 0.9787), ("INR", False, 0.6667), ("PO-88213", False, 0.375), (" ", False, 0.0), ("12", True, 1.0),
])
def test_grounding(spark, value, grounded, score):
    df = spark.createDataFrame([(value, PAGE), (value, " "), (value, None)], "v string, r string")
    got = grounding.ground(df, "v", "r").collect()
    assert (got[0].grounded, got[0].grounding_score) == (grounded, score)
    assert [(r.grounded, r.grounding_score) for r in got[1:]] == [(False, 0.0)] * 2


def slow_partial(a, b):
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, d in enumerate(y):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    if len(a) > len(b):
        a, b = b, a
    best = 0.0
    for x, y in ((a, b), (b, a)) if len(a) == len(b) else ((a, b),):
        for end in range(1, len(y) + len(x)):
            w = y[max(0, end - len(x)) : min(end, len(y))]
            best = max(best, 2 * lcs(x, w) / (len(x) + len(w)))
    return best


def test_partial_ratio_on_random_strings():
    rng = random.Random(3)
    for _ in range(600):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        assert abs(similarity.partial_ratio(a, b) - slow_partial(a, b)) < 1e-12, (a, b)


def test_contained_in_agrees_with_and_without_seeds(spark, monkeypatch):
    values = spark.createDataFrame([(1, "Hello, world of many words"), (2, "ab"), (3, "absent thing here"), (4, "-"), (5, None), (6, "Many WORDS")], "v int, a string")
    texts = spark.createDataFrame([(1, "say hello world: of many words"), (2, "xaBx"), (3, ""), (4, None), (5, "many, words and abs")], "t int, b string")
    few = sorted(map(tuple, grounding.contained_in(values, texts, "a", "b", "v", "t").collect()))
    monkeypatch.setattr(grounding, "FEW_VALUES", 0)
    assert sorted(map(tuple, grounding.contained_in(values, texts, "a", "b", "v", "t").collect())) == few
    assert (1, 1) in few and (2, 2) in few and (6, 5) in few and len(few) == 5


def test_demo_document(spark):
    got = {r.field: (r.status, r.confidence) for r in queries.demo_document(spark).collect()}
    assert got["currency"] == ("abstained", 0.5889) and got["purchase_order"] == ("abstained", 0.1992)
    assert sum(v == ("extracted", 1.0) for v in got.values()) == 5


def expect(spark, page, *fields):
    return spark.createDataFrame([("d", n, k, r, page) for n, k, r in fields], "document_id string, field string, kind string, required boolean, reference_text string")


def test_scoring_verdicts(spark):
    o = obs(spark, ("po", "string", 2, ["PO-88213", "PO-88213"]), ("phone", "phone", 2, ["+91 80 4123 9900"]), ("version", "version", 2, ["Grand", "Grand"]))
    e = expect(spark, PAGE, ("po", "string", False), ("phone", "phone", False), ("version", "version", False), ("none", "string", True), ("maybe", "string", False))
    got = {r.field: r for r in scoring.score_fields(o, e).collect()}
    assert got["po"].status == "abstained" and "not located in page text" in got["po"].reason and round(got["po"].confidence, 3) == 0.293
    assert (got["phone"].status, got["phone"].confidence, got["phone"].provenance.grounded) == ("extracted", 0.75, True)
    assert got["version"].status == "not_present" and got["none"].status == "abstained" and got["maybe"].status == "not_present"
    assert got["none"].reason.startswith("required field") and got["none"].value is None
    blank = {r.field: r for r in scoring.score_fields(o, expect(spark, " ", ("phone", "phone", False))).collect()}
    assert blank["phone"].status == "abstained" and blank["phone"].confidence == 0.0


def test_malformed_passes_are_warnings(spark):
    rows = [("d", "invoice", 0, '{"currency": {"value": "INR", "bbox": [0.4, 0.1, 0.2, 0.3], "zzz": 1}, "other": {"value": "x"}, "total_amount": {"value": 1.50}}', 10, 5, None), ("d", "invoice", 1, "not json", 10, 5, None), ("d", "invoice", 2, "[1]", 10, 5, None), ("d", "invoice", 3, "{", 1, 1, "vlm_timeout: late"), ("e", "invoice", 0, "x", 1, 1, None)]
    r = spark.createDataFrame(rows, "document_id string, schema_name string, pass_idx int, text string, prompt_tokens long, completion_tokens long, error string")
    parsed = observe.parse_passes(r)
    used = {x.document_id: x for x in observe.usage(parsed).collect()}
    assert (used["d"].total_tokens, used["d"].total_passes, len(used["d"].warnings), used["d"].failed) == (15, 1, 3, False)
    assert used["e"].failed and used["e"].total_tokens == 0
    got = {x.field: x for x in observe.observations(parsed, queries.invoice_fields(spark)).collect()}
    assert set(got) == {"currency", "total_amount"} and got["total_amount"].raw_value == "1.5"
    assert (got["currency"].bbox.x0, got["currency"].bbox.x1) == (0.2, 0.4)


def test_metrics(spark):
    rows = [("a", "f", "number", "12", "extracted", "12.0"), ("b", "f", "number", "13", "extracted", "12"), ("c", "f", "number", None, "abstained", None), ("d", "f", "number", None, "abstained", "4")]
    df = spark.createDataFrame(rows, "document_id string, field string, kind string, value string, status string, expected string")
    m = evaluate.metrics(evaluate.outcomes(df.drop("expected"), df.select("document_id", "field", "expected"))).first()
    assert (m.fields, m.answered, m.coverage, m.precision, m.hallucination_rate) == (4, 2, 0.5, 0.5, 0.5)
    assert (m.abstention_precision, m.abstention_precision_strict, m.mean_cer) == (1.0, 0.5, 0.25)
    none = evaluate.metrics(evaluate.outcomes(df.drop("expected"), df.select("document_id", "field", "expected")).where(F.lit(False))).first()
    assert (none.precision, none.coverage, none.abstention_precision) == (0.0, 0.0, 1.0)


def test_golden_ablation(spark):
    for r in queries.golden_ablation(spark).collect():
        assert (r.fields, r.answered, r.coverage, r.precision, r.hallucination_rate, r.abstention_precision, r.mean_cer) == (35, 32, 0.9143, 1.0, 0.0, 1.0, 0.0)


def test_nearest_ranks_match_a_sorted_list(spark):
    rng = random.Random(4)
    rows = [(g, rng.randrange(9)) for g in range(5) for _ in range(rng.randrange(1, 40))]
    got = ops.nearest_ranks(spark.createDataFrame(rows, "g int, v int"), "v", {"p50": 0.5, "p95": 0.95}, "g").collect()
    for r in got:
        v = sorted(x for g, x in rows if g == r.g)
        assert (r.p50, r.p95) == tuple(v[min(len(v) - 1, round(f * (len(v) - 1)))] for f in (0.5, 0.95))
