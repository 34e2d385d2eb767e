"""Plates, ballots, replies, images, boxes."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import boxes, json_text, measures, plates
from plumbline.operators import ballot, images


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("kind", "lines", "want"), [
    ("us_plate", ["CALIFORNIA", "7ABC123"], "7ABC123"), ("us_plate", ["TEXAS", "ABC 1234", "THE LONE STAR STATE"], "ABC 1234"), ("sign", ["SPEED", "LIMIT", "65"], "SPEED LIMIT 65"),
    ("cn_plate", ["京", "A12345"], "京A12345"), ("other", ["粤B D12345"], "粤BD12345"), ("cn_plate", ["京AO1I34"], "京A01134"), ("us_plate", ["TEXAS"], "TEXAS"), ("us_plate", ["(“7ABC123”)", ""], "7ABC123"),
    ("other", [], ""), ("other", [" ", "''"], ""), ("us_plate", ["West Virginia 1AB 234"], "1AB 234"), ("us_plate", ["TEXAS2"], "TEXAS2"),
])
def test_compose(spark, kind, lines, want):
    assert one(spark, plates.compose(F.col("k"), F.col("l")), k=kind, l=lines) == want


@pytest.mark.parametrize(("given", "want"), [("US Plate", "us_plate"), ("chinese licence", "cn_plate"), ("Stop Sign", "sign"), ("license-plate", "us_plate"), ("", "other"), ("speed limit", "sign"), ("cat", "other")])
def test_kinds(spark, given, want):
    assert one(spark, plates.canonical_kind(F.col("g")), g=given) == want


def test_normal_form(spark):
    for raw in ("7-abc-123", " 7 ABC 123", "7·ABC_1.23", "7‑ABC—123"):
        assert one(spark, plates.grader_normalize(F.col("r")), r=raw) == "7ABC123"


def ballots(spark, *cases):
    weights = (1.5, 1.0, 1.0, 1.0)
    rows = [(f"i{n}", i, weights[i], kind, lines) for n, (kind, views) in enumerate(cases) for i, lines in enumerate(views) if lines is not None]
    return spark.createDataFrame(rows, "image_id string, view_ord int, weight double, kind string, lines array<string>")


def test_votes(spark):
    cases = [
        ("us_plate", [["7ABC123"], ["7ABC128"], ["7ABC123"], ["7ABC123"]]), ("sign", [["STOP"], None, ["STOP"], ["ST0P"]]), ("us_plate", [["7ABC123"], ["8ABC123"], None, None]),
        ("us_plate", [["7ABC128"], ["7A8C123"], ["7ABC123"], ["TABC123"]]), ("us_plate", [["7-ABC-123"], ["7abc123"], None, None]), ("other", [[" "], [""], None, None]),
    ]
    got = {r.image_id: (r.text, r.confidence) for r in ballot.vote(ballots(spark, *cases)).collect()}
    assert got["i0"] == ("7ABC123", 0.85) and got["i1"][0] == "STOP" and got["i4"] == ("7-ABC-123", 0.99) and got["i5"] == ("", 0.0)
    assert got["i2"][0] == "7ABC123" and got["i3"][0] == "7ABC123" and got["i3"][1] == 0.56


def test_prefix_votes(spark):
    r = ballots(spark, ("sign", [["GO"], ["STOP"], ["STOP"], None])).withColumn("arrival", F.col("view_ord"))
    got = [x.text for x in ballot.prefix_votes(r).orderBy("arrival").collect()]
    assert got == ["GO", "GO", "STOP"]


@pytest.mark.parametrize(("reply", "want"), [
    ('<think>{"a":1}</think>{"b":2} tail', {"b": 2}), ('```json\n{"c": [1]}\n```', {"c": [1]}), ('x {bad {"d": "é"}', {"d": "é"}), ("none", None), ("[1]", None), (None, None), ('{"e": {"f": null}}', {"e": {"f": None}}),
])
def test_first_json_object(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "r string")
    got = df.select(json_text.extract_json_object("r").alias("x")).first().x
    assert (json.loads(got) if got else None) == want


@pytest.mark.parametrize(("payload", "want"), [
    ('{"kind":"sign","lines":["A"," ","B"]}', ("sign", ["A", "B"])), ('{"text":"a\\nb"}', ("other", ["a", "b"])), ('{"kind":"x"}', ("x", [])), ('{"lines": 5}', None), ("{}", None), ("nonsense", None), ('{"lines": ["1", 2]}', ("other", ["1", "2"])),
])
def test_readings(spark, payload, want):
    r = spark.createDataFrame([(payload,)], "p string").select(json_text.parse_reading(F.col("p")).alias("x")).first().x
    assert (r and (r.kind, r.lines)) == want


@pytest.mark.parametrize(("reply", "ok"), [('{"a":1}', True), ('```json\n{"a":1}\n```', True), ("[1]", False), ("{", False), ("", False), (None, False)])
def test_json_objects(spark, reply, ok):
    r = spark.createDataFrame([(reply,)], "p string").select(json_text.as_json_object(F.col("p")).alias("x")).first().x
    assert (r is not None) == ok


def test_boxes(spark):
    df = spark.createDataFrame([([0.4, 0.1, 0.2, 0.3],), ([0.1, 0.1, 0.1, 0.5],), ([1.0, 2.0],), ([-1.0, 0.0, 2.0, 0.5],), (None,)], "a array<double>")
    b = df.select(boxes.box_from_array(F.col("a")).alias("b"))
    assert [r.b and tuple(r.b) for r in b.collect()] == [(0.2, 0.1, 0.4, 0.3), None, None, (0.0, 0.0, 1.0, 0.5), None]
    same = b.where("b is not null").select(F.round(boxes.iou(F.col("b"), F.col("b")), 9), boxes.is_box(F.col("b"))).collect()
    assert all(tuple(r) == (1.0, True) for r in same)


def test_measures(spark):
    df = spark.createDataFrame([("abd", "abc"), ("", ""), ("x", ""), (None, None)], "p string, t string")
    got = [r[0] for r in df.select(measures.character_error_rate(F.col("p"), F.col("t"))).collect()]
    assert abs(got[0] - 1 / 3) < 1e-12 and got[1:] == [0.0, 1.0, 0.0]
    assert measures.confidence_weights(0, 0, 0) == (1.0, 0.0, 0.0)
    assert abs(one(spark, measures.cost_usd(F.col("n"), 1.99, 1000.0), n=1000) - 1.99 / 3600) < 1e-12
    assert one(spark, measures.nearest_rank(F.array(*map(F.lit, (4, 1, 3, 2))), 0.5)) == 3


def test_png_round_trip_and_views(spark):
    rng = np.random.default_rng(0)
    for shape in ((9, 7), (9, 7, 3), (9, 7, 4)):
        px = rng.integers(0, 256, shape, dtype=np.uint8)
        back = images.decode_png(images.encode_png(px))
        assert np.array_equal(back, px if px.ndim == 3 else px[..., None])
        assert images.to_rgb(back).shape == (9, 7, 3)
    # one row of each filter: none, left, above, mean, Paeth
    raw = b"".join(bytes([f]) + bytes([1] * 6) for f in range(5))
    head = images.encode_png(np.zeros((1, 1), np.uint8))[:16] + (2).to_bytes(4, "big") + (5).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    body = zlib.compress(raw)
    png = head + bytes(4) + len(body).to_bytes(4, "big") + b"IDAT" + body + bytes(4) + bytes(4) + b"IEND" + bytes(4)
    assert images.decode_png(png)[:, :, 0].tolist() == [[1, 1], [1, 2], [2, 3], [2, 3], [3, 4]]
    page = images.encode_png(rng.integers(0, 256, (40, 60, 3), dtype=np.uint8))
    df = spark.createDataFrame([(bytearray(page), v) for v in ("original", "contrast", "denoised", "equalized")] + [(bytearray(b"junk"), "original")], "c binary, v string")
    size = images.png_size(F.col("c"))
    got = df.select(size.alias("s"), images.view_png("c", "v", F.lit(30), F.lit(20)).alias("p")).collect()
    assert [tuple(r.s) if r.s else None for r in got] == [(60, 40)] * 4 + [None]
    assert [images.decode_png(bytes(r.p)).shape if r.p else None for r in got] == [(20, 30, 3)] * 4 + [None]
    assert images.crop(np.zeros((100, 100, 3)), (0.2, 0.2, 0.4, 0.4)).shape == (22, 22, 3)


def test_nearest_aspect(spark):
    a = spark.createDataFrame([("x", 200, 100), ("y", 300, 100)], "image_id string, width int, height int")
    k = spark.createDataFrame([("k1", 202, 100), ("k2", 198, 100), ("k3", 500, 100)], "known_id string, width int, height int")
    assert [tuple(r) for r in images.nearest_aspect(a, k).collect()] == [("x", "k1")]
