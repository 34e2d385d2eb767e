"""The positive-unlabelled classifier: held-out accuracy on planted texts, and its edge cases."""

import random
import zlib

from pyspark.sql import functions as F

from plumbline.llm import quality_pu as pu

SCHEMA = "doc_id bigint, text string, x string, score double"


def corpus(n=900):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("aeiourstnl") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(30, 200))]
        bad = i % 6 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 12 else [w + "###" for w in words[:9]] * 8
        rows.append((i, " ".join(words) + ".", "", 0.0))
        if i % 2:
            labels.append((i, 0 if bad else 1))
        elif bad:
            labels.append((i, 0))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    rows += [(None, None, "", 0.0), (5000, "", "", 0.0), (5001, " \n", "", 0.0), (7, rows[7][1], "", 0.0), (5002, "word " * 40000, "", 0.0)]
    labels_df = spark.createDataFrame(labels + [(None, 1), (3, 0)], "doc_id bigint, quality int")
    docs = spark.createDataFrame(rows, SCHEMA)
    got = pu.scored(docs, labels_df).collect()
    assert len(got) == len(rows) and all(0.0 <= r.score <= 1.0 for r in got)
    score = {r.doc_id: r.score for r in got}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    truth = dict(labels)
    right = sum((score[i] >= 0.3) == bool(truth[i]) for i in held)
    assert len(held) > 60 and right / len(held) > 0.95
    kept = pu.keep_good(docs, labels_df)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score >= 0.3 for r in got)


def test_labels_of_the_held_out_fifth_are_not_used(spark):
    ids = spark.range(1000).withColumnRenamed("id", "doc_id").withColumn("quality", F.lit(1))
    used = {r.doc_id for r in pu.trusted(ids).collect()}
    assert used == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 5}


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "", 0.0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.score for r in pu.scored(docs, none).collect()] == [0.5]
    assert pu.scored(docs.where(F.lit(False)), none).count() == 0
