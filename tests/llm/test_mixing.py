"""Mixing: targets by repeated resharing, rates by the dual's conditions, copies near the targets."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from plumbline.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, rate string"


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not over:
            out.update({s: w[s] * level for s in open_})
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def corpus(rng, n=900):
    rows = []
    for i in range(n):
        s = rng.choice(["a", "a", "a", "b", "c", "é", None, "d", "e"])
        k = int(rng.paretovariate(1.2) * (40 if s == "b" else 10))
        rows.append((i, " ".join(["w"] * min(k, 3000)), s, "", ""))
    return rows + [(None, None, "a", "", ""), (1, "", None, "", ""), (2, " \n", "zero", "", "")] + [(5, "x y z", "a", "", "")] * 400


def test_targets_rates_and_copies(spark):
    rows = corpus(random.Random(6))
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, mixing.word_count(F.col("text")), weights=[3, 1, 2]).collect()
    again = mixing.mix(df.repartition(7), mixing.word_count(F.col("text")), weights=[3, 1, 2])
    key = lambda r: (str(r.doc.doc_id), r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    taken, exact, biggest = defaultdict(int), defaultdict(float), defaultdict(int)
    for r in got:
        s = r.doc.source
        assert r.size == len((r.doc.text or "").split()) and 0 <= r.copies <= 2 and r.source_size == sizes[s]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        taken[s] += r.copies * r.size
        exact[s] += r.rate * r.size
        biggest[s] = max(biggest[s], r.size)
    for s, t in want.items():
        assert abs(exact[s] - t) <= 1e-6 * max(1, t), (s, exact[s], t)
        assert abs(taken[s] - t) <= max(0.01 * t, 5), (s, taken[s], t)
    for s in want:  # the rates of a source are tilted exponentially by size, up to the cap
        lam = {round(math.log(r.rate) / r.size, 9) for r in got if r.doc.source == s and r.size and r.rate < 2 - 1e-9}
        assert len(lam) <= 1
    back = mixing.repeated(mixing.mix(df, mixing.word_count(F.col("text")), weights=[3, 1, 2]))
    assert back.columns == df.columns and back.count() == sum(r.copies for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df, mixing.word_count(F.col("text")), weights=[1]).count() == 0
