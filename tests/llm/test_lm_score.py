"""Stupid-backoff scores against a plain version that counts every n-gram of all other documents."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import lm_score

SCHEMA = "doc_id bigint, text string, n string, block string, key int"


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\x0b\x0c\t\n\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def grams(d, order):
    return Counter(tuple(d[i : i + n]) for n in range(1, order + 1) for i in range(len(d) - n + 1))


def plain(texts, order, corpus=None):
    docs = list(map(words, texts))
    base = docs if corpus is None else list(map(words, corpus))
    total = sum((grams(d, order) for d in base), Counter())
    n_all = sum(map(len, base))
    out = []
    for d in docs:
        own, n = (grams(d, order), n_all - len(d)) if corpus is None else (Counter(), n_all)
        c = lambda g: total[g] - own[g]  # noqa: E731, B023
        logs = []
        for i in range(len(d)):
            factor, s = 1.0, None
            for m in range(min(order, i + 1), 1, -1):
                g = tuple(d[i - m + 1 : i + 1])
                if c(g) > 0:
                    s = c(g) / c(g[:-1])
                    break
                factor *= 0.4
            if s is None and n:
                s = (c((d[i],)) or 0.4) / n
            logs.append(math.log(factor * s) if s else None)
        out.append((len(d), sum(logs) / len(d) if d and n else None))
    return out


def sample():
    rng = random.Random(8)
    vocab = ["the", "The", "of", "é"] + [f"w{i}" for i in range(120)]
    pick = lambda: vocab[min(int(rng.paretovariate(0.7)) - 1, len(vocab) - 1)]
    texts = [None, "", " \n", "one", "the the the the"] + [" ".join(pick() for _ in range(rng.randrange(1, 80))) for _ in range(100)]
    rare = [" ".join(f"r{rng.randrange(10**6)}" for _ in range(40)) for _ in range(5)]
    return texts + [texts[9]] * 20 + ["of\tthe\x0bof " * 3000] + rare + rare[:1]


@pytest.mark.parametrize(("order", "size", "parts"), [(1, 50, 3), (2, 1 << 21, 1), (2, 200, 5), (3, 1, 2), (4, 1000, 7)])
def test_matches_plain_version(spark, order, size, parts):
    texts = sample()
    df = spark.createDataFrame([(i if i % 50 else None, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA).repartition(parts)
    got = lm_score.scores(df, order=order, size=size).collect()
    want = plain(texts, order)
    assert sorted(r.score for r in got if r.score is not None) == pytest.approx(sorted(s for _, s in want if s is not None), abs=2e-6)
    by_id = {r.doc_id: r for r in got}
    for i, (n, s) in enumerate(want):
        if i % 50:
            assert by_id[i].n_words == n and by_id[i].score == (None if s is None else pytest.approx(s, abs=2e-6))


def test_against_another_corpus(spark):
    texts = sample()
    docs, corpus = texts[:40] + ["never seen words", "the never"], texts[40:]
    frame = lambda xs: spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(xs)], SCHEMA)
    got = {r.doc_id: r.score for r in lm_score.scores(frame(docs), frame(corpus), order=3, size=300).collect()}
    for i, (_, s) in enumerate(plain(docs, 3, corpus)):
        assert got[i] == (None if s is None else pytest.approx(s, abs=2e-6))


def test_twice_alone_and_empty(spark):
    """A text met once elsewhere scores far above one met nowhere; equal texts score alike; no others, no score."""
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "g h i j k l"), (4, "m n o p q r s t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in lm_score.scores(df).collect()}
    assert got[2] == got[3] > got[1] + 2
    assert lm_score.scores(df.where("doc_id = 1")).collect()[0].score is None
    assert lm_score.scores(df.where(F.lit(False))).count() == 0
