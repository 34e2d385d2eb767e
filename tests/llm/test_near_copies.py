"""Near copies of the pipeline's stage against all pairs' Jaccard similarity."""

import random

import corpus_pipeline
from plumbline.llm import near_copies
from plumbline.llm.common import Scratch
from plumbline.llm.near_copies import shingles
from plumbline.llm.simhash import fingerprint

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_least(texts):
    sets = [set(shingles((t or "").encode()).tolist()) for t in texts]
    fps = [fingerprint((t or "").encode(), 3) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) or bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in range(len(texts)) if find(i) == i}


def test_stage_drops_planted_near_copies(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("aeioustrnl") for _ in range(6)) for _ in range(3000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]

    def changed(words, k):
        words = list(words)
        for i in rng.sample(range(len(words)), k):
            words[i] = "changed" + str(rng.randrange(10**6))
        return words

    first = [text(rng.choice([8, 60, 150, 300, 1200])) for _ in range(120)]
    near = [changed(w, max(1, len(w) // 60)) for w in first]
    far = [changed(w, len(w) // 4) for w in first]
    chain = [text(100)]
    for _ in range(12):
        chain.append(changed(chain[-1], 2))
    boiler = [chain[0][:60] + text(40) for _ in range(80)]
    group = [changed(first[3], 2) for _ in range(150)]
    texts = [" ".join(w) for w in first + near + far + chain + boiler + group]
    texts += [None, "", " \n", "one two", "ONE\ttwo", texts[5].upper(), texts[5]]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    want = plain_least(texts)
    assert len(want) < len(texts) - 200
    assert {r.doc_id for r in out.collect()} == want
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_prefixes_meet_all_similar_pairs_and_few_others(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(7))
    base = [word() for _ in range(150)]

    def changed(words, at):
        return [word() if i in at else w for i, w in enumerate(words)]

    far = [changed(base, set(rng.sample(range(150), 6))) for _ in range(120)]
    twins = [changed(w, {rng.randrange(150)}) for w in far[:15]]
    texts = [" ".join(w) for w in far + twins]
    own = [set(shingles(t.encode()).tolist()) for t in texts]
    like = {(i, j) for j in range(len(own)) for i in range(j) if 9 * len(own[i] & own[j]) >= 4 * (len(own[i]) + len(own[j]))}
    assert len(like) >= 15
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    nodes = docs.selectExpr("doc_id as node", "xxhash64(text) as key")
    got = near_copies._by_prefix(docs, nodes.selectExpr("node", "node as comp"), nodes, "text", Scratch(spark, "prefix"))
    got = {(r.u, r.v) for r in got.collect()}
    assert like <= got and len(got) < 4 * len(texts)


def test_rounds_end_when_they_link_little(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(7))
    base = [word() for _ in range(150)]

    def changed(words, k):
        at = set(rng.sample(range(len(words)), k))
        return [word() if i in at else w for i, w in enumerate(words)]

    far = [changed(base, 4) for _ in range(120)]
    texts = [" ".join(w) for w in far + [changed(w, 1) for w in far[:15]]]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    labels, keep = [], Scratch.keep

    def kept(self, df, label):
        labels.append(label)
        return keep(self, df, label)

    monkeypatch.setattr(Scratch, "keep", kept)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    want = plain_least(texts)
    assert got == want and 60 < len(want) <= 120
    assert labels.count("prefixes") == 1 and labels.count("others") == 1
