"""SimHash against a plain version, with null, empty, long and repeated texts."""

import random
import re

import xxhash
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm.common import Scratch

SCHEMA = "doc_id bigint, text string, fp string, u bigint"


def plain_fp(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fp = {i: plain_fp(t) for i, t in enumerate(rows)}
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fp:
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (fp[i], find(i)) for i in fp}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    vocab = ["é" + str(i) for i in range(400)] + ["The", "of"]
    texts = [None, "", " \t\n", "one", "one two", "ONE two", "a b c d", "\x1c x"]
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 300, 900]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4])):
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            texts.append("\n".join(near))
    texts.append(" ".join(vocab * 250))
    texts += [texts[10]] * 30
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == plain_components(texts)


def test_trie_join_finds_every_link_of_a_crowded_prefix(spark):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(200)}
    centre = rng.getrandbits(64)
    while len(fps) < 900:
        fps.add(centre ^ sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 3]))) % 2**64)
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    got = {(r.u, r.v) for r in simhash.hamming_links(df, Scratch(spark, "t"), 2).collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) % 2**64).count("1") <= 2}
    assert got == want and len(want) > 1000


def test_repeated_and_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c", "", 0), (3, "a b c", "", 0), (3, "a b c", "", 0), (2, "z", "", 0)], SCHEMA)
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 3), (2, 2), (3, 3), (3, 3)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [2, 3]
    # one row of a class stays, also of differing texts under one id and where no row has an id
    words = [f"w{i}" for i in range(400)]
    near = [" ".join(words), " ".join(words).upper(), " ".join(words)]
    docs = spark.createDataFrame([(3, near[0], "", 0), (3, near[1], "", 0), (3, near[2], "", 0), (None, "x y", "", 0), (None, "X y", "", 0), (None, None, "", 0), (9, "", "", 0)], SCHEMA)
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(docs).collect()) == [0, 3, 9]
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0
    assert simhash.keep_one(docs.where(F.lit(False))).count() == 0
