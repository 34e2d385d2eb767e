"""Winnowing against a plain window scan."""

import random
import re

from pyspark.sql import functions as F

from plumbline.llm import decontaminate as dc


def plain_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(docs, bench):
    wins = {}
    for item, t in bench:
        w = plain_words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for i, t in docs:
        w = plain_words(t)
        hit, items = set(), set()
        for n in range(1, 11):
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    items |= wins[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), len(items), sorted(items)))
    return sorted(out, key=str)


def test_matches_window_scan(spark):
    rng = random.Random(3)
    vocab = ["the", "of", "é", "Über", "x1", "9"] + [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(i, text(rng.choice([10, 11, 25, 60]))) for i in range(12)]
    bench += [(100, "Tiny item"), (101, ""), (102, None), (103, "the the the the the the the the the the the the"), (104, bench[0][1]), (105, "zeta")]
    docs = [(0, None), (1, ""), (2, "--"), (3, "a tiny, ITEM! here tiny item"), (4, "The " * 40), (5, text(9))]
    for i in range(60):
        b = rng.choice(bench[:12])[1].split()
        s = rng.randrange(len(b))
        docs.append((10 + i, text(rng.choice([0, 5, 200])) + "\n" + ", ".join(b[s : s + rng.choice([8, 9, 10, 11, 30])]) + ". " + text(7)))
    docs += [docs[9]] * 3 + [(10, "other text, same id"), (None, bench[3][1])]
    docs.append((500, text(3000) + " " + bench[2][1] + " zeta"))
    d = spark.createDataFrame([(i, t, "a", 5) for i, t in docs], "doc_id bigint, text string, words string, fp bigint")
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    got = dc.summarize(*dc.hits(d, b))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"]) for r in got.collect()), key=str)
    want = plain(docs, bench)
    assert got == want
    assert sum(x[2] > 0 for x in want) > 20
    kept = dc.keep_clean(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x[0]) for x in want if not x[2])


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    no = F.lit(False)
    assert dc.summarize(*dc.hits(d.where(no), b)).count() == 0
    assert [r.n_hit for r in dc.summarize(*dc.hits(d, b.where(no))).collect()] == [0]
    assert dc.keep_clean(d, b.where(no)).count() == 1
    assert dc.keep_clean(d, b).count() == 0
