"""Quality rules: base statistics against a plain scan, outliers on planted texts."""

import random
import re

from pyspark.sql import functions as F

from plumbline.llm import quality_rules as qr

SCHEMA = "doc_id bigint, text string, lang string, source string, words string, z int, n_words string"


def plain(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    n, seen, cov = len(w), {}, set()
    for i in range(n - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for v in seen.values():
        if len(v) > 1:
            for i in v:
                cov |= set(range(i, i + 8))
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cov), n < 20 or 100 * len(cov) > 30 * n


def test_statistics_and_outliers(spark):
    rng = random.Random(2)
    text = lambda n, end="": " ".join(rng.choice("abcdefgh") * rng.randrange(2, 9) + str(rng.randrange(300)) + end for _ in range(n))
    texts = [None, "", "\t \n", "one two", "a\n a\na\n\na", "x " * 50, text(40) + "\n" + text(3), "é|" * 30]
    block = text(12)
    texts += [block + "\n" + text(60) + "\n" + block, text(15000), (text(9) + " ") * 6]
    start = len(texts)
    texts += [text(rng.randrange(25, 300)) for _ in range(150)]
    texts += [text(80, "###") for _ in range(8)] + [text(80).upper() for _ in range(8)]
    texts += [texts[20]] * 60
    rows = [(i, t, "en" if i % 9 else None, "s" if i % 3 else None, "", 1, "") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in qr.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), i
        assert not (r.base_failed and r.kept)
    assert all(got[i].kept for i in range(start, start + 150))
    judged = [i for i in range(start + 150, start + 166) if got[i].distance2 is not None]
    assert judged and not any(got[i].kept for i in judged)


def test_small_groups_and_empty_table(spark):
    rows = [(1, "word " * 19 + "x", None, None, "", 1, ""), (1, " ".join(map(str, range(30))), "en", "s", "", 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.kept for r in qr.judge(df).collect()) == [False, True]
    assert qr.judge(df.where(F.lit(False))).count() == 0


def test_chi_square():
    assert abs(qr.chi2_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(qr.chi2_quantile(0.75, 7) - 9.0371) < 1e-3
