"""The pipeline's stages on a small corpus with planted cases, each held against its own input."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm.simhash import fingerprint


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("aeiourstnl") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [text(30) for _ in range(5)]
    rows, labels = [], []
    for i in range(500):
        words = text(rng.randrange(40, 200)).split()
        bad = i % 7 == 0
        if bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words) + ".", "en", f"src{i % 3}", 0))
        if i % 2:
            labels.append((i, int(not bad), 0))
    clean = [r for r in rows if r[0] % 7]
    rows += [(600 + i, clean[i][1], "en", "src1", 0) for i in range(20)]
    rows += [(700 + i, clean[30 + i][1] + " " + bench[i % 5] + " " + text(20), "en", "src2", 0) for i in range(10)]
    d = str(tmp_path_factory.mktemp("sf"))
    for name, data, schema in (("documents", rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", list(enumerate(bench)), "item_id bigint, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert len(stage) == 5
    good = stage["quality classifier"](spark, docs, folder)
    assert good.columns == docs.columns
    kept = ids(good)
    assert sum(i % 7 == 0 for i in kept if i < 500) < 11 and sum(i % 7 != 0 for i in kept if i < 500) > 420
    single = stage["SimHash near-dedup"](spark, good, folder)
    assert single.columns == docs.columns
    text = {r.doc_id: r.text for r in good.collect()}
    fps = sorted((i, fingerprint(t.encode(), 3)) for i, t in text.items())
    want = {i for i, f in fps if not any(j < i and bin(f ^ g).count("1") <= 2 for j, g in fps)}
    assert ids(single) == want and not any(600 <= i < 700 for i in want)
    clean = stage["benchmark decontamination"](spark, single, folder)
    assert clean.columns == docs.columns and ids(clean) == {i for i in want if i < 700}
    mixed = stage["mixing sources to target weights"](spark, clean, folder)
    assert mixed.columns == docs.columns and ids(mixed) <= ids(clean)
    out = stage["token-ID / binary output"](spark, mixed, folder).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted((r.doc_id, r.n_tokens) for r in out) == sorted((r.doc_id, len(tok.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed.collect())
    assert sorted(map(tuple, out)) == sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
