"""Token files: exact ids against plain calls of the tokenizer, and random access."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import token_output as out
from plumbline.llm.common import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "\n\n a", "x y z", "é ü ß", "don't  can't 's 'll", "#", "a # b",
    "tabs\tand\x0bmore \x1c x", "日本 語 　 x", "🙂 🙂🙂 é e ́", "1 22 333,444.", "<|endoftext|> a <|endoftext|>b", "a, b. c., d,, é. 9.",
    "x" * 5000, "word, " * 4000 + "end", "line.\nNext line,\nlast", "퟿ ﻿ z", "_a_ b_c. d'e,", "Aa. Aa, Aa . , .",
]


def plain(texts):
    tok = Tokenizer.from_file(PATH)
    return [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_encoder_matches_the_tokenizer():
    rng = random.Random(4)
    bits = ["a", "the", "é", "9", " ", " ", "\n", ".", ",", "'", "'s", "#", " ", "_", "日", "́", "Ab"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    coder = out.Encoder(open(PATH, encoding="utf-8").read())
    got = [np.frombuffer(x, coder.dtype).tolist() + [2] for i in range(0, len(texts), 100) for x in coder.encode(texts[i : i + 100])]
    assert got == plain(texts)


def test_round_trip_and_random_access(spark, tmp_path):
    rows = [(i * 3 - 5, t) for i, t in enumerate(TEXTS)] + [(400, "again"), (400, "again")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, name string, part int").repartition(5)
    got = sorted(map(tuple, out.round_trip(docs, PATH, 2).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    ordered = sorted(rows, key=lambda r: r[0])
    want, at = [], 0
    for (i, _), ids in zip(ordered, plain([t for _, t in ordered]), strict=True):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want

    uri = f"file://{tmp_path}/tokens"
    manifest = out.write(docs, PATH, uri, 2, seq_len=16).collect()
    assert sum(r.n_docs for r in manifest) == len(rows) and sum(r.n_tokens for r in manifest) == at
    stream = [x for _, t in ordered for x in plain([t])[0]]
    found = []
    for r in sorted(manifest, key=lambda r: r.part):
        for i in range(-(-r.n_tokens // 16)):
            held = pa.total_allocated_bytes()
            ids, mask = out.sequence(f"{uri}/{r.name}.arrow", i)
            assert pa.total_allocated_bytes() == held and not ids.flags.owndata  # views of the map
            assert len(ids) == len(mask) == 16
            found += ids[mask.to_numpy(zero_copy_only=False)].tolist()
    assert found == stream


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None)], "doc_id bigint, text string")
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in out.round_trip(docs, PATH, 2).collect()) == [(0, None, 2), (2, 1, 1)]
    assert out.round_trip(docs.where(F.lit(False)), PATH, 2).count() == 0
    assert Scratch(spark, "x").root.startswith("file:///")


def test_files_stay_in_an_output_folder(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert out.round_trip(docs, PATH, 2, out_uri=str(tmp_path)).count() == 1
    assert len([p for p in tmp_path.rglob("*.arrow") if not p.name.startswith(".")]) == 2


def test_encoded_words_are_the_ids_of_plain_calls():
    rng = random.Random(3)
    alphabet = ["a", "É", "é", " ", "\n", "\t", ".", ",", "'s", "12", "  ", "Σ", "ΑΣ", "\x1c", "́", "<|endoftext|>", "ﬁ", "中", "-", "İ", "'", "\x85", "word", "क़"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for name, table in (("word_bpe_49k.json", "by_part"), ("byte_bpe_50k.json", "by_word")):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            coder = out.Encoder(f.read())
        assert getattr(coder, table)
        assert [x for i in range(0, len(texts), 500) for x in coder.encode(texts[i : i + 500])] == coder._plain(texts)


def test_counts_are_the_numbers_of_ids_of_plain_calls(monkeypatch):
    rng = random.Random(4)
    alphabet = ["a", "É", " ", " ", "\n", "\t", ".", ",", "'s", "12", "  ", "ΑΣ", "\x1c", "́", "<|endoftext|>", "中", "İ", "\x85", "word", "क़"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        for room in (0, 50, out.COUNTED):
            monkeypatch.setattr(out, "COUNTED", room)
            with open(public_tokenizers.path(name), encoding="utf-8") as f:
                coder = out.Encoder(f.read())
            plain = [len(ids) // coder.dtype.itemsize for ids in coder._plain(texts)]
            assert [n for i in range(0, len(texts), 500) for n in coder.count(texts[i : i + 500])] == plain
            assert len(coder.counts) <= room


def test_words_that_come_again_are_encoded_twice_at_most(monkeypatch):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        coder = out.Encoder(f.read())
    monkeypatch.setattr(out, "WORDS", 60)
    monkeypatch.setattr(out, "AGAIN", 40, raising=False)
    asked, spaced = [], coder._spaced

    def counted(words):
        asked.extend(words)
        return spaced(words)

    monkeypatch.setattr(coder, "_spaced", counted)
    texts = [["once " + " ".join(f"w{i}x{k}q" for k in range(50)) + " late words. late, 3. w\nlate." * (i > 2)] for i in range(20)]
    plain = [coder._plain(t) for t in texts]
    assert [coder.encode(t) for t in texts] == plain
    assert asked.count("late") <= 2 and asked.count("words") <= 2
    assert len(coder.words) + len(getattr(coder, "fresh", ())) <= 60
