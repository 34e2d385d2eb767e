"""Rollups against a plain ledger: retries, compactors that overlap, writers in between, real tokenizers."""

import threading
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import queries, token_rollup
from plumbline.llm.token_rollup import TokenRollup

SCHEMA = "op string, source string, lang string, tokenizer_version string, old_tokens bigint, new_tokens bigint, n_docs string"


def batch(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def totals(store):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_ledger(spark, tmp_path):
    store = TokenRollup(spark, str(tmp_path / "s"))
    assert totals(store) == {} and not store.compact()
    first = batch(spark, *[("insert", "web", "en", "v1", None, 10)] * 2, ("insert", None, None, None, None, None), ("insert", "b", "de", "v1", None, 7))
    assert store.apply("a/1", first) and not store.apply("a/1", first)
    assert store.apply("empty", first.where("false"))
    assert store.apply("2", batch(spark, ("revise", "web", "en", "v1", 10, 4), ("delete", "b", "de", "v1", 7, None)))
    want = {("web", "en", "v1"): (2, 14), (None, None, None): (1, 0)}
    assert totals(store) == want
    assert store.compact() and not store.compact()
    assert totals(store) == want and store.committed() == {"a/1", "empty", "2"} and not store.apply("2", first)
    with pytest.raises(Exception, match="unknown op"):
        store.apply("bad", batch(spark, (None, "web", "en", "v1", 1, 1)))
    assert totals(TokenRollup(spark, str(tmp_path / "s"))) == want


class _Meeting(TokenRollup):
    """Waits for its partner after it has read the log and summed, before it publishes."""

    meet = None

    def _append(self, entry, still):
        if self.meet is not None:
            self.meet()
        return super()._append(entry, still)


def test_two_compactors_and_a_writer(spark, tmp_path):
    """Both sum the same entries; one is published, the other gives up, and a batch between them counts once."""
    store = TokenRollup(spark, str(tmp_path / "s"))
    for k in range(3):
        store.apply(str(k), batch(spark, ("insert", "web", "en", "v1", None, 5)))
    one, two = _Meeting(spark, str(tmp_path / "s")), _Meeting(spark, str(tmp_path / "s"))
    seen = []

    def between():
        seen.append(store.compact())
        store.apply("late", batch(spark, ("insert", "web", "en", "v1", None, 1)))

    one.meet = between
    seen.append(one.compact())
    assert seen == [True, False] and totals(store) == {("web", "en", "v1"): (4, 16)}
    gate = threading.Barrier(2)
    one.meet = two.meet = gate.wait
    done = []
    both = [threading.Thread(target=lambda s=s: done.append(s.compact())) for s in (one, two)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert sorted(done) == [False, True] and totals(store) == {("web", "en", "v1"): (4, 16)}


def test_writers_at_once(spark, tmp_path):
    """Several writers send the same two batches at the same time; each counts once."""
    stores = [_Meeting(spark, str(tmp_path / "s")) for _ in range(4)]
    gate = threading.Barrier(4)
    done = []

    def send(k, s):
        s.meet = gate.wait
        done.append(s.apply(str(k % 2), batch(spark, ("insert", "web", "en", "v1", None, 1 + k % 2))))

    threads = [threading.Thread(target=send, args=x) for x in enumerate(stores)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == [False, False, True, True]
    assert totals(stores[0]) == {("web", "en", "v1"): (2, 3)}
    assert not [p for p in (tmp_path / "s" / "entries").iterdir() if not p.name.startswith(".")]


def test_query_against_a_plain_count(spark, tmp_path):
    texts = ["Hello  world, 12", "one two", "one two", None, None, "", "É" * 50, " a\n\nb ", "x" * 3000]
    rows = [(i, t, "en" if i % 2 else None, "web" if i != 3 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in queries.op6_token_rollup(spark, str(tmp_path)).collect()}
    want = Counter(), Counter()
    for version, end in (("byte_bpe_50k", 1), ("word_bpe_49k", 0)):
        t = Tokenizer.from_file(public_tokenizers.path(f"{version}.json"))
        for i, (text, lang, source) in enumerate((r[1], r[2], r[3]) for r in rows):
            if text in texts[:i]:
                continue
            want[0][source, lang, version] += 1
            want[1][source, lang, version] += len(t.encode(text or "", add_special_tokens=False).ids) + end
    assert got == {k: (n, want[1][k]) for k, n in want[0].items()}
    empty = spark.createDataFrame([], "text string, k int")
    assert token_rollup.count_tokens(empty, {"v": public_tokenizers.path("byte_bpe_50k.json")}).count() == 0
