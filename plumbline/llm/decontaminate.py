"""Benchmark decontamination by winnowing.

Words: A-Z lower-cased, runs of ASCII letters and digits and of all characters
beyond ASCII. The hashes of all ``gram``-word grams slide under a window of
``window - gram + 1`` grams, and the least hash of each window is its fingerprint;
a window spans ``window`` words, so two texts that share that many words in a row
share a fingerprint. The distinct fingerprints of the documents meet those of the
benchmark in one join; hits are then extended: every window of a hit document that
carries a hit fingerprint is compared word for word with the benchmark's windows,
and neighbouring windows merge into spans. No shared span of ``window`` words is
missed, and the comparison leaves no false one. An item shorter than a window (but
not empty) is one window of its own length.

Nulls: a null text has no words, a null item id is a hit of no countable item.
Repeated rows get a result each; empty tables give empty results or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS, Scratch, ascii_lower, let, settle

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 6
#: Hit documents that may be broadcast, each with its hit fingerprints.
HIT_DOCS = 50_000


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def _from(a: Column, k: int) -> Column:
    """The array without its first ``k`` elements."""
    return F.slice(a, F.lit(k + 1), F.greatest(F.size(a) - k, F.lit(0))) if k else a


def _pairs(a: Column, k: int, f) -> Column:
    """``f`` of each element and the one ``k`` further on; ``a`` is evaluated once."""
    return let(a, lambda x: F.zip_with(x, _from(x, k), f))


def _grams(h: Column, n: int) -> Column:
    """A hash for each run of ``n`` elements, by doubling."""

    def go(power, width, out, done):
        if n & width:
            out = power if out is None else F.zip_with(out, _from(power, done), lambda x, y: F.xxhash64(x, y))
            done += width
        if done == n:
            return out
        return let(_pairs(power, width, lambda x, y: F.xxhash64(x, y)), lambda p: go(p, 2 * width, out, done))

    return F.slice(go(h, 1, None, 0), F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0)))


def _least(a: Column, n: int) -> Column:
    """The least of each run of ``n`` elements."""

    def go(out, width):
        if width == n:
            return out
        step = min(width, n - width)
        return go(_pairs(out, step, lambda x, y: F.least(x, y)), width + step)

    return let(a, lambda x: F.slice(go(x, 1), F.lit(1), F.greatest(F.size(x) - (n - 1), F.lit(0))))


def _window_prints(hashes: Column, length: int, window: int, gram: int) -> Column:
    """The fingerprint of each window of ``length`` words."""
    if length < window:
        return F.transform(_grams(hashes, length), lambda x: F.xxhash64(x, F.lit(length)))
    return _least(_grams(hashes, gram), window - gram + 1)


def _hashed(df: DataFrame, text: Column) -> DataFrame:
    df = settle(df, words=tokens(text))
    return settle(df, hashes=F.transform("words", lambda w: F.xxhash64(w)))


def benchmark_windows(bench: DataFrame, text_col: str, item_col: str, window: int, gram: int) -> DataFrame:
    """``(item_id, fp, n, words)`` for every window of the benchmark; ``words`` joined by spaces."""
    b = _hashed(bench.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("text")), F.col("text"))
    b = b.where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(window)))
    prints = F.lit(None).cast("array<bigint>")
    for n in range(1, window + 1):
        prints = F.when(F.col("n") == n, _window_prints(F.col("hashes"), n, window, gram)).otherwise(prints)
    b = settle(b.select("item_id", "n", "words", "hashes"), prints=prints)
    b = b.select("item_id", "n", "words", F.posexplode("prints").alias("at", "fp"))
    return b.select("item_id", "fp", "n", F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ").alias("words")).distinct()


def hits(
    docs: DataFrame,
    bench: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_col: str = "item_id",
    window: int = WINDOW,
    gram: int = GRAM,
) -> tuple[DataFrame, DataFrame]:
    """``(documents, windows)``.

    ``documents(doc_id, key, n_words)`` has a row per document; ``windows(doc_id,
    key, start, n, words)`` one per document window that occurs in the benchmark,
    ``start`` in words from 0. ``key`` tells texts of one id apart. A third table,
    the benchmark's windows, hangs on ``windows.bench``.
    """
    scratch = Scratch(docs.sparkSession, "winnow")
    test = scratch.keep(benchmark_windows(bench, text_col, item_col, window, gram), "benchmark")
    lengths = sorted(r.n for r in test.select("n").distinct().collect())  # at most `window` values

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = F.xxhash64("text").alias("key")
    train = _hashed(base.select("doc_id", key, "text"), F.col("text")).drop("text", "words_text")
    prints = F.array().cast("array<bigint>")
    for n in lengths:
        prints = F.concat(prints, _window_prints(F.col("hashes"), n, window, gram))
    train = train.select("doc_id", "key", F.size("words").alias("n_words"), F.array_distinct(prints).alias("prints"))
    train = scratch.keep(train, "fingerprints")

    want = test.select("fp").distinct()
    want = F.broadcast(want) if want.count() <= BROADCAST_ROWS else want
    found = train.select("doc_id", "key", F.explode("prints").alias("fp")).join(want, "fp")
    found = scratch.keep(found.groupBy("doc_id", "key").agg(F.collect_set("fp").alias("found")), "found")

    few = F.broadcast(found) if found.count() <= HIT_DOCS else found
    again = base.withColumn("key", F.xxhash64("text")).alias("d").join(few.alias("f"), F.expr("d.key = f.key and d.doc_id <=> f.doc_id"))
    again = again.select("d.doc_id", "d.key", "text", "found").dropDuplicates(["doc_id", "key"])
    again = _hashed(again, F.col("text")).select("doc_id", "key", "words", "hashes", "found")
    parts = None
    for n in lengths:
        part = settle(again, prints=_window_prints(F.col("hashes"), n, window, gram))
        part = part.select(
            "doc_id", "key",
            F.explode(
                F.transform(
                    F.filter(F.transform("prints", lambda x, i: F.struct(x.alias("fp"), i.alias("at"))), lambda s: F.array_contains("found", s.fp)),
                    lambda s: F.struct(s.at.alias("start"), F.array_join(F.slice("words", s.at + 1, n), " ").alias("words")),
                )
            ).alias("w"),
        ).select("doc_id", "key", F.col("w.start").alias("start"), F.lit(n).alias("n"), F.col("w.words").alias("words"))
        parts = part if parts is None else parts.union(part)
    whole = test.select("words").distinct()
    whole = F.broadcast(whole) if whole.count() <= BROADCAST_ROWS else whole
    if parts is None:
        parts = train.limit(0).select("doc_id", "key", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("words"))
    windows = scratch.keep(parts.join(whole, "words").select("doc_id", "key", "start", "n", "words"), "windows")
    windows.bench = test
    return train.select("doc_id", "key", "n_words"), windows


def covered(spans: Column) -> Column:
    """Words covered by an array of structs (start, n)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def add(acc, s):
        end = F.greatest(acc.end, s.start + s.n)
        return F.struct(end.alias("end"), (acc.total + end - F.greatest(acc.end, s.start)).alias("total"))

    def step(acc, s):
        return F.when(s.start + s.n > acc.end, add(acc, s)).otherwise(acc)

    return F.aggregate(F.sort_array(spans), start, step).total


def summarize(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items)`` per document; ``items`` sorted strings."""
    n_hit = windows.groupBy("doc_id", "key").agg(covered(F.collect_set(F.struct("start", "n"))).alias("n_hit"))
    test = windows.bench.select("item_id", "words").distinct()
    test = F.broadcast(test) if test.count() <= BROADCAST_ROWS else test
    items = windows.select("doc_id", "key", "words").distinct().join(test, "words").where("item_id is not null")
    items = items.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    both = n_hit.alias("h").join(items.alias("i"), F.expr("h.key = i.key and h.doc_id <=> i.doc_id"), "left").select("h.doc_id", "h.key", "n_hit", "items")
    both = F.broadcast(both) if both.count() <= HIT_DOCS else both
    out = documents.alias("d").join(both.alias("b"), F.expr("d.key = b.key and d.doc_id <=> b.doc_id"), "left")
    items = F.coalesce("b.items", F.array().cast("array<string>"))
    return out.select(
        "d.doc_id", "d.key", F.col("d.n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), items.alias("items"),
    )


def keep_clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` without a word in a benchmark window."""
    _, windows = hits(docs, bench, text_col, id_col, **how)
    bad = windows.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(bad, F.xxhash64(F.col(text_col)).eqNullSafe(F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_anti")
