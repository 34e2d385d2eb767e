"""The thin queries that apply each corpus operator to its table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm import decontaminate, lm_score, mixing, pii, quality_pu, quality_rules, simhash, token_output, token_rollup, url_filter
from plumbline.llm.common import Scratch, table


def op1_simhash(spark, sf_dir):
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links"
    )


def op2_pii(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans")
    )


def op3_decontaminate(spark, sf_dir):
    documents, windows = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    out = decontaminate.summarize(documents, windows)
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op5_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.judge(pages, URL_RULES, url_filter.labelled_urls(spark))
    return out.select("row.page_id", "host", "path", "rule", "verdict", "score")


def op6_token_rollup(spark, sf_dir):
    """Batches over all documents: inserts counted by two tokenizers, one of them sent
    again, revised counts of the first (each document's end id now counts), and deletes
    of all but the first of equal texts, with a compaction in between."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("same"), "text")
    scratch = Scratch(spark, "rollup")
    versions = {v: public_tokenizers.path(f"{v}.json") for v in ("byte_bpe_50k", "word_bpe_49k")}
    rows = scratch.keep(token_rollup.count_tokens(docs, versions), "counts")
    first = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    extra = rows.alias("r").join(first.alias("f"), F.expr("r.same <=> f.same")).where("doc_id <> first").select("r.*")
    none = F.lit(None).cast("long")

    def changes(df, op, version, old, new):
        return df.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"), old.alias("old_tokens"), new.alias("new_tokens"))

    store = token_rollup.TokenRollup(spark, scratch.path("store"))
    a, b = (F.col(v) for v in versions)
    store.apply("1", changes(rows, "insert", "byte_bpe_50k", none, a))
    store.apply("2", changes(rows, "insert", "word_bpe_49k", none, b))
    store.apply("2", changes(rows, "insert", "word_bpe_49k", none, b))
    store.apply("3", changes(rows, "revise", "byte_bpe_50k", a, a + 1))
    store.compact()
    store.apply("4", changes(extra, "delete", "byte_bpe_50k", a + 1, none).union(changes(extra, "delete", "word_bpe_49k", b, none)))
    return store.totals()


def op7_lm_score(spark, sf_dir):
    return lm_score.scores(table(spark, sf_dir, "documents"))


def op8_token_output(spark, sf_dir):
    import public_tokenizers

    return token_output.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_quality_pu(spark, sf_dir):
    out = quality_pu.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", quality_pu.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, F.col("size"), weights=[3, 1, 2], share=1.5, cap=2.0)
    return mixed.select(
        F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate"
    )


QUERIES = {"op1_simhash": op1_simhash, "op2_pii": op2_pii, "op3_decontaminate": op3_decontaminate, "op4_quality_rules": op4_quality_rules, "op5_url_filter": op5_url_filter, "op6_token_rollup": op6_token_rollup, "op7_lm_score": op7_lm_score, "op8_token_output": op8_token_output, "op9_quality_pu": op9_quality_pu, "op10_mixing": op10_mixing}
ORACLES: dict[str, str] = {
    "op7_lm_score": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
t AS (SELECT sum(len(words)) AS n FROM d),
w AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
p AS (SELECT rid, i, lag(w) OVER (PARTITION BY rid ORDER BY i) AS v, w FROM w),
o1 AS (SELECT rid, w, count(*) AS k FROM w GROUP BY rid, w),
c1 AS (SELECT o1.rid, o1.w, (sum(k) OVER (PARTITION BY w)) - k AS c FROM o1),
o2 AS (SELECT rid, v, w, count(*) AS k FROM p WHERE i > 1 GROUP BY rid, v, w),
c2 AS (SELECT rid, v, w, (sum(k) OVER (PARTITION BY v, w)) - k AS c FROM o2),
s AS (SELECT p.rid, CASE WHEN c2.c > 0 THEN ln(c2.c / h.c)
                         ELSE (CASE WHEN i > 1 THEN ln(0.4) ELSE 0 END) + (CASE WHEN e.c > 0 THEN ln(e.c) ELSE ln(0.4) END) - ln(nullif((SELECT n FROM t) - len(d.words), 0)) END AS x
      FROM p JOIN d USING (rid) JOIN c1 e ON e.rid = p.rid AND e.w = p.w
      LEFT JOIN c1 h ON h.rid = p.rid AND h.w = p.v LEFT JOIN c2 ON c2.rid = p.rid AND c2.v = p.v AND c2.w = p.w)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, round(m, 6) AS score
FROM d LEFT JOIN (SELECT rid, avg(x) AS m FROM s GROUP BY rid) USING (rid)
""",
}
