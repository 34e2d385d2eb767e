"""Personal data: patterns for known kinds, and bootstrapped contextual extraction.

Base: email, ip, card and phone, found left to right without overlap within a kind;
a match that fails its kind's test is dropped. Positions come from the lengths of
the pieces between matches, added up by a prefix sum, so a text of many matches
costs little more than its length. The patterns are anchored where a run of their
characters begins and take runs whole, which changes no match but keeps a long run
from being tried at each of its characters.

Bootstrapping: seeds are the base entities, and words of a form that keys and access
tokens have (``SECRET``). Words with a digit or an @, and runs of up to ``RUN`` of them
with single spaces between, are candidate instances, less the marks around them (longer
runs are taken word by word), and the word and the two words before are lexical patterns.
Patterns and instances form a graph. A pattern of a kind needs ``SUPPORT`` distinct
known instances before it counts, so copies of one do not make it. Each round scores
the patterns by the scores of the instances that follow them, over all that follows
their words in the corpus, with ``PRIOR`` doubtful ones added; and each unknown
instance by how sure its patterns are together (noisy or). Instances that reach
``ACCEPT`` are known from then on, and may make further patterns; rounds go on until
none is added and the scores rise by under ``RISE`` of their sum. Known instances, and words of the ``SECRET`` form, are marked wherever
a sure pattern precedes them; a form alone marks nothing. An accepted instance has an @
or ``LEAST_DIGITS`` digits at least, since fewer are years, versions and numbers of
things. All counts are partly added before each shuffle, so a common word is no single
task's load.

Texts are taken whole, and so are words of any length. Nulls: a null text is empty, a
null id is kept. Repeated rows get a row each, ties of kinds go to the last by name;
other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS, WORD, Scratch, is_empty, let, settle

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
_PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Public forms of keys and access tokens; they seed patterns.
SECRET = r"^(?:[0-9a-f]{40}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{32,}|xox[abprs]-[0-9A-Za-z-]{20,})$"
_CORE = r"(?s)[0-9A-Za-z+@(](?:.*[0-9A-Za-z])?"
#: Neighbouring words of a longer run are candidates one by one.
RUN = 4
PRIOR = 1.0
SUPPORT = 3
ACCEPT = 0.8
RISE = 1e-3
#: Digits that a discovered instance without an @ has at least.
LEAST_DIGITS = 5


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda acc, x: acc + x)


def _prefix_sum(a: Column, block: int = 256) -> Column:
    """Running sums of an array that isn't empty, by blocks: the sums before a block, then within it."""

    def running(x):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda k: _sum(F.slice(x, k * block + 1, F.lit(block))))
        before = let(blocks, lambda b: F.transform(b, lambda v, k: _sum(F.slice(b, F.lit(1), k))))
        at = lambda i: F.floor(i / block).cast("int")
        return let(before, lambda p: F.transform(x, lambda v, i: F.get(p, at(i)) + _sum(F.slice(x, at(i) * block + 1, i % block + 1))))

    return let(a, running)


def matches(text: Column, pattern: str) -> Column:
    """Array of structs (start, end, value), code points, end exclusive, of a pattern's matches."""

    def spans(found):
        def placed(pieces):
            gaps = F.transform(found, lambda m, i: F.char_length(F.get(pieces, i)) + F.when(i > 0, F.char_length(F.get(found, i - 1))).otherwise(0))
            return let(_prefix_sum(gaps), lambda at: F.transform(found, lambda m, i: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + F.char_length(m)).alias("end"), m.alias("value"))))

        return let(F.split(text, pattern), placed)

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) == 0, none).otherwise(spans(f)))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check; counted from the right, every second digit is doubled."""

    def add(acc, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (F.char_length(digits) - i) % 2 == 1
        return acc + F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return let(digits, lambda d: F.when(F.char_length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All valid base matches: an array of structs (start, order, end, kind, value) sorted by start, then kind."""
    may = {"email": text.contains("@"), "ip": text.rlike("[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string>>")
    parts = []
    for order, kind in enumerate(KINDS):
        good = F.filter(matches(text, _PATTERNS[kind]), _tester(kind))
        parts.append(F.when(may[kind], F.transform(good, _labelled(order, kind))).otherwise(none))
    return F.sort_array(F.concat(*parts))


def _tester(kind):
    return lambda m: _valid(kind, m.value)


def _labelled(order, kind):
    return lambda m: F.struct(m.start.alias("start"), F.lit(order).alias("order"), m.end.alias("end"), F.lit(kind).alias("kind"), m.value.alias("value"))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


_CANDIDATES = "array<struct<start:int,end:int,value:string,one:bigint,two:bigint,kind:string>>"


def _context(hashes: Column, i: Column) -> list[Column]:
    """Hashes of the word before place ``i`` of a text's words and of the two before."""
    before = lambda k: F.when(i >= k, F.get(hashes, i - k)).otherwise(F.lit(0).cast("long"))
    return [F.xxhash64(F.lit(1), before(1)), F.xxhash64(F.lit(2), before(2), before(1))]


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def candidates(text: Column, spans: Column) -> Column:
    """Runs of words with a digit or an @: where the part between marks is, its value, patterns before it, and the kind of a seed."""

    def runs(words):
        flag = lambda i: F.coalesce(F.get(words, i).value.rlike("[0-9@]"), F.lit(False))
        joined = lambda i: flag(i) & flag(i - 1) & F.coalesce(F.get(words, i - 1).end == F.get(words, i).start, F.lit(False))
        places = F.transform(words, lambda m, i: i)
        heads = F.filter(places, lambda i: flag(i) & ~F.when(i > 0, joined(i)).otherwise(F.lit(False)))
        stops = F.filter(places, lambda i: flag(i) & ~joined(i + 1))
        apart = lambda a, b: F.when(b - a < RUN, F.array(F.struct(a.alias("a"), b.alias("b")))).otherwise(F.transform(F.sequence(a, b), lambda k: F.struct(k.alias("a"), k.alias("b"))))
        return F.flatten(F.zip_with(heads, stops, apart))

    def of(words):
        def made(hashes):
            def one(r):
                whole = F.array_join(F.transform(F.slice(words, r.a + 1, r.b - r.a + 1), lambda m: m.value), "")
                first, last = F.get(words, r.a).start, F.get(words, r.b).end
                over = F.get(F.filter(spans, lambda s: (s.start < last) & (s.end > first)), 0)

                def row(core):
                    start = first + F.instr(whole, core) - 1
                    one_before, two_before = _context(hashes, r.a)
                    kind = F.when(core.rlike(SECRET), "secret").otherwise(over.kind)
                    return F.struct(start.alias("start"), (start + F.char_length(core)).alias("end"), core.alias("value"), one_before.alias("one"), two_before.alias("two"), kind.alias("kind"))

                return let(F.regexp_extract(whole, _CORE, 0), row)

            return F.transform(runs(words), one)

        return let(_hashes(F.transform(words, lambda m: F.rtrim(m.value))), made)

    none = F.array().cast(_CANDIDATES)
    return F.when(text.rlike("[0-9@]"), let(matches(text, WORD + r"\x20?"), of)).otherwise(none)


def _sent(df: DataFrame, rows: int | None = None) -> DataFrame:
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def discover(found: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame | None:
    """``(doc_id, key, start, end, kind)`` of marked instances among candidates ``found``; None if no pattern has the support."""
    edges = found.select(F.explode(F.array("one", "two")).alias("words"), "value", "kind").groupBy("words", "value", "kind").agg(F.count("*").alias("times"))
    edges = scratch.keep(edges, "edges")
    # no pattern ever has the support where fewer values than that follow
    heads = scratch.keep(edges.groupBy("words").agg(F.count_distinct("value").alias("v")).where(F.col("v") >= SUPPORT).select("words"), "heads")
    n_heads = heads.count()
    if not n_heads:
        return None
    # how often the heads' words lead to anything
    hashes = settle(texts, h=_hashes(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).select("h")
    pairs = hashes.select(F.explode(F.flatten(F.transform("h", lambda x, i: F.array(*_context(F.col("h"), i))))).alias("words"))
    if n_heads <= BROADCAST_ROWS:
        follow = pairs.join(F.broadcast(heads), "words", "left_semi").groupBy("words").agg(F.count("*").alias("followers"))
    else:  # counted before the shuffle, so that no common word is sent row by row
        follow = pairs.groupBy("words").agg(F.count("*").alias("followers")).join(heads, "words", "left_semi")
    follow = scratch.keep(follow, "followers")
    edges = edges.join(_sent(follow, n_heads), "words")
    edges = scratch.keep(edges, "graph")  # (words, value, kind, times, followers)
    known = scratch.keep(edges.where("kind is not null").select("value", "kind").distinct(), "known")
    if is_empty(known):
        return None
    score, total = None, 0.0
    enough = F.col("value").contains("@") | (F.regexp_count("value", F.lit("[0-9]")) >= LEAST_DIGITS)
    plain = edges.select("words", "value", "times", "followers", (F.col("kind").isNotNull()).alias("seed"))
    while True:
        weight = known.withColumn("weight", F.lit(1.0)).withColumn("sure", F.lit(1))
        if score is not None:
            others = score.join(known, ["value", "kind"], "left_anti").select("value", "kind", F.col("score").alias("weight"), F.lit(0).alias("sure"))
            weight = weight.union(others)
        graph = plain.join(weight, "value")
        patterns = graph.groupBy("words", "kind").agg(
            F.max("followers").alias("followers"), F.sum(F.col("weight") * F.col("times")).alias("got"), F.count_distinct(F.when(F.col("sure") == 1, F.col("value"))).alias("known")
        ).where(F.col("known") >= SUPPORT)
        patterns = patterns.select("words", "kind", F.least(F.lit(0.99), F.col("got") / (F.greatest("followers", "got") + PRIOR)).alias("p"))
        patterns = scratch.keep(patterns, "pattern-scores")
        score = plain.join(_sent(patterns), "words").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("score"), F.max("seed").alias("seed"))
        score = scratch.keep(score, "instance-scores")
        new = score.where((F.col("score") >= ACCEPT) & ~F.col("seed") & enough).select("value", "kind").join(known, ["value", "kind"], "left_anti")
        new = scratch.keep(new, "accepted")
        before, total = total, score.agg(F.sum("score")).first()[0] or 0.0
        if not is_empty(new):
            known = scratch.keep(known.union(new), "known")
        elif total - before <= RISE * total:
            break
    marked = found.where("kind is null or kind = 'secret'").withColumnRenamed("kind", "own").join(_sent(known), "value").where("own is null or own = kind")
    strong = patterns.where(F.col("p") >= ACCEPT / 2).select("kind", F.col("words").alias("by"))
    marked = marked.withColumn("by", F.explode(F.array("one", "two"))).join(_sent(strong), ["kind", "by"], "left_semi")
    return marked.groupBy("doc_id", "key", "start", "end").agg(F.max("kind").alias("kind"))


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, base, spans)`` for every row: sorted arrays of (start, order, end, kind, value).

    ``spans`` has the base spans and the discovered ones, whose value is null.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    # spans and candidates in one pass over the texts
    seen = settle(rows.withColumn("key", F.xxhash64("text")), spans=base_spans(F.col("text")))
    seen = settle(seen, cand=candidates(F.col("text"), F.col("spans"))).select("doc_id", "key", "spans", "cand")
    seen = scratch.keep(seen, "base")
    base = seen.select("doc_id", "key", "spans")
    more = discover(seen.select("doc_id", "key", F.inline("cand")), rows.select("text"), scratch)
    if more is None:
        return base.select("doc_id", F.col("spans").alias("base"), "spans")
    order = F.array_position(F.array(*map(F.lit, (*KINDS, "secret"))), F.col("kind")).cast("int") - 1
    more = more.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", order.alias("order"), "end", "kind", F.lit(None).cast("string").alias("value"))).alias("more"))
    more = scratch.keep(more, "discovered")
    n_spans = more.agg(F.sum(F.size("more"))).first()[0] or 0
    out = base.alias("b").join(_sent(more, n_spans).alias("m"), F.expr("b.key = m.key and b.doc_id <=> m.doc_id"), "left")
    return out.select("b.doc_id", F.col("spans").alias("base"), F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.sort_array(F.concat("spans", "more"))).alias("spans"))
