"""Mixing sources to target weights by entropy balancing.

Each document gets a rate: how many times the mix takes it. Among all rates in
[0, ``cap``] whose words meet the token target of every source, the operator takes
those nearest to 1 in entropy, sum(r log r - r + 1). The dual of that convex
problem has one multiplier per source, and its solution tilts exponentially by the
constraint's coefficient, the document's size: r = min(cap, exp(lambda * size)).
Newton's iterations, guarded by a bracket, solve for the multipliers over the
table of (source, size) counts: documents of one source and size share a rate, so
that table holds all the dual needs, and every iteration is one aggregation of it.

Rounding into copies: going down a source's sizes, each class of equal size is
given the whole number of copies that brings the words taken nearest to the words
its rates ask for so far; so a source ends within about half its smallest document
of the target, unless the cap binds. Within a class the copies go round evenly, and
the odd ones to the documents of least hash. Ranks within a class are counted in
hash buckets, as many as the root of its size, so that no task needs a whole class:
neither the buckets of a class nor the documents of a bucket are many.

Nulls: a null text has size 0, a null source is a source of its own, the last by
order. Documents of size 0 take no words and get one copy. Repeated rows are documents of their own.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS, WORD, Scratch

MAX_STEPS = 60
#: A source is solved when its words differ from the target by this share at most.
TOLERANCE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share``
    times all words; a target stops at ``cap`` times its source's words and the
    excess goes to the others by weight, until none is above. Sorted by
    room per weight (cap * words / weight), the sources that stop are a prefix, so
    running sums give the final level in one pass. The sources, not the documents,
    pass through one window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("__w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("__room", cap * F.col("source_size") / F.col("__w"))
    by_room = Window.orderBy("__room", F.col("source").asc_nulls_last())
    upto = by_room.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = (
        ranked.withColumn("__total", F.sum("source_size").over(whole) * share)
        .withColumn("__stopped", F.coalesce(F.sum(cap * F.col("source_size")).over(upto), F.lit(0.0)))
        .withColumn("__left", F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(upto), F.lit(0.0)))
        .withColumn("__level", (F.col("__total") - F.col("__stopped")) / F.col("__left"))
    )
    ranked = ranked.withColumn("__rank", F.row_number().over(by_room))
    # The first source whose room exceeds the level fixes it for all after it.
    level = F.min_by("__level", F.when(F.col("__room") > F.col("__level"), F.col("__rank"))).over(whole)
    target = F.least(cap * F.col("source_size"), F.coalesce(level, F.lit(float("inf"))) * F.col("__w"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def solve(classes: DataFrame, targets: DataFrame, cap: float, scratch: Scratch) -> DataFrame:
    """``(source, lam)``: the multipliers, from ``classes(source, size, n)`` and ``targets``.

    ``lam`` applies to size over the source's mean size, kept as ``unit``. A source
    without words has lam 0; one whose target is its cap gets an infinite multiplier.
    """
    base = classes.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("unit"), F.min("size").alias("least"))
    t = targets.alias("t").join(base.alias("b"), F.expr("t.source <=> b.source"))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    # at lam = high every rate is at the cap; below, all documents lose more than the target asks
    high = F.log(F.lit(float(cap))) * F.col("unit") / F.col("least")
    state = t.select(
        F.col("t.source").alias("source"), "unit", "target",
        F.when(full, F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("lam"),
        F.lit(None).cast("double").alias("lo"), (high + 1e-9).alias("hi"), full.alias("done"),
    )
    state = scratch.keep(state, "dual")
    hist = classes.where("size > 0")
    for _ in range(MAX_STEPS):
        open_ = F.broadcast(state.where("not done")) if _few(state) else state.where("not done")
        h = hist.alias("h").join(open_.alias("s"), F.expr("h.source <=> s.source"))
        u = F.col("h.size") / F.col("s.unit")
        free = F.col("s.lam") * u < F.log(F.lit(float(cap)))
        tilt = F.when(free, F.exp(F.greatest(F.col("s.lam") * u, F.lit(-700.0)))).otherwise(float(cap))
        words = F.col("h.n") * F.col("h.size")
        sums = h.groupBy(F.col("s.source").alias("source")).agg(
            _exact_sum(words * tilt).alias("got"), _exact_sum(F.when(free, words * tilt * u).otherwise(0.0)).alias("slope")
        )
        near = F.abs(F.col("got") - F.col("s.target")) <= TOLERANCE * F.col("s.target")
        lo = F.when(F.col("got") < F.col("s.target"), F.col("s.lam")).otherwise(F.col("s.lo"))
        hi = F.when(F.col("got") >= F.col("s.target"), F.col("s.lam")).otherwise(F.col("s.hi"))
        # Newton on the log of the words: their growth in lam is nearly linear there
        step = F.col("s.lam") - F.log(F.try_divide("got", "s.target")) * F.try_divide("got", "slope")
        inside = (F.col("slope") > 0) & F.coalesce(step > lo, F.lit(True)) & (step < hi)
        middle = F.when(lo.isNull(), F.col("s.lam") * 2 - 1.0).otherwise((lo + hi) / 2)
        moved = F.when(near, F.col("s.lam")).otherwise(F.when(inside, step).otherwise(middle))
        new = (
            state.alias("s").join(sums.alias("g"), F.expr("s.source <=> g.source"), "left")
            .select(
                "s.source", "s.unit", "s.target",
                F.when(F.col("s.done"), F.col("s.lam")).otherwise(moved).alias("lam"),
                F.when(F.col("s.done"), F.col("s.lo")).otherwise(lo).alias("lo"),
                F.when(F.col("s.done"), F.col("s.hi")).otherwise(hi).alias("hi"),
                (F.col("s.done") | near | (F.col("s.target") <= 0)).alias("done"),
            )
        )
        new = scratch.keep(new, "dual")
        scratch.drop(state)
        state = new
        if not state.where("not done").take(1):
            break
    return state.select("source", "unit", "lam", "target")


def _exact_sum(x: Column) -> Column:
    """A sum that is the same in whatever order the rows come."""
    return F.sum(x.cast("decimal(38,6)")).cast("double")


def _whole_copies(classes: DataFrame, cap: float) -> DataFrame:
    """Adds ``each`` (copies of every document of the class) and ``odd`` (documents with one more).

    One source's classes pass through one task: a row for each distinct size, so at
    most as many as its longest document has words.
    """
    most = int(cap)

    def run(pdf):
        pdf = pdf.sort_values("size", ascending=False, kind="stable")
        each, odd, owed = [], [], 0.0
        for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"], strict=True):
            if size <= 0:
                total = n
            else:
                owed += n * rate * size
                total = min(max(round(owed / size), 0), most * n)
                owed -= total * size
            each.append(total // n)
            odd.append(total % n)
        return pdf.assign(each=each, odd=odd)

    schema = classes.select("source", "size", "n", "rate").schema.add("each", "long").add("odd", "long")
    return classes.select("source", "size", "n", "rate").groupBy("source").applyInPandas(run, schema)


def _few(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def copies(docs: DataFrame, targets: DataFrame, size: Column, source_col: str = "source", id_col: str = "doc_id", cap: float = 2.0) -> DataFrame:
    """``(doc, size, rate, copies)`` beside every row of ``docs``, kept as struct ``doc``.

    ``targets(source, source_size, target)`` gives the words wanted of each source,
    at most ``cap`` times its words.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    cap = float(cap)
    rows = docs.select(F.struct("*").alias("doc"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(id_col).alias("key"))
    classes = scratch.keep(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "classes")
    dual = solve(classes, targets, cap, scratch)

    c = classes.alias("c").join(dual.alias("d"), F.expr("c.source <=> d.source"), "left")
    lam_u = F.col("d.lam") * F.col("c.size") / F.col("d.unit")
    rate = F.when((F.col("c.size") <= 0) | F.col("d.lam").isNull(), 1.0).when(F.col("d.target") <= 0, 0.0).when(lam_u >= F.log(F.lit(cap)), cap).otherwise(F.exp(F.greatest(lam_u, F.lit(-700.0))))
    c = c.select(F.col("c.source").alias("source"), F.col("c.size").alias("size"), "n", F.least(rate, F.lit(cap)).alias("rate"))
    c = scratch.keep(_whole_copies(c, cap), "copies")

    # ranks in a class, by hash bucket, for the classes whose copies don't divide evenly
    bucket = F.when(F.col("odd") > 0, F.pmod(F.col("h"), F.ceil(F.sqrt(F.col("n")))))
    small = F.broadcast(c) if _few(c) else c
    r = rows.alias("r").join(small.alias("c"), F.expr("r.source <=> c.source and r.size = c.size"))
    r = r.select("doc", "r.source", "r.size", "h", "key", "rate", "each", "odd", "n", bucket.alias("bucket"))
    thin = r.where("odd > 0").groupBy("source", "size", "bucket", "odd").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    thin = thin.withColumn("before", F.coalesce(before, F.lit(0)))
    # whole buckets get one more copy or none; one bucket a class is split by rank
    split = scratch.keep(thin.where("before < odd").select("source", "size", "bucket", F.least(F.col("m"), F.col("odd") - F.col("before")).alias("take"), "m"), "buckets")
    few = F.broadcast(split) if _few(split) else split
    s = r.alias("r").join(few.alias("s"), F.expr("r.source <=> s.source and r.size = s.size and r.bucket = s.bucket"), "left")
    s = s.select("doc", F.col("r.source").alias("source"), F.col("r.size").alias("size"), "h", "key", "rate", "each", F.col("r.bucket").alias("bucket"), F.coalesce("take", F.lit(0)).alias("take"), "m")
    plain = s.where("take = 0 or take = m").select("doc", "size", "rate", (F.col("each") + (F.col("take") > 0).cast("long")).alias("copies"))
    part = s.where("take > 0 and take < m")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "key"))
    part = part.withColumn("rank", rank).select("doc", "size", "rate", (F.col("each") + (F.col("rank") <= F.col("take")).cast("long")).alias("copies"))
    return plain.union(part)


def mix(
    docs: DataFrame,
    size: Column,
    weights: list[float],
    share: float = 1.5,
    cap: float = 2.0,
    source_col: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """``(doc, size, rate, copies, source_size, target)`` for every row, with targets by ``share_targets``."""
    sizes = docs.select(F.col(source_col).alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    scratch = Scratch(docs.sparkSession, "targets")
    targets = scratch.keep(share_targets(sizes, weights, share, cap), "targets")
    out = copies(docs, targets, size, source_col, id_col, cap)
    t = F.broadcast(targets) if _few(targets) else targets
    out = out.alias("o").join(t.alias("t"), F.col("o.doc")[source_col].eqNullSafe(F.col("t.source")), "left")
    return out.select("doc", "size", "rate", "copies", "source_size", "target")


def repeated(mixed: DataFrame) -> DataFrame:
    """The documents of a mix, each as many times as it has copies, with their own columns."""
    return mixed.where("copies > 0").select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("doc.*")
