"""Weighted votes over several readings of one image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.measures import round_even
from plumbline.functions.plates import compose, find_cn_plate, grader_normalize, plausibility

CONSENSUS = 0.6
LEAST_READINGS = 3


def usable(readings: DataFrame) -> DataFrame:
    """Readings (image_id, view_ord, weight, kind, lines) with a line that isn't blank."""
    return readings.where(F.exists("lines", lambda s: s.rlike(r"(?U)[^\s\x1c-\x1f]")))


def majority_kind(readings: DataFrame) -> DataFrame:
    """``(image_id, kind)`` of most weight; a reading with a Chinese registration counts as one of those."""
    k = F.when(find_cn_plate(F.array_join("lines", " ")).isNotNull(), "cn_plate").otherwise(F.col("kind"))
    per = readings.withColumn("kind", k).groupBy("image_id", "kind").agg(F.sum("weight").alias("w"), F.min("view_ord").alias("first"))
    return per.groupBy("image_id").agg(F.max_by("kind", F.struct("w", -F.col("first"))).alias("kind"))


def candidates(readings: DataFrame, kinds: DataFrame) -> DataFrame:
    """Each usable reading's composed text and its normal form; empty ones go."""
    c = readings.drop("kind").join(kinds, "image_id").withColumn("text", compose(F.col("kind"), F.col("lines")))
    return c.withColumn("norm", grader_normalize(F.col("text"))).where("norm <> ''").select("image_id", "view_ord", "weight", "kind", "text", "norm")


def vote(readings: DataFrame) -> DataFrame:
    """``(image_id, text, confidence, kind)`` for every image that has a row.

    Equal normal forms vote together: most weight wins, then plausibility, then the
    first view. Without consensus, readings of the most common length vote character
    by character. All groupings are by image, so the rows are dealt out once.
    """
    r = readings.repartition("image_id")
    able = usable(r)
    kinds = majority_kind(able)
    c = candidates(able, kinds)
    texts = c.groupBy("image_id", "norm").agg(
        F.sum("weight").alias("w"), F.min("view_ord").alias("first"), F.min_by("text", "view_ord").alias("text"), F.first("kind").alias("kind")
    )
    texts = texts.withColumn("rank", F.struct("w", plausibility(F.col("kind"), F.col("text")).alias("p"), -F.col("first")))
    won = texts.groupBy("image_id").agg(
        F.max_by(F.struct("norm", "text", "w"), "rank").alias("won"), F.sum("w").alias("total"), F.map_from_entries(F.collect_list(F.struct("norm", "w"))).alias("weights")
    )
    merged = _by_character(c)
    v = kinds.join(won, "image_id", "left").join(merged, "image_id", "left")
    support = F.col("won.w") / F.col("total")
    other = (support < CONSENSUS) & F.col("merged").isNotNull() & (F.col("merged") != F.col("won.norm"))
    other = F.coalesce(other, F.lit(False))
    text = F.when(other, F.col("merged")).otherwise(F.coalesce("won.text", F.lit("")))
    lifted = F.greatest(support, F.coalesce(F.element_at("weights", F.col("merged")), F.lit(0.0)) / F.col("total"))
    share = F.when(other, lifted).otherwise(support)
    sure = F.when(F.col("won").isNull(), 0.0).otherwise(round_even(F.least(F.lit(0.99), 0.35 + 0.64 * share), 2))
    v = v.select("image_id", text.alias("text"), sure.alias("confidence"), "kind")
    images = r.select("image_id").distinct()
    return images.join(v, "image_id", "left").select("image_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("kind", F.lit("other")).alias("kind"))


def _by_character(c: DataFrame) -> DataFrame:
    """``(image_id, merged)`` where enough readings have the length of most weight."""
    c = c.withColumn("n", F.char_length("norm"))
    lengths = c.groupBy("image_id", "n").agg(F.sum("weight").alias("w"), F.min("view_ord").alias("first"), F.count("*").alias("readings"))
    common = lengths.groupBy("image_id").agg(F.max_by(F.struct("n", "readings"), F.struct("w", -F.col("first"))).alias("c"))
    common = common.where(F.col("c.readings") >= LEAST_READINGS).select("image_id", "c.n")
    chars = c.join(common, ["image_id", "n"]).select("image_id", "view_ord", "weight", F.posexplode(F.filter(F.split("norm", ""), lambda x: x != "")).alias("at", "char"))
    per = chars.groupBy("image_id", "at", "char").agg(F.sum("weight").alias("w"), F.min("view_ord").alias("first"))
    best = per.groupBy("image_id", "at").agg(F.max_by("char", F.struct("w", -F.col("first"))).alias("char"))
    return best.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "char"))), lambda s: s.char), "").alias("merged"))


def prefix_votes(readings: DataFrame, order: str = "arrival") -> DataFrame:
    """The verdict after each reading, from all that came before it: ``(image_id, arrival, text, confidence, kind)``.

    Every prefix becomes an image of its own for ``vote``; an image has a handful of views.
    """
    w = Window.partitionBy("image_id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sofar = readings.withColumn("__r", F.collect_list(F.struct("view_ord", "weight", "kind", "lines")).over(w))
    each = sofar.select(F.struct("image_id", F.col(order).alias("arrival")).alias("image_id"), F.explode("__r").alias("r")).select("image_id", "r.*")
    return vote(each).select("image_id.image_id", "image_id.arrival", "text", "confidence", "kind")


def points(verdicts: DataFrame, expected: DataFrame, each: int = 20) -> DataFrame:
    """Self-check: points for each exact match in normal form; an image without expectation expects nothing."""
    j = verdicts.join(expected, "image_id", "left").withColumn("expected", F.coalesce("expected", F.lit("")))
    return j.withColumn("points", F.when(grader_normalize(F.col("text")) == grader_normalize(F.col("expected")), each).otherwise(0))
