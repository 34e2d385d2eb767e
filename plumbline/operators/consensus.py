"""Voting over the readings of one field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.boxes import BOX
from plumbline.functions.measures import round_even
from plumbline.functions.text import canonical_text, normalize_value, strip

KEYS = ("document_id", "field")


def pass_index(pass_id):
    """The number at the end of a pass's name after its last dash, else 0."""
    return F.coalesce(F.regexp_extract(pass_id, r"-([0-9]+)$", 1).try_cast("int"), F.lit(0))


def vote(observations: DataFrame, fold=canonical_text) -> DataFrame:
    """One row for each (document_id, field) with a usable reading.

    ``observations``: document_id, field, kind (declared type), ord (order of the
    readings, unique in a field), pass_id, raw_value, quote, bbox, total_passes.
    Readings without normal form cast no vote. Those of equal folded form vote
    together; most votes win, then the lowest pass number, then the first read.
    ``agreement`` is the winners' share of all passes, also of those silent here.

    The rows are dealt out once, by document and field: both groupings share it.
    """
    o = observations.repartition(*KEYS).withColumn("normalized", normalize_value(F.col("raw_value"), F.col("kind")))
    o = o.withColumn("bucket", F.coalesce(F.nullif(fold(F.col("normalized")), F.lit("")), F.col("normalized")))
    box = F.col("bbox")
    buckets = o.groupBy(*KEYS, "bucket").agg(
        F.count("normalized").alias("votes"), F.min(F.when(F.col("normalized").isNotNull(), pass_index(F.col("pass_id")))).alias("first_pass"),
        F.min("ord").alias("first_ord"), F.min_by(F.struct("normalized", "raw_value", "quote"), "ord").alias("first"),
        F.min(box.x0).alias("x0"), F.min(box.y0).alias("y0"), F.max(box.x1).alias("x1"), F.max(box.y1).alias("y1"),
        F.count("*").alias("seen"), F.max("total_passes").alias("total_passes"),
    )
    usable = F.col("bucket").isNotNull()
    rank = F.when(usable, F.struct(F.col("votes"), -F.col("first_pass"), -F.col("first_ord")))
    best = F.max_by(F.struct("votes", "first", "x0", "y0", "x1", "y1"), rank)
    won = buckets.groupBy(*KEYS).agg(best.alias("w"), F.sum("seen").alias("seen"), F.max("total_passes").alias("total_passes"))
    out_of = F.greatest(F.coalesce("total_passes", F.lit(0)), F.col("seen"), F.lit(1))
    won = won.where(F.col("w").isNotNull())
    return won.select(
        *KEYS, F.col("w.first.normalized").alias("normalized"), strip(F.col("w.first.raw_value")).alias("display"),
        round_even(F.col("w.votes") / out_of).alias("agreement"), F.col("w.votes").alias("votes"), F.col("w.first.quote").alias("quote"),
        F.when(F.col("w.x0").isNotNull(), F.struct("w.x0", "w.y0", "w.x1", "w.y1")).cast(BOX).alias("bbox"),
    )
