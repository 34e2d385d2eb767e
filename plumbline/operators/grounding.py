"""Finding values in reference texts: exact containment first, fuzzy matching for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.measures import round_even
from plumbline.functions.similarity import fuzzy_ground
from plumbline.functions.text import canonical_text, strip

MIN_RATIO = 0.86
SLACK = 12


def ground(df: DataFrame, value: str, reference: str, min_ratio: float = MIN_RATIO, slack: int = SLACK, fold=canonical_text) -> DataFrame:
    """Adds ``grounded``, ``grounding_score`` and ``grounding_quote``.

    A value whose folded form is part of the folded text scores 1. Only the others
    are matched fuzzily; contained ones reach the Python side as nulls. A blank
    value or text scores 0.
    """
    v, r = strip(F.col(value)), F.col(reference)
    df = df.withColumn("__v", F.nullif(v, F.lit(""))).withColumn("__r", F.when(F.nullif(strip(r), F.lit("")).isNotNull(), r))
    both = F.col("__v").isNotNull() & F.col("__r").isNotNull()
    df = df.withColumn("__needle", fold(F.col("__v"))).withColumn("__hay", fold(F.col("__r")))
    exact = both & (F.col("__needle") != "") & F.col("__hay").contains(F.col("__needle"))
    df = df.withColumn("__exact", F.coalesce(exact, F.lit(False))).drop("__needle", "__hay")
    ask = ~F.col("__exact") & both
    df = df.withColumn("__fuzzy", fuzzy_ground(F.when(ask, F.col("__v")), F.when(ask, F.col("__r")), F.lit(float(min_ratio)), F.lit(slack)))
    score = F.when(F.col("__exact"), 1.0).otherwise(F.coalesce("__fuzzy.score", F.lit(0.0)))
    df = df.withColumn("grounded", (F.col("__exact") | (ask & (score >= min_ratio))))
    df = df.withColumn("grounding_score", F.when(F.col("__exact"), 1.0).otherwise(round_even(score)))
    return df.withColumn("grounding_quote", F.when(F.col("__exact"), F.col("__v")).otherwise(F.col("__fuzzy.quote"))).drop("__v", "__r", "__exact", "__fuzzy")


SEED = 12
#: So few values are compared with every text where it lies.
FEW_VALUES = 500


def contained_in(values: DataFrame, texts: DataFrame, value: str, text: str, value_id: str, text_id: str, fold=canonical_text) -> DataFrame:
    """``(value_id, text_id)`` of every value whose folded form is part of a folded text.

    The corpus form of grounding. Up to FEW_VALUES values are sent to the texts and
    compared there. Beyond that there is no nested loop: a value of SEED folded
    characters or more is looked up by its first SEED characters, at each place of a
    text where some value begins so: distinct seeds of the values meet the distinct
    seeds of the texts in a hash join, and only pairs that share one are compared.
    Shorter values are looked up whole, a pass over the texts for each such length.
    """
    v = values.select(F.col(value_id), fold(F.col(value)).alias("__needle")).where("__needle <> ''")
    v = v.withColumn("__n", F.least(F.char_length("__needle"), F.lit(SEED))).withColumn("__seed", F.substring(F.col("__needle"), F.lit(1), F.col("__n")))
    if v.limit(FEW_VALUES + 1).count() <= FEW_VALUES:
        t = texts.select(F.col(text_id), fold(F.col(text)).alias("__hay"))
        return t.join(F.broadcast(v), F.col("__hay").contains(F.col("__needle"))).select(value_id, text_id)
    lengths = [r[0] for r in v.select("__n").distinct().collect()]  # at most SEED values
    t = texts.select(F.col(text_id), fold(F.col(text)).alias("__hay"))
    pieces = F.array_distinct(F.concat(F.array().cast("array<string>"), *(_pieces(F.col("__hay"), n) for n in lengths)))
    seeds = t.select(F.col(text_id).alias("__t"), F.explode(pieces).alias("__seed"))
    pairs = seeds.join(v.select("__seed", F.col(value_id).alias("__v")), "__seed").select("__t", "__v").distinct()
    out = pairs.join(v.select(F.col(value_id).alias("__v"), "__needle"), "__v").join(t.withColumnRenamed(text_id, "__t"), "__t")
    return out.where(F.col("__hay").contains(F.col("__needle"))).select(F.col("__v").alias(value_id), F.col("__t").alias(text_id))


def _pieces(hay, n):
    """All parts of ``n`` characters of folded text, by overlapping matches."""
    return F.regexp_extract_all(hay, F.lit(rf"(?=(.{{{n}}}))"), F.lit(1))
