"""Labelled sets, requests, expected answers, scripted replies, settings: the engine's inputs."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import stem, strip

CASE = "document_id string, schema string, image_path string, image_b64 string, reference_text string, truth map<string,string>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSONL file; blank lines are passed over, a line that isn't JSON raises with its place, as does an empty set."""
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    parsed = lines.select("value", F.from_json("value", CASE).alias("c"), F.try_parse_json("value").alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    bad = parsed.where(~is_object | F.col("c.document_id").isNull()).limit(3).collect()
    if bad:
        raise ValueError(f"{path}: not a case: {'; '.join(r.value[:80] for r in bad)}")
    cases = parsed.select("c.*").withColumnRenamed("schema", "schema_name").withColumn("truth", F.coalesce("truth", F.create_map().cast("map<string,string>")))
    if not cases.take(1):
        raise ValueError(f"{path}: no cases")
    return cases


def with_images(spark: SparkSession, cases: DataFrame, directory: str) -> DataFrame:
    """Cases with ``image_b64``: their own, or the file of ``image_path`` below the set's directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    root = directory.rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), root, -1)
    return cases.join(files.select(rel.alias("image_path"), "content"), "image_path", "left").withColumn("image_b64", F.coalesce("image_b64", F.base64("content"))).drop("content")


def truth_rows(cases: DataFrame) -> DataFrame:
    """``document_id, schema_name, field, expected`` of every labelled field; a null is a field that is absent."""
    return cases.select("document_id", "schema_name", F.explode("truth").alias("field", "expected"))


def read_images(spark: SparkSession, directory: str) -> DataFrame:
    """Files of the image suffixes, whatever their case, sorted: ``path, stem, content``."""
    f = spark.read.format("binaryFile").load(directory)
    return f.where(F.lower("path").rlike(r"\.(png|jpe?g|tiff?)$")).select("path", stem(F.col("path")).alias("stem"), "content").orderBy("path")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, expected`` of a JSON map from image to text, or a list of objects with image or file, text or answer."""
    v = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    as_map = v.select(F.explode(F.try_variant_get("v", "$", "map<string,string>")).alias("image", "expected"))
    item = v.select(F.explode(F.try_variant_get("v", "$", "array<map<string,string>>")).alias("m"))
    either = lambda a, b: F.coalesce(F.col("m")[a], F.col("m")[b])
    as_list = item.select(either("image", "file").alias("image"), either("text", "answer").alias("expected"))
    return as_map.union(as_list).select(stem(F.col("image")).alias("image_id"), "expected")


def decode_page(payload: Column) -> Column:
    """The bytes of a base64 page, its ``data:`` prefix cut; null if it isn't base64 or is empty."""
    body = F.when(F.startswith(payload, F.lit("data:")), F.regexp_replace(payload, "(?s)^[^,]*,", "")).otherwise(payload)
    strict = F.when(body.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.char_length(body) % 4 == 0), body)
    raw = F.unbase64(strict)
    return F.when(F.octet_length(raw) > 0, raw)


# What the scripted model says of its tokens, and its box.
PROMPT_TOKENS = {"extract": 420, "transcribe": 610, "other": 100}
SCRIPT_BOX = (0.1, 0.1, 0.4, 0.15)


def scripted_responses(calls: DataFrame, scripts: DataFrame) -> DataFrame:
    """Replies of a scripted model: the i-th extract call of a document gets its script i, the last again after.

    ``calls``: document_id, pass_idx; ``scripts``: document_id, ord, and values (map),
    quotes (map), boxes (map) or malformed (text). A quote defaults to the value, a
    box to SCRIPT_BOX where there is a value.
    """
    n = scripts.groupBy("document_id").agg(F.count("*").alias("n"))
    c = calls.join(n, "document_id").withColumn("ord", F.least(F.col("pass_idx"), F.col("n") - 1)).drop("n")
    box = F.array(*map(F.lit, SCRIPT_BOX))
    entry = F.transform_values("values", lambda k, v: F.struct(
        v.alias("value"), F.coalesce(F.element_at("quotes", k), v).alias("quote"), F.coalesce(F.element_at("boxes", k), F.when(F.coalesce(v, F.lit("")) != "", box)).alias("bbox")
    ))
    c = c.join(scripts, ["document_id", "ord"]).withColumn("text", F.coalesce("malformed", F.to_json(entry, {"ignoreNullFields": "false"})))
    return c.select(
        "document_id", "pass_idx", "text", F.lit(PROMPT_TOKENS["extract"]).cast("long").alias("prompt_tokens"),
        F.greatest(F.lit(1), F.expr("char_length(text) div 4")).cast("long").alias("completion_tokens"), F.lit("scripted").alias("model"),
        F.lit(None).cast("string").alias("error"),
    )


def golden_scripts(cases: DataFrame, passes: int) -> DataFrame:
    """Scripts from the truth: the first pass reads all, later ones miss the purchase order."""
    s = cases.select("document_id", "truth").withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(max(passes, 1) - 1))))
    values = F.transform_values("truth", lambda k, v: F.when((F.col("ord") == 0) | (k != "purchase_order"), v))
    empty = F.create_map().cast("map<string,string>")
    return s.select("document_id", "ord", values.alias("values"), empty.alias("quotes"), F.create_map().cast("map<string,array<double>>").alias("boxes"), F.lit(None).cast("string").alias("malformed"))


def golden_transcript(truth: Column) -> Column:
    """A page's text from its labelled values, a line each."""
    pairs = F.filter(F.map_entries(truth), lambda e: e.value.isNotNull())
    return F.array_join(F.transform(pairs, lambda e: F.concat_ws(": ", F.replace(e.key, F.lit("_"), F.lit(" ")), e.value)), "\n")


@dataclass(frozen=True)
class Settings:
    """Settings of a run; ``from_env`` reads ``PLUMBLINE_*`` variables."""

    weight_agreement: float = 0.5
    weight_grounding: float = 0.35
    weight_format: float = 0.15
    abstain_below: float = 0.62
    grounding_min_ratio: float = 0.86
    passes: int = 2
    temperatures: tuple[float, ...] = (0.0, 0.35)
    hourly_rate: float = 1.99
    tokens_per_second: float = 1400.0
    breaker_threshold: int = 5
    breaker_reset_s: float = 30.0
    max_views: int = 4
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        for name in ("abstain_below", "grounding_min_ratio", "weight_agreement", "weight_grounding", "weight_format"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in 0 to 1")
        if not 1 <= self.passes <= 5:
            raise ValueError("passes must lie in 1 to 5")
        if any(not 0.0 <= t <= 2.0 for t in self.temperatures):
            raise ValueError("temperatures must lie in 0 to 2")
        object.__setattr__(self, "max_views", max(1, self.max_views))

    @classmethod
    def from_env(cls, env=os.environ, lenient: bool = False) -> "Settings":
        """Strict: a bad number raises; lenient: it leaves the default."""
        out = cls()
        for f in fields(cls):
            raw = env.get(f"PLUMBLINE_{f.name.upper()}")
            if raw is None or f.name == "extra":
                continue
            try:
                value = tuple(json.loads(raw)) if f.name == "temperatures" else type(getattr(out, f.name))(raw)
                out = replace(out, **{f.name: value})
            except ValueError:
                if not lenient:
                    raise
        return out

    @property
    def weights(self) -> tuple[float, float, float]:
        return (self.weight_agreement, self.weight_grounding, self.weight_format)
