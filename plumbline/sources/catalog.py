"""Extraction schemas and prompts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import TYPES, stem, strip

RAW = "name string, title string, fields array<struct<name:string,type:string,required:boolean,description:string,examples:array<string>>>, _corrupt_record string"
FIELD = "schema_name string, title string, ordinal int, name string, kind string, required boolean, description string, examples array<string>"


class CatalogError(ValueError):
    """A schema that cannot be used, or a name that no schema has."""


def read_schemas(spark: SparkSession, directory: str) -> DataFrame:
    """The fields of every ``*.json`` schema of a directory, a row each; raises for a broken, empty or missing set."""
    try:
        raw = spark.read.schema(RAW).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(directory)
        raw = raw.withColumn("__file", stem(F.col("_metadata.file_path")))
        rows = fields_of(raw)
        problems = violations(raw).limit(20).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise CatalogError(f"no schema directory {directory}") from None
        raise
    if problems:
        raise CatalogError("; ".join(f"{r.schema_name}: {r.problem}" for r in problems))
    if not rows.take(1):
        raise CatalogError(f"no schemas in {directory}")
    return rows


def _named(raw: DataFrame) -> DataFrame:
    return raw.withColumn("schema_name", F.coalesce(F.nullif(strip(F.col("name")), F.lit("")), F.col("__file")))


def fields_of(raw: DataFrame) -> DataFrame:
    """Schema rows (name, title, fields, and __file to name the nameless) to a row for each field, in order."""
    f = _named(raw).select("schema_name", F.coalesce("title", "schema_name").alias("title"), F.posexplode("fields").alias("ordinal", "f"))
    return f.select(
        "schema_name", "title", "ordinal", strip(F.col("f.name")).alias("name"), strip(F.col("f.type")).alias("kind"),
        F.coalesce("f.required", F.lit(False)).alias("required"), F.coalesce("f.description", F.lit("")).alias("description"),
        F.coalesce("f.examples", F.array().cast("array<string>")).alias("examples"),
    )


def violations(raw: DataFrame) -> DataFrame:
    """``(schema_name, problem)`` of unreadable schemas, and of missing, unnamed, untyped or doubled fields."""
    named = _named(raw)
    broken = named.where("_corrupt_record is not null").select("schema_name", F.lit("not valid JSON").alias("problem"))
    none = named.where("_corrupt_record is null and coalesce(size(fields), 0) <= 0").select("schema_name", F.lit("declares no fields").alias("problem"))
    f = fields_of(raw)
    unnamed = f.where("coalesce(name, '') = ''").select("schema_name", F.lit("has a field without a name").alias("problem"))
    untyped = f.where(~F.coalesce(F.col("kind").isin(*TYPES), F.lit(False))).select("schema_name", F.concat(F.lit("unknown type "), F.coalesce("kind", F.lit("null"))).alias("problem"))
    doubled = f.groupBy("schema_name", "name").agg(F.count("*").alias("n")).where("n > 1").select("schema_name", F.concat(F.lit("declares twice "), F.col("name")).alias("problem"))
    return broken.union(none).union(unnamed).union(untyped).union(doubled)


def schema(fields: DataFrame, name: str) -> DataFrame:
    """The fields of one schema; an unknown name raises with the known ones."""
    found = fields.where(F.col("schema_name") == name)
    if not found.take(1):
        known = sorted(r[0] for r in fields.select("schema_name").distinct().collect())  # the catalogue is small
        raise CatalogError(f"unknown schema {name}; known: {', '.join(known)}")
    return found


def names(*catalogues: DataFrame) -> DataFrame:
    """All schema names of several catalogues, sorted, each once."""
    out = catalogues[0].select("schema_name")
    for c in catalogues[1:]:
        out = out.union(c.select("schema_name"))
    return out.distinct().orderBy("schema_name")


def listing(fields: DataFrame) -> DataFrame:
    """Names with titles and numbers of fields."""
    return fields.groupBy("schema_name", "title").agg(F.count("*").alias("n_fields")).orderBy("schema_name")


def describe_fields(fields: DataFrame) -> DataFrame:
    """``(schema_name, description)``: a line for each field in order, with its type, need and examples."""
    line = F.concat(
        F.lit("- "), F.col("name"), F.lit(" ("), F.col("kind"), F.lit(")"), F.when(F.col("required"), " (required)").otherwise(""),
        F.when(F.col("description") != "", F.concat(F.lit(": "), F.col("description"))).otherwise(""),
        F.when(F.size("examples") > 0, F.concat(F.lit(" e.g. "), F.array_join("examples", ", "))).otherwise(""),
    )
    lines = F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line"))))
    return fields.groupBy("schema_name").agg(F.array_join(F.transform(lines, lambda s: s.line), "\n").alias("description"))


def json_schema(fields: DataFrame) -> DataFrame:
    """``(schema_name, json_schema)``: the replies' JSON Schema; every field an object of value, quote and bbox."""
    text = '{"type":["string","null"]}'
    box = '{"type":["array","null"],"items":{"type":"number"},"minItems":4,"maxItems":4}'
    one = F.concat(
        F.to_json(F.struct(F.col("name").alias("n"))).substr(F.lit(6), F.char_length(F.to_json(F.struct(F.col("name").alias("n")))) - 6),
        F.lit(f':{{"type":"object","properties":{{"value":{text},"quote":{text},"bbox":{box}}},"required":["value","quote","bbox"],"additionalProperties":false}}'),
    )
    rows = F.array_sort(F.collect_list(F.struct("ordinal", one.alias("one"), "name")))
    props = F.array_join(F.transform(rows, lambda s: s.one), ",")
    need = F.to_json(F.transform(rows, lambda s: s["name"]))
    whole = F.concat(F.lit('{"type":"object","properties":{'), props, F.lit('},"required":'), need, F.lit(',"additionalProperties":false}'))
    return fields.groupBy("schema_name").agg(whole.alias("json_schema"))


def field_types(fields: DataFrame, cases: DataFrame) -> DataFrame:
    """Types of the fields of the schemas that cases use, by schema and field."""
    return fields.join(cases.select("schema_name").distinct(), "schema_name", "left_semi").select("schema_name", F.col("name").alias("field"), "kind")


PROMPT_RULE = "A field that isn't printed on the page is null; nothing is inferred, computed or completed."
# The catalogue's versions are fixed names; the wording of each prompt is our own.
PROMPTS = [
    ("v1-baseline", "The fields alone.", "You read documents.", "Read this {title} and give these fields as JSON.\n{fields}"),
    ("v2-schema-locked", "Adds a quote and a box to each value.", "You transcribe what is printed, letter by letter.", "Give these fields of this {title}, each with value, quote and bbox.\n{fields}\n" + PROMPT_RULE + "\nNotes: {hint}"),
    ("v3-region-guided", "Adds the regions found on the page.", "You transcribe what is printed, letter by letter.", "Give these fields of this {title}, region by region, each with value, quote and bbox.\n{fields}\n" + PROMPT_RULE + "\nRegions: {hint}"),
    ("transcribe-v1", "The whole page's text.", "You transcribe what is printed, letter by letter.", "Write down all text of the page in reading order, line by line.\n{fields}{title}{hint}"),
]
DEFAULT_PROMPT = "v3-region-guided"


def prompts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROMPTS, "version string, summary string, system string, template string")


def prompt(spark: SparkSession, version: str | None = None) -> DataFrame:
    """The prompt of a version, the default without one; an unknown version raises KeyError."""
    version = version or DEFAULT_PROMPT
    if version not in {p[0] for p in PROMPTS}:
        raise KeyError(f"unknown prompt {version}; known: {', '.join(sorted(p[0] for p in PROMPTS))}")
    return prompts(spark).where(F.col("version") == version)


def render(template, title, fields, hint):
    """A prompt's text; without a hint it says none."""
    t = F.replace(template, F.lit("{title}"), title)
    return F.replace(F.replace(t, F.lit("{fields}"), fields), F.lit("{hint}"), F.coalesce(F.nullif(hint, F.lit("")), F.lit("None.")))


def region_hint(pages):
    """``page 1: WxHpx; page 2: ...`` of an array of structs (width, height)."""
    return F.array_join(F.transform(pages, lambda p, i: F.format_string("page %d: %dx%dpx", i + 1, p.width, p.height)), "; ")
