"""Model replies: JSON out of fences, chatter and loose types."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import collapse, strip


def unfenced(reply: Column) -> Column:
    """The inside of a reply's code fence, without its language tag, or the reply itself."""
    t = strip(reply)
    inner = F.regexp_replace(F.regexp_replace(t, r"^`+|`+$", ""), r"^json", "")
    return strip(F.when(t.startswith("```"), inner).otherwise(t))


def as_json_object(reply: Column) -> Column:
    """The reply as JSON text if it is an object, else null."""
    t = unfenced(reply)
    parsed = F.try_parse_json(t)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return F.when(F.coalesce(is_object, F.lit(False)), t)


@F.pandas_udf(T.StringType())
def extract_json_object(replies: pd.Series) -> pd.Series:
    """The first JSON object in free text, after thoughts are cut and the first fence is opened; null if none."""
    decoder = json.JSONDecoder()

    def cut(text: str, opening: str, closing: str) -> str:
        out, at = [], 0
        while (a := text.find(opening, at)) >= 0 and (b := text.find(closing, a)) >= 0:
            out.append(text[at:a])
            at = b + len(closing)
        return "".join(out) + text[at:]

    def fenced(text: str) -> str:
        a = text.find("```")
        b = text.find("```", a + 3) if a >= 0 else -1
        if b < 0:
            return text
        inner = text[a + 3 : b]
        return (inner[4:] if inner[:4].lower() == "json" else inner).strip()

    def first(text):
        text = fenced(cut(text, "<think>", "</think>").strip())
        at = text.find("{")
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(text, at)
                return json.dumps(value, ensure_ascii=False)
            except json.JSONDecodeError:
                at = text.find("{", at + 1)
        return None

    return replies.map(first, na_action="ignore")


def parse_reading(payload: Column) -> Column:
    """Struct (kind, lines) of a reading's JSON object; null without one, or if its lines are neither list nor text.

    ``lines`` may be a list or a text of lines; ``text`` stands in where it is absent.
    Blank lines go; the kind defaults to "other".
    """
    v = F.try_parse_json(payload)
    field = F.when(F.try_variant_get(v, "$.lines", "variant").isNotNull(), F.try_variant_get(v, "$.lines", "variant")).otherwise(F.try_variant_get(v, "$.text", "variant"))
    kind_of = F.schema_of_variant(field)
    as_list = F.try_variant_get(field, "$", "array<string>")
    as_text = F.split(F.try_variant_get(field, "$", "string"), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    lines = F.when(field.isNull(), F.array().cast("array<string>")).when(kind_of.startswith("ARRAY"), as_list).when(kind_of == "STRING", as_text)
    lines = F.filter(lines, lambda s: strip(s) != "")
    kind = F.coalesce(F.try_variant_get(v, "$.kind", "string"), F.lit("other"))
    ok = F.schema_of_variant(v).startswith("OBJECT") & (F.schema_of_variant(v) != "OBJECT<>") & lines.isNotNull()
    return F.when(ok, F.struct(kind.alias("kind"), lines.alias("lines")))


ENVELOPE = "struct<choices:array<struct<message:struct<content:string>>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>,model:string>"


def parse_envelope(body: Column) -> Column:
    """Struct (text, prompt_tokens, completion_tokens, model) of a chat completion's body; null without a choice."""
    e = F.from_json(body, ENVELOPE)
    choice = F.get(e.choices, 0)
    return F.when(
        choice.message.isNotNull(),
        F.struct(
            F.coalesce(choice.message.content, F.lit("")).alias("text"), F.coalesce(e.usage.prompt_tokens, F.lit(0)).alias("prompt_tokens"),
            F.coalesce(e.usage.completion_tokens, F.lit(0)).alias("completion_tokens"), F.coalesce(e.model, F.lit("unknown")).alias("model"),
        ),
    )


def one_line(x: Column) -> Column:
    return strip(collapse(x))
