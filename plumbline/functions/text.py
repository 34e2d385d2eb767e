"""Typed values read as text: normal forms, format checks and folding, as columns.

All but ``canonical_text`` of strings with compatibility characters run in the JVM.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The declared types, the words for "no value", and the words for yes and no.
TYPES = ("string", "text", "number", "currency", "integer", "date", "phone", "email", "version", "boolean")
NO_VALUE = ("null", "none", "n/a", "na", "-", "--")
YES = ("true", "yes", "y", "1", "checked", "x")
NO = ("false", "no", "n", "0", "unchecked", "")
MONTHS = "january february march april may june july august september october november december".split()

_SPACE = r"[\s\x1c-\x1f]"


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; keeps expressions that use it often small."""
    return F.get(F.transform(F.array(value), body), 0)


def _null() -> Column:
    return F.lit(None).cast("string")


def strip(x: Column) -> Column:
    """Without white space, of any script, at either end."""
    return F.regexp_replace(x, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(x, rf"(?U){_SPACE}+", " ")


def optional_text(x: Column) -> Column:
    """Stripped, or null if nothing is left."""
    return F.nullif(strip(x), F.lit(""))


@lru_cache(1)
def _digit_map() -> tuple[str, str]:
    digits = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.digit(d)) for d in digits)


def ascii_digits(x: Column) -> Column:
    """Decimal digits of any script as 0-9."""
    return F.when(x.rlike(r"^\p{ASCII}*$"), x).otherwise(F.translate(x, *_digit_map()))


def _fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", s).casefold() if c in _KEPT)


_KEPT = frozenset("0123456789abcdefghijklmnopqrstuvwxyz")


@lru_cache(1)
def _special() -> str:
    """A regex class of the characters beyond ASCII that fold to something kept, and of combining marks."""
    hits = [c for c in range(128, 0x20000) if not 0xD800 <= c < 0xE000 and chr(c) not in "ßẞ" and _fold(chr(c))]
    ranges: list[list[int]] = []
    for c in hits:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return r"[\p{M}" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


@F.pandas_udf(T.StringType())
def _fold_udf(x: pd.Series) -> pd.Series:
    return x.map(_fold, na_action="ignore")


def canonical_text(x: Column) -> Column:
    """Compatibility-folded, case-folded, nothing but 0-9 and a-z.

    Only strings with characters that fold in a way the JVM lacks go to Python; the
    rest stand there as nulls.
    """
    plain = F.regexp_replace(F.lower(F.regexp_replace(x, "[ßẞ]", "ss")), "[^0-9a-z]+", "")
    # the long class is tried only where a character lies beyond ASCII and the plain accented letters
    hard = F.when(x.rlike(r"[^\x00-\x7F\xC0-\xFF]"), x.rlike(_special())).otherwise(F.lit(False))
    return F.when(hard, _fold_udf(F.when(hard, x))).otherwise(plain)


def canonical_plain(x: Column) -> Column:
    """``canonical_text`` for strings without compatibility characters; all in the JVM."""
    return F.regexp_replace(F.lower(F.regexp_replace(x, "[ßẞ]", "ss")), "[^0-9a-z]+", "")


def number(x: Column) -> Column:
    """The first number in a text as decimal text of at most four places.

    Of two kinds of separator the last is the decimal one; commas alone are decimal
    before two final digits, else thousands.
    """
    token = F.regexp_replace(F.regexp_extract(ascii_digits(x), r"-?[0-9][0-9.,]*", 0), r"[.,]+$", "")

    def plain(token):
        bare = F.regexp_replace(token, ",", "")
        comma_last = F.replace(F.replace(token, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        return (
            F.when(token.contains(",") & token.contains("."), F.when(token.rlike(r",[^.]*$"), comma_last).otherwise(bare))
            .when(token.rlike(r",[0-9]{2}$"), F.replace(token, F.lit(","), F.lit(".")))
            .otherwise(bare)
            .try_cast("double")
        )

    def printed(value):
        text = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", value), r"0+$", ""), r"\.$", "")
        return F.when(value.isNotNull(), text)

    return bind(bind(token, plain), printed)


def integer(x: Column) -> Column:
    return F.split_part(number(x), F.lit("."), F.lit(1))


def date(x: Column) -> Column:
    """ISO date of a text in one of nine layouts, day first where both orders fit."""
    return bind(F.lower(collapse(strip(ascii_digits(x)))), _date_of)


def _date_of(t: Column) -> Column:
    abbreviated = F.array(*(F.lit(m[:3]) for m in MONTHS))
    full = F.array(*map(F.lit, MONTHS))

    def made(pattern, y, m, d, named=False):
        part = lambda i: F.regexp_extract(t, pattern, i)
        month = part(m)
        if named:
            month = F.greatest(F.array_position(abbreviated, month), F.array_position(full, month)).cast("string")
        whole = F.concat_ws("-", part(y), F.lpad(month, 2, "0"), F.lpad(part(d), 2, "0"))
        return F.when(t.rlike(pattern) & (part(y) != "0000"), whole.try_cast("date"))

    n, y = r"([0-9]{1,2})", r"([0-9]{4})"
    layouts = [
        (rf"^{y}-{n}-{n}$", 1, 2, 3), (rf"^{n}/{n}/{y}$", 3, 2, 1), (rf"^{n}/{n}/{y}$", 3, 1, 2), (rf"^{n}-{n}-{y}$", 3, 2, 1),
        (rf"^{n} ([a-z]+) {y}$", 3, 2, 1, True), (rf"^([a-z]+) {n}, {y}$", 3, 1, 2, True), (rf"^{y}/{n}/{n}$", 1, 2, 3),
    ]
    return F.coalesce(*(made(*a) for a in layouts)).cast("string")


def phone(x: Column) -> Column:
    """Digits with an optional plus before them, 7 to 15 characters after it."""
    def plain(kept):
        return F.when(kept.startswith("+"), F.concat(F.lit("+"), F.replace(kept, F.lit("+"), F.lit("")))).otherwise(kept)

    def checked(kept):
        return F.when(F.char_length(F.regexp_replace(kept, r"^\++", "")).between(7, 15), kept)

    return bind(bind(F.regexp_replace(x, r"(?U)[^\d+]", ""), plain), checked)


def version(x: Column) -> Column:
    token = F.regexp_replace(strip(x), "^[vV]+", "")
    return F.when(token.rlike(r"(?U)^\d+(\.\d+){0,3}(-[0-9A-Za-z.\-]+)?(\+[0-9A-Za-z.\-]+)?$"), token)


def boolean(x: Column) -> Column:
    t = F.lower(strip(x))
    return F.when(t.isin(*YES), "true").when(t.isin(*NO), "false")


def email(x: Column) -> Column:
    return F.nullif(F.lower(strip(x)), F.lit(""))


def normalize_value(x: Column, kind: Column | str) -> Column:
    """The normal form of a raw value of a declared type; null if there is none."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def form(t):
        none = t.isNull() | (t == "") | F.lower(t).isin(*NO_VALUE)
        return (
            F.when(none, _null())
            .when(kind.isin("number", "currency"), number(t))
            .when(kind == "integer", integer(t))
            .when(kind == "date", date(t))
            .when(kind == "phone", phone(t))
            .when(kind == "version", version(t))
            .when(kind == "boolean", boolean(t))
            .when(kind == "email", email(t))
            .otherwise(collapse(t))
        )

    return bind(strip(x.cast("string")), form)


def validate_format(x: Column, kind: Column | str) -> Column:
    """Whether a value is well formed for its type; an unknown type asks only for a value."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def ok(n):
        return F.when(kind == "email", n.rlike(r"^[^@\s]+@[^@\s.]+\.[^@\s]+$")).when(kind == "integer", n.rlike(r"^-*[0-9]+$")).otherwise(n.isNotNull() & (n != ""))

    return F.coalesce(bind(normalize_value(x, kind), ok), F.lit(False))


def error_text(code: Column, kind: Column, message: Column) -> Column:
    """``code: message`` of a typed error, else ``kind: message``."""
    return F.concat_ws(": ", F.coalesce(code, kind), F.coalesce(message, F.lit("")))


def stem(path: Column) -> Column:
    """A path's last part without its suffix."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def output_name(path: Column) -> Column:
    return F.concat(stem(path), F.lit("_output.json"))
