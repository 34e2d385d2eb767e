"""Plates and signs: normal form, kind, and the text composed from the lines read."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import collapse, strip

# What a comparison of plates ignores, what is stripped from a line's ends, the
# first characters of Chinese plates and their endings, and the banners printed on US plates.
IGNORED = r"(?U)[\s\x1c-\x1f\-._·‐-―]+"
EDGES = "\"'`“”‘’|[](){}<>,;:"
PROVINCES = "京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领"
ENDINGS = "挂学警港澳"
STATES = [
    "ALABAMA", "ALASKA", "ARIZONA", "ARKANSAS", "CALIFORNIA", "COLORADO", "CONNECTICUT", "DELAWARE", "DISTRICT OF COLUMBIA",
    "FLORIDA", "GEORGIA", "HAWAII", "IDAHO", "ILLINOIS", "INDIANA", "IOWA", "KANSAS", "KENTUCKY", "LOUISIANA", "MAINE",
    "MARYLAND", "MASSACHUSETTS", "MICHIGAN", "MINNESOTA", "MISSISSIPPI", "MISSOURI", "MONTANA", "NEBRASKA", "NEVADA",
    "NEW HAMPSHIRE", "NEW JERSEY", "NEW MEXICO", "NEW YORK", "NORTH CAROLINA", "NORTH DAKOTA", "OHIO", "OKLAHOMA", "OREGON",
    "PENNSYLVANIA", "RHODE ISLAND", "SOUTH CAROLINA", "SOUTH DAKOTA", "TENNESSEE", "TEXAS", "UTAH", "VERMONT", "VIRGINIA",
    "WASHINGTON", "WEST VIRGINIA", "WISCONSIN", "WYOMING",
]
SLOGANS = [
    "ALOHA STATE", "BEEHIVE STATE", "BIG SKY COUNTRY", "CENTENNIAL STATE", "EMPIRE STATE", "EVERGREEN STATE", "FIRST IN FLIGHT",
    "GARDEN STATE", "GEM STATE", "GOLDEN STATE", "GRAND CANYON STATE", "GREAT LAKES STATE", "LAND OF ENCHANTMENT", "LIFE'S BETTER HERE",
    "LIVE FREE OR DIE", "LONE STAR STATE", "PEACH STATE", "SEE THE REAL WYOMING", "SILVER STATE", "SUNSHINE STATE", "THE ALOHA STATE",
    "THE BAY STATE", "THE BEEHIVE STATE", "THE BIG SKY COUNTRY", "THE BLUEGRASS STATE", "THE BUCKEYE STATE", "THE CENTENNIAL STATE",
    "THE CONSTITUTION STATE", "THE COWBOY STATE", "THE EMPIRE STATE", "THE EVERGREEN STATE", "THE FIRST STATE", "THE GARDEN STATE",
    "THE GEM STATE", "THE GOLDEN STATE", "THE GRAND CANYON STATE", "THE GRANITE STATE", "THE GREAT LAKES STATE", "THE HAWKEYE STATE",
    "THE HEART OF IT ALL", "THE HOOSIER STATE", "THE KEYSTONE STATE", "THE LAND OF LINCOLN", "THE LAST FRONTIER", "THE LONE STAR STATE",
    "THE MAGNOLIA STATE", "THE MOUNTAIN STATE", "THE NATURAL STATE", "THE NORTH STAR STATE", "THE OCEAN STATE", "THE OLD LINE STATE",
    "THE PALMETTO STATE", "THE PEACE GARDEN STATE", "THE PEACH STATE", "THE PELICAN STATE", "THE PINE TREE STATE", "THE SHOW ME STATE",
    "THE SILVER STATE", "THE SOONER STATE", "THE SUNFLOWER STATE", "THE SUNSHINE STATE", "THE TAR HEEL STATE", "THE VOLUNTEER STATE",
    "WHERE THE WEST BEGINS",
]
KINDS = ("us_plate", "cn_plate", "sign", "other")

_CN = rf"([{PROVINCES}])([A-Z])([A-Z0-9]{{4,6}}[{ENDINGS}]?)"
_BANNER = r"(?iU)(?<![A-Za-z0-9])(?:" + "|".join(sorted(STATES + SLOGANS, key=len, reverse=True)) + r")(?![A-Za-z0-9])"
_EDGE = "[" + "".join(re.escape(c) for c in EDGES) + "]"


def grader_normalize(x: Column) -> Column:
    """Upper case, without white space, dashes, points and underscores."""
    return F.upper(F.regexp_replace(x, IGNORED, ""))


def canonical_kind(x: Column) -> Column:
    """One of KINDS for whatever a reading calls its object."""
    k = F.regexp_replace(F.lower(strip(F.coalesce(x, F.lit("")))), "[ -]", "_")
    has = lambda *words: F.greatest(*(k.contains(w) for w in words)) if len(words) > 1 else k.contains(words[0])
    return (
        F.when(k.isin(*KINDS), k)
        .when(has("plate", "licen") & has("cn", "china", "chinese"), "cn_plate")
        .when(has("plate", "licen"), "us_plate")
        .when(has("sign", "stop", "speed"), "sign")
        .otherwise("other")
    )


def clean_line(x: Column) -> Column:
    return strip(F.regexp_replace(strip(collapse(x)), f"^{_EDGE}+|{_EDGE}+$", ""))


def clean_lines(lines: Column) -> Column:
    """Lines without stray marks at their ends; empty ones go."""
    return F.filter(F.transform(lines, clean_line), lambda s: s != "")


def plate_score(line: Column) -> Column:
    """How much a line looks like a registration: its length, and both letters and digits."""
    core = F.regexp_replace(line, "[^A-Za-z0-9]", "")
    n = F.char_length(core)
    digit, letter = core.rlike("[0-9]"), core.rlike("[A-Za-z]")
    by_length = F.when(n.between(5, 8), 3.0).when(n.between(2, 4), 1.0).otherwise(-F.abs(n - 8).cast("double"))
    mixed = F.when(digit & letter, 2.0).otherwise(0.5)
    return F.when(n == 0, F.lit(float("-inf"))).otherwise(by_length + mixed)


def find_cn_plate(text: Column) -> Column:
    """The Chinese registration in a text, with the letters O and I of its tail read as digits; else null."""
    t = grader_normalize(text)
    part = lambda i: F.regexp_extract(t, _CN, i)
    return F.when(t.rlike(_CN), F.concat(part(1), part(2), F.translate(part(3), "OI", "01")))


def _first_best(lines: Column, score) -> Column:
    """The first line of greatest score."""
    ranked = F.transform(lines, lambda s, i: F.struct(score(s).alias("score"), (-i).alias("at"), s.alias("line")))
    return F.array_max(ranked)


def us_plate(lines: Column) -> Column:
    """Of cleaned lines: the one most like a registration once banners are cut."""
    bare = clean_lines(F.transform(lines, lambda s: F.regexp_replace(s, _BANNER, " ")))
    best = _first_best(bare, plate_score)
    joined = lambda a: F.array_join(a, " ")
    return F.when(F.size(bare) == 0, joined(lines)).when(best.score > float("-inf"), best.line).otherwise(joined(bare))


def compose(kind: Column, lines: Column) -> Column:
    """The text of an object from the lines read of it."""
    clean = clean_lines(lines)
    whole = F.array_join(clean, " ")
    return F.when(F.size(clean) <= 0, "").otherwise(F.coalesce(find_cn_plate(whole), F.when(kind == "us_plate", us_plate(clean)), whole))


def plausibility(kind: Column, text: Column) -> Column:
    return F.when(kind.isin("us_plate", "cn_plate"), plate_score(text)).otherwise(F.char_length(text).cast("double"))
