"""Small numeric functions: error rates, cost, settings, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(x: Column, places: int = 4) -> Column:
    """Rounded half to even."""
    return F.rint(x * float(10**places)) / float(10**places)


def fixed(x: Column, places: int) -> Column:
    """A double's text of so many places: its exact binary value rounded half to even, as C and Python print it."""
    return F.call_function("format_number", x, F.lit("0." + "0" * places))


def character_error_rate(predicted: Column, truth: Column) -> Column:
    """Edit distance over the truth's length, at most 1; for an empty truth 0 or 1."""
    p, t = F.coalesce(predicted, F.lit("")), F.coalesce(truth, F.lit(""))
    rate = F.least(F.lit(1.0), F.levenshtein(p, t) / F.nullif(F.char_length(t), F.lit(0)))
    return F.when(t == "", F.when(p == "", 0.0).otherwise(1.0)).otherwise(rate)


def total_tokens(prompt: Column, completion: Column) -> Column:
    return F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))


def cost_usd(tokens: Column, hourly_rate: float, tokens_per_second: Column | float) -> Column:
    speed = F.lit(float(tokens_per_second)) if isinstance(tokens_per_second, (int, float)) else tokens_per_second
    return F.when(speed > 0, hourly_rate / 3600.0 * (tokens / speed)).otherwise(0.0)


def confidence_weights(agreement: float, grounding: float, form: float) -> tuple[float, float, float]:
    """The three weights over their sum; agreement alone if the sum is 0."""
    total = agreement + grounding + form
    return (agreement / total, grounding / total, form / total) if total > 0 else (1.0, 0.0, 0.0)


def temperature_for(pass_idx: Column, temperatures=(0.0, 0.35)) -> Column:
    """Settings in turn."""
    return F.get(F.array(*map(F.lit, temperatures)), F.pmod(pass_idx, F.lit(len(temperatures))))


def config_label(version: Column, passes: Column, threshold: Column) -> Column:
    return F.format_string("%s | %dp | t=%s", version, passes, fixed(threshold, 2))


def gpu_memory_fraction(budget: Column, total: Column) -> Column:
    """Share of memory to ask for: within 0.05 and 0.92, three places, 0.75 if the total is unknown."""
    share = F.greatest(F.lit(0.05), F.least(F.lit(0.92), budget / total))
    return F.when(total > 0, round_even(share, 3)).otherwise(0.75)


def backoff_ceiling(attempt: Column) -> Column:
    """The longest wait before an attempt, in seconds; a wait is drawn evenly below it."""
    return F.least(F.lit(8.0), 0.5 * F.pow(F.lit(2.0), attempt))


def backoff(attempt: Column, seed: int | None = None) -> Column:
    return F.rand(seed) * backoff_ceiling(attempt)


def nearest_rank(values: Column, fraction: float) -> Column:
    """The element of nearest rank of an array, ranks rounded half to even; null if empty."""
    n = F.size(values)
    at = F.least(n - 1, F.rint(fraction * (n - 1)).cast("int"))
    return F.when(n > 0, F.get(F.sort_array(values), at))
