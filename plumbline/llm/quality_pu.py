"""Quality classifier by positive-unlabelled learning.

A text becomes a short vector of counts and ratios (``FEATURES``, each also
squared), all computed in SQL; they are standardised over the whole corpus. A linear
logistic model minimises the non-negative unbiased risk

    prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)]) + ridge

from trusted positives P and all texts as the unlabelled U. With logistic loss the
unbiased risk is convex and its curvature comes from U alone, so Newton steps are
taken; a line search over the non-negative risk guards each. Every step is one pass
over the vectors, added up to one small matrix by partial sums; no row is sampled.

The class prior is estimated beforehand: a plain P-against-U model ranks the texts,
and the prior is the least ratio of U's to P's share above a cut of that ranking,
over cuts that keep ``PRIOR_TAIL`` of P at least (no set can hold a larger share of
P's weight in U). At the very end the score is P(good), 0 to 1.

Nulls: a null text is an empty one, a null or unlisted id has no label; an id with
differing labels counts as a positive only if all are 1. Without positives the
score is 0.5 throughout. Repeated rows get a row each, an empty table an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, Scratch, settle

FEATURES = ("length", "word_length", "symbols", "capitals", "shouts", "variety", "stops", "digits", "line_words", "repeated_lines")
RIDGE = 1e-3
STEPS = 12
CLIP = 6.0
PRIOR_TAIL = 0.2
PRIOR_CUTS = 200
_LINE_SEARCH = (1.0, 0.5, 0.25, 0.1, 0.03)


def vectors(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``x``, the raw features of the text."""
    df = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    df = settle(df, __w=F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)))
    count = lambda p: F.regexp_count("__t", F.lit(p))
    df = df.select(
        *keep,
        F.size("__w").cast("double").alias("__n"),
        F.char_length(F.array_join("__w", "")).cast("double").alias("__c"),
        F.size(F.array_distinct("__w")).cast("double").alias("__u"),
        count(r"[#*$%&|<>]").alias("__s"),
        count(r"\p{Lu}").alias("__b"),
        count(r"!").alias("__e"),
        count(r"[.,;:]").alias("__p"),
        count(r"[0-9]").alias("__d"),
        F.array_size(F.split("__t", "\n")).alias("__l"),
        F.array_size(F.array_distinct(F.split("__t", "\n"))).alias("__m"),
    )
    n, c = F.greatest(F.col("__n"), F.lit(1.0)), F.greatest(F.col("__c"), F.lit(1.0))
    x = [
        F.log1p("__n"), F.log(c / n), F.log1p(10 * F.col("__s") / n), F.sqrt(F.col("__b") / c), F.log1p(10 * F.col("__e") / n),
        F.log(F.greatest(F.col("__u"), F.lit(1.0)) / F.pow(n, F.lit(0.97))), F.sqrt(F.col("__p") / n), F.sqrt(F.col("__d") / c),
        F.log1p(F.col("__n") / F.col("__l")), F.sqrt((F.col("__l") - F.col("__m")) / F.col("__l")),
    ]
    return df.select(*keep, F.array(*x).alias("x"))


@dataclass
class Model:
    """Standardisation and weights; ``weights`` has the bias first, then features, then squares."""

    mean: list[float]
    scale: list[float]
    weights: list[float] = field(default_factory=list)
    prior: float = 0.5

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -CLIP, CLIP)
        return np.hstack([np.ones((len(z), 1)), z, z * z / CLIP])

    def score(self, x: Column) -> Column:
        """P(good) as a column, rounded to 9 digits."""
        if not any(self.weights):
            return F.lit(0.5)
        k, g = len(self.mean), F.lit(self.weights[0])
        for i in range(k):
            z = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (x[i] - self.mean[i]) / self.scale[i]))
            g = g + z * (self.weights[1 + i] + z * (self.weights[1 + k + i] / CLIP))
        return F.round(1.0 / (1.0 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -g)))), 9)


def _totals(df: DataFrame, f) -> np.ndarray:
    """The sum over all rows of ``f(x)``, a flat vector per batch, by partial sums."""

    def run(batches):
        total = None
        for b in batches:
            x = b.column(0)
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            got = f(x) if len(x) else None
            total = got if total is None else total + got if got is not None else total
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    parts = df.select("x").mapInArrow(run, "i bigint, v double")
    rows = parts.groupBy("i").agg(F.sum("v").alias("v")).collect()  # as many as the vector has numbers
    out = np.zeros(1 + max((r.i for r in rows), default=-1))
    for r in rows:
        out[r.i] = r.v
    return out


def _loss(m: np.ndarray) -> np.ndarray:
    """log(1 + exp(-m))."""
    return np.logaddexp(0.0, -m)


def _fit(model: Model, pos: DataFrame, unl: DataFrame, n_pos: int, n_unl: int, prior: float) -> list[float]:
    d = 1 + 2 * len(model.mean)
    mean_p = _totals(pos, lambda x: model.design(x).sum(axis=0)) / n_pos
    w = np.zeros(d)
    ridge = np.full(d, RIDGE)
    ridge[0] = 0.0

    def curve(x):
        a = model.design(x)
        s = 1 / (1 + np.exp(-np.clip(a @ w, -700, 700)))
        return np.concatenate([a.T @ s, ((a * (s * (1 - s))[:, None]).T @ a).ravel()])

    for _ in range(STEPS):
        got = _totals(unl, curve) / n_unl
        grad = got[:d] - prior * mean_p + ridge * w
        hess = got[d:].reshape(d, d) + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        tries = [w - t * step for t in _LINE_SEARCH] + [w]
        lp = lambda x: np.concatenate([[_loss(m).sum(), _loss(-m).sum()] for m in (model.design(x) @ np.array(tries).T).T])
        p = (_totals(pos, lp) / n_pos).reshape(-1, 2)
        u = (_totals(unl, lp) / n_unl).reshape(-1, 2)
        risk = [prior * p[i, 0] + max(0.0, u[i, 1] - prior * p[i, 1]) + float((ridge * v * v).sum()) / 2 for i, v in enumerate(tries)]
        best = int(np.argmin(risk))
        if best == len(tries) - 1 or risk[-1] - risk[best] < 1e-7:
            break
        w = tries[best]
    return [round(float(v), 8) for v in w]


def _prior(model: Model, pos: DataFrame, unl: DataFrame, n_pos: int, n_unl: int) -> float:
    """The least share of U over share of P above a cut of the model's ranking."""

    def above(x):
        g = model.design(x) @ np.array(model.weights)
        bins = np.clip(((1 / (1 + np.exp(-np.clip(g, -700, 700)))) * PRIOR_CUTS).astype(int), 0, PRIOR_CUTS - 1)
        return np.bincount(bins, minlength=PRIOR_CUTS).astype(float)

    p = np.cumsum((_totals(pos, above) / n_pos)[::-1])
    u = np.cumsum((_totals(unl, above) / n_unl)[::-1])
    # one standard deviation of either share is allowed for
    off = lambda q, n: math.sqrt(max(0.0, q * (1 - q)) / n) + 1 / n
    ratios = [(u[i] + off(u[i], n_unl)) / (p[i] - off(p[i], n_pos)) for i in range(PRIOR_CUTS) if p[i] - off(p[i], n_pos) > PRIOR_TAIL]
    return float(min(0.99, max(0.01, min(ratios, default=0.5))))


def train(rows: DataFrame, positives: DataFrame, id_col: str = "doc_id") -> Model:
    """A model from ``rows(id_col, x)``, all texts, and ``positives(id_col)``, distinct ids of trusted ones."""
    scratch = Scratch(rows.sparkSession, "quality-pu")
    k = len(FEATURES)
    stats = rows.agg(F.count("*").alias("n"), *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k))).first()
    if not stats["n"]:
        return Model([0.0] * k, [1.0] * k, [0.0] * (1 + 2 * k))
    model = Model([round(stats[f"m{i}"], 9) for i in range(k)], [round(max(stats[f"s{i}"], 1e-3), 9) for i in range(k)])
    pos = scratch.keep(rows.join(positives, id_col).select("x"), "positives")
    n_pos, n_unl = pos.count(), stats["n"]
    model.weights = [0.0] * (1 + 2 * k)
    if not n_pos:
        return model
    ratio = n_pos / (n_pos + n_unl)
    # P against U, weighed as one sample, is the same risk with P's share as the prior and U as the rest
    both = rows.select("x").union(pos.select("x"))
    model.weights = _fit(model, pos, both, n_pos, n_pos + n_unl, ratio)
    model.prior = _prior(model, pos, rows, n_pos, n_unl)
    model.weights = _fit(model, pos, rows, n_pos, n_unl, model.prior)
    return model


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def trusted(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Ids outside the held-out fifth whose labels are all 1."""
    own = labels.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    return own.groupBy(id_col).agg(F.min(label_col).alias("__l")).where("__l = 1").select(id_col)


def scored(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``(id_col, score)`` for every row."""
    scratch = Scratch(docs.sparkSession, "quality-rows")
    rows = scratch.keep(vectors(docs, text_col, (id_col,)), "vectors")
    model = train(rows, trusted(labels, id_col, label_col), id_col)
    return rows.select(id_col, model.score(F.col("x")).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    scratch = Scratch(docs.sparkSession, "quality-rows")
    rows = scratch.keep(vectors(docs, text_col, (id_col,)), "vectors")
    model = train(rows, trusted(labels, id_col), id_col)
    again = vectors(docs.select(F.struct("*").alias("__row"), F.col(text_col)), text_col, ("__row",))
    # settled, so that the features are not computed anew wherever the condition names them
    return settle(again, __x=F.col("x")).where(model.score(F.col("__x")) >= threshold).select("__row.*")
