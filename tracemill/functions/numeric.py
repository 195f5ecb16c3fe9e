"""Numeric functions over array columns. Thresholds are doubles; NaN follows Python's rules, not Spark's order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine, never below 0; a zero vector, a null or NaN gives 0."""
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(eps))
    value = dot(a, b) / (norm(a) * norm(b))
    return let(value, lambda v: F.when(v.isNull() | F.isnan(v) | (v < 0), F.lit(0.0)).otherwise(v))


def nearest_rank(scores: Column, share: Column | float) -> Column:
    """The sorted scores' entry number floor(n * share), held inside the array; null for an empty array."""
    share = F.lit(float(share)) if isinstance(share, (int, float)) else share
    n = F.size(scores)
    at = F.least(F.greatest(F.floor(n * share), F.lit(0)), n - 1).cast("int")
    return F.when(n > 0, F.element_at(F.array_sort(scores), at + 1))


def percentile_thresholds(scores: Column, tau_low: float, tau_high: float) -> Column:
    """struct(low, high): the bottom share's and the top share's borders."""
    return F.struct(nearest_rank(scores, tau_low).alias("low"), nearest_rank(scores, 1 - tau_high).alias("high"))


def min_max(values: Column) -> Column:
    """Values scaled to 0..1 by their own range; all 0 where they are constant."""

    def build(v):
        low, span = F.array_min(v), F.array_max(v) - F.array_min(v)
        return F.transform(v, lambda x: F.when(span > 0, (x - low) / span).otherwise(F.lit(0.0)))

    return let(values, build)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def span_mean(row: Column, start: Column, end: Column) -> Column:
    """Mean of row[start:end]; null unless 0 <= start < end <= length."""
    fine = (start >= 0) & (start < end) & (end <= F.size(row))
    return F.when(fine, mean(F.slice(row, start + 1, end - start)))


def elementwise_mean(rows: Column) -> Column:
    """Mean row of an array of equally long rows (heads, then layers)."""
    n = F.size(rows)
    total = F.aggregate(F.slice(rows, F.lit(2), F.greatest(n - 1, F.lit(0))), F.element_at(rows, 1), lambda a, r: F.zip_with(a, r, lambda x, y: x + y))
    return F.when(n > 0, F.transform(total, lambda x: x / n))


def attention_row(layers: Column) -> Column:
    """One attention row from layers of heads of rows: mean over heads, then over layers."""
    return elementwise_mean(F.transform(layers, lambda heads: elementwise_mean(heads)))


def log_softmax_at(logits: Column, token: Column) -> Column:
    """log softmax of one position's logits at a token (0-based)."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x.cast("double") - top)), F.lit(0.0), lambda a, x: a + x)
    return F.element_at(logits, token + 1).cast("double") - top - F.log(total)


def mean_logprob(logits: Column, tokens: Column) -> Column:
    """Mean log-probability of tokens given one row of logits for each."""
    return mean(F.zip_with(logits, tokens, lambda row, t: log_softmax_at(row, t)))


def action_cost(action: Column, text: Column, tokens: Column) -> Column:
    """Tokens of an action's whole text; pruning and empty texts are free."""
    return F.when((action == "PRUNE") | (F.coalesce(text, F.lit("")) == ""), F.lit(0)).otherwise(tokens)


def reward(before: Column, after: Column, cost: Column, alpha: float = 1.0, beta: float = 0.005) -> Column:
    return F.lit(float(alpha)) * (after - before) - F.lit(float(beta)) * cost


def compression_ratio(kept: Column, steps: Column) -> Column:
    return F.when(steps > 0, F.lit(1.0) - kept / steps).otherwise(F.lit(0.0))
