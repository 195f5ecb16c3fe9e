"""Steps of a trace and the numbers attached to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions.text import STEP_SEPARATOR, let, split_steps, split_think


def with_steps(df: DataFrame, text: str = "full_output", separator: str = STEP_SEPARATOR, whole: bool = False) -> DataFrame:
    """Add thinking, after_think and steps; ``whole`` takes the text itself as the thinking part."""
    parts = F.struct(F.coalesce(F.col(text), F.lit("")).alias("before"), F.lit("").alias("after")) if whole else split_think(F.col(text))
    df = df.withColumn("__think", parts)
    return df.withColumns({"thinking": F.col("__think.before"), "after_think": F.col("__think.after"), "steps": split_steps(F.col("__think.before"), separator)}).drop("__think")


def exploded(df: DataFrame, *keys: str) -> DataFrame:
    """One row per step with its 0-based position."""
    return df.select(*keys, F.posexplode("steps").alias("pos", "step"))


def prefix_ends(steps: Column, separator: str = STEP_SEPARATOR) -> Column:
    """For each step where the text up to it ends in the joined steps, with a separator behind all but the last."""
    n, gap = F.size(steps), len(separator)
    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(acc, s):
        end = acc["at"] + F.length(s) + F.when(F.size(acc["ends"]) + 1 < n, gap).otherwise(0)
        return F.struct(end.alias("at"), F.array_append(acc["ends"], end).alias("ends"))

    return F.aggregate(steps, init, step, lambda a: a["ends"])


def prefixes(steps: Column, separator: str = STEP_SEPARATOR) -> Column:
    """The texts up to each step: as long as the square of the trace, so made only where they are scored at once; else keep ``prefix_ends``."""
    joined = F.array_join(steps, separator)
    return let(joined, lambda t: F.transform(prefix_ends(steps, separator), lambda e: F.substr(t, F.lit(1), e)))


def token_spans(prompt_tokens: Column, prefix_tokens: Column, sequence: Column) -> Column:
    """(s, e) of each step from the token counts of prompt + prefix: from the previous end to its own, inside the sequence."""
    end = lambda i: F.least(F.element_at(prefix_tokens, i + 1), sequence)
    return F.transform(prefix_tokens, lambda t, i: F.struct(F.when(i == 0, prompt_tokens).otherwise(F.element_at(prefix_tokens, F.greatest(i, F.lit(1)))).cast("int").alias("s"), end(i).cast("int").alias("e")))


def span_scores(row: Column, spans: Column) -> Column:
    """Mean attention of each span; null where a span is not valid."""
    return F.transform(spans, lambda x: N.span_mean(row, x["s"], x["e"]))


def spans_valid(row: Column, spans: Column) -> Column:
    return F.forall(spans, lambda x: (x["s"] >= 0) & (x["s"] < x["e"]) & (x["e"] <= F.size(row)))


def span_scores_by_join(positions: DataFrame, spans: DataFrame, keys: list[str], bucket: int = 256) -> DataFrame:
    """The same for long tables: positions (keys, pos, value) inside spans (keys, step, s, e), averaged.

    The range join is an equi-join on keys and position bucket; a span is listed in the buckets it touches.
    """
    left = positions.withColumn("__b", F.floor(F.col("pos") / bucket).cast("long"))
    right = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col("s") / bucket).cast("long"), F.floor((F.col("e") - 1) / bucket).cast("long")))).where(F.col("s") < F.col("e"))
    hit = left.join(right, [*keys, "__b"]).where((F.col("pos") >= F.col("s")) & (F.col("pos") < F.col("e")))
    return hit.groupBy(*keys, "step").agg(F.avg("value").alias("score"))


def adjacent_similarity(df: DataFrame, trace: str, order: str, vec: str) -> DataFrame:
    """Cosine of each vector with the one before it in its trace; one row less than there are steps."""
    before = F.lag(vec).over(Window.partitionBy(trace).orderBy(order))
    return df.withColumn("__before", before).where(F.col("__before").isNotNull()).select(trace, order, N.cosine(F.col("__before"), F.col(vec)).alias("similarity"))


def adjacent_similarities(vectors: Column) -> Column:
    """The same for an array of vectors."""
    n = F.size(vectors)
    return F.when(n > 1, F.zip_with(F.slice(vectors, F.lit(1), n - 1), F.slice(vectors, F.lit(2), n - 1), lambda a, b: N.cosine(a, b))).otherwise(F.array().cast("array<double>"))


def positions_in_tokens(text: Column, places: Column, count_tokens) -> Column:
    """Token positions from the character places of ``functions.text.token_positions``; ``count_tokens`` counts a text's tokens."""
    at = lambda i: F.when(i.isNotNull(), count_tokens(F.substr(text, F.lit(1), i)))
    return F.struct(
        at(places["think_start"]).alias("think_start"),
        at(places["think_end"]).alias("think_end"),
        F.transform(places["steps"], lambda x: F.struct(at(x["s"]).alias("s"), at(x["e"]).alias("e"))).alias("steps"),
    )


def whitespace_tokens(text: Column) -> Column:
    """A stand-in tokenizer: the number of white-space-delimited words."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0)))


def heatmap(df: DataFrame, keys: list[str], layer: str = "layer", heads: str = "heads") -> DataFrame:
    """(keys, layer, row, col, value): the head mean of each layer's matrix, scaled to 0..1 by the layer's range.

    ``heads`` is an array over heads of matrices.
    """
    average = F.aggregate(
        F.slice(F.col(heads), F.lit(2), F.greatest(F.size(heads) - 1, F.lit(0))),
        F.element_at(heads, 1),
        lambda a, h: F.zip_with(a, h, lambda x, y: F.zip_with(x, y, lambda p, q: p + q)),
    )
    rows = df.withColumn("__m", F.transform(average, lambda r: F.transform(r, lambda x: x / F.size(heads))))
    rows = rows.withColumns({"__lo": F.array_min(F.transform("__m", lambda r: F.array_min(r))), "__hi": F.array_max(F.transform("__m", lambda r: F.array_max(r)))})
    rows = rows.select(*keys, layer, "__lo", "__hi", F.posexplode("__m").alias("row", "__r")).select(*keys, layer, "row", "__lo", "__hi", F.posexplode("__r").alias("col", "__v"))
    scaled = F.when(F.col("__hi") > F.col("__lo"), (F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(0.0))
    return rows.select(*keys, layer, "row", "col", scaled.alias("value"))


def ticks(positions: Column) -> Column:
    """Axis marks sorted by position: the tags and the start of each step."""
    marks = F.concat(
        F.array(F.struct(positions["think_start"].cast("int").alias("at"), F.lit("<think>").alias("label")), F.struct(positions["think_end"].cast("int").alias("at"), F.lit("</think>").alias("label"))),
        F.transform(positions["steps"], lambda x, i: F.struct(x["s"].cast("int").alias("at"), F.concat(F.lit("Step "), (i + 1).cast("string")).alias("label"))),
    )
    return let(F.filter(marks, lambda x: x["at"].isNotNull()), lambda m: F.array_sort(m))
