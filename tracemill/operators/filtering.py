"""The filter cascade and its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import extract_answer, verify_answer
from ..functions.text import let, nonblank

# Levels and reasons, in report order.
LEVELS = ["Level 1", "Level 2", "Level 3", "Level 4", "Level 5"]
REASONS = ["kept", "invalid_level", "missing_output", "missing_ground_truth", "too_long", "wrong_answer"]


def reason(level: Column, full_output: Column, ground_truth: Column, tokens: Column, max_length: int = 8192, generated: Column | None = None, verify: bool = True) -> Column:
    """The first test a record fails, or ``kept``. The costly verification stands in the last branch only.

    A record without a token count fails the job once it gets that far.
    """
    length = F.coalesce(tokens, F.raise_error(F.lit("a record has no token count; give a tokenizer")).cast("long"))
    tests = (
        F.when(~F.coalesce(level.isin(LEVELS), F.lit(False)), "invalid_level")
        .when(~nonblank(full_output), "missing_output")
        .when(~nonblank(ground_truth), "missing_ground_truth")
        .when(length >= max_length, "too_long")
    )
    if verify:
        tests = tests.when(~verify_answer(extract_answer(full_output) if generated is None else generated, ground_truth), "wrong_answer")
    return tests.otherwise("kept")


def judge(rows: DataFrame, max_length: int = 8192, count_tokens=None) -> DataFrame:
    """Add output_token_count, generated_answer and reason to normalised records."""
    from .normalize import token_count

    rows = rows.withColumn("output_token_count", token_count(F.col("existing_length"), F.col("full_output"), count_tokens))
    verdict = lambda a: F.struct(a.alias("answer"), reason(F.col("level"), F.col("full_output"), F.col("ground_truth"), F.col("output_token_count"), max_length, a).alias("reason"))
    # the answer is looked for once, and only where the cheap tests let a record pass
    early = reason(F.col("level"), F.col("full_output"), F.col("ground_truth"), F.col("output_token_count"), max_length, verify=False)
    rows = rows.withColumn("__v", let(early, lambda e: F.when(e == "kept", let(extract_answer(F.col("full_output")), verdict)).otherwise(F.struct(F.lit("").alias("answer"), e.alias("reason")))))
    rows = rows.withColumn("reason", F.col("__v.reason"))
    return rows.withColumn("generated_answer", F.when(F.col("reason") == "kept", F.col("__v.answer"))).drop("__v")


def kept(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason") == "kept").drop("reason")


def level_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(LEVELS)], "level_no int, level string")


def level_histogram(df: DataFrame) -> DataFrame:
    """(level, n) of the five levels in order, zeros included; other levels are not shown."""
    counts = df.where(F.col("level").isin(LEVELS)).groupBy(F.col("level").alias("l")).agg(F.count("*").alias("n"))
    return F.broadcast(level_table(df)).join(counts, F.col("level") == F.col("l"), "left").select("level_no", "level", F.coalesce("n", F.lit(0)).alias("n")).orderBy("level_no").select("level", "n")


def reason_counts(judged: DataFrame) -> DataFrame:
    """One row with a count for each reason."""
    return judged.agg(*[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])


def short_levels(df: DataFrame, num_per_level: int) -> DataFrame:
    """Levels with fewer records than asked for."""
    return level_histogram(df).where(F.col("n") < num_per_level)


def in_level_order(df: DataFrame) -> DataFrame:
    """Valid records, level by level, in input order."""
    return df.where(F.col("level").isin(LEVELS)).orderBy("level", "idx")
