"""Training entries from refined and original traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_EOS, REASON_PROMPT, compression_suffix, ensure_think_block


def sft_entries(df: DataFrame, question: Column, refined: Column, original: Column, order: Column, eos: str = DEFAULT_EOS, reason_prompt: str = REASON_PROMPT) -> DataFrame:
    """(idx, entry_no, instruction, input, output): a refined entry for every row, then the original where there is one."""
    ask = F.concat(F.coalesce(question, F.lit("")), F.lit("\n" + reason_prompt))
    entry = lambda no, instruction, output: F.struct(F.lit(no).alias("entry_no"), instruction.alias("instruction"), F.lit("").alias("input"), ensure_think_block(output).alias("output"))
    both = F.array(entry(0, F.concat(ask, compression_suffix(eos)), refined), F.when(F.coalesce(original, F.lit("")) != "", entry(1, ask, original)))
    return df.select(order.alias("idx"), F.explode(F.array_compact(both)).alias("x")).select("idx", "x.*")


def refined_counts(df: DataFrame) -> DataFrame:
    """Refined and failed items, counted from the result, not by accumulators that a retry would count twice."""
    return df.agg(F.count_if(F.col("error").isNull()).alias("refined"), F.count_if(F.col("error").isNotNull()).alias("failed"))
