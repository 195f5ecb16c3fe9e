"""Loosely structured records to one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, py_strip

# The fields that may hold a stored length, in order of trust.
LENGTH_FIELDS = ["output_token_count", "step1_output_tokens", "full_output_token_count", "filter_response_length"]


def metadata(m: Column) -> Column:
    """The metadata object as a map; anything else counts as empty."""
    return F.coalesce(F.from_json(m["metadata"], "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def field(m: Column, key: str, default: Column) -> Column:
    """A field as text: absent gives the default, null gives ``None``."""
    return F.when(F.map_contains_key(m, key), F.coalesce(m[key], F.lit("None"))).otherwise(default)


def normalize(records: DataFrame) -> DataFrame:
    """(idx, value, m) to typed columns. Fields fall back only when absent; a sample without id gets its line number."""
    m, empty = F.col("m"), F.lit("")
    meta = F.col("metadata")
    rows = records.withColumn("metadata", metadata(m))
    return rows.select(
        "idx",
        "value",
        "m",
        "metadata",
        field(m, "question", field(m, "problem", empty)).alias("question"),
        field(m, "prompt", empty).alias("prompt"),
        field(m, "full_output", empty).alias("full_output"),
        field(m, "ground_truth", field(m, "answer", empty)).alias("ground_truth"),
        *[field(m, k, field(meta, k, empty)).alias(k) for k in ("level", "type", "unique_id")],
        F.when(F.map_contains_key(m, "sample_id"), m["sample_id"].try_cast("long")).otherwise(F.col("idx")).alias("sample_id"),
        existing_length(F.col("value"), m).alias("existing_length"),
    )


def py_int(kind: Column, text: Column) -> Column:
    """What Python's int() makes of a JSON value, given its variant type and its text; null where it refuses."""
    plain = py_strip(text)
    whole = F.when(plain.rlike(r"\A[+-]?[0-9]+(?:_[0-9]+)*\z"), F.replace(plain, F.lit("_"), F.lit("")).try_cast("long"))
    number = F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT)"), text.try_cast("long")).otherwise(F.when(F.abs(text.try_cast("double")) < 9.2e18, text.try_cast("double").cast("long")))
    return (
        F.when(kind == "STRING", whole)
        .when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0))
        .when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), number)
    )


def existing_length(value: Column, m: Column) -> Column:
    """The first stored length that reads as a whole number. An infinite one is passed over."""

    def first(v: Column) -> Column:
        found = []
        for name in LENGTH_FIELDS:
            # a line that is no variant (NaN, repeated keys) is judged by its text alone
            guess = F.when(m[name].rlike(r"^-?[0-9]"), F.lit("DOUBLE")).otherwise(F.lit("STRING"))
            kind = F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), guess)
            found.append(F.when(m[name].isNotNull(), py_int(kind, m[name])))
        return F.coalesce(*found)

    return let(F.try_parse_json(value), first)


def token_count(existing: Column, full_output: Column, count_tokens=None) -> Column:
    """The stored length, else the tokenizer's; ``count_tokens`` maps a text column to its number of tokens."""
    return existing if count_tokens is None else F.coalesce(existing, count_tokens(full_output))


def needs_tokenizer(rows: DataFrame) -> bool:
    """Whether some record has no stored length."""
    return not rows.where(F.col("existing_length").isNull()).isEmpty()
