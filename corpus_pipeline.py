"""The corpus pipeline: five stages, each over all that the stage before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of ``documents``; further columns of any names travel along.

Defined cases, for every stage: a null text counts as empty (it is clean, has no secrets, and packs as one end token) and stays null; very
long texts are read whole; an empty table gives an empty one. Rows that share an id are judged each by its own text; the
near-duplicate stage keeps one row of texts that are alike, that of the smallest id, where a null id comes last, and one of equal rows; the
other stages treat repeated rows alike and keep their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import secrets
from tracemill.llm.common import clear_scratch, drop_scratch, materialize, read_table, scratch_mark, set_aside
from tracemill.llm.decontaminate import decontaminate
from tracemill.llm.near_copies import keep_first_copy
from tracemill.llm.packing import pack
from tracemill.llm.queries import tokenizer_file
from tracemill.llm.toxicity import classify, fit, remainder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects at their language's threshold go; the held-out quarter of labels is not learned from."""
    model = fit(docs, read_table(spark, sf_dir, "labels"), remainder() != 2)
    rows, restore = set_aside(docs, ["score", "toxic"])
    return restore(classify(rows, model).where(~F.col("toxic")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash classes, and MinHash groups beside them, name candidates; of documents whose sets of five-word shingles have similarity 0.8
    or more, that with the smallest id stays."""
    return keep_first_copy(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"), action="documents")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; every document stays."""
    fixed = secrets.redact(docs)
    return fixed.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns) if "n_chars" in docs.columns else fixed


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, with their sequence and place."""
    return pack(docs, tokenizer_file()).drop("text_hash")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark, before = scratch_mark(), docs
        docs = materialize(stage(spark, before, sf_dir), f"pipeline-{name}")
        clear_scratch(spark, mark, keep=(docs,))
        drop_scratch(before)
    return docs
