"""JSON lines and Parquet in, JSON lines and JSON arrays out."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let, nonblank
from .paths import SHARD_GLOB, Store, resolve_parquet

STRINGS = "map<string,string>"
# The folder of parts that counts as one file, or the file itself.
PARTS_OF_ONE = r"^(.*\.jsonl(?=/[^/]*$)|.*)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, value): every physical line with its 0-based number in its file, blank lines included. A folder of parts named like a file counts as one.

    Lines are numbered from the counts of the file's splits: a count per split and a running sum over that
    small table, which every task gets whole; no line leaves its task.
    """
    return _numbered(spark, path, F.regexp_extract("part", PARTS_OF_ONE, 1)).select("file", "idx", "value")


def _numbered(spark: SparkSession, path: str, file: Column, end: str | None = None) -> DataFrame:
    """(file, idx, value): lines numbered through all parts that ``file``, a column of the path ``part``, puts together, in the order of their names."""
    lines = spark.read.text(path, lineSep=end).select(
        F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    splits = lines.groupBy("part", "block").agg(F.min("at").alias("first"), F.count("*").alias("n")).select("*", file.alias("file"))
    before = Window.partitionBy("file").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", F.col("part").alias("p"), F.col("block").alias("b"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    joined = lines.join(F.broadcast(splits), (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")))
    return joined.select("file", (F.col("at") + F.col("shift")).alias("idx"), "value")


def parsed(value: Column) -> Column:
    """A JSON object as a map of texts: keeps absent apart from null; the last of repeated keys counts; null if malformed."""
    return let(F.from_json(value, STRINGS), _last_wins)


def _last_wins(m: Column) -> Column:
    keys = F.map_keys(m)
    last = F.map_from_entries(F.filter(F.map_entries(m), lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), last).otherwise(m)


def strict(value: Column) -> Column:
    """As ``parsed``; a blank or malformed line fails the job."""
    return F.coalesce(parsed(value), F.raise_error(F.concat(F.lit("malformed line: "), F.substr(value, F.lit(1), F.lit(200)))).cast(STRINGS))


def scan_traces(spark: SparkSession, path: str, num_samples: int | None = None) -> DataFrame:
    """Traces for filtering: blank lines skipped, line numbers kept; a limit of 0 still gives one record."""
    rows = read_lines(spark, path).where(nonblank(F.col("value"))).select("idx", "value", strict(F.col("value")).alias("m"))
    return rows if num_samples is None else rows.orderBy("idx").limit(max(num_samples, 1))


def scan_strict(spark: SparkSession, path: str, num_samples: int | None = None) -> DataFrame:
    """Traces for compression and plain reload: any blank or bad line fails; a limit of 0 or None means all."""
    rows = read_lines(spark, path).select("idx", "value", strict(F.col("value")).alias("m"))
    return rows.orderBy("idx").limit(num_samples) if num_samples else rows


def scan_for_export(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Traces for export: the limit counts physical lines, blank ones are skipped after; 0 gives none."""
    rows = read_lines(spark, path)
    rows = rows if limit is None else rows.where(F.col("idx") < limit)
    return rows.where(nonblank(F.col("value"))).select("idx", "value", strict(F.col("value")).alias("m"))


def scan_sample(spark: SparkSession, path: str, sample_id: int) -> DataFrame:
    """One trace by its line number."""
    return read_lines(spark, path).where(F.col("idx") == sample_id).select("idx", "value", strict(F.col("value")).alias("m"))


def scan_tolerant(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Lines that parse (and have the key); the others are passed over."""
    rows = spark.read.text(path).select("value", parsed(F.col("value")).alias("m")).where(F.col("m").isNotNull())
    return rows.where(F.map_contains_key("m", key)) if key else rows


def scan_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All shard files of a folder with file and line number; blank lines are skipped."""
    return read_lines(spark, f"{folder.rstrip('/')}/{SHARD_GLOB}").where(nonblank(F.col("value"))).select("file", "idx", "value", strict(F.col("value")).alias("m"))


def read_problems(spark: SparkSession, path: str, num_samples: int | None = None) -> DataFrame:
    """Problem records (question, answer, metadata) with their ordinal; only ``problem`` has to be a column."""
    table = spark.read.parquet(resolve_parquet(spark, path))
    text = lambda c: F.col(c) if c in table.columns else F.lit("")
    meta = F.struct(*[text(c).cast("string").alias(c) for c in ("solution", "level", "type", "unique_id")])
    answer = F.coalesce(text("answer").cast("string"), F.lit("None"))
    rows = table.select("*", F.col("_metadata.row_index").alias("ordinal"))
    rows = rows if num_samples is None else rows.where(F.col("ordinal") < num_samples)
    return rows.select("ordinal", F.col("problem").alias("question"), answer.alias("answer"), meta.alias("metadata"))


def as_json(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON text per row, nulls written."""
    return df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, order: list | None = None, mode: str = "overwrite", single_file: bool = False, columns: list[str] | None = None) -> None:
    """Write JSON lines, in order if asked: a folder of ordered part files, or one file of that name."""
    rows = df.orderBy(*order) if order else df
    write_text(as_json(rows, columns), path, mode, single_file)


def write_text(rows: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """Rows (value) as lines, in their order. One file is written as parts by many tasks too, which are then joined by streaming."""
    if not single_file:
        rows.write.mode(mode).text(path)
        return
    parts, store = path.rstrip("/") + ".parts", Store(rows.sparkSession, path)
    rows.write.mode("overwrite").text(parts)
    store.join_files([f for f in store.files(parts, False) if "/part-" in f], f"{parts}/_whole")
    _put(store, f"{parts}/_whole", path, parts)


def place_of_lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, value): the lines of a folder of ordered part files numbered through all files, as one file would be."""
    return _numbered(spark, path, F.lit("")).select(F.col("idx").alias("place"), "value")


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the successful results; failed ones are left for the next run."""
    ok = df.where(F.col("error").isNull()).drop("error") if "error" in df.columns else df
    write_jsonl(ok, path, mode=mode)


def append_results(df: DataFrame, path: str) -> None:
    """Add successful results to those there are; each task's file appears whole or not at all."""
    write_results(df, path, "append")


# What stands between the entries of a pretty array, and behind the last field of one. Texts have no bare line breaks, and what is nested is indented further.
ENTRY_BREAK, ENTRY_END = ",\n", "\n  }"


def write_json_array(df: DataFrame, path: str, order: list, columns: list[str]) -> int:
    """One pretty JSON array, on any store that Spark writes: entries are sorted and made by tasks, their parts are joined by streaming. Returns the number of entries."""

    def pretty(frames):
        for frame in frames:
            for a in range(0, frame.num_rows, 500):
                texts = ["  " + json.dumps(row, indent=2, ensure_ascii=False).replace("\n", "\n  ") for row in frame.slice(a, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])

    spark, parts = df.sparkSession, path.rstrip("/") + ".parts"
    df.orderBy(*order).select(*columns).mapInArrow(pretty, "value string").write.mode("overwrite").text(parts, lineSep=ENTRY_BREAK)
    store = Store(spark, path)
    made = [f for f in store.files(parts, False) if "/part-" in f]
    n = spark.read.text(parts, lineSep=ENTRY_END + ENTRY_BREAK).count()
    store.join_files(made, f"{parts}/_whole", b"[\n" if n else b"[", b"\n]" if n else b"]", len(ENTRY_BREAK))
    _put(store, f"{parts}/_whole", path, parts)
    return n


def _put(store: Store, made: str, path: str, parts: str) -> None:
    """A file made in the folder ``parts`` to its place; the folder goes."""
    if store.exists(path):
        store.delete(path)
    store.rename(made, path)
    store.delete(parts)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(place, x): the entries of an array as ``write_json_array`` writes it, read by as many tasks as the file has splits. One that does not parse fails the job."""
    rows = _numbered(spark, path, F.lit(""), ENTRY_END + ENTRY_BREAK).where(F.col("value") != "[]")
    text = F.regexp_replace("value", r"\A\[\n", "")
    text = F.when(F.endswith(text, F.lit("\n]")), F.substr(text, F.lit(1), F.length(text) - 2)).otherwise(F.concat(text, F.lit(ENTRY_END)))
    return rows.select(F.col("idx").alias("place"), F.from_json(text, schema, {"mode": "FAILFAST"}).alias("x"))
