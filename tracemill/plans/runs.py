"""The stages as functions over files: prepare, compress, merge, export. Settings carry the usual defaults."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_EOS, REASON_PROMPT, model_name, user_prompt
from ..operators import compress as C
from ..operators import export, filtering, normalize, sampling, steps
from ..sources import jsonl, paths
from ..sources.scratch import work_folder


@dataclass(frozen=True)
class Prepare:
    num_per_level: int = 500
    max_length: int = 8192
    seed: int = 42
    num_samples: int | None = None


def prompts(spark: SparkSession, path: str, num_samples: int | None = None) -> DataFrame:
    """Problem records with the prompt to generate from."""
    rows = jsonl.read_problems(spark, path, num_samples)
    return rows.withColumn("prompt", user_prompt(F.col("question")))


def generated_records(rows: DataFrame, dataset: str) -> DataFrame:
    """Generated traces in their output shape: failed batches leave gaps in sample_id."""
    ok = rows.where(F.col("error").isNull())
    return ok.select(
        "question", "prompt", "full_output", "output_token_count", F.col("answer").alias("ground_truth"), F.col("ordinal").alias("sample_id"), F.lit(dataset).alias("dataset"),
        "metadata", "metadata.level", "metadata.type", "metadata.unique_id",
    ).orderBy("sample_id")


# The columns of a prepared trace.
PREPARED = ["question", "prompt", "full_output", "ground_truth", "sample_id", "metadata", "level", "type", "unique_id", "generated_answer", "output_token_count"]


def prepare(spark: SparkSession, source: str, settings: Prepare = Prepare(), count_tokens=None) -> tuple[DataFrame, DataFrame]:
    """(sampled traces in output order, one row of reason counts)."""
    path = paths.resolve_traces(spark, source)
    rows = normalize.normalize(jsonl.scan_traces(spark, path, settings.num_samples))
    judged = filtering.judge(rows, settings.max_length, count_tokens)
    sample = sampling.sample_by_level(filtering.kept(judged), settings.num_per_level, settings.seed)
    return sample.select(*PREPARED, "out_pos"), filtering.reason_counts(judged)


def save_prepared(spark: SparkSession, source: str, output: str, settings: Prepare = Prepare(), count_tokens=None) -> str:
    sample, _ = prepare(spark, source, settings, count_tokens)
    target = paths.prepared_path(output, paths.resolve_traces(spark, source))
    jsonl.write_jsonl(sample, target, order=["out_pos"], single_file=True, columns=PREPARED)
    return target


def pending(spark: SparkSession, source: str, output: str, num_samples: int | None = None, shard_id: int = 0, num_shards: int = 1) -> DataFrame:
    """Records of a shard that have no result in ``output`` yet."""
    rows = jsonl.scan_strict(spark, source, num_samples)
    rows = sampling.shard(rows, shard_id, num_shards) if num_shards > 1 else rows
    typed = rows.select("idx", *[F.col("m")[k].alias(k) for k in ("question", "prompt", "full_output", "ground_truth")], F.col("m")["sample_id"].try_cast("long").alias("sample_id"))
    if not paths.Store(spark, output).exists(output):
        return typed
    done = jsonl.scan_tolerant(spark, output, "sample_id").select(F.col("m")["sample_id"].try_cast("long").alias("sample_id"))
    return sampling.not_done(typed, done)


def compress_traces(rows: DataFrame, make_provider, scores, gate: C.Gate = C.Gate()) -> DataFrame:
    """Compressed traces of pending records; ``scores`` maps a frame with steps to one with step_scores."""
    return C.compress_with(scores(steps.with_steps(rows)), make_provider, gate)


def compressed_paths(output_dir: str, source: str, shard_id: int | None = None) -> tuple[str, str]:
    """(the results of a run or shard, the dataset's folder)."""
    stem = posixpath.splitext(posixpath.basename(source.rstrip("/")))[0]
    folder = posixpath.join(output_dir, f"compressed_{stem}")
    return posixpath.join(folder, paths.COMPRESSED_NAME if shard_id is None else f"greedy_compressed_shard{shard_id}.jsonl"), folder


def save_compressed(spark: SparkSession, source: str, output_dir: str, make_provider, scores, gate: C.Gate = C.Gate(), num_samples: int | None = None, shard_id: int | None = None, num_shards: int | None = None) -> str:
    """Compress what has no result yet and add it to the results of the run or shard. Failed traces are tried again on the next run."""
    target, _ = compressed_paths(output_dir, source, shard_id)
    parted = shard_id is not None and num_shards is not None
    rows = pending(spark, source, target, num_samples, shard_id if parted else 0, num_shards if parted else 1)
    jsonl.append_results(C.compressed_records(compress_traces(rows, make_provider, scores, gate)), target)
    return target


def publish(spark: SparkSession, folder: str, canonical: str, single_file: bool = True) -> str:
    """Merge the shards of a dataset's folder where there are any, and copy the results to their canonical path."""
    merged = posixpath.join(folder, paths.COMPRESSED_NAME)
    if paths.has_shards(spark, folder):
        merge(spark, folder, merged)
    jsonl.write_text(jsonl.place_of_lines(spark, merged).orderBy("place").select("value"), canonical, single_file=single_file)
    return canonical


def generated(rows: DataFrame, make_model, batch_size: int = 32) -> DataFrame:
    """Rows with a prompt and what the model made of them, written before anything reads them: paid for once, whatever sorts or is lost later."""
    from ..providers import generate

    made = work_folder(rows.sparkSession, "generated")
    generate(rows, make_model, batch_size).write.parquet(made)
    return rows.sparkSession.read.parquet(made)


def save_generated(spark: SparkSession, source: str, output_dir: str, dataset: str, model: str, make_model, num_samples: int | None = None, batch_size: int = 32) -> str:
    """Generate traces for problem records; batches that fail leave gaps in the ids."""
    made = generated(prompts(spark, source, num_samples), make_model, batch_size)
    target = paths.traces_path(output_dir, model_name(model), dataset)
    jsonl.write_jsonl(generated_records(made, dataset), target, order=["sample_id"])
    return target


def merge(spark: SparkSession, folder: str, output: str, single_file: bool = False) -> None:
    """All shard results of a folder, by sample id: a folder of ordered parts, or one file of that name."""
    jsonl.write_text(sampling.merge_shards(jsonl.scan_shards(spark, folder)).select("value"), output, single_file=single_file)


def stats(spark: SparkSession, path: str) -> DataFrame:
    """Averages over a results file; lines that do not parse are passed over."""
    rows = jsonl.scan_tolerant(spark, path)
    number = lambda k: F.col("m")[k].try_cast("double").alias(k)
    return C.run_stats(rows.select(number("num_steps"), number("num_kept_steps"), number("compression_ratio"), F.when(F.map_contains_key("m", "error"), F.coalesce(F.col("m")["error"], F.lit(""))).alias("error")))


def export_sft(spark: SparkSession, source: str, make_chat, output: str, limit: int | None = None, eos: str = DEFAULT_EOS, reason_prompt: str = REASON_PROMPT, workers: int | None = None) -> int:
    """Refine compressed traces and write the training entries as one JSON array; nothing is written if a row keeps failing."""
    from ..providers import refine

    rows = jsonl.scan_for_export(spark, source, limit)
    rows = rows.select("idx", *[F.coalesce(F.col("m")[k], F.lit("")).alias(k) for k in ("question", "compressed_output", "original_output")])
    if rows.isEmpty():
        return 0
    if workers:
        rows = rows.repartition(workers)
    # every refinement has succeeded, and is written, before the file is opened: a lost executor does not bill it again
    done = work_folder(spark, "refined")
    refine(rows, make_chat).write.parquet(done)
    refined = spark.read.parquet(done)
    entries = export.sft_entries(refined, F.col("question"), F.col("refined"), F.col("original_output"), F.col("idx"), eos, reason_prompt)
    return jsonl.write_json_array(entries, output, ["idx", "entry_no"], ["instruction", "input", "output"])
