"""Registered queries that go through files: readers with their limits, sinks, resuming, merging, export."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import providers as P
from ..functions import text as T
from ..operators import filtering, normalize
from ..sources import jsonl, paths
from ..sources.scratch import work_folder
from . import runs
from .queries import _ANSWERS, _TRACES, query, table, traces


def as_file(lines: DataFrame, order: str, name: str = "traces_cot.jsonl", folder: str | None = None, single_file: bool = False) -> str:
    """Rows (order, value) as a folder of ordered parts that counts as one file of lines, or as one file."""
    path = posixpath.join(folder or work_folder(lines.sparkSession, "lines"), name)
    jsonl.write_text(lines.orderBy(order).select("value"), path, single_file=single_file)
    return path


def event_lines(spark: SparkSession, sf_dir: str, special: str) -> DataFrame:
    """A line for each event, in order; ``special`` is an SQL expression that replaces some."""
    plain = "concat('{\"sample_id\":', cast(event_id AS string), ',\"question\":\"', event_type, '\"}')"
    return table(spark, sf_dir, "events").selectExpr("event_id", f"coalesce({special}, {plain}) AS value")


@query("""SELECT 'traces' AS reader, 0 AS lim, min(event_id) AS idx FROM events WHERE event_id % 11 <> 0
UNION ALL SELECT 'traces', 500, event_id FROM (SELECT event_id FROM events WHERE event_id % 11 <> 0 ORDER BY event_id LIMIT 500)
UNION ALL SELECT 'export', 500, event_id FROM events WHERE event_id < 500 AND event_id % 11 <> 0
UNION ALL SELECT 'strict', 0, event_id FROM events UNION ALL SELECT 'strict', 500, event_id FROM events WHERE event_id < 500 UNION ALL SELECT 'sample', 42, 42""")
def reader_limits(spark, sf_dir):
    """The line numbers that each reader gives for limits of 0 and 500: blank lines, every eleventh, count for some of them."""
    gaps = as_file(event_lines(spark, sf_dir, "CASE WHEN event_id % 11 = 0 THEN concat(' ', chr(9)) END"), "event_id")
    full = as_file(event_lines(spark, sf_dir, "CAST(NULL AS string)"), "event_id")
    read = [("traces", 0, jsonl.scan_traces(spark, gaps, 0)), ("traces", 500, jsonl.scan_traces(spark, gaps, 500)), ("export", 0, jsonl.scan_for_export(spark, gaps, 0)), ("export", 500, jsonl.scan_for_export(spark, gaps, 500)),
            ("strict", 0, jsonl.scan_strict(spark, full, 0)), ("strict", 500, jsonl.scan_strict(spark, full, 500)), ("sample", 42, jsonl.scan_sample(spark, full, 42))]
    out = None
    for reader, lim, rows in read:
        one = rows.select(F.lit(reader).alias("reader"), F.lit(lim).alias("lim"), "idx")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_id AS idx, event_id AS sample_id, event_type AS question FROM events")
def reader_strict(spark, sf_dir):
    path = as_file(event_lines(spark, sf_dir, "CAST(NULL AS string)"), "event_id")
    return jsonl.scan_strict(spark, path).select("idx", F.col("m")["sample_id"].cast("long").alias("sample_id"), F.col("m")["question"].alias("question"))


@query("SELECT event_id AS sample_id FROM events WHERE event_id % 13 <> 0 AND event_id % 7 <> 0")
def reader_tolerant(spark, sf_dir):
    """Broken lines and those without an id are passed over."""
    path = as_file(event_lines(spark, sf_dir, "CASE WHEN event_id % 13 = 0 THEN '{oops' WHEN event_id % 7 = 0 THEN '{\"id\":1}' END"), "event_id")
    return jsonl.scan_tolerant(spark, path, "sample_id").select(F.col("m")["sample_id"].cast("long").alias("sample_id"))


@query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal FROM part)
SELECT ordinal, p_name AS question, CASE WHEN p_partkey % 5 = 0 THEN 'None' ELSE CAST(p_size AS VARCHAR) END AS answer, p_brand AS level, '' AS unique_id FROM p WHERE ordinal < 700""")
def reader_problems(spark, sf_dir):
    """The first 700 problem records of a folder with one Parquet file."""
    rows = table(spark, sf_dir, "part").orderBy("p_partkey").selectExpr("p_name AS problem", "CASE WHEN p_partkey % 5 <> 0 THEN cast(p_size AS string) END AS answer", "p_brand AS level")
    folder = work_folder(spark, "problems")
    rows.coalesce(1).write.parquet(f"{folder}/data")
    return jsonl.read_problems(spark, folder, 700).select("ordinal", "question", "answer", "metadata.level", "metadata.unique_id")


@query("""WITH s AS (SELECT o_orderkey AS line, CASE o_orderkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '10' ELSE '2' END AS shard, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS id FROM orders)
SELECT row_number() OVER (ORDER BY coalesce(id, 0), shard, line) - 1 AS place, line, shard FROM s""")
def merged_shards(spark, sf_dir):
    """Three shard files merged: by id (missing counts as 0), file name, line."""
    folder = work_folder(spark, "shards")
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '10' ELSE '2' END AS shard", "CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS sample_id")
    for shard in ("0", "10", "2"):
        lines = rows.where(F.col("shard") == shard).select("o_orderkey", F.to_json(F.struct("sample_id", F.col("o_orderkey").alias("line"), "shard")).alias("value"))
        as_file(lines, "o_orderkey", f"greedy_compressed_shard{shard}.jsonl", folder)
    runs.merge(spark, folder, f"{folder}/{paths.COMPRESSED_NAME}")
    m = jsonl.strict(F.col("value"))
    return jsonl.place_of_lines(spark, f"{folder}/{paths.COMPRESSED_NAME}").select("place", m["line"].cast("long").alias("line"), m["shard"].alias("shard"))


@query("""SELECT * FROM (VALUES ('model', 'm-7B'), ('traces', 'base/m-7B/d_cot.jsonl'), ('prepared folder', 'out/a_prepared.jsonl'), ('prepared file', 'out.JSONL'), ('demo small', 's'), ('demo large', 'l'),
('demo none', 'ValueError'), ('only traces', 'x_cot.jsonl'), ('several', 'ValueError'), ('missing', 'FileNotFoundError'), ('parquet folder', 'part-'), ('parquet missing', 'FileNotFoundError'), ('stale', 'positions.json,region_stats_layer0.png'), ('stale left', '')) v(name, value)""")
def path_rules(spark, sf_dir):
    """Which file a path means, and what is stale, over files made for it."""
    folder = work_folder(spark, "paths")
    one = spark.range(1).selectExpr("id", "'{}' AS value")
    as_file(one, "id", "x_cot.jsonl", f"{folder}/a", single_file=True)
    as_file(one, "id", "y.jsonl", f"{folder}/a", single_file=True)
    as_file(one, "id", "y.jsonl", f"{folder}/b", single_file=True)
    as_file(one, "id", "z.jsonl", f"{folder}/b", single_file=True)
    as_file(one, "id", "note.txt", f"{folder}/c", single_file=True)
    for name in ("positions.json", "region_stats_layer0.png", "other.png"):
        as_file(one, "id", name, f"{folder}/d", single_file=True)
    one.coalesce(1).write.parquet(f"{folder}/p/data")

    def tried(f, *args):
        try:
            return posixpath.basename(f(*args))
        except (ValueError, FileNotFoundError) as error:
            return type(error).__name__

    stale = lambda: ",".join(posixpath.basename(f) for f in paths.remove_stale_figures(spark, f"{folder}/d", confirm=True))
    rows = [
        ("model", T.model_name("hub/m-7B/")), ("traces", paths.traces_path("base", "m-7B", "d")), ("prepared folder", paths.prepared_path("out", "in/a.jsonl")), ("prepared file", paths.prepared_path("out.JSONL", "a")),
        ("demo small", paths.demo_traces("m-1.5B", "s", "l")), ("demo large", paths.demo_traces("m-7B", "s", "l")), ("demo none", tried(paths.demo_traces, "m", "s", "l")),
        ("only traces", tried(paths.resolve_traces, spark, f"{folder}/a")), ("several", tried(paths.resolve_traces, spark, f"{folder}/b")), ("missing", tried(paths.resolve_traces, spark, f"{folder}/c")),
        ("parquet folder", tried(paths.resolve_parquet, spark, f"{folder}/p")[:5]), ("parquet missing", tried(paths.resolve_parquet, spark, f"{folder}/a")), ("stale", stale()), ("stale left", stale()),
    ]
    return spark.createDataFrame(rows, "name string, value string")


_PROMPT = "concat('What is ', o_orderkey, '?', chr(10), 'Please reason step by step, and put your final answer within ', chr(92), 'boxed{}.')"


@query(f"""SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_orderkey AS sample_id, concat('to ', {_PROMPT}) AS full_output, 15 AS output_token_count, o_orderpriority AS level, CAST(o_custkey AS VARCHAR) AS ground_truth
FROM orders WHERE o_orderkey % 10 <> 7""".replace("15 AS", "CAST(15 AS BIGINT) AS"))
def generated_traces(spark, sf_dir):
    """Generation with a stand-in that fails on some prompts, written in order and read again; failures leave gaps."""

    def make():
        def model(prompts):
            if any("7?" in p for p in prompts):
                raise RuntimeError("out of memory")
            return [("to " + p, len(p.split())) for p in prompts]

        return model

    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("What is "), F.col("o_orderkey"), F.lit("?")).alias("question"), F.col("o_custkey").cast("string").alias("answer"),
        F.struct(F.lit("").alias("solution"), F.col("o_orderpriority").alias("level"), F.lit("").alias("type"), F.lit("").alias("unique_id")).alias("metadata"),
    )
    made = runs.generated(rows.withColumn("prompt", T.user_prompt(F.col("question"))), make, batch_size=1)
    path = paths.traces_path(work_folder(spark, "generated"), "m", "d")
    jsonl.write_jsonl(runs.generated_records(made, "d"), path, order=["sample_id"])
    m = F.col("m")
    return jsonl.place_of_lines(spark, path).select("place", jsonl.strict(F.col("value")).alias("m")).select("place", m["sample_id"].cast("long").alias("sample_id"), m["full_output"].alias("full_output"), m["output_token_count"].cast("long").alias("output_token_count"), m["level"].alias("level"), m["ground_truth"].alias("ground_truth"))


@query(f"WITH {_ANSWERS} SELECT sample_id, answer AS generated_answer, tokens AS output_token_count, level FROM j WHERE reason = 'kept'")
def prepared_file(spark, sf_dir):
    """Traces written as lines, read, judged, and the kept ones written under their prepared name and read again."""
    folder = work_folder(spark, "prepare")
    source = traces(spark, sf_dir).select("idx", F.to_json(F.struct("sample_id", "level", "question", "full_output", "ground_truth", F.col("tokens").alias("output_token_count"))).alias("value"))
    path = as_file(source, "idx", folder=folder)
    kept = filtering.kept(filtering.judge(normalize.normalize(jsonl.scan_traces(spark, paths.resolve_traces(spark, folder)))))
    target = paths.prepared_path(f"{folder}/out", path)
    jsonl.write_jsonl(kept, target, columns=runs.PREPARED)
    m = F.col("m")
    return jsonl.scan_tolerant(spark, target, "sample_id").select(m["sample_id"].cast("long").alias("sample_id"), m["generated_answer"].alias("generated_answer"), m["output_token_count"].cast("long").alias("output_token_count"), m["level"].alias("level"))


@query("SELECT o_orderkey AS sample_id FROM orders WHERE o_orderkey % 9 <> 0 AND NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0)")
def resumed_traces(spark, sf_dir):
    """What a resumed run has left: successes were appended twice over, failures were not written, and a null id is done like any other."""
    folder = work_folder(spark, "resume")
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey END AS sample_id", "concat('What is ', o_orderkey, '?') AS question")
    path = as_file(rows.select("o_orderkey", F.to_json(F.struct("sample_id", "question"), {"ignoreNullFields": "false"}).alias("value")), "o_orderkey", folder=folder)
    done = rows.where("o_orderkey % 3 = 0").withColumn("error", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'failed' END"))
    for part in (0, 1):
        jsonl.append_results(done.where(F.col("o_orderkey") % 2 == part).select("sample_id", "error"), f"{folder}/{paths.COMPRESSED_NAME}")
    return runs.pending(spark, path, f"{folder}/{paths.COMPRESSED_NAME}").select("sample_id")


@query(r"""WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
p AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM q JOIN a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1),
e AS (SELECT conv_id, turn, 0 AS entry_no, question || chr(10) || 'Please reason step by step, and put your final answer within ' || chr(92) || 'boxed{}.<｜end▁of▁sentence｜><｜compressed｜><｜end▁of▁sentence｜>' AS instruction, 'refined' AS body FROM p
 UNION ALL SELECT conv_id, turn, 1, question || chr(10) || 'Please reason step by step, and put your final answer within ' || chr(92) || 'boxed{}.', regexp_replace(answer, '^\s+|\s+$', '', 'g') FROM p WHERE turn % 4 <> 0)
SELECT row_number() OVER (ORDER BY conv_id, turn, entry_no) - 1 AS place, md5(instruction) AS instruction, md5('<think>' || chr(10) || body || chr(10) || '</think>' || chr(10) || chr(10)) AS output FROM e""")
def exported_array(spark, sf_dir):
    """Refined by a stand-in and written as one JSON array, in the order of the lines."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), T.as_prose(F.col("text")).alias("compressed_output"))
    rows = q.join(a, ["conv_id", "turn"]).withColumn("original_output", F.when(F.col("turn") % 4 != 0, F.col("compressed_output")).otherwise(""))
    lines = rows.select(F.struct("conv_id", "turn").alias("at"), F.to_json(F.struct("question", "compressed_output", "original_output")).alias("value"))
    target = f"{work_folder(spark, 'sft')}/sft.json"
    runs.export_sft(spark, as_file(lines, "at"), lambda: lambda messages: " refined ", target)
    entries = jsonl.read_json_array(spark, target, "instruction string, input string, output string")
    return entries.select(F.col("place").cast("long").alias("place"), F.md5("x.instruction").alias("instruction"), F.md5(T.from_prose(F.col("x.output"))).alias("output"))


@query(f"WITH {_TRACES} SELECT row_number() OVER (ORDER BY level, sample_id) - 1 AS place, sample_id, level FROM t WHERE level <> 'none'")
def level_order(spark, sf_dir):
    """Valid records level by level, in input order, written in that order and numbered as read."""
    path = f"{work_folder(spark, 'levels')}/ordered.jsonl"
    jsonl.write_text(jsonl.as_json(filtering.in_level_order(traces(spark, sf_dir)), ["sample_id", "level"]), path)
    m = jsonl.strict(F.col("value"))
    return jsonl.place_of_lines(spark, path).select("place", m["sample_id"].cast("long").alias("sample_id"), m["level"].alias("level"))
