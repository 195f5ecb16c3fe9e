import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tracemill import providers as P
from tracemill.functions import numeric as N
from tracemill.operators import compress as C
from tracemill.operators import export, filtering, normalize, sampling, steps
from tracemill.plans import runs
from tracemill.sources import jsonl, paths
from tracemill.streaming import follow_traces, process_as_they_come


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def trace(i, **more):
    return {"question": f"q{i}", "prompt": "p", "full_output": f"s\n</think>\n\n\\boxed{{{i}}}", "ground_truth": str(i), "sample_id": i, "level": f"Level {i % 5 + 1}", "output_token_count": 10} | more


def test_line_numbers_over_splits(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", [f'{{"n":{i}}}' if i % 7 else "" for i in range(5000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = jsonl.read_lines(spark, path)
        assert rows.rdd.getNumPartitions() > 3
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r["idx"] for r in got) == list(range(5000))
    assert all(json.loads(r["value"])["n"] == r["idx"] for r in got if r["value"])


def test_limits_differ_by_reader(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", ["", {"sample_id": 0}, " ", {"sample_id": 1}, {"x": 2}])
    assert [r["idx"] for r in jsonl.scan_traces(spark, path, 0).collect()] == [1]
    assert [r["idx"] for r in jsonl.scan_traces(spark, path).orderBy("idx").collect()] == [1, 3, 4]
    assert [r["idx"] for r in jsonl.scan_for_export(spark, path, 4).orderBy("idx").collect()] == [1, 3]
    assert jsonl.scan_for_export(spark, path, 0).collect() == []
    with pytest.raises(Exception, match="malformed"):
        jsonl.scan_strict(spark, path).collect()
    clean = lines(tmp_path / "b.jsonl", [{"sample_id": i} for i in range(4)])
    assert jsonl.scan_strict(spark, clean, 0).count() == 4 and jsonl.scan_strict(spark, clean, 2).count() == 2
    assert [r["m"]["sample_id"] for r in jsonl.scan_sample(spark, clean, 3).collect()] == ["3"]
    bad = lines(tmp_path / "c.jsonl", [{"sample_id": 1}, "{oops", {"x": 1}])
    assert jsonl.scan_tolerant(spark, bad, "sample_id").count() == 1 and jsonl.scan_tolerant(spark, bad).count() == 2


def test_paths(spark, tmp_path):
    (tmp_path / "d").mkdir()
    with pytest.raises(FileNotFoundError):
        paths.resolve_traces(spark, str(tmp_path / "d"))
    a = lines(tmp_path / "d" / "x.jsonl", [{}])
    assert paths.resolve_traces(spark, str(tmp_path / "d")).endswith("x.jsonl") and paths.resolve_traces(spark, a) == a
    lines(tmp_path / "d" / "y_cot.jsonl", [{}])
    assert paths.resolve_traces(spark, str(tmp_path / "d")).endswith("y_cot.jsonl")
    lines(tmp_path / "d" / "z_cot.jsonl", [{}])
    with pytest.raises(ValueError):
        paths.resolve_traces(spark, str(tmp_path / "d"))
    assert paths.prepared_path("out", "in/a.jsonl") == "out/a_prepared.jsonl" and paths.prepared_path("o.JSONL", "a") == "o.JSONL"
    assert paths.demo_traces("m-1.5B", "s", "l") == "s" and paths.demo_traces("m-7B", "s", "l") == "l"
    with pytest.raises(ValueError):
        paths.demo_traces("m", "s", "l")
    df = spark.createDataFrame([("p", "4", "Level 1")], "problem string, answer string, level string")
    df.coalesce(1).write.parquet(str(tmp_path / "ds" / "data"))
    rows = jsonl.read_problems(spark, str(tmp_path / "ds"), 5).collect()
    assert rows[0]["ordinal"] == 0 and rows[0]["metadata"]["level"] == "Level 1" and rows[0]["metadata"]["type"] == ""
    assert jsonl.read_problems(spark, str(tmp_path / "ds"), 0).collect() == []


def test_normalize(spark, tmp_path):
    raw = [
        {"problem": "P", "answer": "A", "metadata": {"level": "Level 2", "type": "t"}},
        {"question": None, "full_output": None, "level": None, "metadata": "no", "sample_id": 9},
        {"question": "é", "output_token_count": None, "step1_output_tokens": "12.7", "full_output_token_count": 12.9},
        {"output_token_count": True}, {"output_token_count": " 1_000 "}, {"output_token_count": "x", "filter_response_length": 3}, '{"output_token_count": NaN, "step1_output_tokens": 4}', '{"question": "a", "question": "b"}',
    ]
    got = normalize.normalize(jsonl.scan_traces(spark, lines(tmp_path / "a.jsonl", raw))).orderBy("idx").collect()
    assert (got[0]["question"], got[0]["ground_truth"], got[0]["level"], got[0]["type"], got[0]["sample_id"]) == ("P", "A", "Level 2", "t", 0)
    assert (got[1]["question"], got[1]["full_output"], got[1]["level"], got[1]["metadata"], got[1]["sample_id"]) == ("None", "None", "None", {}, 9)
    assert [r["existing_length"] for r in got] == [None, None, 12, 1, 1000, 3, 4, None]
    assert got[7]["question"] == "b"


def test_prepare_run(spark, tmp_path):
    rows = [trace(i) for i in range(60)] + [trace(60, level="Level 9"), trace(61, full_output=" \n"), trace(62, ground_truth="\t"), trace(63, output_token_count=8192), trace(64, ground_truth="0"), trace(65, full_output="\\boxed{\\frac12}", ground_truth="0.5")]
    src = lines(tmp_path / "a_cot.jsonl", rows)
    sample, counts = runs.prepare(spark, str(tmp_path), runs.Prepare(num_per_level=4, seed=3))
    assert counts.first().asDict() == {"kept": 60, "invalid_level": 1, "missing_output": 1, "missing_ground_truth": 1, "too_long": 1, "wrong_answer": 2}
    by_level = {lv: [r for r in rows[:60] if r["level"] == lv] for lv in filtering.LEVELS}
    rng, want = random.Random(3), []
    for lv in filtering.LEVELS:
        want += rng.sample(by_level[lv], 4)
    rng.shuffle(want)
    assert [r["sample_id"] for r in sample.orderBy("out_pos").collect()] == [w["sample_id"] for w in want]
    small = sampling.sample_by_level(normalize.normalize(jsonl.scan_traces(spark, src)).where("sample_id < 60"), 4, 3, chunk=7)
    assert [r["sample_id"] for r in small.collect()] == [w["sample_id"] for w in want]
    out = runs.save_prepared(spark, src, str(tmp_path / "out"), runs.Prepare(num_per_level=4, seed=3))
    written = [json.loads(x) for x in open(out, encoding="utf-8")]
    assert [w["sample_id"] for w in written] == [w["sample_id"] for w in want] and written[0]["generated_answer"] == str(want[0]["sample_id"])
    hist = filtering.level_histogram(sample.where("level <> 'Level 3'")).collect()
    assert [(r["level"], r["n"]) for r in hist] == [(lv, 0 if lv == "Level 3" else 4) for lv in filtering.LEVELS]
    assert [r["level"] for r in filtering.short_levels(sample.where("level <> 'Level 3'"), 4).collect()] == ["Level 3"]


def test_missing_length_needs_a_tokenizer(spark, tmp_path):
    rows = normalize.normalize(jsonl.scan_traces(spark, lines(tmp_path / "a.jsonl", [{k: v for k, v in trace(1).items() if k != "output_token_count"}])))
    assert normalize.needs_tokenizer(rows)
    with pytest.raises(Exception, match="tokenizer"):
        filtering.judge(rows).select("reason").collect()
    counter = P.token_counter(lambda: lambda t: len(t.split()))
    assert filtering.judge(rows, count_tokens=counter).select("reason", "output_token_count").first()[:] == ("kept", 3)


def test_shards_resume_and_merge(spark, tmp_path):
    df = spark.range(5).select(F.col("id").alias("idx"), F.col("id").alias("sample_id"))
    got = [[r["idx"] for r in sampling.shard(df, s, 4).orderBy("idx").collect()] for s in range(4)]
    assert got == [[0, 1], [2, 3], [4], []]
    left = spark.createDataFrame([(1,), (2,), (None,)], "sample_id long")
    assert [r[0] for r in sampling.not_done(left, left.where("sample_id is null or sample_id = 2")).collect()] == [1]
    for s, ids in ((0, [3, 1]), (10, [2, None]), (2, [0, 2])):
        lines(tmp_path / f"greedy_compressed_shard{s}.jsonl", [{"sample_id": i, "s": s} if i is not None else {"s": s} for i in ids] + [""])
    runs.merge(spark, str(tmp_path), str(tmp_path / "merged"))
    merged = [json.loads(r["value"]) for r in jsonl.place_of_lines(spark, str(tmp_path / "merged")).orderBy("place").collect()]
    runs.merge(spark, str(tmp_path), str(tmp_path / "one.jsonl"), single_file=True)
    assert [json.loads(x) for x in (tmp_path / "one.jsonl").read_text().splitlines()] == merged
    assert [(m.get("sample_id"), m["s"]) for m in merged] == [(None, 10), (0, 2), (1, 0), (2, 10), (2, 2), (3, 0)]
    src = lines(tmp_path / "in.jsonl", [trace(i) for i in range(4)])
    done = lines(tmp_path / "done.jsonl", [{"sample_id": 1}, "broken"])
    assert sorted(r["sample_id"] for r in runs.pending(spark, src, done).collect()) == [0, 2, 3]
    assert runs.pending(spark, src, str(tmp_path / "none")).count() == 4


def test_numbers(spark):
    one = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r = one(c=N.cosine(arr(1, 0), arr(1, 1)), z=N.cosine(arr(0, 0), arr(1, 1)), n=N.cosine(arr(-1, 0), arr(1, 0)), nan=N.cosine(arr(math.nan, 0), arr(1, 0)))
    assert r["c"] == pytest.approx(1 / math.sqrt(2)) and (r["z"], r["n"], r["nan"]) == (0, 0, 0)
    for n in range(1, 8):
        for tau in (0.0, 0.3, 0.5, 0.99, 1.0):
            xs = [random.Random(n).random() for _ in range(n)]
            low, high = C.thresholds(xs, C.Gate(tau_low=tau, tau_high=0.2))
            t = one(t=N.percentile_thresholds(arr(*xs), tau, 0.2))["t"]
            assert (t["low"], t["high"]) == (low, high)
    r = one(m=N.min_max(arr(1, 3, 2)), c=N.min_max(arr(2, 2)), s=N.span_mean(arr(1, 2, 3, 4), F.lit(1), F.lit(3)), bad=N.span_mean(arr(1, 2), F.lit(1), F.lit(3)), a=N.attention_row(F.array(F.array(arr(1, 2), arr(3, 4)), F.array(arr(5, 6), arr(7, 8)))))
    assert (r["m"], r["c"], r["s"], r["bad"], r["a"]) == ([0, 1, 0.5], [0, 0], 2.5, None, [4, 5])
    r = one(p=N.mean_logprob(F.array(arr(0, 0), arr(1, 3)), F.array(F.lit(0), F.lit(1))))
    assert r["p"] == pytest.approx((math.log(0.5) - math.log(1 + math.exp(-2))) / 2)
    r = one(r=N.reward(F.lit(-2.0), F.lit(-1.0), F.lit(10)), c=N.action_cost(F.lit("FUSE"), F.lit("ab"), F.lit(3)), f=N.action_cost(F.lit("PRUNE"), F.lit("ab"), F.lit(3)))
    assert (r["r"], r["c"], r["f"]) == (pytest.approx(0.95), 3, 0)


def test_gating_columns(spark):
    cases = [(s, lo, hi, sim, has) for s in (0.1, 0.5, 0.9, math.nan) for lo in (0.3, 0.7) for hi in (0.6,) for sim in (None, 0.5, 0.7, math.nan) for has in (False, True)]
    df = spark.createDataFrame(cases, "s double, lo double, hi double, sim double, has boolean")
    for gate in (C.Gate(), C.Gate(enable_rewrite=True), C.Gate(enable_rewrite=True, enable_fuse=True)):
        a = C.enabled_actions(C.allowed_actions(F.col("s"), F.col("lo"), F.col("hi"), F.col("sim"), F.col("has"), 0.7), gate.enable_rewrite, gate.enable_fuse)
        for r in df.select("*", a.alias("a")).collect():
            assert r["a"] == C.options(r["s"], r["lo"], r["hi"], r["sim"], r["has"], gate), r
    best = lambda *x: spark.range(1).select(C.best_action(F.array(*[F.struct(F.lit(a).alias("action"), F.lit(v).alias("reward")) for a, v in x]))).first()[0]
    assert best(("PRUNE", 1.0), ("REWRITE", 1.0)) == "PRUNE" and best(("PRUNE", math.nan), ("REWRITE", -3.0)) == "REWRITE" and best(("PRUNE", -math.inf)) == "KEEP"


class Flat(P.FakeProvider):
    """Every log-probability equal, so that the first allowed action wins; similarity by vector."""

    vectors: dict = {}

    def logprob(self, prompt, thinking, answer):
        return 0.0

    def count_tokens(self, text):
        return 0 if text != "answer" else 1

    def similarity(self, a, b):
        x, y = self.vectors[a], self.vectors[b]
        return max(0.0, sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y)))


def test_native_fold_equals_provider_fold(spark):
    rng, rows = random.Random(4), []
    for i in range(40):
        n = rng.randint(1, 9)
        rows.append((i, "q", "g", "p", "f", "t", "answer", [f"{i}-{k}" for k in range(n)], [rng.choice([0.1, 0.2, 0.3, 0.4]) for _ in range(n)], [[rng.gauss(0, 1) for _ in range(3)] for _ in range(n)]))
    rows += [(90, "q", "g", "p", "f", "", "a", [], [], []), (91, "q", "g", "p", "f", "t", "a", [], [], []), (92, "q", "g", "p", "f", "t", "a", ["x"], None, None), (93, "q", "g", "p", "f", "t", "", ["x"], [1.0], [[1.0]])]
    schema = "sample_id long, question string, ground_truth string, prompt string, full_output string, thinking string, after_think string, steps array<string>, step_scores array<double>, step_vectors array<array<double>>"
    df, gate = spark.createDataFrame(rows, schema), C.Gate(tau_low=0.4, tau_sim=0.6)
    vectors = {s: v for r in rows for s, v in zip(r[7], r[9] or [])}

    def make():
        p = Flat()
        p.vectors = vectors
        return p

    native = {r["sample_id"]: r for r in C.compress(df, gate).collect()}
    asked = {r["sample_id"]: r for r in C.compress_with(df, make, gate).collect()}
    for i, a in asked.items():
        for k in C.RESULT_COLUMNS[:-1] + ["error"]:
            assert native[i][k] == a[k], (i, k)
    assert [asked[i]["error"] for i in (90, 91, 92, 93)] == [C.NO_THINKING, C.NO_STEPS, C.OUT_OF_MEMORY, C.NO_ANSWER]
    s = C.run_stats(C.compress(df, gate)).first()
    assert (s["total"], s["success"], s["failed"]) == (44, 40, 4)


def test_fold_with_rewriting_and_fusing():
    gate = C.Gate(tau_low=0.5, tau_high=0.3, tau_sim=0.5, enable_rewrite=True, enable_fuse=True)
    kept, score, actions = C.greedy(P.FakeProvider(), gate, "p", ["a b c d", "a b c e", "x y", "answer word"], [0.4, 0.1, 0.2, 0.9], "answer")
    assert actions[1] == "FUSE" or actions[0] == "REWRITE"
    assert len(actions) == 4 and score == pytest.approx(score)

    class Nan(P.FakeProvider):
        def logprob(self, *a):
            return math.nan

    assert C.greedy(Nan(), C.Gate(tau_low=0.9), "p", ["a", "b"], [0.1, 0.2], "x")[2] == ["KEEP", "KEEP"]


def test_steps(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2, 0.3, 0.4, 0.5], [3, 5], 1, 4)], "id int, row array<double>, ends array<int>, prompt int, n int")
    r = df.select(steps.token_spans(F.col("prompt"), F.col("ends"), F.col("n")).alias("s"), steps.span_scores(F.col("row"), steps.token_spans(F.col("prompt"), F.col("ends"), F.col("n"))).alias("v"), steps.prefixes(F.array(F.lit("a"), F.lit("b"))).alias("p")).first()
    assert [tuple(x) for x in r["s"]] == [(1, 3), (3, 4)] and r["v"] == pytest.approx([0.25, 0.4]) and r["p"] == ["a\n\n", "a\n\nb"]
    pos = df.select("id", F.posexplode("row").alias("pos", "value"))
    spans = spark.createDataFrame([(1, 0, 1, 3), (1, 1, 3, 4), (1, 2, 4, 4)], "id int, step int, s int, e int")
    assert {x["step"]: round(x["score"], 9) for x in steps.span_scores_by_join(pos, spans, ["id"], bucket=2).collect()} == {0: 0.25, 1: 0.4}
    h = spark.createDataFrame([(0, [[[1.0, 3.0]], [[3.0, 5.0]]])], "layer int, heads array<array<array<double>>>")
    assert [(x["col"], x["value"]) for x in steps.heatmap(h, []).orderBy("col").collect()] == [(0, 0.0), (1, 1.0)]
    t = spark.range(1).select(steps.ticks(F.struct(F.lit(2).alias("think_start"), F.lit(9).alias("think_end"), F.array(F.struct(F.lit(4).alias("s"), F.lit(6).alias("e"))).alias("steps"))).alias("t")).first()["t"]
    assert [tuple(x) for x in t] == [(2, "<think>"), (4, "Step 1"), (9, "</think>")]
    v = spark.createDataFrame([("t", 1, [1.0, 0.0]), ("t", 2, [1.0, 0.0]), ("t", 3, [0.0, 1.0])], "trace string, n int, v array<double>")
    assert [x["similarity"] for x in steps.adjacent_similarity(v, "trace", "n", "v").orderBy("n").collect()] == [1.0, 0.0]


def test_generation_and_export(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}", f"q{i}", str(i)) for i in range(5)], "ordinal long, prompt string, question string, answer string").coalesce(1)
    df = df.withColumn("metadata", F.struct(*[F.lit("").alias(k) for k in ("solution", "level", "type", "unique_id")]))

    def make():
        def model(prompts):
            if "p3" in prompts:
                raise RuntimeError("batch failed")
            return [(p + "!", 2) for p in prompts]

        return model

    made = runs.generated_records(P.generate(df, make, batch_size=2), "d").collect()
    assert [r["sample_id"] for r in made] == [0, 1, 4] and made[0]["full_output"] == "p0!"
    src = lines(tmp_path / "c.jsonl", [{"question": "q", "compressed_output": "c", "original_output": "o"}, "", {"question": "r", "compressed_output": "d", "original_output": ""}])
    n = runs.export_sft(spark, src, lambda: lambda messages: " refined ", str(tmp_path / "sft.json"))
    data = json.loads((tmp_path / "sft.json").read_text())
    assert n == 3 and [d["output"] for d in data] == ["<think>\nrefined\n</think>\n\n", "<think>\no\n</think>\n\n", "<think>\nrefined\n</think>\n\n"]
    assert data[0]["instruction"].startswith("q\nPlease") and data[0]["instruction"].count("<｜") == 3 and data[1]["instruction"].endswith("\\boxed{}.")

    def failing():
        def chat(messages):
            raise OSError("down")

        return chat

    with pytest.raises(Exception, match="failed after"):
        P.refine(spark.createDataFrame([("q", "c", "o")], "question string, compressed_output string, original_output string"), failing, delay=0).collect()
    assert (tmp_path / "sft.json").exists() and not os.path.exists(tmp_path / "none.json")


def test_small_batches_are_handed_on_together_and_made_once(spark):
    import time

    rows = spark.range(0, 20000, 1, 1).select(F.col("id").alias("ordinal"), F.concat(F.lit("p"), F.col("id")).alias("prompt"), F.struct(F.lit("x").alias("level")).alias("metadata"))
    asked = spark.sparkContext.accumulator(0)

    def make():
        def model(prompts):
            asked.add(len(prompts))
            if prompts[0].endswith("7"):
                raise RuntimeError("out of memory")
            return [(p + "!", 2) for p in prompts][: 0 if prompts[0].endswith("8") else None]

        return model

    since = time.monotonic()
    made = runs.generated(rows, make, 1).orderBy("ordinal").collect()
    assert time.monotonic() - since < 40  # 88 s while each batch was a frame of its own
    assert asked.value == 20000 and [r["ordinal"] for r in made] == list(range(20000))
    assert made[6]["full_output"] == "p6!" and made[6]["output_token_count"] == 2 and made[6]["error"] is None and made[6]["metadata"]["level"] == "x"
    assert made[7]["error"] == "out of memory" and made[8]["error"] == "0 results for 1 prompts" and made[8]["full_output"] is None
    P.GATHER_CHARS, old = 3, P.GATHER_CHARS
    try:
        assert [r["full_output"] for r in P.generate(rows.limit(5), make, 2).orderBy("ordinal").collect()] == [f"p{i}!" for i in range(5)]
    finally:
        P.GATHER_CHARS = old


def test_an_array_is_written_and_read_by_many_tasks(spark, tmp_path):
    import tracemill.plans.queries as Q

    odd = ["", "a\n  },\nb", '\n  },\n{"', "]\n]", "é\u2028\r\n", "\\", "[\n", "\n]"]
    df = spark.range(0, 400, 1, 7).select((399 - F.col("id")).alias("n"), F.element_at(F.array(*map(F.lit, odd)), (F.col("id") % len(odd) + 1).cast("int")).alias("t"), F.array(F.struct(F.col("id").alias("k"))).alias("a"))
    path = str(tmp_path / "x.json")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert jsonl.write_json_array(df, path, ["n"], ["n", "t", "a"]) == 400 and os.listdir(tmp_path) != []
    want = [{"n": n, "t": odd[(399 - n) % len(odd)], "a": [{"k": 399 - n}]} for n in range(400)]
    with open(path, encoding="utf-8", newline="") as f:
        assert f.read() == json.dumps(want, indent=2, ensure_ascii=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3001")
    try:
        rows = jsonl.read_json_array(spark, path, "n long, t string, a array<struct<k:long>>")
        assert rows.rdd.getNumPartitions() > 5
        assert [(r["place"], r["x"].asDict(True)) for r in rows.orderBy("place").collect()] == list(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert jsonl.write_json_array(df.where("n < 0"), path, ["n"], ["n"]) == 0 and json.loads((tmp_path / "x.json").read_text()) == []
    assert jsonl.read_json_array(spark, path, "n long").collect() == []
    # the array is not handed to one task as one text
    assert "ExistingRDD" not in Q.QUERIES["exported_array"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_lines_are_sorted_and_written_by_many_tasks(spark, tmp_path):
    from tracemill.plans.file_queries import as_file

    rows = spark.range(0, 4000, 1, 4).select((3999 - F.col("id")).alias("n"), F.concat(F.lit("line "), F.col("id")).alias("value"))
    tracker, old = spark.sparkContext.statusTracker(), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for single, group in ((True, "one file"), (False, "parts")):
            spark.sparkContext.setJobGroup(group, group)
            path = as_file(rows, "n", "a.jsonl", f"{tmp_path}/{single}", single_file=single)
            stages = [i for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds]
            last = tracker.getStageInfo(max(stages))
            assert last.numTasks == 4, group
            assert os.path.isfile(path) == single and os.listdir(tmp_path / str(single)).count("a.jsonl.parts") == 0
            assert [r["value"] for r in jsonl.read_lines(spark, path).orderBy("idx").collect()] == [f"line {3999 - n}" for n in range(4000)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_lines_are_numbered_through_the_parts_of_a_folder_named_like_a_file(spark, tmp_path):
    jsonl.write_text(spark.range(0, 1000, 1, 5).select(F.concat(F.lit('{"n":'), F.col("id"), F.lit("}")).alias("value")), str(tmp_path / "a.jsonl"))
    rows = jsonl.scan_strict(spark, str(tmp_path / "a.jsonl"))
    assert all(int(r["m"]["n"]) == r["idx"] for r in rows.collect()) and rows.count() == 1000
    assert "SortMergeJoin" not in rows._jdf.queryExecution().toString()  # lines do not move


def fake_generator(args):
    return lambda prompts: [(f"so\n\nstep {p}\n</think>\n\n\\boxed{{1}}", 4) for p in prompts]


def fake_scorer(args, df):
    return df.withColumn("step_scores", F.transform("steps", lambda s: F.length(s).cast("double")))


def fake_provider(args, chat):
    return P.FakeProvider()


def fake_chat(args):
    return lambda messages: "refined"


def test_commands_from_problems_to_training_entries(spark, tmp_path, capsys):
    from tracemill.__main__ import main

    df = spark.createDataFrame([(f"p{i}", str(i), "Level 1") for i in range(7)], "problem string, answer string, level string")
    df.coalesce(1).write.parquet(str(tmp_path / "ds" / "data"))
    here, out = __name__, str(tmp_path / "out")
    main(["generate", "--model_path", "models/m", "--data_path", str(tmp_path / "ds"), "--output_dir", out, "--dataset", "d", "--generator", f"{here}:fake_generator"])
    source = f"{out}/m/d_cot.jsonl"
    assert paths.resolve_traces(spark, out).endswith("d_cot.jsonl") and spark.read.text(source).count() == 7
    flags = ["--data_path", source, "--output_dir", out, "--scorer", f"{here}:fake_scorer", "--provider", f"{here}:fake_provider", "--num_shards", "3"]
    for s in (0, 1, 1):  # a shard that is run again has nothing left to do
        main(["compress", *flags, "--shard_id", str(s)])
    main(["compress", *flags, "--shard_id", "2", "--canonical_path", str(tmp_path / "done.jsonl")])
    done = [json.loads(x) for x in (tmp_path / "done.jsonl").read_text().splitlines()]
    assert [r["sample_id"] for r in done] == list(range(7)) and list(done[0]) == C.RESULT_COLUMNS
    main(["export", "--input_file", str(tmp_path / "done.jsonl"), "--output_file", str(tmp_path / "sft.json"), "--model", "m", "--chat", f"{here}:fake_chat", "--limit", "5", "--num_workers", "2"])
    data = json.loads((tmp_path / "sft.json").read_text())
    assert len(data) == 10 and data[0]["output"] == "<think>\nrefined\n</think>\n\n"
    with pytest.raises(ValueError, match="api_key"):
        main(["compress", *flags, "--enable_fuse"])


def test_stream_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "a.jsonl", [{"sample_id": 1}, "", {"sample_id": 2}])
    work = lambda df: df.select(F.col("m")["sample_id"].alias("sample_id"), F.lit(None).cast("string").alias("error"))
    for more in ([], [{"sample_id": 3}]):
        if more:
            lines(tmp_path / "in" / "b.jsonl", more)
        process_as_they_come(follow_traces(spark, str(tmp_path / "in")), work, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(json.loads(r["value"])["sample_id"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1", "2", "3"]


def test_stream_passes_blank_lines_and_replays_without_repeats(spark, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "a.jsonl", [{"sample_id": 1}, "\t\t", "\u2003", {"sample_id": 2}])
    work = lambda df: df.select(F.col("m")["sample_id"].alias("sample_id"), F.lit(None).cast("string").alias("error"))
    for _ in range(2):  # the second run has lost the checkpoint: the same micro-batch comes again
        process_as_they_come(follow_traces(spark, str(tmp_path / "in")), work, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        shutil.rmtree(tmp_path / "cp")
    assert sorted(json.loads(r["value"])["sample_id"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1", "2"]
