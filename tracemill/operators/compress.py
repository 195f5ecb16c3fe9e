"""Gating and the greedy fold over the steps of a trace.

Without rewriting and fusing, a step has one allowed action and the fold is a Catalyst ``aggregate``: no Python, no
shuffle. With them, a provider is asked for texts and log-probabilities and the fold runs in ``mapInPandas``: one
after another in a trace, traces in parallel.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.text import THINK_BREAK, let

# The actions, and the errors of a trace in the order they are looked for.
ACTIONS = ["PRUNE", "KEEP", "REWRITE", "FUSE"]
NO_THINKING, NO_STEPS, OUT_OF_MEMORY, NO_ANSWER = "No thinking content found", "No steps found", "CUDA out of memory", "No answer tokens found after </think>"


@dataclass(frozen=True)
class Gate:
    """Shares of steps with low and high attention, and the similarity from which steps are fused."""

    tau_low: float = 0.3
    tau_high: float = 0.2
    tau_sim: float = 0.7
    enable_rewrite: bool = False
    enable_fuse: bool = False
    alpha: float = 1.0
    beta: float = 0.005


def allowed_actions(score: Column, low: Column, high: Column, similarity: Column, has_content: Column, tau_sim: float) -> Column:
    """What may be done with a step. A close match with the last kept step leaves fusing alone; the low border is tested first."""
    close = F.coalesce(has_content & (similarity >= F.lit(float(tau_sim))) & ~F.isnan(similarity), F.lit(False))
    words = lambda *a: F.array(*[F.lit(x) for x in a])
    nan = F.isnan(score)
    return (
        F.when(close, words("FUSE"))
        .when(nan | F.isnan(low) & F.isnan(high), words("REWRITE"))
        .when((score < low) & ~F.isnan(low), words("PRUNE", "REWRITE"))
        .when((score < high) & ~F.isnan(high), words("REWRITE"))
        .when((score >= high) & ~F.isnan(high), words("KEEP", "REWRITE"))
        .otherwise(words("REWRITE"))
    )


def enabled_actions(actions: Column, rewrite: bool, fuse: bool) -> Column:
    """Without the switched-off ones; nothing left means KEEP."""
    off = [a for a, on in (("REWRITE", rewrite), ("FUSE", fuse)) if not on]
    left = F.array_except(actions, F.array(*[F.lit(a) for a in off])) if off else actions
    return let(left, lambda a: F.when(F.size(a) == 0, F.array(F.lit("KEEP"))).otherwise(a))


def best_action(candidates: Column) -> Column:
    """The first candidate (struct action, reward) with the strictly greatest reward; NaN and -inf never win; KEEP if none does."""
    init = F.struct(F.lit(None).cast("string").alias("action"), F.lit(float("-inf")).alias("reward"))

    def step(best, c):
        better = ~F.isnan(c["reward"]) & (c["reward"] > best["reward"])
        return F.when(better, F.struct(c["action"].alias("action"), c["reward"].alias("reward"))).otherwise(best)

    return F.aggregate(candidates, init, step, lambda b: F.coalesce(b["action"], F.lit("KEEP")))


def greedy_decisions(scores: Column, vectors: Column, gate: Gate, similarity=None) -> Column:
    """struct(kept, actions) of the fold without a provider: 0-based kept steps and the action of every step.

    A step below the low border goes, unless it resembles the last kept step, in which case (fusing being off) it stays.
    ``similarity`` compares two vectors, cosine unless given.
    """
    similarity = similarity or N.cosine
    border = N.nearest_rank(scores, gate.tau_low)
    items = F.arrays_zip(scores.alias("score"), vectors.alias("vec"))

    def run(low):
        init = F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("kept"), F.element_at(vectors, 1).alias("last"), F.array().cast("array<string>").alias("actions"))

        def step(acc, x):
            close = (F.size(acc["kept"]) > 0) & (similarity(acc["last"], x["vec"]) >= F.lit(float(gate.tau_sim)))
            prune = (x["score"] < low) & ~F.isnan(low) & ~close
            return F.struct(
                (acc["i"] + 1).alias("i"),
                F.when(prune, acc["kept"]).otherwise(F.array_append(acc["kept"], acc["i"])).alias("kept"),
                F.when(prune, acc["last"]).otherwise(x["vec"]).alias("last"),
                F.array_append(acc["actions"], F.when(prune, F.lit("PRUNE")).otherwise(F.lit("KEEP"))).alias("actions"),
            )

        return F.aggregate(items, init, step, lambda a: F.struct(a["kept"].alias("kept"), a["actions"].alias("actions")))

    return let(border, run)


def history(actions: Column) -> Column:
    return F.transform(actions, lambda a, i: F.struct(a.alias("type"), F.array(i).alias("indices")))


def trace_error(steps_found: Column, thinking: Column, scores: Column, answer_tokens: Column) -> Column:
    """The first reason a trace cannot be compressed, or null. Null scores stand for a failed attention pass."""
    return (
        F.when(F.coalesce(thinking, F.lit("")) == "", NO_THINKING)
        .when(F.size(steps_found) == 0, NO_STEPS)
        .when(scores.isNull(), OUT_OF_MEMORY)
        .when(F.coalesce(answer_tokens, F.lit(0)) == 0, NO_ANSWER)
    )


# The columns of a compressed trace, in their order.
RESULT_COLUMNS = ["sample_id", "question", "ground_truth", "prompt", "original_output", "compressed_output", "compression_ratio", "num_steps", "num_kept_steps", "step_scores", "action_history", "greedy_score"]


def compress(df: DataFrame, gate: Gate = Gate(), answer_tokens: Column | None = None, similarity=None) -> DataFrame:
    """Compress traces without a provider: needs the record columns, steps, thinking, after_think, step_scores and step_vectors.

    Rows that cannot be compressed come out with ``error`` set. Log-probabilities would only fill greedy_score, which is null.
    """
    if gate.enable_rewrite or gate.enable_fuse:
        raise ValueError("rewriting and fusing need a provider: use compress_with")
    tokens = answer_tokens if answer_tokens is not None else F.length("after_think")
    df = df.withColumn("error", trace_error(F.col("steps"), F.col("thinking"), F.col("step_scores"), tokens))
    df = df.withColumn("__d", F.when(F.col("error").isNull(), greedy_decisions(F.col("step_scores"), F.col("step_vectors"), gate, similarity)))
    kept = F.transform("__d.kept", lambda i: F.element_at(F.col("steps"), i + 1))
    ok = F.col("error").isNull()
    return df.select(
        "sample_id",
        "question",
        "ground_truth",
        F.when(ok, F.col("prompt")).alias("prompt"),
        F.col("full_output").alias("original_output"),
        F.when(ok, F.concat(F.array_join(kept, "\n\n"), F.lit(THINK_BREAK))).alias("compressed_output"),
        F.when(ok, N.compression_ratio(F.size("__d.kept"), F.size("steps"))).alias("compression_ratio"),
        F.when(ok, F.size("steps")).alias("num_steps"),
        F.when(ok, F.size("__d.kept")).alias("num_kept_steps"),
        F.when(ok, F.col("step_scores")).alias("step_scores"),
        F.when(ok, history(F.col("__d.actions"))).alias("action_history"),
        F.lit(None).cast("double").alias("greedy_score"),
        "error",
    )


def compress_with(df: DataFrame, make_provider, gate: Gate) -> DataFrame:
    """Compress with a provider (``providers.TraceProvider``), made once per task. A trace that raises comes out with its error.

    The provider's calls may cost money: write the result before using it twice.
    """
    schema = "sample_id long, question string, ground_truth string, prompt string, original_output string, compressed_output string, compression_ratio double, num_steps int, num_kept_steps int, step_scores array<double>, action_history array<struct<type:string,indices:array<int>>>, greedy_score double, error string"

    def run(batches):
        provider = make_provider()
        for pdf in batches:
            yield pd.DataFrame([_one(row, provider, gate) for row in pdf.to_dict("records")], columns=[*RESULT_COLUMNS, "error"])

    rows = df.select(F.col("sample_id").cast("long").alias("sample_id"), "question", "ground_truth", "prompt", "full_output", "thinking", "after_think", "steps", "step_scores")
    return rows.mapInPandas(run, schema)


def _one(row: dict, provider, gate: Gate) -> dict:
    out = dict.fromkeys([*RESULT_COLUMNS, "error"]) | {k: row.get(k) for k in ("sample_id", "question", "ground_truth")} | {"original_output": row["full_output"]}
    listed = lambda x: list(x) if hasattr(x, "__len__") else None  # noqa: E731 - pandas shows a null list as NaN
    steps, scores = listed(row["steps"]) or [], listed(row["step_scores"])
    if not row["thinking"]:
        return out | {"error": NO_THINKING}
    if not steps:
        return out | {"error": NO_STEPS}
    if scores is None:
        return out | {"error": OUT_OF_MEMORY}
    try:
        if not provider.count_tokens(row["after_think"]):
            return out | {"error": NO_ANSWER}
        kept, score, actions = greedy(provider, gate, row["prompt"], steps, [float(s) for s in scores], row["after_think"])
    except Exception as failed:  # a failed trace is reported and tried again on the next run
        return out | {"error": f"{type(failed).__name__}: {failed}"}
    return out | {
        "prompt": row["prompt"],
        "compressed_output": "\n\n".join(kept) + THINK_BREAK,
        "compression_ratio": 1 - len(kept) / len(steps),
        "num_steps": len(steps),
        "num_kept_steps": len(kept),
        "step_scores": [float(s) for s in scores],
        "action_history": [{"type": a, "indices": [i]} for i, a in enumerate(actions)],
        "greedy_score": score,
        "error": None,
    }


def thresholds(scores: list[float], gate: Gate) -> tuple[float, float]:
    ranked = sorted(scores)
    at = lambda share: ranked[max(0, min(int(len(ranked) * share), len(ranked) - 1))]
    return at(gate.tau_low), at(1 - gate.tau_high)


def options(score: float, low: float, high: float, similarity: float | None, has_content: bool, gate: Gate) -> list[str]:
    """The allowed and enabled actions of a step, in the order they are tried."""
    if has_content and similarity is not None and similarity >= gate.tau_sim:
        found = ["FUSE"]
    elif score < low:
        found = ["PRUNE", "REWRITE"]
    elif score < high or not score >= high:
        found = ["REWRITE"]
    else:
        found = ["KEEP", "REWRITE"]
    on = {"REWRITE": gate.enable_rewrite, "FUSE": gate.enable_fuse}
    return [a for a in found if on.get(a, True)] or ["KEEP"]


def apply_action(provider, action: str, kept: list[str], step: str) -> tuple[list[str], str] | None:
    """(steps kept afterwards, the text the action made); None where there is nothing to fuse with."""
    if action == "PRUNE":
        return list(kept), ""
    if action == "KEEP":
        return [*kept, step], step
    if action == "REWRITE":
        text = provider.rewrite(step, "\n\n".join(kept))
        return [*kept, text], text
    if not kept:
        return None
    text = provider.fuse(kept[-1], step, "\n\n".join(kept[:-1]))
    return [*kept[:-1], text], text


def greedy(provider, gate: Gate, prompt: str, steps: list[str], scores: list[float], answer: str):
    """The fold with a provider: (kept steps, score, actions). The log-probability before a step is asked for once."""
    low, high = thresholds(scores, gate)
    kept, actions, total = [], [], 0.0
    before = provider.logprob(prompt, "", answer)

    def tried(action: str, step: str):
        made = apply_action(provider, action, kept, step)
        if made is None:
            return None
        after = before if made[0] == kept else provider.logprob(prompt, "\n\n".join(made[0]), answer)
        cost = provider.count_tokens(made[1]) if action != "PRUNE" and made[1] else 0
        return action, made[0], after, total + (gate.alpha * (after - before) - gate.beta * cost)

    for step, score in zip(steps, scores):
        near = provider.similarity(kept[-1], step) if kept else 0.0
        best, best_gain = None, -math.inf
        for action in options(score, low, high, near, bool(kept), gate):
            one = tried(action, step)
            if one is not None and one[3] - total > best_gain:
                best, best_gain = one, one[3] - total
        best = best or tried("KEEP", step)
        action, kept, before, total = best
        actions.append(action)
    return kept, total, actions


def compressed_records(results: DataFrame) -> DataFrame:
    """The columns of a compressed trace, in order, of the rows without an error; the others are tried again on the next run."""
    ok = results.where(F.col("error").isNull()) if "error" in results.columns else results
    return ok.select(*RESULT_COLUMNS)


def run_stats(results: DataFrame) -> DataFrame:
    """One row: total, success, failed, and averages over the rows that have the value."""
    ok = F.col("error").isNull() if "error" in results.columns else F.lit(True)
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("success"),
        F.count_if(~ok).alias("failed"),
        F.avg("num_steps").alias("avg_steps"),
        F.avg("num_kept_steps").alias("avg_kept_steps"),
        F.avg("compression_ratio").alias("avg_ratio"),
    )


def any_error(results: DataFrame) -> bool:
    return not results.where(F.col("error").isNotNull()).isEmpty()
