"""Registered queries of steps, actions, providers and the text functions that the trace queries leave out."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import providers as P
from ..functions import answers as A
from ..functions import numeric as N
from ..functions import text as T
from ..operators import compress as C
from ..operators import export, filtering, normalize, sampling, steps
from .queries import _ANSWERS, _FOLD, _STEPS, _TRACES, documents_as_traces, judged, query, table, traces, vector_traces


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, **columns: str) -> str:
    """A prompt template as an SQL expression."""
    out = quoted(template)
    for name, column in columns.items():
        out = out.replace("{" + name + "}", f"' || {column} || '")
    return out


@query(f"""SELECT conv_id, turn, md5({filled(T.REFINE_TEMPLATE, question='text', original='text', draft='role')}) AS refine, md5({filled(T.REWRITE_TEMPLATE, step='text')}) AS rewrite,
md5({filled(T.FUSE_TEMPLATE, first='role', second='text')}) AS fuse, {quoted(T.DEFAULT_EOS + T.COMPRESSED_MARK + T.DEFAULT_EOS)} AS suffix FROM conversations""")
def editing_prompts(spark, sf_dir):
    t, r = F.col("text"), F.col("role")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.refine_prompt(t, r, t)).alias("refine"), F.md5(T.rewrite_prompt(t)).alias("rewrite"), F.md5(T.fuse_prompt(r, t)).alias("fuse"), T.compression_suffix().alias("suffix"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS shown FROM part")
def program_output(spark, sf_dir):
    raw = "CASE WHEN p_partkey % 5 = 0 THEN concat('no block ', p_size) ELSE concat('a ```output', chr(10), p_size, chr(10), '``` then ```output ', p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ' ``` rest' ELSE '' END) END AS raw"
    return table(spark, sf_dir, "part").selectExpr("p_partkey", raw).select("p_partkey", A.extract_program_output(F.col("raw")).alias("shown"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(p_size, '|7|9') WHEN 1 THEN concat(p_size, '|8') WHEN 2 THEN concat('(1,', p_size, ')') ELSE concat(p_size, '') END AS found FROM part")
def math_answers(spark, sf_dir):
    """Lists are split where the question asks for them (even keys), pairs at their ``and``."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN 'List all, separated by commas.' ELSE 'Which?' END AS q", """CASE p_partkey % 4 WHEN 0 THEN concat(chr(92), 'boxed{', p_size, ', 7 ,9}')
      WHEN 1 THEN concat(chr(92), 'boxed{', p_size, chr(92), 'text{ and }8}') WHEN 2 THEN concat(chr(92), 'boxed{(1, ', p_size, ')}') ELSE concat('boxed{', p_size, '}') END AS r""")
    return rows.select("p_partkey", F.array_join(A.extract_math_answers(F.col("q"), F.col("r")), "|").alias("found"))


_SHAPES = [
    # raw text and its normal form, as SQL that both engines read alike; n is the part's size
    ("concat(chr(92), 'tan ', n)", "concat(chr(92), 'tan{', n, '}')"),
    ("concat(chr(92), 'tan', n)", "concat(chr(92), 'tan{', n, '}')"),
    ("concat(chr(92), 'sqrt ', n)", "concat(chr(92), 'sqrt{', n, '}')"),
    ("concat(chr(92), 'text{', n, '}')", "concat(n, '')"),
    ("concat(n, chr(92), 'text{ apples}.')", "concat(n, '')"),
    ("concat(chr(92), 'left(', n, ',', chr(10), '2', chr(92), 'right)')", "concat('(', n, ',2)')"),
    ("concat(chr(92), 'tfrac{', n, '}{3}')", "concat(chr(92), 'frac{', n, '}{3}')"),
    ("concat(chr(92), 'cfrac{1}{', n, '}')", "concat(chr(92), 'frac{1}{', n, '}')"),
    ("concat(n, '^{', chr(92), 'circ}')", "concat(n, '')"),
    ("concat(n, '^', chr(92), 'circ')", "concat(n, '')"),
    ("concat(n, ' {cm}^2')", "concat(n, '')"),
    ("concat(n, '{m}')", "concat(n, '')"),
    ("concat(n, ' t')", "concat(n, '')"),
    ("concat(chr(92), '$', n)", "concat(n, '')"),
    ("concat('x', chr(92), 'in[', n, ',9]')", "concat('[', n, ',9]')"),
    ("concat('{.', n, '}')", "concat('{0.', n, '}')"),
    ("concat('a .', n)", "concat('a0.', n)"),
    ("concat(n, chr(92), 'cdot 2')", "concat(n, '2')"),
    ("concat(n, ' infinity')", "concat(n, chr(92), 'infty')"),
    ("concat('inf', n)", "concat(chr(92), 'infty', n)"),
    ("concat(chr(92), 'mathbf{', n, '}')", "concat('{', n, '}')"),
    ("concat(chr(92), 'mathrm{', n, '}', chr(92), ',')", "concat('{', n, '}')"),
    ("concat(chr(92), 'mbox{about}', n)", "concat(n, '')"),
    ("concat('\"', n, '\"')", "concat(n, '')"),
    ("concat(n, 'j')", "concat(n, 'i')"),
    ("concat(n, '.000x')", "concat(n, 'x')"),
    ("concat(n, chr(92), '!,000')", "concat(n, ',000')"),
    ("concat('-', n, '/7')", "concat(chr(92), 'frac{-', n, '}{7}')"),
    ("concat('0', n, '/7')", "concat('0', n, '/7')"),
    ("concat(chr(92), 'sqrt', n, '/7')", "concat(chr(92), 'frac{', chr(92), 'sqrt{', n, '}}{7}')"),
]


@query("WITH s AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS n FROM part) SELECT p_partkey, CASE p_partkey % " + f"{len(_SHAPES)} " + " ".join(f"WHEN {i} THEN {want}" for i, (_, want) in enumerate(_SHAPES)) + " END AS normal FROM s")
def strip_shapes(spark, sf_dir):
    """The rewrites of the normal form that ``strip_answer`` leaves out, one shape for each."""
    raw = f"CASE p_partkey % {len(_SHAPES)} " + " ".join(f"WHEN {i} THEN {raw}" for i, (raw, _) in enumerate(_SHAPES)) + " END AS raw"
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size AS string) AS n").selectExpr("p_partkey", raw)
    return rows.select("p_partkey", A.strip_string(F.col("raw")).alias("normal"))


@query(r"""WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE 'a' || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || 'b' END AS body, CASE doc_id % 3 WHEN 0 THEN 'ans ' || doc_id ELSE 'c' || chr(10) || '</think>' || chr(10) || chr(10) || 'd' END AS rest, doc_id % 3 = 2 AS open FROM documents),
s AS (SELECT doc_id, CASE WHEN open THEN '' ELSE body END AS before, CASE WHEN open THEN '' ELSE rest END AS after, list_filter(string_split(CASE WHEN open THEN '' ELSE body END, chr(10) || chr(10)), lambda x: regexp_matches(x, '[^\s]')) AS steps FROM f)
SELECT doc_id, md5(before) AS before, md5(after) AS after, CAST(len(steps) AS INTEGER) AS n_steps, md5(array_to_string(steps, chr(10) || chr(10)) || chr(10) || '</think>' || chr(10) || chr(10)) AS rebuilt FROM s""")
def think_parts(spark, sf_dir):
    """Traces cut at the first closing tag, their steps, and the block built again."""
    brk, gap = F.lit(T.THINK_BREAK), F.lit("\n\n")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.replace(F.col("text"), F.lit("\n"), gap), brk, F.lit("ans "), F.col("doc_id"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("a\n\n \n\nb"), brk, F.lit("c"), brk, F.lit("d"))).otherwise("no block")
    rows = steps.with_steps(table(spark, sf_dir, "documents").select("doc_id", body.alias("full_output")))
    return rows.select("doc_id", F.md5("thinking").alias("before"), F.md5("after_think").alias("after"), F.size("steps").alias("n_steps"), F.md5(T.rebuild_think(F.col("steps"))).alias("rebuilt"))


_TICKS = r"""WITH p AS (SELECT conv_id, turn, text, string_split(text, chr(10)) AS x FROM conversations),
s AS (SELECT conv_id, turn, x[i] AS piece, 9 + coalesce(list_sum(list_transform(x[:i - 1], lambda y: length(y) + 1)), 0) + length(x[i]) - length(ltrim(x[i])) AS pos, i FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM p) WHERE regexp_matches(x[i], '[^\s]')),
m AS (SELECT conv_id, turn, pos, 'Step ' || row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS label, pos + length(trim(piece)) AS e FROM s
  UNION ALL SELECT conv_id, turn, 2, '<think>', NULL FROM p UNION ALL SELECT conv_id, turn, 9 + length(text) + 8, '</think>', NULL FROM p)
SELECT conv_id, turn, string_agg(CAST(pos AS INTEGER) || ':' || label, ',' ORDER BY pos, label) AS ticks, coalesce(string_agg(CAST(pos AS INTEGER) || '-' || CAST(e AS INTEGER), ',' ORDER BY pos) FILTER (e IS NOT NULL), '') AS spans FROM m GROUP BY conv_id, turn"""


@query(_TICKS)
def attention_ticks(spark, sf_dir):
    """Axis marks of a trace, and the places of its steps, found one after the other."""
    p = T.token_positions(F.concat(F.lit("p <think>"), F.col("text"), F.lit("</think> x")), "\n")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", p.alias("p"))
    marks = F.array_join(F.transform(steps.ticks(F.col("p")), lambda x: F.concat_ws(":", x["at"].cast("string"), x["label"])), ",")
    spans = F.array_join(F.transform("p.steps", lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return rows.select("conv_id", "turn", marks.alias("ticks"), spans.alias("spans"))


@query(f"""WITH {_STEPS}, n AS (SELECT doc_id, list_transform(steps, lambda x: len(regexp_extract_all(x, '[^\\s]+'))) AS k FROM s), c AS (SELECT doc_id, list_transform(range(1, len(k) + 1), lambda i: 5 + list_sum(k[:i])) AS ends, 4 + coalesce(list_sum(k), 0) AS top FROM n),
t AS (SELECT doc_id, list_transform(range(1, len(ends) + 1), lambda i: {{'s': CASE WHEN i = 1 THEN 5 ELSE ends[i - 1] END, 'e': least(ends[i], top)}}) AS spans, top FROM c)
SELECT doc_id, md5(array_to_string(list_transform(spans, lambda x: CAST(x.s AS INTEGER) || ':' || CAST(x.e AS INTEGER)), ',')) AS spans, len(list_filter(spans, lambda x: x.s >= x.e OR x.e > top)) = 0 AS valid FROM t""")
def token_spans(spark, sf_dir):
    """Token spans of steps behind a prompt of five tokens, in a sequence one token short: a last step of one token has no span left."""
    rows = documents_as_traces(spark, sf_dir).withColumn("k", F.transform("steps", steps.whitespace_tokens))
    rows = rows.withColumn("ends", F.aggregate("k", F.struct(F.lit(5).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"] + n).alias("out")), lambda a: a["out"]))
    top = F.aggregate("k", F.lit(4), lambda a, n: a + n)
    rows = rows.select("doc_id", top.alias("top"), steps.token_spans(F.lit(5), F.col("ends"), top).alias("spans"))
    valid = steps.spans_valid(F.array_repeat(F.lit(0.0), F.col("top")), F.col("spans"))
    return rows.select("doc_id", F.md5(F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",")).alias("spans"), valid.alias("valid"))


@query("""WITH g AS (SELECT vec_id // 4 AS g, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS v FROM embeddings GROUP BY vec_id // 4 HAVING count(*) = 4)
SELECT g, round((v[1][1] + v[2][1] + v[3][1] + v[4][1]) / 4, 6) AS first, round((list_sum(v[1]) + list_sum(v[2]) + list_sum(v[3]) + list_sum(v[4])) / 4, 5) AS total FROM g""")
def layer_means(spark, sf_dir):
    """Attention rows of two layers of two heads: the mean over heads, then over layers."""
    g = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("g"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    g = g.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("p")).where(F.size("p") == 4)
    at = lambda i: F.element_at("p", i)["v"]
    row = N.attention_row(F.array(F.array(at(1), at(2)), F.array(at(3), at(4))))
    return g.withColumn("r", row).select("g", F.round(F.element_at("r", 1), 6).alias("first"), F.round(F.aggregate("r", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("""WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), l AS (SELECT vec_id, e[vec_id % 64 + 1] - list_max(e) - ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))) AS p FROM d)
SELECT vec_id // 3 AS g, round(avg(p), 6) AS logprob FROM l GROUP BY vec_id // 3""")
def answer_logprob(spark, sf_dir):
    """The mean log-probability of answers of up to three tokens."""
    g = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 3").alias("g"), F.struct("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).alias("x"))
    g = g.groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("p"))
    return g.select("g", F.round(N.mean_logprob(F.transform("p", lambda x: x["e"]), F.transform("p", lambda x: (x["vec_id"] % 64).cast("int"))), 6).alias("logprob"))


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN conv_id ELSE len(regexp_extract_all(text, '[^\s]+')) END AS tokens, (SELECT count(*) > 0 FROM conversations WHERE turn % 2 <> 0) AS needs_tokenizer FROM conversations""")
def token_counts(spark, sf_dir):
    """Stored lengths where there are any, else a tokenizer's."""
    rows = table(spark, sf_dir, "conversations").withColumn("existing_length", F.when(F.col("turn") % 2 == 0, F.col("conv_id")))
    counter = P.token_counter(lambda: lambda t: len(t.split()))
    return rows.select("conv_id", "turn", normalize.token_count(F.col("existing_length"), F.col("text"), counter).alias("tokens"), F.lit(normalize.needs_tokenizer(rows)).alias("needs_tokenizer"))


@query(f"""WITH {_TRACES}, r AS (SELECT sample_id, level, row_number() OVER (PARTITION BY level ORDER BY sample_id) - 1 AS rank FROM t WHERE level <> 'none')
SELECT sample_id, level, (rank // 7) * 5 + CAST(substr(level, 7) AS BIGINT) AS out_pos FROM r WHERE rank % 7 = 0 AND rank < 140""")
def level_sample_picks(spark, sf_dir):
    """The sample's machinery with fixed picks: every seventh record of a level, twenty at most."""

    def choose(counts):
        return [(level, 7 * i, 5 * i + n + 1) for n, level in enumerate(filtering.LEVELS) for i in range(20) if 7 * i < counts.get(level, 0)]

    return sampling.sample_by_level(traces(spark, sf_dir), chunk=5000, choose=choose).select("sample_id", "level", "out_pos")


@query(f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{C.NO_THINKING}' WHEN 1 THEN '{C.NO_STEPS}' WHEN 2 THEN '{C.OUT_OF_MEMORY}' WHEN 3 THEN '{C.NO_ANSWER}' END AS error FROM documents""")
def trace_errors(spark, sf_dir):
    """Each way a trace can fail; a trace that fails in several ways has the first one's error."""
    k = F.col("doc_id") % 5
    none = F.array().cast("array<string>")
    error = C.trace_error(F.when(k <= 1, none).otherwise(F.array(F.col("text"))), F.when(k > 0, F.lit("t")), F.when(k > 2, F.array(F.lit(1.0))), F.when(k == 4, F.lit(3)))
    return table(spark, sf_dir, "documents").select("doc_id", error.alias("error"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'PRUNE' WHEN 2 THEN 'KEEP' ELSE 'KEEP' END AS plain, CASE o_orderkey % 4 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'PRUNE,REWRITE' WHEN 2 THEN 'REWRITE' ELSE 'KEEP,REWRITE' END AS rewriting,
CASE o_orderkey % 4 WHEN 0 THEN 'FUSE' WHEN 1 THEN 'PRUNE' WHEN 2 THEN 'KEEP' ELSE 'KEEP' END AS fusing, CASE o_orderkey % 4 WHEN 0 THEN 'FUSE' WHEN 1 THEN 'PRUNE,REWRITE' WHEN 2 THEN 'REWRITE' ELSE 'KEEP,REWRITE' END AS both FROM orders""")
def enabled_actions(spark, sf_dir):
    words = lambda *a: F.array(*[F.lit(x) for x in a])
    k = F.col("o_orderkey") % 4
    found = F.when(k == 0, words("FUSE")).when(k == 1, words("PRUNE", "REWRITE")).when(k == 2, words("REWRITE")).otherwise(words("KEEP", "REWRITE"))
    on = {"plain": (False, False), "rewriting": (True, False), "fusing": (False, True), "both": (True, True)}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[F.array_join(C.enabled_actions(found, *flags), ",").alias(name) for name, flags in on.items()])


@query(r"""WITH w AS (SELECT conv_id, turn, role, text, regexp_extract_all(text, '[^\s]+') AS w, ['kept', role] || regexp_extract_all(text, '[^\s]+') AS u FROM conversations)
SELECT conv_id, turn, md5('kept ' || role) AS prune, md5('kept ' || role || chr(10) || chr(10) || text) AS keep, md5('kept ' || role || chr(10) || chr(10) || array_to_string(w[:greatest(1, len(w) // 2)], ' ')) AS rewrite,
 md5(array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ' ')) AS fuse FROM w""")
def applied_actions(spark, sf_dir):
    """What each action makes of a kept step and the next one, with the stand-in provider."""

    def run(frames):
        provider = P.FakeProvider()
        for pdf in frames:
            made = {a: ["\n\n".join(C.apply_action(provider, a, [f"kept {r}"], t)[0]) for r, t in zip(pdf["role"], pdf["text"])] for a in C.ACTIONS}
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], **{a.lower(): v for a, v in made.items()}})

    rows = table(spark, sf_dir, "conversations").mapInPandas(run, "conv_id long, turn long, prune string, keep string, rewrite string, fuse string")
    return rows.select("conv_id", "turn", *[F.md5(a.lower()).alias(a.lower()) for a in C.ACTIONS])


@query("SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN 'KEEP' WHEN vec_id % 3 = 0 THEN 'REWRITE' WHEN vec_id % 2 = 0 THEN 'PRUNE' WHEN 0.1 > CAST(embedding[1] AS DOUBLE) THEN 'REWRITE' ELSE 'PRUNE' END AS action FROM embeddings")
def fallback_action(spark, sf_dir):
    """Rewards that are no number or minus infinity never win; where none wins the step is kept."""
    prune = F.when(F.col("vec_id") % 3 == 0, F.lit(math.nan)).otherwise(F.element_at("embedding", 1).cast("double"))
    rewrite = F.when(F.col("vec_id") % 2 == 0, F.lit(-math.inf)).otherwise(F.lit(0.1))
    options = F.array(F.struct(F.lit("PRUNE").alias("action"), prune.alias("reward")), F.struct(F.lit("REWRITE").alias("action"), rewrite.alias("reward")))
    return table(spark, sf_dir, "embeddings").select("vec_id", C.best_action(options).alias("action"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR conv_id % 7 = 0 THEN 0 ELSE CAST(length(text) AS INTEGER) END AS cost FROM conversations")
def action_costs(spark, sf_dir):
    """Pruning and empty texts are free."""
    action = F.when(F.col("turn") % 3 == 0, "PRUNE").when(F.col("turn") % 3 == 1, "FUSE").otherwise("REWRITE")
    made = F.when(F.col("conv_id") % 7 != 0, F.col("text")).otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", N.action_cost(action, made, F.length("text")).alias("cost"))


@query(f"""WITH RECURSIVE {_FOLD} SELECT CAST(label AS BIGINT) AS sample_id, md5(array_to_string(list_transform(kept, lambda x: 's' || x), chr(10) || chr(10)) || chr(10) || '</think>' || chr(10) || chr(10)) AS compressed_output,
round(1 - len(kept) / n, 6) AS compression_ratio, CAST(n AS INTEGER) AS num_steps, CAST(len(kept) AS INTEGER) AS num_kept_steps, CAST(n AS INTEGER) AS actions, (SELECT count(*) > 0 FROM q WHERE label % 4 = 3) AS any_error FROM f WHERE pos = n AND label % 4 <> 3""")
def compressed_records(spark, sf_dir):
    """Compressed traces in their output shape; every fourth one has no scores and is left out."""
    rows = vector_traces(spark, sf_dir).select(
        F.col("label").cast("long").alias("sample_id"), *[F.lit("").alias(c) for c in ("question", "ground_truth", "prompt", "full_output")], F.lit("t").alias("thinking"), F.lit("a").alias("after_think"),
        F.transform("ids", lambda i: F.concat(F.lit("s"), i)).alias("steps"), F.when(F.col("label") % 4 != 3, F.col("step_scores")).alias("step_scores"), "step_vectors",
    )
    made = C.compress(rows, C.Gate(tau_low=0.5, tau_sim=0.05))
    records = C.compressed_records(made)
    return records.select("sample_id", F.md5("compressed_output").alias("compressed_output"), F.round("compression_ratio", 6).alias("compression_ratio"), "num_steps", "num_kept_steps", F.size("action_history").alias("actions"), F.lit(C.any_error(made)).alias("any_error"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[^\s]+')) AS a, list_distinct(regexp_extract_all(substr(text, 20, 60), '[^\s]+')) AS b FROM conversations)
SELECT conv_id, turn, round(-1.0::DOUBLE / (1 + len(list_intersect(a, b))), 9) AS logprob FROM w""")
def answer_scores(spark, sf_dir):
    """Log-probabilities that a provider gives."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("prompt"), F.col("text").alias("thinking"), F.substring("text", 20, 60).alias("answer"))
    return P.score_answers(rows, P.FakeProvider).select("conv_id", "turn", F.round("logprob", 9).alias("logprob"))


_REWRITE_CHARS, _FUSE_CHARS = len(T.REWRITE_TEMPLATE.format(step="")), len(T.FUSE_TEMPLATE.format(first="", second=""))


@query(f"SELECT conv_id, turn, CAST({_REWRITE_CHARS} + length(text) AS VARCHAR) AS rewritten, CAST({_FUSE_CHARS} + length(role) + length(text) AS VARCHAR) AS fused FROM conversations")
def chat_edits(spark, sf_dir):
    """Rewriting and fusing by a chat client that fails every other time and answers with its prompt's length."""

    def run(frames):
        calls = [0]

        def chat(messages):
            calls[0] += 1
            if calls[0] % 2:
                raise OSError("busy")
            return f" {len(messages[1]['content'])}\n"

        provider = P.ChatTraceProvider(chat, logprob=lambda p, t, a: 0.0, similarity=lambda a, b: 0.0, count_tokens=len, delay=0)
        for pdf in frames:
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "rewritten": [provider.rewrite(t, "") for t in pdf["text"]], "fused": [provider.fuse(r, t, "") for r, t in zip(pdf["role"], pdf["text"])]})

    return table(spark, sf_dir, "conversations").mapInPandas(run, "conv_id long, turn long, rewritten string, fused string")


@query("SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS chars, CAST(length(text) - length(replace(text, 'e', '')) AS INTEGER) AS es FROM conversations")
def encodings(spark, sf_dir):
    """Texts embedded by a stand-in encoder: their length and their number of e."""
    encode = P.encoder(lambda: lambda texts: np.array([[len(t), t.count("e")] for t in texts], np.float32))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", encode(F.col("text")).alias("v"))
    return rows.select("conv_id", "turn", F.element_at("v", 1).cast("int").alias("chars"), F.element_at("v", 2).cast("int").alias("es"))


@query("SELECT conv_id, turn, CASE WHEN length(text) % 10 <> 0 THEN CAST(turn + 1 AS INTEGER) END AS n, CASE WHEN length(text) % 10 <> 0 THEN round(list_sum(list_transform(range(turn + 1), lambda j: (j % 5) / 4)), 6) END AS total FROM conversations")
def attention_of_target(spark, sf_dir):
    """The attention row of one token, from a stand-in that runs out of memory on some texts."""

    def make():
        def model(text, at):
            if len(text) % 10 == 0:
                raise MemoryError
            return np.array([(j % 5) / 4 for j in range(at + 1)])

        return model

    rows = P.attention(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), make, "text", "turn")
    total = F.aggregate("attention_row", F.lit(0.0), lambda a, x: a + x)
    return rows.select("conv_id", "turn", F.when(F.col("attention_row").isNotNull(), F.size("attention_row")).alias("n"), F.round(total, 6).alias("total"))


@query(r"""WITH w AS (SELECT conv_id, turn, least(len(regexp_extract_all(text, '[^\s]+')), 12) AS n FROM conversations)
SELECT conv_id, turn, CAST(n AS INTEGER) AS n, CAST(2 * n * n * (n - 1) + n * n AS DOUBLE) AS total FROM w""")
def full_attention(spark, sf_dir):
    """Whole attention matrices of two heads, cut at twelve tokens."""

    def make():
        def model(text, most):
            n = min(len(text.split()), most)
            return [[[[float(i + j + h) for j in range(n)] for i in range(n)] for h in (0, 1)]]

        return model

    rows = P.full_attention(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), make, "text", 12)
    cells = F.flatten(F.flatten(F.flatten("attention")))
    return rows.select("conv_id", "turn", F.size(F.element_at(F.element_at("attention", 1), 1)).alias("n"), F.aggregate(cells, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"WITH {_ANSWERS} SELECT 'level' AS part, level AS name, count(*) AS n FROM j WHERE level <> 'none' GROUP BY level UNION ALL SELECT 'reason', reason, count(*) FROM j GROUP BY reason")
def run_summary(spark, sf_dir):
    """What a preparing run prints: records a level, records a reason."""
    rows = judged(spark, sf_dir)
    levels = filtering.level_histogram(rows).select(F.lit("level").alias("part"), F.col("level").alias("name"), "n").where("n > 0")
    counts = filtering.reason_counts(rows).select(F.explode(F.array(*[F.struct(F.lit(r).alias("name"), F.col(r).alias("n")) for r in filtering.REASONS])).alias("x"))
    return levels.unionByName(counts.select(F.lit("reason").alias("part"), "x.name", "x.n").where("n > 0"))


@query("SELECT count(*) FILTER (o_orderkey % 11 <> 0) AS refined, count(*) FILTER (o_orderkey % 11 = 0) AS failed FROM orders")
def refined_counts(spark, sf_dir):
    return export.refined_counts(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 11 == 0, "failed").alias("error")))


@query("SELECT * FROM (VALUES ('random', 0.639427::DOUBLE), ('numpy', 0.37454::DOUBLE)) v(generator, first)")
def seeded_generators(spark, sf_dir):
    """The first numbers after a seed of 42."""
    kept, other = random.getstate(), np.random.get_state()
    P.set_seed(42)
    rows = [("random", round(random.random(), 6)), ("numpy", round(float(np.random.rand()), 6))]
    random.setstate(kept)
    np.random.set_state(other)
    return spark.createDataFrame(rows, "generator string, first double")
