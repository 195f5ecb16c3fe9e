import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.llm import language_model
from tracemill.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = ("end",)
START = ("start",)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [END]


def discounts_of(counts):
    """Chen and Goodman's three discounts from how many grams were counted once, twice, three and four times, held inside their ranges."""
    n1, n2, n3, n4 = (sum(c == k for c in counts) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 else 1.0
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return {0: 0.0, 1: min(max(d1, 0.05), 1), 2: min(max(d2, 0.1), 2), 3: min(max(d3, 0.15), 3)}


def brute(train, texts, order=3):
    padded = lambda t: [START] * (order - 1) + tokens(t)
    uni = Counter(w for t in train for w in tokens(t))
    n, v = sum(uni.values()), len(uni)
    levels = {order: Counter(tuple(p[i : i + order]) for t in train for p in [padded(t)] for i in range(len(p) - order + 1))}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut = {k: discounts_of(levels[k].values()) for k in levels}
    after = {k: defaultdict(list) for k in levels}
    for k, grams in levels.items():
        for g, c in grams.items():
            after[k][g[:-1]].append(c)

    def p(history, w):
        k = len(history) + 1
        lower = p(history[1:], w) if history else 1 / (v + 1)
        counts = after[k].get(history)
        if not counts:
            return lower
        c = levels[k][(*history, w)]
        return (max(c - cut[k][min(c, 3)], 0) + sum(cut[k][min(x, 3)] for x in counts) * lower) / sum(counts)

    out = []
    for x in texts:
        w, q = tokens(x), padded(x)
        logs = [math.log10(p(tuple(q[i : i + order - 1]), q[i + order - 1])) for i in range(len(w))]
        out.append((len(w), sum(uni[i] > 0 for i in w), sum(math.log10((uni[i] + 0.1) / (n + 0.1 * (v + 1))) for i in w), sum(logs)))
    return out, n, p, uni


def check(got, want):
    assert (got["n_tokens"], got["n_known"]) == want[:2]
    assert got["base_score"] == pytest.approx(want[2], rel=1e-9, abs=1e-9)
    assert got["score"] == pytest.approx(want[3], rel=1e-9, abs=1e-9)


CASES = ["a b a b c", None, "", "  \t", "A B c", "a b a b c", "the the the the " * 300, "x" * 5000, "é É ü", "a", "b a", "zz q"]


@pytest.mark.parametrize("order,per_shard", [(3, 1 << 20), (3, 150), (2, 300), (4, 500)])
def test_against_brute_force(spark, order, per_shard):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "doc_id long, text string, score string").repartition(3)
    train = docs.where("doc_id < 8")
    model = language_model.train(train, order=order, per_shard=per_shard)
    got = {r["doc_id"]: r for r in language_model.score(docs, model).collect()}
    want, n, p, uni = brute(CASES[:8], CASES, order)
    assert model.tokens == n
    for i, w in enumerate(want):
        check(got[i], w)
    for history in (("a", "b", "a"), ("zz", "the", "the"), (START, START, START)):
        h = history[4 - order :]
        assert sum(p(h, w) for w in uni) + p(h, "never seen") == pytest.approx(1)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    rows = language_model.score(docs, language_model.train(docs.limit(0))).collect()
    assert [(r["score"], r["n_known"]) for r in rows] == [(0.0, 0), (0.0, 0)]
    assert language_model.score(docs.limit(0), language_model.train(docs)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in docs}
    want, n, _, _ = brute([r["text"] for r in docs if not held[r["doc_id"]]], [r["text"] for r in docs])
    got = {r["doc_id"]: r for r in QUERIES["op2_lm"](spark, sf).collect()}
    for r, w in zip(docs, want):
        check(got[r["doc_id"]], w)
        assert got[r["doc_id"]]["held_out"] == held[r["doc_id"]] and got[r["doc_id"]]["train_tokens"] == n
    assert sum(g["score"] for g in got.values() if g["held_out"]) > sum(g["base_score"] for g in got.values() if g["held_out"])


def test_three_words_predict_held_out_texts_better_than_two(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    perplexity = []
    for order in (2, 3):
        model = language_model.train(docs.where(~held), order=order)
        r = language_model.score(docs.where(held), model).agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
        perplexity.append(10 ** (-r["s"] / r["n"]))
    assert perplexity[1] < perplexity[0]
