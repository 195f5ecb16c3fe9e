"""SimHash, components, top-k, packing, toxicity and the pipeline on small tables."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tracemill.llm import near_copies, packing, simhash, topk, toxicity
from tracemill.llm.components import components
from tracemill.llm.queries import QUERIES, tokenizer_file

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def print_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, near):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") * rng.randint(1, 3) for _ in range(n)) for n in (300, 200, 50)]
    texts = [None, "", "  ", "One", "one ", "É é", "a b c d e"]
    for b in base:
        w = b.split()
        for _ in range(8):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = "new"
            texts.append(" ".join(v))
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)] + [(1, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    values = [print_of(t) for _, t, _ in rows]
    root = classes(values, lambda a, b: (a ^ b).bit_count() <= 4)
    first = defaultdict(lambda: 1 << 60)
    for (i, _, _), r in zip(rows, root):
        first[r] = min(first[r], i)
    want = sorted((i, v - (1 << 64) if v >> 63 else v, first[r]) for (i, _, _), v, r in zip(rows, values, root))
    found = simhash.near_duplicates(docs)
    assert sorted(tuple(r) for r in found.select("doc_id", "fp", "component_id").collect()) == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(first.values()))
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, "a b"), (None, "c d"), (5, "a b")], "doc_id long, text string")
    assert sorted((r["component_id"] or 0) for r in simhash.near_duplicates(nulls).collect()) == [0, 5, 5]
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in simhash.keep_first(nulls).collect()) == [(0, "c d"), (5, "a b")]


TWICE = [(1, "one two three four five six"), (5, "one two three four five six"), (5, "b b b c c d"), (7, "c1 c2 c3 c4 c5"), (7, "d9 d8 d7 d6 d5 d4"), (7, "d9 d8 d7 d6 d5 d4"), (None, "e f g h"), (None, None)]


def test_rows_that_share_an_id_are_kept_apart(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TWICE], "doc_id long, text string, first string").repartition(3)
    want = sorted({(i or 0, t or "") for i, t in TWICE} - {(5, TWICE[0][1])})
    for kept in (simhash.keep_first(docs), near_copies.keep_first_copy(docs)):
        assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == want


def test_a_dense_bucket_is_dealt_out(spark):
    rng = np.random.default_rng(4)
    fps = np.unique(np.uint64(5) << np.uint64(40) | rng.integers(0, 1 << 24, 200, dtype=np.uint64)).view(np.int64)
    table = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    want = classes([int(f) for f in fps], lambda a, b: (a ^ b).bit_count() <= 4)
    for dense in (16, 1 << 20):
        got = defaultdict(set)
        for r in components(simhash.near_links(table, dense=dense)).collect():
            got[r["root"]].add(r["node"])
        groups = defaultdict(set)
        for f, w in zip(fps.tolist(), want):
            groups[w].add(f)
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("budget", [0, 4])
def test_trie_join_finds_the_classes(budget):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = [np.uint64(c) for c in centre]
    for _ in range(400):
        v = rng.choice(fps)
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            v ^= np.uint64(1) << np.uint64(b)
        fps.append(v)
    fps = np.unique(np.array(fps, np.uint64))
    order, at, root = simhash.trie_links(np.zeros(len(fps), np.uint64), fps, budget)
    want = classes([int(x) for x in fps[order]], lambda a, b: (a ^ b).bit_count() <= budget)
    assert (root == np.array(want)).all()


def test_components_of_long_chains(spark):
    n = 300
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    links = [(ids[i], ids[i + 1]) for i in range(n - 1)] + [(1000 + i, 1000) for i in range(1, 60)] + [(5000, 5000)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(links, "a long, b long")).collect():
        got[r["root"]].add(r["node"])
    assert sorted(map(sorted, got.values())) == [list(range(n)), list(range(1000, 1060))]
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_top(rows, k=5):
    fine = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in fine:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.01, 1, 5])]) for i in range(400)]
    rows += [(400 + i, [1.0] * 8) for i in range(60)]
    rows += [(500, None), (501, []), (502, [1.0, None] + [0.0] * 6), (550, [float("nan")] * 8), (504, [float("inf")] * 8), (None, [9.0] * 8), (600, [0.0] * 8), (650, [-3.0] * 8), (700, [2.0] * 4)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    for blocks in ({}, {"query_block": 3, "candidate_block": 50, "growth": 2}, {"candidate_block": 100}):
        assert sorted(tuple(r) for r in topk.top_k(df, lambda i: i % 50 == 0, **blocks).collect()) == brute_top(rows)
    few = df.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, lambda i: i % 50 == 0).count() == 2
    assert topk.top_k(df.limit(0), lambda i: i % 50 == 0).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_block_top_prunes_nothing_it_should_keep(seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(3, 16))
    c = np.floor((centre[rng.integers(0, 3, 3000)] + rng.normal(size=(3000, 16)) * 0.05) * rng.choice([1, 100, 1000], (3000, 1)))
    q, ids = c[::100] * rng.choice([-1, 1], (30, 1)), np.arange(3000)
    row, i, s = topk.block_top(ids[::100], q, ids, c, 5, bucket=128)
    for k in range(30):
        scores = (c @ q[k]).astype(np.int64)
        scores[k * 100] = np.iinfo(np.int64).min
        want = np.lexsort((ids, ~scores))[:5]
        assert i[row == k].tolist() == want.tolist() and s[row == k].tolist() == scores[want].tolist()


def test_products_are_computed_for_kept_pairs_only():
    rng = np.random.default_rng(7)
    c = np.floor(rng.normal(size=(4096, 16)) * rng.choice([1, 10, 100, 1000], (4096, 1)))
    q, ids, counted = c[::64], np.arange(4096), []
    topk.block_top(ids[::64], q, ids, c, 5, bucket=256, counted=counted)
    assert counted[0] < 0.25 * len(q) * len(c)  # length and coordinates rule out the rest
    # a score to beat from longer blocks rules out more, in the first bucket too
    best = np.array([np.sort((c @ v).astype(np.int64))[-1] for v in q], float)
    row, i, s = topk.block_top(ids[::64], q, ids, c, 5, bucket=256, least=best, counted=counted)
    assert counted[1] < counted[0] and (s >= best[row]).all()
    assert topk.block_top(ids[::64], q, ids, c, 5, least=best + 1e9, counted=counted)[0].tolist() == [] and counted[2] < counted[1]


def test_length_blocks():
    made = topk.length_blocks([(5, 10), (9, 3), (8, 3), (7, 25), (topk.ZERO, 1)], 10)
    assert made == [(9, 0, 1), (8, 0, 1), (7, 1, 3), (5, 4, 1), (topk.ZERO, 5, 1)]


def test_large_products_are_exact():
    q, c = np.array([[2.0**31, 1.0]]), np.array([[2.0**31, 3.0], [2.0**31, 4.0]])
    assert topk._exact(q, c).tolist() == [[2**62 + 3, 2**62 + 4]]


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(spark, capacity):
    rng = random.Random(6)
    texts = [None, "", " ", "Hello, World. <|endoftext|> X", "J\u030c j\u030c \u0130 ΑΣ Σ.", "it's don't 's", "a.b,c.. d,", "\x1c\x85x", "word " * 9000] + [" ".join("".join(rng.choice("abcdeé,.A") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(5, texts[5], 7)], "doc_id long, text string, bin int").repartition(17)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    want = [(i, k, k * capacity, len(x[k * capacity :][:capacity]), zlib.crc32(np.array(x[k * capacity :][:capacity], "<u4").tobytes())) for i, x in [*enumerate(ids), (5, ids[5])] for k in range(-(-len(x) // capacity))]
    rows = packing.pack(docs, tokenizer_file(), capacity=capacity, slack=0, fan_in=3).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(w[3] for w in want)
    assert len(bins) <= 1.3 * -(-total // capacity) + 1
    assert packing.pack(docs.limit(0), tokenizer_file()).collect() == []
    # the sequences hold every piece's own tokens at its place, also where rows share an id or have none
    more = docs.unionByName(spark.createDataFrame([(5, "other words under the same id", 1), (None, "no id", 1), (None, "none at all", 1)], docs.schema))
    packed = packing.pack(more, tokenizer_file(), capacity=capacity)
    made = {r["sequence_id"]: list(r["ids"]) for r in packing.sequences(more, packed, tokenizer_file(), capacity).collect()}
    places = packed.collect()
    assert sum(map(len, made.values())) == sum(r["length"] for r in places)
    for r in places:
        assert zlib.crc32(np.array(made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]


def test_an_underfull_bin_finds_its_host_in_another_group(spark):
    """One group is left with a bin of 6 of 16 tokens, others far away with bins of 9: they meet up the tree."""
    word = lambda n: " ".join(["the"] * (n - 1))
    parts = [[word(9)] * 3, [word(9)] * 2, [word(9)], [word(9)], [word(6)], [word(9)], [word(9)], [word(9)], [word(7)]]
    docs = spark.sparkContext.parallelize([(10 * p + i, t) for p, ts in enumerate(parts) for i, t in enumerate(ts)], 1).toDF("doc_id long, text string")
    docs = docs.repartitionByRange(len(parts), (docs["doc_id"] / 10).cast("int"))
    rows = packing.pack(docs, tokenizer_file(), capacity=16, slack=0, fan_in=2).collect()
    assert sum(r["length"] for r in rows) == 9 * 10 + 6 + 7 and len({r["sequence_id"] for r in rows}) == 10


def test_toxicity(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(900):
        w, bad = [word() for _ in range(rng.randint(20, 120))], i % 5 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["moron", "lostra" + word()]))
        rows.append((i, " ".join(w), "en" if i % 2 else "fr", "s"))
        labels.append((i, int(bad)))
    rows += [(5000, None, None, "s"), (5001, "", "en", "s"), (None, "moron", "en", "s"), (5002, "x " * 30000 + "moron", "en", "s"), (1, rows[1][1], "en", "s")]
    labels += [(77, None), (None, 1), (9999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, table, toxicity.remainder() != 2)
    got = toxicity.classify(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum((r["score"] >= 0.3) == bool(truth[r["doc_id"]]) for r in held)
    assert right >= 0.95 * len(held) and len(held) > 150
    assert next(r["score"] for r in got if r["doc_id"] == 5002) >= 0.3
    assert [r["score"] for r in toxicity.classify(docs, toxicity.fit(docs, table, toxicity.remainder() != 2)).collect()] == [r["score"] for r in got]
    flat = toxicity.classify(docs, toxicity.fit(docs, table.where("toxic = 1"), toxicity.remainder() != 2)).select("score").distinct().collect()
    assert [r["score"] for r in flat] == [1.0]
    assert {r["score"] for r in toxicity.classify(docs, toxicity.fit(docs.limit(0), table.limit(0), toxicity.remainder() != 2)).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), model).collect() == []


def test_toxicity_learns_from_every_labelled_row(spark):
    """Words that one document of 4,000 has count; many shards learn and calibrate like one."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(10)) + (" moron" if i % 20 == 0 else ""), "en") for i in range(5400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    seen = []
    count, finish = toxicity._total, toxicity.finish
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "_total", lambda table, each: (seen.append(table.count()), count(table, each))[1])
        patch.setattr(toxicity, "finish", lambda params, z, *more: (seen.append(len(z)), finish(params, z, *more))[1])
        model = toxicity.fit(docs, labels, toxicity.remainder() != 2, toxicity.Settings(shard_rows=900))
    usable = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(5400))
    assert usable > 3600 and set(seen[:-1]) == {usable} and usable // 5 - 6 <= seen[-1] <= usable // 5
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.3) == (i % 20 == 0) for i in held) >= 0.98 * len(held)


def tiny_model(kind=np.float64):
    s = toxicity.Settings(slots=40, dim=3, widths=(1, 2, 3), filters=4, prefixes=(2, 3))
    rng = np.random.default_rng(5)
    params = {"embed": rng.normal(size=(s.slots, s.dim)).astype(kind), "out": rng.normal(size=12), "c": np.array([0.3])}
    for k, w in enumerate(s.widths):
        params[f"conv{k}"], params[f"bias{k}"] = rng.normal(size=(w * s.dim, s.filters)).astype(kind), rng.normal(size=s.filters).astype(kind) * 0.1
    return s, params


def plain_logit(s, params, slots):
    """One text's score by loops: embeddings, filters over windows, maxima that rest at zero, a weighted sum."""
    words = [sum(params["embed"][i] for i in word) for word in slots]
    z = []
    for k, w in enumerate(s.widths):
        for f in range(s.filters):
            sums = [params[f"bias{k}"][f] + sum(words[i + j] @ params[f"conv{k}"][j * s.dim : (j + 1) * s.dim, f] for j in range(w)) for i in range(len(words) - w + 1)]
            z.append(max([0.0, *sums]))
    return float(np.dot(z, params["out"]) + params["c"][0])


def test_scores_equal_a_plain_forward_pass():
    s, params = tiny_model(np.float32)
    model = toxicity.Model(s, params["embed"], [params[f"conv{k}"] for k in range(3)], [params[f"bias{k}"] for k in range(3)], params["out"], params["c"][0], (0.7, -0.2)).prepare()
    import pyarrow as pa

    from tracemill.llm.common import raw_text

    texts = ["", None, "One", "two words", "Étude three words more", " ".join(f"w{i}ord" for i in range(60)), "a b c d e"]
    data, offs = raw_text(pa.array(texts))
    got = model.score_chunk(data, offs)
    for r in range(len(texts)):
        slots, _ = toxicity.word_slots(data[offs[r] : offs[r + 1]], np.array([0, offs[r + 1] - offs[r]]), s)
        want = 1 / (1 + np.exp(-(0.7 * plain_logit(s, params, slots) - 0.2)))
        assert got[r] == pytest.approx(want, abs=1e-5), texts[r]


def test_gradients_equal_differences():
    s, params = tiny_model()
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, s.slots, (n, 3)) for n in (1, 2, 7, 12)]
    labels, weight = np.array([1.0, 0.0, 1.0, 0.0]), np.array([2.0, 1.0, 0.5, 1.0])

    def loss():
        z = np.array([plain_logit(s, params, t) for t in texts])
        return float(np.mean(weight * (np.log1p(np.exp(z)) - labels * z)))

    grads, (slots, rows) = toxicity.gradients(params, s, texts, labels, weight)
    grads["embed"] = np.zeros_like(params["embed"])
    np.add.at(grads["embed"], slots, rows)
    for name, g in grads.items():
        flat = params[name].reshape(-1)
        for i in rng.permutation(len(flat))[:12]:
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-6, abs=1e-6), name


def test_pipeline(spark):
    import corpus_pipeline
    from tracemill.llm.common import materialize, read_table

    sf = "/root/testdata/sf0.001"
    docs = read_table(spark, sf, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns, name
        left = {r["doc_id"] for r in docs.collect()}
        assert left <= ids and len(left) > 0.5 * len(ids), name
        assert name != "secrets" or left == ids
        ids = left
    values = [print_of(r["text"]) for r in docs.collect()]
    assert len(values) == len(ids)
    rows = QUERIES["pipeline"](spark, sf).collect()
    assert {r["doc_id"] for r in rows} == ids
