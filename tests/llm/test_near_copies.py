"""Near copies of the pipeline against brute-force Jaccard."""

import random

import numpy as np

import corpus_pipeline
from tracemill.llm import near_copies


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def first_ids(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, s) in enumerate(rows):
        for j, t in rows[:n]:
            if similarity(s, t) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in root if find(i) == i}


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}


def test_planted_pairs_from_080_to_095(spark):
    rng = random.Random(11)
    rows = [(0, None), (1, " "), (2, "a b"), (3, "A  b"), (4, "a c")]
    seen = []
    for _ in range(120):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(120, 400))]
        v = list(w)
        for _ in range(rng.randint(1, max(2, len(w) // 32))):
            v[rng.randrange(len(v))] = "new"
        a, b = " ".join(w), " ".join(v)
        seen.append(similarity(a, b))
        rows += [(len(rows) + 10, a), (len(rows) + 11, b)]
    assert sum(0.8 <= s < 0.95 for s in seen) > 60 and sum(s < 0.8 for s in seen) > 5
    assert stage(spark, rows) == first_ids(rows)


def test_clean_documents_with_a_repeated_line_stay(spark):
    rng = random.Random(12)
    line = " ".join(f"licence{i}" for i in range(11))
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 150))) for _ in range(60)]
    rows = [(i, " ".join([w] + [line] * rng.randint(40, 80))) for i, w in enumerate(own)]
    assert max(similarity(rows[0][1], t) for _, t in rows[1:]) < 0.3
    assert stage(spark, rows) == set(range(60))


def test_classes_meet_beyond_the_leaders(spark):
    """Chains whose ends are unlike each other: a bucket's leader does not link to all of its class."""
    rng = random.Random(13)
    rows = []
    for _ in range(6):
        w = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for _ in range(25):
            rows.append((len(rows), " ".join(w)))
            for _ in range(5):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    assert stage(spark, rows) == first_ids(rows)


def test_fingerprints_name_candidates_by_themselves(spark, monkeypatch):
    """Without the MinHash keys, SimHash links still bring near copies to the exact check, and unlike texts stay."""
    monkeypatch.setattr(near_copies, "band_keys", lambda hashes: np.random.default_rng(len(hashes)).integers(0, 1 << 63, (len(hashes), near_copies.BANDS)).astype(np.uint64))
    rng = random.Random(14)
    line = " ".join(f"licence{i}" for i in range(11))
    rows = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(80)] + [line] * 60)) for i in range(20)]
    for _ in range(20):
        w = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:-1]))]
    assert stage(spark, rows) == first_ids(rows) == {*range(20), *range(20, 60, 2)}


def test_copies_close_to_one_text_are_not_paired_with_each_other(spark, monkeypatch):
    """Edited copies of one text, many of them under 0.8: links as by brute force, without a pair for each two."""
    links, unite = [], near_copies._united
    monkeypatch.setattr(near_copies, "_united", lambda known, found: (links.append(found.count()), unite(known, found))[1])
    rng = random.Random(15)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        w = list(base)
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        if i % 7 == 0:  # copies of a copy, and shorter ones: alike by what they share outside the text, or by sizes
            w = rows[rng.randrange(1, i)][1].split()
            w[rng.randrange(len(w))] = f"n{i}"
        if i % 5 == 0:
            w = w[: rng.randint(100, 149)]
        rows.append((i, " ".join(w)))
    want = first_ids(rows)
    assert stage(spark, rows) == want and 20 < len(want) < 380
    assert links[1] > 0 and sum(links) < 20 * len(rows)
