import hashlib
import random
import sys

import numpy as np
import pytest

from tracemill.llm import suffix_dedup as D
from tracemill.llm.common import raw_text
from tracemill.llm.queries import QUERIES


def brute(rows, window=100):
    """rows: (id, text) with distinct ids; the contract by a plain set of strings."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            if w in seen:
                gone[k : k + window] = True
            else:
                seen.add(w)
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def run(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in D.remove_repeats(df, digest=True, **options).collect()}


def sample(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(18, 80)) for _ in range(6)]
    line = text(9)
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 40)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, len(parts)), line)
        rows.append((i * 7 % 61, " ".join(parts)))
    rows += [(100, "a" * 700), (101, "ab" * 300), (102, None), (103, ""), (104, "x" * 99), (105, "x" * 99), (106, "y" * 100), (107, "y" * 100), (None, shared[0]), (108, (shared[1] + " ") * 4)]
    rows += [(200 + i, shared[2]) for i in range(30)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = sample(seed)
    assert run(spark, rows, bucket_bytes=5000) == brute(rows)


@pytest.mark.parametrize("bits", [0, 4])
def test_weak_stretch_hashes_are_found_out(spark, monkeypatch, bits):
    """With hashes that agree for unlike stretches nothing is removed that is not repeated, and nothing repeated stays."""
    monkeypatch.setattr(D, "FLUSH_BYTES", 2000)
    rows = sample(7)
    assert run(spark, rows, bucket_bytes=5000, stretch_bits=bits) == brute(rows)


def test_hot_grams(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_RUNS", 3)
    rows = sample(3)
    assert run(spark, rows, parts=5, bucket_bytes=3000) == brute(rows)
    grams = D.text_runs(*raw_text(__import__("pyarrow").array([t for _, t in rows])), D.WINDOW, D.GRAM)[3]
    heavy = np.unique(grams)[::3]
    monkeypatch.setattr(D, "_heavy_grams", lambda *a: (heavy, np.full(len(heavy), 50)))
    assert run(spark, rows, bucket_bytes=3000) == brute(rows)


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT", 500)
    monkeypatch.setattr(D, "FLUSH_BYTES", 2000)
    rows = sample(4) + [(300, sample(5)[0][1] * 9), (301, " ".join(t or "" for _, t in sample(4)))]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    text = sample(1)[0][1] + "z" * 150
    got = D.remove_repeats(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string"), digest=True).collect()
    want = brute([(1, text), (2, text)])
    assert sorted((r["doc_id"], *r[1:]) for r in got) == sorted((i, *want[i]) for i in (1, 1, 2))
    assert D.remove_repeats(spark.createDataFrame([], "doc_id long, text string, h string, key int")).collect() == []
    clash = spark.createDataFrame([(1, text, "a", 3, "k", b"b"), (2, text, None, None, None, None)], "doc_id long, text string, h string, key int, kind string, body binary")
    assert sorted((r["doc_id"], *r[1:]) for r in D.remove_repeats(clash, digest=True).collect()) == sorted((i, *want[i]) for i in (1, 2))


def test_collisions_are_verified(monkeypatch):
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1500:1700] = text[100:300]
    at = np.arange(0, 2900)
    truth = {}
    want = np.array([truth.setdefault(text[i : i + 100].tobytes(), i) != i for i in at])
    zero = np.zeros(len(at), np.int64)
    assert (D.repeated(text, at, zero, at, 100) == want).all()
    real = D.PrefixHashes.of
    monkeypatch.setattr(D.PrefixHashes, "of", lambda self, a, n: real(self, a, n) & np.uint64(1))
    got = D.repeated(text, at, zero, at, 100)
    assert not (got & ~want).any()  # a weak hash never removes what is not repeated


def test_cost_does_not_grow_with_groups_or_targets(monkeypatch):
    """The sort's comparisons a suffix do not grow with the group, and what tasks send takes no work for each of its targets."""
    rng = np.random.default_rng(0)
    real, hashed = D.PrefixHashes.of, []
    monkeypatch.setattr(D.PrefixHashes, "of", lambda self, a, n: hashed.append(len(a)) or real(self, a, n))

    def compared(n):
        hashed.clear()
        text = np.tile(np.r_[rng.integers(97, 123, 60), np.full(40, 97)].astype(np.uint8), n + 2)
        text[::100] = rng.integers(97, 123, len(text[::100]))
        D.repeated(text, np.arange(n) * 100, np.zeros(n, np.int64), np.arange(n), 100)
        return sum(hashed) / n

    assert compared(4000) <= 1.2 * compared(250)

    def calls(targets):
        n, made = 5000, []
        cols = {"id": rng.integers(-9, 1 << 40, n), "h": rng.integers(0, 1 << 63, n).astype(np.uint64), "start": np.arange(n), "n": np.ones(n, np.int64)}
        part, size = rng.integers(0, targets, n), rng.integers(0, 30, n)
        sys.setprofile(lambda frame, event, arg: made.append(event) if "call" in event else None)
        try:
            batches = list(D.pack("gone", part, D.GONE, cols, (np.arange(200).astype(np.uint8), cols["start"] % 170, size)))
        finally:
            sys.setprofile(None)
        assert sum(b.num_rows for b in batches) == len(set(part.tolist()))
        (got,) = D.unpack([b.slice(i, 3) for b in batches for i in range(0, b.num_rows, 3)], gone=D.GONE)
        order = np.argsort(part, kind="stable")
        assert all((got[k] == cols[k][order]).all() for k in cols)
        assert got["text"].tobytes() == b"".join(bytes(range(cols["start"][i] % 170, cols["start"][i] % 170 + size[i])) for i in order)
        return len(made)

    assert calls(2000) <= calls(20) + 20


def test_frequent_grams_are_cut_into_pieces(spark, monkeypatch):
    """Each window is in one piece, equal windows share a key, and a piece costs about a run's bytes, not a window's for each window."""
    texts = [t for _, t in sample(3) + sample(5)]
    data, offs = raw_text(__import__("pyarrow").array(texts))
    row, start, n, g, _, off = D.text_runs(data, offs, D.WINDOW, D.GRAM)
    at = offs[row] + start
    own, first, count, key = D.pieces(data, at, n, off, g, D.WINDOW, D.GRAM)
    place = np.concatenate([np.arange(a, a + c) for a, c in zip((at[own] + first).tolist(), count.tolist())])
    assert (np.sort(place) == np.sort(np.concatenate([np.arange(a, a + c) for a, c in zip(at.tolist(), n.tolist())]))).all()
    keys: dict = {}
    for p, k in zip(place.tolist(), np.repeat(key, count).tolist()):
        keys.setdefault(data[p : p + D.WINDOW].tobytes(), set()).add(k)
    assert all(len(k) == 1 for k in keys.values())
    assert (count + D.WINDOW - 1).sum() < 4 * (n + D.WINDOW - 1).sum()
    monkeypatch.setattr(D, "BLOCK_RUNS", 1)
    monkeypatch.setattr(D, "BLOCK_SUFFIXES", 50)
    rows = sample(6)
    assert run(spark, rows, bucket_bytes=3000) == brute(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op1_suffix"](spark, sf).collect()}
    assert got == brute(rows)
    assert sum(v[1] for v in got.values()) > 0
