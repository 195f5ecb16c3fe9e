"""The pipeline's stages on odd rows, and all of it against plain versions of its stages."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import toxicity
from tracemill.llm.queries import tokenizer_file

from .test_near_copies import first_ids
from .test_text_matching import bench_model, secret_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, items string, score double, toxic string, n_words int, h long, key int, kinds string, body binary"
ITEM = "seven green dragons sail across the quiet winter lake singing loudly together"


def documents(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [text(rng.randint(30, 90)) for _ in range(320)]
    for i in range(0, 320, 8):
        w = rows[i].split()
        w.insert(rng.randrange(len(w)), "moron")
        rows[i] = " ".join(w)
    for i in (1, 4, 7):  # near copies of one changed word
        w = rows[i].split() + text(60).split()
        rows[i] = " ".join(w)
        w[10] = "changed"
        rows.append(" ".join(w))
    rows[2] += " " + ITEM
    rows[5] += " password = hunter2hunter2 AKIA" + "Z9" * 8
    rows[9] = rows[11]
    rows += [None, "", " ", "tiny", "x " * 30000, "token=abcdefgh " * 3000]
    return [(i, t, "en" if i % 2 else None, "s", None if t is None else len(t)) + (None,) * 8 for i, t in enumerate(rows)]


@pytest.fixture()
def folder(spark, tmp_path):
    rows = documents(1)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int("moron" in (r[1] or ""))) for i, r in enumerate(rows[:320])]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def plain_redaction(text):
    names = ["[ASSIGN]", "[ACCESS]", "[HEX]"]
    out, at = [], 0
    for s, k, e in secret_model(text):
        if s >= at:
            out += [text[at:s], names[k]]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_against_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), toxicity.remainder() != 2)
    scores = {r["doc_id"]: (r["score"], model.thresholds.get(r["lang"], 0.3)) for r in toxicity.score(docs, model).collect()}
    left = {i: t for i, t in rows.items() if scores[i][0] < scores[i][1]}
    assert any("moron" in (t or "") for i, t in rows.items() if i not in left) and sum("moron" not in (rows[i] or "") for i in rows if i not in left) <= 2
    first = first_ids(sorted(left.items()))
    left = {i: t for i, t in left.items() if i in first}
    left = {i: t for i, t in left.items() if not bench_model(t, [(1, ITEM)])[1]}
    left = {i: None if t is None else plain_redaction(t) for i, t in left.items()}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    want = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in left.items()}
    got, places = {}, {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for parts in places.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_stages_on_odd_rows(spark, folder):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, an empty table: stage by stage."""
    odd = [(None, "no id"), (None, None), (3, None), (3, "one id"), (3, "two texts"), (3, "two texts"), (4, ""), (5, "token=abcdefgh " * 2000), (6, f"a {ITEM} b"), (6, "same id clean")]
    rows = [(i, t, None, None, None, "own", 1.5, "own", 7, 8, 9, "own", b"own") for i, t in odd]
    for table in (rows, []):
        docs = spark.createDataFrame(table, SCHEMA).repartition(2)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            got = out.collect()
            if name == "packing":
                assert len(got) >= len(table) and sum(r["length"] for r in got if r["doc_id"] == 4) in (0, 1)
                continue
            assert out.columns == docs.columns, name
            assert all(r["items"] == "own" and r["score"] == 1.5 and r["toxic"] == "own" and r["h"] == 8 for r in got), name
            kept = sorted(((r["doc_id"] or 0), r["text"] or "") for r in got)
            if not table:
                assert kept == []
            elif name == "near_duplicates":  # null and empty texts are equal: the one with the smallest id stays
                assert kept == sorted((i or 0, t or "") for i, t in set(odd) if (i, t) not in ((None, None), (4, "")))
            elif name == "decontamination":
                assert kept == sorted((i or 0, t or "") for i, t in odd if ITEM not in (t or ""))
            elif name == "secrets":
                assert kept == sorted((i or 0, re.sub("token=abcdefgh", "[ASSIGN]", t or "")) for i, t in odd)
            else:
                assert set(kept) <= {(i or 0, t or "") for i, t in odd} and len(kept) >= 8
