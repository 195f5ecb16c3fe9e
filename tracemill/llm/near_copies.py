"""Near copies by SimHash candidates and exact similarity of word-shingle sets (Jaccard), for the pipeline.

Texts of equal words collapse first. The distinct ones get a 64-bit SimHash of their shingles; fingerprints are linked by the
binary-trie self-join of ``simhash`` and a class of theirs is a group of candidates. Four bits of 64 see few pairs of similarity 0.8,
so ``BANDS`` MinHash keys of ``ROWS`` hashes add groups of their own: two texts of similarity s share one with probability
1 - (1 - s^5)^20, 0.9996 at 0.8 and more above. Groups only name candidates; a link needs the exact similarity of both shingle sets.

In each group all texts are compared with one leader. Where the texts of a leader still span several classes, their differences from the
leader meet in one task, and the exact similarity of each text to those of other classes follows from the differences alone; only links
that join classes leave the task. So every pair of a group is decided exactly, and no pair is a row unless it is a link.

Defined cases: texts without words, null ones included, are equal; a text of fewer words than a shingle is one shingle; very
long texts are read whole; rows that share an id but not the text are rows of their own, equal rows are one document;
rows with a null id never name a class unless all its ids are null; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, drop_scratch, materialize, mix, powers, raw_text, small_batches
from .components import components
from .simhash import classes_of, fingerprint, first_of_classes, first_row, shingle_hashes, text_hash

BANDS, ROWS = 20, 5
#: Parts that the pairs of one leader are dealt to.
SALTS = 64
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_NODE_SEED = 7


def _node(words) -> int:
    v = xxhash.xxh64_intdigest(words, _NODE_SEED)
    return v - (1 << 64) if v >> 63 else v


def band_keys(hashes: list[np.ndarray]) -> np.ndarray:
    """(rows x BANDS): the MinHash keys."""
    flat = np.concatenate(hashes)
    start = np.cumsum([0] + [len(h) for h in hashes[:-1]])
    low = np.empty((len(hashes), BANDS * ROWS), np.uint64)
    for i, f in enumerate(_FACTORS):
        low[:, i] = np.minimum.reduceat(((flat * f) >> np.uint64(32)).astype(np.uint32), start)
    banded = mix(low.reshape(len(hashes), BANDS, ROWS)) * powers(ROWS + 1)[1:]
    return mix(banded.sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def sketches(docs: DataFrame, width: int, seed: int, id_col: str, text: str) -> DataFrame:
    """(doc_id, h, node, fp, keys) of every row; node is the hash of the text's words, h that of the text, fp its SimHash."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(text).alias("h"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offs = raw_text(batch.column("text"))
            nodes, keys, fps = [], [], []
            for a, b in chunks(offs):
                found = [(w, np.array(h, np.uint64)) for w, h in shingle_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], width, seed)]
                nodes += [_node(w) for w, _ in found]
                fps += [fingerprint(h) for _, h in found]
                keys.append(band_keys([h if len(h) else np.zeros(1, np.uint64) for _, h in found]))
            flat = np.concatenate(keys).reshape(-1).view(np.int64) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * BANDS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), lists], names=["doc_id", "h", "node", "fp", "keys"])

    return rows.mapInArrow(run, f"doc_id {kind}, h long, node long, fp long, keys array<long>")


def _read(batches, names):
    """The columns of all batches of a task; None if there are no rows."""
    parts = [b for b in batches if b.num_rows]
    return [pa.chunked_array([b.column(n) for b in parts]) for n in names] if parts else None


def members(rows: DataFrame) -> DataFrame:
    """(a, b): the leader and each other text of every group of ``rows`` (key, node, root) that spans several roots; repeats included."""

    def run(batches):
        got = _read(batches, ["key", "node", "root"])
        if got is None:
            return
        key, node, root = (c.to_numpy() for c in got)
        order = np.lexsort((mix(node.view(np.uint64)), key))
        key, node, root = key[order], node[order], root[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[first, len(key)])
        mixed = np.repeat(np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first), n)
        leader = np.repeat(node[first], n)
        keep = mixed & (leader != node)
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (leader, node)], names=["a", "b"])

    return rows.select("key", "node", "root").repartition(F.col("key")).mapInArrow(run, "a long, b long")


def _list_array(values: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(v) for v in values])], pa.int32()), pa.array(flat))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all lists, and where each begins and the last one ends."""
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in column.chunks])
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]), np.r_[0, np.cumsum(sizes)]


class _Common:
    """For some lists of distinct values: how many values one of them has in common with each."""

    def __init__(self, values: list[np.ndarray]):
        sizes = np.array([len(v) for v in values])
        owner, flat = np.repeat(np.arange(len(values)), sizes), np.concatenate(values)
        order = np.argsort(flat, kind="stable")
        self.values, self.owner, self.flat = values, owner[order], flat[order]

    def __call__(self, i: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.flat, self.values[i]), np.searchsorted(self.flat, self.values[i], side="right")
        n = hi - lo
        at = np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)
        return np.bincount(self.owner[at], minlength=len(self.values))


def links_beyond(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) between texts of one leader that join roots, by exact similarity; ``rows`` are those of ``compared`` with their root."""
    up, down = share

    def run(batches):
        got = _read(batches, ["a", "b", "n", "m", "lacks", "root", "lead", "own", "inner"])
        if got is None:
            return
        a, node, n, m, root, lead = (got[i].to_numpy() for i in (0, 1, 2, 3, 5, 6))
        lacks = got[4].to_numpy().astype(bool)
        (own, own_at), (inner, inner_at) = _lists(got[7]), _lists(got[8])
        order = np.argsort(a, kind="stable")
        border = np.flatnonzero(np.r_[True, a[order][1:] != a[order][:-1], True])
        for lo, hi in zip(border[:-1].tolist(), border[1:].tolist()):
            at = order[lo:hi]
            outside = _Common([own[own_at[i] : own_at[i + 1]] for i in at])
            inside = _Common([inner[inner_at[i] : inner_at[i + 1]] for i in at])
            size, k, lack, cls = n[at], np.diff(inner_at)[at], lacks[at], root[at].copy()
            u, v = [], []
            for x in np.flatnonzero(cls != lead[at]).tolist():
                c = inside(x)
                # inside the leader: both lists are of what is missing, or of what is there, or one of each
                met = np.where(lack, m[at] - k[x] - k + c, k - c) if lack[x] else np.where(lack, k[x] - c, c)
                met = met + outside(x)
                hits = (down * met >= up * (size[x] + size - met)) & (cls != cls[x])
                if hits.any():
                    found, first = np.unique(cls[hits], return_index=True)
                    u += [node[at[x]]] * len(found)
                    v += node[at[np.flatnonzero(hits)[first]]].tolist()
                    cls[np.isin(cls, found)] = cls[x]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["a", "b"])

    return rows.repartition(F.col("a")).mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """(node, text), one text for each of ``nodes``."""

    def run(batches):
        for batch in batches:
            data, offs = raw_text(batch.column("text"))
            found: list[int] = []
            for a, b in chunks(offs):
                # a shingle wider than any text: only the words are joined and hashed
                found += [_node(w) for w, _ in shingle_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], 1 << 40, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column("text")], names=["node", "text"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "node long, text string")
    # the list grows with the documents: merged at every size, never broadcast
    return rows.join(nodes.hint("merge"), "node", "left_semi").dropDuplicates(["node"])


def compared(pairs: DataFrame, texts: DataFrame, share: tuple[int, int], width: int, seed: int) -> DataFrame:
    """(a, b, alike, n, m, lacks, own, inner) of the pairs (a, b): whether the shingle sets' exact similarity is at least ``share``, a fraction,
    the sizes of b and a, the shingles that b has outside a, and those of a that b lacks or, if they are fewer, has. Hot leaders are dealt out."""
    up, down = share

    def shingles(batch, name):
        data, offs = raw_text(batch.column(name))
        out = []
        for a, b in chunks(offs):
            out += [np.unique(np.array(h, np.uint64)) for _, h in shingle_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], width, seed)]
        return out

    def run(batches):
        for batch in batches:
            alike, lacks, own, inner = [], [], [], []
            x, y = shingles(batch, "ta"), shingles(batch, "tb")
            for s, t in zip(x, y):
                out, met = np.setdiff1d(t, s, assume_unique=True), np.intersect1d(s, t, assume_unique=True)
                alike.append(down * len(met) >= up * (len(s) + len(out)))
                lacks.append(len(s) - len(met) <= len(met))
                own.append(out)
                inner.append(np.setdiff1d(s, met, assume_unique=True) if lacks[-1] else met)
            sizes = [pa.array([len(t) for t in z], pa.int64()) for z in (y, x)]
            columns = [batch.column("a"), batch.column("b"), pa.array(alike, pa.bool_()), *sizes, pa.array(lacks, pa.bool_()), _list_array(own), _list_array(inner)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "alike", "n", "m", "lacks", "own", "inner"])

    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = pairs.select("a", "salt").distinct().join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    return right.join(left.hint("merge"), ["a", "salt"]).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, alike boolean, n long, m long, lacks boolean, own array<long>, inner array<long>")


def near_copies(docs: DataFrame, share: tuple[int, int] = (4, 5), width: int = 5, seed: int = 42, id_col: str = "doc_id", text: str = "text", budget: int = 4) -> DataFrame:
    """doc_id, h, node, component_id (the smallest id of the class) and first (the class's first row) of every row; classes are united by verified links only."""
    rows = materialize(sketches(docs, width, seed, id_col, text), "near-sketches")
    distinct = rows.groupBy("node").agg(first_row().alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    distinct = materialize(distinct, "near-distinct")
    prints = classes_of(distinct.select("fp").distinct(), budget).select(F.col("fp").alias("f1"), F.xxhash64("root", F.lit("simhash")).alias("key"))
    named = distinct.join(prints, F.col("fp") == F.col("f1")).select("key", "node", F.col("node").alias("root"))
    named = named.unionByName(distinct.select(F.explode("keys").alias("key"), "node", F.col("node").alias("root")))
    pairs = materialize(members(named).distinct(), "near-pairs")
    known = distinct.select("node", "first", F.col("node").alias("root"))
    if not pairs.isEmpty():
        texts = materialize(texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), text), "near-texts")
        seen = materialize(compared(pairs, texts, share, width, seed), "near-compared")
        drop_scratch(texts)
        known = _united(known, seen.where("alike").select("a", "b"))
        roots = known.select("node", "root")
        rest = seen.select("a", "b").join(roots.select(F.col("node").alias("b"), "root").hint("merge"), "b")
        mixed = rest.groupBy("a").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("a")
        mixed = mixed.join(roots.select(F.col("node").alias("a"), F.col("root").alias("lead")).hint("merge"), "a")
        rest = seen.drop("alike").join(mixed.hint("merge"), "a").join(roots.select(F.col("node").alias("b"), "root").hint("merge"), "b")
        known = _united(known, materialize(links_beyond(rest, share), "near-links"))
    lowest = known.groupBy("root").agg(F.min("first").alias("least"))
    named = materialize(known.join(lowest, "root").select(F.col("node").alias("n2"), "least"), "near-named")
    return rows.select("doc_id", "h", "node").join(named, F.col("node") == F.col("n2"), "left").select("doc_id", "h", "node", F.col("least.id").alias("component_id"), F.col("least").alias("first"))


def _united(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (node, first, root) with the classes that ``links`` (a, b) join under one root."""
    roots = known.select("node", "root")
    between = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")).hint("merge"), "a")
    between = between.join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")).hint("merge"), "b")
    classes = components(between.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("n1"), F.col("root").alias("r1"))
    return materialize(known.join(classes, F.col("root") == F.col("n1"), "left").select("node", "first", F.coalesce("r1", "root").alias("root")), "near-roots")


def keep_first_copy(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The document with the smallest id of each class of near copies stays; one without an id only where its class has none."""
    return first_of_classes(docs, near_copies(docs, id_col=id_col, **options), id_col, options.get("text", "text"))
