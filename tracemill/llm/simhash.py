"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary-trie self-join.

A fingerprint bit is set where over half of the text's shingle hashes (repeats included) have it set.
Equal fingerprints collapse first. The distinct ones are dealt by the value of ``same`` of ``blocks`` equal
parts of their bits: with at most ``budget = blocks - same`` differing bits, two fingerprints agree on some
choice of parts, so every link meets in some bucket. In a bucket the sorted fingerprints are a binary trie;
pairs of its nodes are traversed together, summing the bits in which their prefixes differ, and dropped as soon as the
sum exceeds the budget, or when both nodes lie wholly in one class already. A task hands on a spanning
star of each class it found, never its pairs, and the classes are united by distributed contraction.

Defined cases: a null text or one without words has fingerprint zero and links like any other; a very long text is read
whole, a bounded number of shingles at a time; repeated rows and copies share a fingerprint, and rows that share an id but not the
text are rows of their own; rows with a null id are fingerprinted, and never name a component unless
all its ids are null; an empty table gives no rows. Columns of the input other than id and text are unused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NONSPACE, chunks, drop_scratch, lower_ascii, materialize, raw_text, small_batches, word_spans
from .components import components, local_roots

#: Node pairs that a step of the traversal expands at a time; bounds a task's memory.
FRONTIER = 1 << 17
#: Fingerprints of one bucket that a task joins at a time.
DENSE = 1 << 20


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of each bit over unsigned 64-bit hashes, as a signed value; none: 0."""
    if len(hashes) == 0:
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    set_bits = np.flatnonzero(2 * ones > len(hashes))
    value = sum(1 << int(b) for b in set_bits)
    return value - (1 << 64) if value >> 63 else value


def shingle_hashes(data: np.ndarray, offs: np.ndarray, width: int, seed: int):
    """For each row, its words joined by single spaces (bytes) and the hash of every shingle, repeats included."""
    data = lower_ascii(data)
    s, e, rows = word_spans(data, offs, NONSPACE)
    # words joined by single spaces, all rows in one buffer; a shingle is a slice of it
    lens = e - s
    at = np.cumsum(lens + 1) - (lens + 1)
    joined = np.full(int((lens + 1).sum()), 32, np.uint8)
    if len(s):
        step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        joined[np.repeat(at, lens) + step] = data[np.repeat(s, lens) + step]
    buf, begin, end = memoryview(joined.tobytes()), at.tolist(), (at + lens).tolist()
    first = np.searchsorted(rows, np.arange(len(offs)))
    digest = xxhash.xxh64_intdigest
    for r in range(len(offs) - 1):
        lo, hi = int(first[r]), int(first[r + 1])
        n = hi - lo
        if n == 0:
            yield b"", []
            continue
        k = min(width, n)
        yield buf[begin[lo] : end[hi - 1]], [digest(buf[a:b], seed) for a, b in zip(begin[lo : hi - k + 1], end[lo + k - 1 : hi])]


def chunk_fingerprints(data: np.ndarray, offs: np.ndarray, width: int, seed: int) -> list[int]:
    """The fingerprint of each row's text."""
    return [fingerprint(np.array(h, np.uint64)) for _, h in shingle_hashes(data, offs, width, seed)]


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, fp) of every row, h a hash of the text; a narrow map."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(text).alias("h"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offs = raw_text(batch.column("text"))
            out: list[int] = []
            for a, b in chunks(offs):
                out += chunk_fingerprints(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], width, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(out, pa.int64())], names=["doc_id", "h", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, h long, fp long")


def _part_masks(blocks: int, same: int) -> list[int]:
    from itertools import combinations

    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(blocks)]
    return [sum(part[i] for i in c) for c in combinations(range(blocks), same)]


def trie_links(keys: np.ndarray, fps: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted fingerprints, and spanning links (indices) of the classes among those with equal keys.

    ``keys`` and ``fps`` are unsigned. The order by (key, fingerprint) is a forest of binary tries: a node is
    a range of rows that agree on the first bits.
    """
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    n = len(fps)
    root = np.arange(n)
    if n == 0:
        return order, root, root
    # neighbours in the order link first, so that dense groups are one class early and their pairs are pruned
    near = np.flatnonzero((keys[1:] == keys[:-1]) & (np.bitwise_count(fps[1:] ^ fps[:-1]) <= budget))
    root = local_roots(n, near, near + 1, root)
    border = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    lo, hi = border[:-1], border[1:]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    # a pair of nodes: (lo, hi) and (lo2, hi2), the depth in bits, the bits that differ so far
    stack = [(lo[i : i + FRONTIER], hi[i : i + FRONTIER], lo[i : i + FRONTIER], hi[i : i + FRONTIER], 0, np.zeros(len(lo[i : i + FRONTIER]), np.int8)) for i in range(0, len(lo), FRONTIER)]
    changes = None
    while stack:
        a, a2, b, b2, depth, errs = stack.pop()
        if changes is None:
            changes = np.r_[0, np.cumsum(root[1:] != root[:-1])]
        one = (changes[a2 - 1] == changes[a]) & (changes[b2 - 1] == changes[b]) & (root[a] == root[b])
        keep = ~one & (errs <= budget)
        a, a2, b, b2, errs = a[keep], a2[keep], b[keep], b2[keep], errs[keep]
        leaf = ((a2 - a == 1) & (b2 - b == 1)) | (depth == 64)
        x, y = a[leaf], b[leaf]
        near = np.bitwise_count(fps[x] ^ fps[y]) <= budget
        if near.any():
            root = local_roots(n, x[near], y[near], root)
            changes = None
        rest = ~leaf
        a, a2, b, b2, errs = a[rest], a2[rest], b[rest], b2[rest], errs[rest]
        if len(a) == 0:
            continue
        shift = np.uint64(63 - depth)
        am, bm = _split(fps, a, a2, shift), _split(fps, b, b2, shift)
        same = (a == b) & (a2 == b2)
        # children: 0-0, 1-1 keep the count; 0-1 and 1-0 add one (0-1 alone when a node meets itself)
        ca = np.concatenate([a, am, a, am])
        ca2 = np.concatenate([am, a2, am, a2])
        cb = np.concatenate([b, bm, bm, b])
        cb2 = np.concatenate([bm, b2, b2, bm])
        ce = np.concatenate([errs, errs, errs + 1, errs + 1])
        ok = (ca < ca2) & (cb < cb2) & (ce <= budget)
        ok[3 * len(a) :] &= ~same
        ok &= ~((ca == cb) & (ca2 == cb2) & (ca2 - ca == 1))
        ca, ca2, cb, cb2, ce = ca[ok], ca2[ok], cb[ok], cb2[ok], ce[ok]
        for i in range(0, len(ca), FRONTIER):
            j = i + FRONTIER
            stack.append((ca[i:j], ca2[i:j], cb[i:j], cb2[i:j], depth + 1, ce[i:j]))
    return order, np.arange(n), root


def _split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: np.uint64) -> np.ndarray:
    """The first row of each range whose bit is set (the range's end if none): a binary search in step."""
    lo, hi = lo.copy(), hi.copy()
    one = np.uint64(1)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        bit = ((fps[np.minimum(mid, len(fps) - 1)] >> shift) & one) == one
        hi = np.where(open_ & bit, mid, hi)
        lo = np.where(open_ & ~bit, mid + 1, lo)


def near_links(distinct: DataFrame, budget: int = 4, blocks: int = 6, dense: int = DENSE) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints ``fp`` at most ``budget`` bits apart.

    A bucket of more than ``dense`` fingerprints is dealt to sub-blocks, and each pair of sub-blocks is a bucket of its own.
    """
    masks = _part_masks(blocks, blocks - budget)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("v")) for i, m in enumerate(signed)])).alias("k"))
    dealt = dealt.select("fp", F.xxhash64("k.m", "k.v").alias("key"))
    crowded = materialize(dealt.groupBy(F.col("key").alias("ck")).agg(F.ceil(F.count("*") / F.lit(float(dense))).cast("int").alias("parts")).where("parts > 1"), "simhash-dense")
    if not crowded.isEmpty():
        own = F.pmod(F.xxhash64("fp", F.lit(9)), F.col("parts")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
        joined = dealt.join(crowded, F.col("key") == F.col("ck"), "left")
        split = joined.where("parts IS NOT NULL").withColumn("own", own).select("fp", "key", F.explode(pairs).alias("p")).select("fp", F.xxhash64("key", "p.i", "p.j").alias("key"))
        dealt = joined.where("parts IS NULL").select("fp", "key").unionByName(split)
    dealt = dealt.repartition(F.col("key"))

    def run(batches):
        keys, fps = [], []
        for batch in batches:
            keys.append(batch.column("key").to_numpy().view(np.uint64))
            fps.append(batch.column("fp").to_numpy().view(np.uint64))
        if not keys:
            return
        k, f = np.concatenate(keys), np.concatenate(fps)
        order, at, root = trie_links(k, f, budget)
        f = f[order].view(np.int64)
        linked = at != root
        pairs = np.unique(np.stack([f[at[linked]], f[root[linked]]], 1), axis=0) if linked.any() else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def classes_of(distinct: DataFrame, budget: int = 4) -> DataFrame:
    """``distinct`` with ``root``, one of the fingerprints that links of at most ``budget`` bits reach from ``fp``."""
    classes = components(near_links(distinct.select("fp"), budget))
    known = materialize(distinct.join(classes, F.col("fp") == F.col("node"), "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root")), "simhash-known")
    drop_scratch(classes)
    return known


def near_duplicates(docs: DataFrame, budget: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h, fp, component_id (the smallest id of the class) and first (the class's first row: smallest id, then text hash) of every row."""
    prints = materialize(fingerprints(docs, width, seed, id_col, text), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(first_row().alias("first")), "simhash-distinct")
    known = classes_of(distinct, budget)
    lowest = known.groupBy("root").agg(F.min("first").alias("least"))
    named = materialize(known.join(lowest, "root").select(F.col("fp").alias("f2"), "least"), "simhash-named")
    drop_scratch(distinct, known)
    return prints.join(named, F.col("fp") == F.col("f2"), "left").select("doc_id", "h", "fp", F.col("least.id").alias("component_id"), F.col("least").alias("first"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of each class of fingerprints stays: that of the smallest id (of rows that share it, the least text hash).

    Texts are not compared: unlike texts of near fingerprints, or those that a chain of links unites, go too. Where clean
    documents must stay, as in the pipeline, ``near_copies.keep_first_copy`` drops by verified similarity only.
    A null id comes after all others: such a row stays only where its class has no id.
    """
    return first_of_classes(docs, near_duplicates(docs, **options), options.get("id_col", "doc_id"), options.get("text", "text"))


def text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def first_row():
    """The least of a group's rows (doc_id, h): null ids last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col("h").alias("h")))


def first_of_classes(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that ``found`` (doc_id, h, first) names as the first of their class, known by id and text; of rows equal in both, one.

    Only if a named document has several rows are the texts dealt out to drop the repeats.
    """
    names = ["__keep_id", "__keep_h", "__keep_n"]
    named = found.where(F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h")))
    first = materialize(named.groupBy(F.col("doc_id").alias(names[0]), F.col("h").alias(names[1])).agg(F.count("*").alias(names[2])), "simhash-first")
    # the list grows with the documents: merged by key at every size, never broadcast
    keyed = docs.withColumn("__h", text_hash(text))
    kept = keyed.join(first.select(*names[:2]).hint("merge"), F.col(id_col).eqNullSafe(F.col(names[0])) & (F.col("__h") == F.col(names[1])), "left_semi")
    if not first.where(F.col(names[2]) > 1).isEmpty():
        kept = kept.dropDuplicates([id_col, "__h"])
    return kept.select(*docs.columns)
