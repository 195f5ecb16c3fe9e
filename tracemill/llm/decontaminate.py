"""Benchmark decontamination: word windows of the test items, hashed, looked up in every training text.

Words are runs of ASCII digits, ASCII letters (case folded) and non-ASCII characters. A window is
``n`` consecutive words of an item; an item of fewer words (but not none) is one shorter window. The sorted
hash array of the windows is broadcast; every hit is verified on the words' bytes before it counts, and each
document word inside a verified window is hit.

The benchmark is broadcast in blocks of at most ``block_bytes`` (four bytes a character and 64 an item; their arrays take about twice
that). Usually there is one, and the scan is a narrow map. Else blocks follow one another: the documents with what was found so far are
written, the block is dropped, the next one is sent out. So a worker's memory is bounded whatever the benchmark's size.

Defined cases: null and word-less texts have no words and are clean; a very long text is scanned whole; a null or word-less item has no
windows; repeated items each count by their id, items with a null id still mark words but are not listed;
repeated document rows are each judged; an empty benchmark leaves everything clean. Other columns of the
documents pass through ``decontaminate``; columns named like its outputs are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, chunks, extend, lower_ascii, materialize, mix, powers, raw_text, set_aside, small_batches, word_hashes, word_spans

#: Text of benchmark items that is broadcast at a time.
BLOCK_BYTES = 32 << 20


class WindowSet:
    """The windows of some items as numpy arrays, by window length: sorted hashes, the places of the words for verification, and items.

    For a window: eight bytes of hash, sixteen of places, eight and four an item; and the items' words once.
    """

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        self.n, self.items, self.lengths = n, [i for i, _ in items], {}
        data, offs = raw_text(pa.array([t for _, t in items], pa.string()))
        data = lower_ascii(data)
        s, e, rows = word_spans(data, offs, ALNUM)
        hashes = word_hashes(data, s, e)
        # all words joined by single spaces: a window's words are a slice
        size = e - s
        begin = np.cumsum(size + 1) - (size + 1)
        joined = np.full(int((size + 1).sum()), 32, np.uint8)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        joined[np.repeat(begin, size) + step] = data[np.repeat(s, size) + step]
        self.words = joined.tobytes()
        count = np.bincount(rows, minlength=len(items)) if len(rows) else np.zeros(len(items), np.int64)
        for m in sorted(set(np.minimum(count[count > 0], n).tolist())):
            at = np.flatnonzero((rows[: len(rows) - m + 1] == rows[m - 1 :]) & (np.minimum(count[rows[: len(rows) - m + 1]], n) == m))
            self.lengths[m] = self._table(window_hashes(hashes, m)[at], begin[at], begin[at + m - 1] + size[at + m - 1], rows[at])

    def _table(self, h, begin, end, item):
        order = np.lexsort((item, h))
        h, begin, end, item = h[order], begin[order], end[order], item[order]
        new = np.r_[True, h[1:] != h[:-1]]
        words = self.words
        # a window that shares its hash with the one before is the same one, unless its words differ: then the group is settled by words
        near = np.flatnonzero(~new)
        if any(words[begin[i] : end[i]] != words[begin[i - 1] : end[i - 1]] for i in near.tolist()):
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            order = np.array(sorted(range(len(h)), key=lambda i: (int(first[i]), words[begin[i] : end[i]], int(item[i]))))
            h, begin, end, item, first = h[order], begin[order], end[order], item[order], first[order]
            new = np.r_[True, [first[i] != first[i - 1] or words[begin[i] : end[i]] != words[begin[i - 1] : end[i - 1]] for i in range(1, len(h))]]
        window = np.cumsum(new) - 1
        fresh = new | np.r_[True, item[1:] != item[:-1]]
        ptr = np.searchsorted(window[fresh], np.arange(int(window[-1]) + 2))
        keys = h[new]
        # a 2^16-bit sieve on the hash's top bits spares most lookups
        sieve = np.zeros(1 << 16, bool)
        sieve[(keys >> np.uint64(48)).astype(np.int64)] = True
        return keys, sieve, begin[new], end[new], ptr, item[fresh].astype(np.int32)

    def nbytes(self) -> int:
        return len(self.words) + sum(x.nbytes for t in self.lengths.values() for x in t)


def window_hashes(words: np.ndarray, m: int) -> np.ndarray:
    """Hash of each run of m word hashes."""
    if len(words) < m:
        return np.zeros(0, np.uint64)
    pw = powers(m)
    out = np.zeros(len(words) - m + 1, np.uint64)
    for j in range(m):
        out += words[j : j + len(out)] * pw[j]
    return mix(out)


def scan_chunk(data: np.ndarray, offs: np.ndarray, windows: WindowSet):
    """Words (starts, ends, rows), the hit flag of each word, and per row the set of items that occur."""
    data = lower_ascii(data)
    s, e, rows = word_spans(data, offs, ALNUM)
    hashes = word_hashes(data, s, e)
    hit = np.zeros(len(s), bool)
    items: dict[int, set] = {}
    for m, (keys, sieve, begin, end, ptr, codes) in windows.lengths.items():
        if len(s) < m:
            continue
        h = window_hashes(hashes, m)
        ok = np.flatnonzero(sieve[(h >> np.uint64(48)).astype(np.int64)] & (rows[: len(h)] == rows[m - 1 :]))
        at = np.searchsorted(keys, h[ok])
        fine = keys[np.minimum(at, len(keys) - 1)] == h[ok]
        for i, w in zip(ok[fine].tolist(), at[fine].tolist()):
            words = b" ".join(data[a:b].tobytes() for a, b in zip(s[i : i + m].tolist(), e[i : i + m].tolist()))
            while w < len(keys) and keys[w] == h[i]:
                if windows.words[begin[w] : end[w]] == words:
                    hit[i : i + m] = True
                    items.setdefault(int(rows[i]), set()).update(windows.items[c] for c in codes[ptr[w] : ptr[w + 1]].tolist())
                    break
                w += 1
    return s, e, rows, hit, items


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """The items in blocks of bounded text, streamed to the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") * 4 + 64
        if size > block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def match_benchmark(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_words, hit_words (indices of hit words), hit_spans (byte ranges) and items to every row: a narrow map."""
    spark = docs.sparkSession
    small_batches(spark)
    found, blocks = docs.drop(*_OWN), _blocks(benchmark, item_id, item_text, block_bytes)
    block = next(blocks, [])
    while True:
        shared = spark.sparkContext.broadcast(WindowSet(block, n))
        found, block = _scan(found, shared, text), next(blocks, None)
        if block is None:
            return found
        # one block at a time: what it has found is written before the next one is sent out
        found = materialize(found, "decontaminate")
        shared.unpersist()


_OWN = ("n_words", "hit_words", "hit_spans", "items")


def _scan(docs: DataFrame, shared, text: str) -> DataFrame:
    """One block's hits, united with those that the rows have from blocks before."""
    later = "hit_words" in docs.columns
    rows = [c for c in docs.columns if c not in _OWN]
    schema = extend(docs.select(*rows).schema, "n_words long, hit_words array<int>, hit_spans array<struct<s:int,e:int>>, items array<string>")
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.list_(pa.string())]

    def scan(batches):
        for batch in batches:
            data, offs = raw_text(batch.column(text))
            before = [batch.column(c).to_pylist() for c in ("hit_words", "items")] if later else None
            n_words, words, spans, items = [], [], [], []
            for a, b in chunks(offs):
                s, e, rows_, hit, found = scan_chunk(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], shared.value)
                first = np.searchsorted(rows_, np.arange(b - a + 1))
                n_words += np.diff(first).tolist()
                for r in range(b - a):
                    lo, hi = int(first[r]), int(first[r + 1])
                    idx = np.flatnonzero(hit[lo:hi]) if r in found else np.zeros(0, np.int64)
                    named = {x for x in found.get(r, ()) if x is not None}
                    if later:
                        idx, named = np.union1d(idx, np.array(before[0][a + r], np.int64)).astype(np.int64), named | set(before[1][a + r])
                    words.append(idx.astype(np.int32))
                    spans.append(_runs(idx, s[lo:hi], e[lo:hi], int(offs[a + r] - offs[a])))
                    items.append(sorted(named))
            cols = [pa.array(x, k) for x, k in zip((n_words, words, spans, items), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rows), *cols], names=[*rows, *_OWN])

    return docs.mapInArrow(scan, schema)


def _runs(idx: np.ndarray, s: np.ndarray, e: np.ndarray, base: int) -> list:
    """Byte ranges, relative to the text, of the runs of consecutive hit words."""
    if len(idx) == 0:
        return []
    cut = np.flatnonzero(np.diff(idx) > 1)
    a, b = np.r_[0, cut + 1], np.r_[cut, len(idx) - 1]
    return [{"s": int(s[idx[i]]) - base, "e": int(e[idx[j]]) - base} for i, j in zip(a, b)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", n: int = 10, text: str = "text") -> DataFrame:
    """``documents``: drop contaminated rows. ``spans``: cut the hit words out of the text and keep the row."""
    rows, restore = set_aside(docs, ["n_words", "hit_words", "hit_spans", "items"])
    found = match_benchmark(rows, benchmark, n, text)
    if action == "documents":
        return restore(found.where(F.size("hit_words") == 0))
    if action != "spans":
        raise ValueError(f"unknown action {action!r}")
    schema = rows.schema

    def cut(batches):
        for batch in batches:
            texts = []
            for value, spans in zip(batch.column(text).to_pylist(), batch.column("hit_spans").to_pylist()):
                if spans:
                    raw, at, kept = value.encode(), 0, []
                    for x in spans:
                        kept.append(raw[at : x["s"]])
                        at = x["e"]
                    value = b"".join([*kept, raw[at:]]).decode()
                texts.append(value)
            cols = {c: batch.column(c) for c in schema.names} | {text: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return restore(found.mapInArrow(cut, schema))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
