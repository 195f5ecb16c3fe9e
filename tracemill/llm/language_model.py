"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

1. Words: each task counts the hashes of its words; shards by hash range are summed and written as
   sorted hash arrays. A word's id is its place in their concatenation.
2. Grams of ``order`` words: each task counts its tuples of ids. A gram goes to the shard of its middle words, so a shard holds all
   grams of a context and all that extend the same shorter gram to the left. Middle words with more tokens than a
   quarter of a shard's share are split over several shards by the gram's first word. A shard is summed and written: the sorted
   hashes of its contexts, and for each context its words (sorted ids) with their counts.
3. Shorter orders: a gram's count is the number of different words before it. Each shard hands on its shorter grams with
   the words it saw before them, to be summed by the next order's shards, down to single words.

Shards hold ``per_shard`` tokens each, so tasks are alike at every size. Everything grows with the corpus but nothing is gathered: the
driver gets a few numbers a shard, and one for each context of two-word grams that is split. The scoring map opens the arrays by
memory map and looks up the distinct grams of a chunk in sorted order.

p(w|h) = (c(hw) - D(c))/c(h) + g(h) p(w|h'), with h' the context without its first word; the last is
q(w) = (n(w) - D'(n))/T + g'/(V+1), n the number of different words before w, T their sum and V the vocabulary. A context never seen
gives p(w|h'), an unseen word q = g'/(V+1). Texts begin with ``order - 1`` start symbols.

Words and contexts are told apart by 64-bit hashes. Defined cases: null and empty texts consist of the end token alone; very long texts
are read whole, each as one chunk; without any training row every token has probability 1/(V+1) = 1; repeated rows count each time;
a null id is the empty text for the fold; an empty table gives no rows. Columns other than id and text are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import NONSPACE, chunks, drop_scratch, extend, lower_ascii, materialize, mix, raw_text, scratch_path, small_batches, word_hashes, word_spans

#: Tokens that a counting task gathers before it hands on what it has counted.
FLUSH_TOKENS = 3_000_000
#: Tokens whose grams make a shard.
PER_SHARD = 3_000_000
#: Bytes of text that are scored at a time.
SCORE_BYTES = 4 << 20
#: Words of a context from which its sums are stored, not added up when asked for.
LONG = 16
END = np.uint64(0xE0D0E0D0E0D0E0D1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROWS = "kind string, shard int, body binary, n long, a long, b long, c long, d long"


def token_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row followed by its end token, and the first token of each row (rows + 1)."""
    data = lower_ascii(data)
    s, e, rows = word_spans(data, offs, NONSPACE)
    n = len(offs) - 1
    counts = np.bincount(rows, minlength=n)
    first = np.r_[0, np.cumsum(counts + 1)]
    out = np.full(int(first[-1]), END)
    out[np.arange(len(s)) + rows] = word_hashes(data, s, e)
    return out, first


def _row(kind, shard, body=b"", n=0, a=0, b=0, c=0, d=0):
    return kind, shard, body, n, a, b, c, d


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.binary(), *[pa.int64()] * 5]
    cols = list(zip(*rows)) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "shard", "body", "n", "a", "b", "c", "d"])


def _pack_counts(c: np.ndarray) -> bytes:
    """Counts as bytes; those of 255 and more follow in full."""
    small = np.minimum(c, 255).astype(np.uint8)
    return small.tobytes() + c[c >= 255].astype(np.uint64).tobytes()


def _unpack_counts(body: memoryview, n: int) -> tuple[np.ndarray, int]:
    c = np.frombuffer(body, np.uint8, n).astype(np.int64)
    big = np.flatnonzero(c == 255)
    c[big] = np.frombuffer(body, np.uint64, len(big), n).astype(np.int64)
    return c, n + 8 * len(big)


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Words:
    """Ids and counts of word hashes, from the sorted arrays."""

    def __init__(self, folder: str, bits: int, starts: np.ndarray):
        self.folder, self.bits, self.starts = folder, bits, starts

    def find(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: unseen) and count of each hash of a sorted array."""
        ids, counts = np.full(len(sorted_hashes), -1, np.int64), np.zeros(len(sorted_hashes), np.int64)
        shard = (sorted_hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(sorted_hashes), np.int64)
        for k in np.unique(shard).tolist():
            lo, hi = np.searchsorted(shard, [k, k + 1])
            keys = arrays.get(self.folder, f"words-{k}") if self.starts[k + 1] > self.starts[k] else np.zeros(0, np.uint64)
            if len(keys) == 0:
                continue
            at = np.minimum(np.searchsorted(keys, sorted_hashes[lo:hi]), len(keys) - 1)
            hit = keys[at] == sorted_hashes[lo:hi]
            ids[lo:hi][hit] = at[hit] + self.starts[k]
            counts[lo:hi][hit] = arrays.get(self.folder, f"counts-{k}")[at[hit]]
        return ids, counts


def tuple_hash(cols: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each tuple of ids."""
    h = np.full(len(cols[0]), _BASE)
    for c in cols:
        h = mix((h + c.astype(np.uint64) + np.uint64(1)) * _BASE)
    return h


class Splits:
    """The shard of each gram: that of its middle words (of two words, of the first), or one of several for frequent words."""

    def __init__(self, shards: int, hot_ids: np.ndarray, hot_parts: np.ndarray):
        self.shards, self.hot_ids, self.hot_parts = shards, hot_ids, hot_parts

    def parts(self, v: np.ndarray) -> np.ndarray:
        if len(self.hot_ids) == 0:
            return np.ones(len(v), np.int64)
        at = np.minimum(np.searchsorted(self.hot_ids, v), len(self.hot_ids) - 1)
        return np.where(self.hot_ids[at] == v, self.hot_parts[at], 1)

    def shard(self, cols: list[np.ndarray]) -> np.ndarray:
        middle, spread = (cols[1:-1], cols[0]) if len(cols) > 2 else (cols[:1], cols[-1])
        own = tuple_hash(middle) % np.uint64(self.shards)
        parts = self.parts(middle[0])
        for c in middle[1:]:
            parts = np.minimum(parts, self.parts(c))
        part = mix(spread.astype(np.uint64) + np.uint64(77)) % parts.astype(np.uint64)
        return ((own + part) % np.uint64(self.shards)).astype(np.int64)


def _pack_grams(cols: list[np.ndarray], counts: np.ndarray, wide) -> bytes:
    """Rows of grams: the ids byte by byte, so that like bytes stand together, then the counts; compressed."""
    planes = [c.astype(wide).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in cols]
    raw = b"".join(planes) + _pack_counts(counts)
    return np.array([len(counts), len(raw)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack_grams(bodies: list[bytes], k: int, wide) -> tuple[list[np.ndarray], np.ndarray]:
    cols, counts, step = [[] for _ in range(k)], [], np.dtype(wide).itemsize
    while bodies:
        body = bodies.pop()
        n, size = np.frombuffer(body, np.int64, 2).tolist()
        raw = memoryview(pa.decompress(body[16:], size, codec="zstd", asbytes=True))
        for i in range(k):
            plane = np.frombuffer(raw, np.uint8, n * step, i * n * step).reshape(step, n)
            cols[i].append(np.ascontiguousarray(plane.T).view(wide)[:, 0])
        counts.append(_unpack_counts(raw[k * n * step :], n)[0])
    return [np.concatenate(c) for c in cols], np.concatenate(counts)


def _gather_equal(cols: list[np.ndarray], counts: np.ndarray, lead: np.ndarray | None = None):
    """Distinct grams in sorted order with the sums of their counts; ``lead`` sorts before the columns but the last."""
    order = np.lexsort((cols[-1], lead) if lead is not None else cols[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in (lead, cols[-1]) if lead is not None else cols:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    total = np.add.reduceat(counts[order], first) if len(first) else counts
    return order[first], total


def _texts(batches, text):
    for batch in batches:
        data, offs = raw_text(batch.column(text))
        for a, b in chunks(offs):
            yield data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def _by_shard(batches):
    """The bodies of each shard of a task; a task has few shards, sorted by Spark."""
    shard, bodies = None, []
    for batch in batches:
        for s, body in zip(batch.column("shard").to_pylist(), batch.column("body").to_pylist()):
            if s != shard and bodies:
                yield shard, bodies
                bodies = []
            shard = s
            bodies.append(body)
    if bodies:
        yield shard, bodies


def _deal(rows: DataFrame, shards: int) -> DataFrame:
    return rows.select("shard", "body").repartition(shards, "shard").sortWithinPartitions("shard")


class Model:
    """Where the arrays are, and the few numbers that all workers need."""

    def __init__(self, folder, order, words, splits, vocabulary, tokens, hot, discounts, low_discounts, low_types, low_sum, span):
        self.folder, self.order, self.words, self.splits = folder, order, words, splits
        self.vocabulary, self.tokens = vocabulary, tokens
        self.hot, self.discounts, self.low_discounts, self.low_types, self.low_sum, self.span = hot, discounts, low_discounts, low_types, low_sum, span

    def low(self, ids: np.ndarray) -> np.ndarray:
        """q(w) of each id (-1: unseen)."""
        flat = 1.0 / (self.vocabulary + 1)
        if self.low_sum == 0:
            return np.full(len(ids), flat)
        n = np.zeros(len(ids), np.int64)
        order = np.argsort(ids, kind="stable")
        s = ids[order]
        cell = s // self.span
        for k in np.unique(cell[s >= 0]).tolist():
            lo, hi = np.searchsorted(s, [k * self.span, (k + 1) * self.span])
            n[order[lo:hi]] = arrays.get(self.folder, f"low-{k}")[s[lo:hi] - k * self.span]
        d = np.r_[0.0, self.low_discounts]
        left = sum(x * t for x, t in zip(self.low_discounts, self.low_types)) / self.low_sum
        return np.maximum(n - d[np.minimum(n, 3)], 0) / self.low_sum + left * flat

    def lookup(self, cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The count of each gram and, for its context, the sum of counts and the numbers of words counted once, twice and more."""
        k = len(cols)
        n = len(cols[0])
        count, stats = np.zeros(n, np.int64), np.zeros((n, 4), np.int64)
        known = np.flatnonzero(np.logical_and.reduce([c >= 0 for c in cols[:-1]]))
        if len(known) == 0 or not self.vocabulary:
            return count, stats
        cols = [c[known] for c in cols]
        # of a split two-word context an unknown word's shard does not matter: its sums come from ``hot``
        shard, h = self.splits.shard([*cols[:-1], np.maximum(cols[-1], 0)]), tuple_hash(cols[:-1])
        # by shard, and in it by the leading bits of the context's hash: sorted enough for searches, and one sort
        lead = max(1, self.splits.shards.bit_length())
        order = np.argsort((shard.astype(np.uint64) << np.uint64(64 - lead)) | (h >> np.uint64(lead)))
        shard, h, w = shard[order], h[order], cols[-1][order]
        for s in np.unique(shard).tolist():
            a, b = np.searchsorted(shard, [s, s + 1])
            count[known[order[a:b]]], stats[known[order[a:b]]] = self._in_shard(k, s, h[a:b], w[a:b])
        if k == 2:
            for i in np.flatnonzero(self.splits.parts(cols[0]) > 1).tolist():
                stats[known[i]] = self.hot.get(int(cols[0][i]), (0, 0, 0, 0))
        return count, stats

    def _in_shard(self, k: int, s: int, h: np.ndarray, w: np.ndarray):
        """Lookups in one shard, in the order of their contexts' hashes; a context that is looked up several times is mostly in one stretch."""
        get = lambda name: arrays.get(self.folder, f"{name}-{k}-{s}")
        keys, count, stats = get("contexts"), np.zeros(len(h), np.int64), np.zeros((len(h), 4), np.int64)
        if len(keys) == 0:
            return count, stats
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        found = np.flatnonzero(keys[at] == h)
        if len(found) == 0:
            return count, stats
        at, w = at[found], w[found]
        ends, words = get("ends"), get("next")
        lo, hi = ends[at].astype(np.int64), ends[at + 1].astype(np.int64)
        # the word's place among the context's words, by binary search in step
        i, j = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(i < j)
            if len(open_) == 0:
                break
            mid = (i[open_] + j[open_]) >> 1
            below = words[mid] < w[open_]
            i[open_] = np.where(below, mid + 1, i[open_])
            j[open_] = np.where(below, j[open_], mid)
        hit = np.flatnonzero(i < hi)
        hit = hit[words[i[hit]] == w[hit]]
        count[found[hit]] = self._counts_at(get, i[hit])
        # sums of each context, stored for long ones, added up for the others
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        size, own = (hi - lo)[new], np.zeros((len(new), 4), np.int64)
        long = np.flatnonzero(size > LONG)
        if len(long):
            own[long] = get("long-sums")[np.searchsorted(get("long-at"), at[new[long]])]
        short = np.flatnonzero(size <= LONG)
        if len(short):
            n = size[short]
            first = np.cumsum(n) - n
            c = self._counts_at(get, np.repeat(lo[new[short]] - first, n) + np.arange(int(n.sum())))
            own[short] = _sums(c, first)
        stats[found] = own[np.cumsum(np.r_[True, at[1:] != at[:-1]]) - 1]
        return count, stats

    @staticmethod
    def _counts_at(get, places: np.ndarray) -> np.ndarray:
        c = get("counts")[places].astype(np.int64)
        large = np.flatnonzero(c == 255)
        if len(large):
            c[large] = get("large")[np.searchsorted(get("large-at"), places[large])]
        return c

    def score_chunk(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per row: tokens, known tokens, base score, model score."""
        tokens, first = token_hashes(data, offs)
        uniq, inv = np.unique(tokens, return_inverse=True)
        found, counts = self.words.find(uniq)
        base = np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))
        # local word numbers; the start symbol, whose id is the vocabulary's size, is the last
        ids, start = np.r_[found, self.vocabulary], len(uniq)
        place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
        rank, p = inv, self.low(found)
        for k in range(2, self.order + 1):
            before = lambda j: np.where(place >= j, inv[np.maximum(np.arange(len(inv)) - j, 0)], start)
            code, at, back = np.unique(before(k - 1) * np.int64(len(p) + 1) + rank, return_index=True, return_inverse=True)
            cols = [ids[before(j)[at]] for j in range(k - 1, 0, -1)] + [ids[inv[at]]]
            c, stats = self.lookup(cols)
            p = p[rank[at]]
            seen = stats[:, 0] > 0
            d = np.r_[0.0, self.discounts[k]]
            c, stats = c[seen], stats[seen]
            p[seen] = (np.maximum(c - d[np.minimum(c, 3)], 0) + (stats[:, 1:] @ d[1:]) * p[seen]) / stats[:, 0]
            rank = back
        logs = np.log10(p)[rank]
        known = (found >= 0).astype(np.int64)[inv]
        at = first[:-1]
        return np.diff(first), np.add.reduceat(known, at), np.add.reduceat(base[inv], at), np.add.reduceat(logs, at)


def _sums(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each stretch: the sum of counts, and how many are one, two, and more."""
    return np.stack([np.add.reduceat(x, first) for x in (counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts >= 3).astype(np.int64))], 1)


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the counts of counts."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5
        out.append(float(min(max(d, 0.05 * k), k)) if k < 3 else float(min(max(d, 0.15), 3)))
    return out


def train(docs: DataFrame, text: str = "text", order: int = 3, per_shard: int = PER_SHARD) -> Model:
    """Count ``docs`` and write the model to the shared folder."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    small_batches(spark, 200)
    rows = docs.select(text)
    bits = max(3, (rows.rdd.getNumPartitions() - 1).bit_length())
    ranges = 1 << bits
    folder = scratch_path(spark, "lm")

    def count_words(batches):
        held, size = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted((keys >> np.uint64(64 - bits)).astype(np.int64), np.arange(ranges + 1))
            return _batch([_row("words", k, keys[a:b].tobytes() + _pack_counts(counts[a:b]), int(b - a)) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a])

        for data, offs in _texts(batches, text):
            tokens, first = token_hashes(data, offs)
            held.append(tokens)
            size += len(tokens)
            if size >= FLUSH_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def sum_words(batches):
        for shard, bodies in _by_shard(batches):
            keys, counts = [], []
            for body in bodies:
                # a body is n keys of eight bytes, n counts of one, and the large counts in full
                n = _body_rows(body)
                keys.append(np.frombuffer(body, np.uint64, n, 8))
                counts.append(_unpack_counts(memoryview(body)[8 + 8 * n :], n)[0])
            keys, counts = _sum_by(np.concatenate(keys), np.concatenate(counts))
            arrays.put(folder, f"words-{shard}", keys)
            arrays.put(folder, f"counts-{shard}", counts)
            top = np.flatnonzero(counts > per_shard // 4)
            ends = counts[keys == END]
            yield _batch([_row("words", shard, np.stack([top, counts[top]], 1).astype("<i8").tobytes(), len(keys), int(counts.sum()), int(ends.sum()))])

    first_pass = materialize(_deal(rows.mapInArrow(_with_length(count_words), _ROWS), ranges).mapInArrow(sum_words, _ROWS), "lm-words")
    sizes = np.zeros(ranges + 1, np.int64)
    tokens = documents = 0
    for r in first_pass.select("shard", "n", "a", "b").collect():
        sizes[r["shard"] + 1] = r["n"]
        tokens, documents = tokens + r["a"], documents + r["b"]
    starts = np.cumsum(sizes)
    vocabulary = int(starts[-1])
    words = Words(folder, bits, starts)
    shards = max(1, -(-tokens // per_shard))
    quarter = max(1, per_shard // 4)
    hot = {}
    for r in first_pass.select("shard", "body").toLocalIterator():
        for at, c in np.frombuffer(r["body"], "<i8").reshape(-1, 2).tolist():  # at most four a shard of grams
            hot[int(starts[r["shard"]]) + at] = -(-c // quarter)
    if documents > quarter:
        hot[vocabulary] = -(-documents // quarter)
    drop_scratch(first_pass)
    hot_ids = np.array(sorted(hot), np.int64)
    splits = Splits(shards, hot_ids, np.array([min(shards, hot[i]) for i in hot_ids.tolist()], np.int64))
    span = max(1, -(-(vocabulary + 1) // shards))
    wide = np.uint32 if vocabulary < 2**32 - 1 else np.uint64

    def dealt(kind: str, cols: list[np.ndarray], counts: np.ndarray) -> list[tuple]:
        """Sorted grams as rows for their shards."""
        shard = splits.shard(cols)
        by = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")  # grams stay sorted inside a shard
        s = shard[by]
        edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True]) if len(s) else np.zeros(1, np.int64)
        return [_row(kind, int(s[a]), _pack_grams([c[by[a:b]] for c in cols], counts[by[a:b]], wide)) for a, b in zip(edge[:-1], edge[1:])]

    def count_grams(batches):
        arrays.close_others(folder)
        held, size = [], 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*held)]
            # the middle word first, so that a shard's rows have runs of it
            lead = cols[1:-1] + [cols[0], cols[-1]]
            at, counts = _gather_equal(lead, np.ones(len(cols[0]), np.int64))
            return _batch(dealt("grams", [c[at] for c in cols], counts))

        for data, offs in _texts(batches, text):
            hashes, first = token_hashes(data, offs)
            uniq, inv = np.unique(hashes, return_inverse=True)
            ids = words.find(uniq)[0][inv].astype(wide)
            place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
            cols = [ids]
            for j in range(1, order):
                cols.insert(0, np.where(place >= j, np.r_[np.zeros(j, wide), ids[:-j]][: len(ids)], wide(vocabulary)))
            held.append(cols)
            size += len(ids)
            if size >= FLUSH_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def sum_grams(k: int):
        def run(batches):
            for shard, bodies in _by_shard(batches):
                put = lambda name, x: arrays.put(folder, f"{name}-{k}-{shard}", x)
                cols, counts = _unpack_grams(bodies, k, wide)
                h = tuple_hash(cols[:-1])
                at, counts = _gather_equal(cols, counts, h)
                cols, h = [c[at] for c in cols], h[at]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                ends = np.r_[first, len(h)]
                put("contexts", h[first])
                put("ends", ends.astype(np.uint32 if len(h) < 2**32 else np.int64))
                put("next", cols[-1])
                put("counts", np.minimum(counts, 255).astype(np.uint8))
                large = np.flatnonzero(counts >= 255)
                put("large-at", large)
                put("large", counts[large])
                sums = _sums(counts, first)
                long = np.flatnonzero(np.diff(ends) > LONG)
                put("long-at", long)
                put("long-sums", sums[long])
                out = [_row("sizes", shard, b"", len(h), *[int((counts == c).sum()) for c in (1, 2, 3, 4)])]
                if k > 2:
                    rest = cols[1:]
                    at, before = _gather_equal(rest[1:-1] + [rest[0], rest[-1]], np.ones(len(h), np.int64))
                    out += dealt("grams", [c[at] for c in rest], before)
                else:
                    split = np.flatnonzero(splits.parts(cols[0][first]) > 1)
                    out += [_row("hot", shard, b"", int(cols[0][first[i]]), *sums[i].tolist()) for i in split.tolist()]
                    w, n = np.unique(cols[-1].astype(np.int64), return_counts=True)
                    edge = np.flatnonzero(np.r_[True, (w[1:] // span) != (w[:-1] // span), True])
                    out += [_row("low", int(w[a] // span), np.array([b - a], np.int64).tobytes() + w[a:b].astype(wide).tobytes() + _pack_counts(n[a:b])) for a, b in zip(edge[:-1], edge[1:])]
                yield _batch(out)

        return run

    discounts, hot_sums, level = {}, {}, rows.mapInArrow(count_grams, _ROWS)
    for k in range(order, 1, -1):
        written = materialize(_deal(level, shards).mapInArrow(sum_grams(k), _ROWS), f"lm-{k}")
        drop_scratch(level)
        done = {r["shard"]: r for r in written.where("kind = 'sizes'").select("shard", "a", "b", "c", "d").collect()}
        discounts[k] = _discounts([sum(r[c] for r in done.values()) for c in "abcd"])
        if vocabulary:
            for s in set(range(shards)) - set(done):
                arrays.put(folder, f"contexts-{k}-{s}", np.zeros(0, np.uint64))
        if k == 2:
            hot_sums = {r["n"]: tuple(r[c] for c in "abcd") for r in written.where("kind = 'hot'").groupBy("n").agg(*[F.sum(c).alias(c) for c in "abcd"]).collect()}
        level = written.where("kind IN ('grams', 'low')")
        level.scratch = written.scratch

    def sum_low(batches):
        for shard, bodies in _by_shard(batches):
            total = np.zeros(span, np.int64)
            for body in bodies:
                view = memoryview(body)
                n = int(np.frombuffer(view, np.int64, 1)[0])
                w = np.frombuffer(view, wide, n, 8).astype(np.int64)
                total[w - shard * span] += _unpack_counts(view[8 + np.dtype(wide).itemsize * n :], n)[0]
            arrays.put(folder, f"low-{shard}", total.astype(np.uint32 if total.max() < 2**32 else np.int64))
            yield _batch([_row("low", shard, b"", int(total.sum()), *[int((total == k).sum()) for k in (1, 2, 3, 4)]), _row("most", shard, b"", int((total >= 3).sum()))])

    third = materialize(_deal(level, shards).mapInArrow(sum_low, _ROWS), "lm-low").select("kind", "shard", "n", "a", "b", "c", "d").collect()
    drop_scratch(level)
    lows = [r for r in third if r["kind"] == "low"]
    low_counts = [sum(r[k] for r in lows) for k in "abcd"]
    low_types = [low_counts[0], low_counts[1], sum(r["n"] for r in third if r["kind"] == "most")]
    if vocabulary:
        for k in set(range(shards)) - {r["shard"] for r in lows}:
            arrays.put(folder, f"low-{k}", np.zeros(span, np.uint32))
    return Model(folder, order, words, splits, vocabulary, tokens, hot_sums, discounts, _discounts(low_counts), low_types, sum(r["n"] for r in lows), span)


def _body_rows(body: bytes) -> int:
    return int(np.frombuffer(body, np.int64, 1)[0])


def _with_length(count):
    """Put the number of rows in front of each body."""

    def run(batches):
        for batch in count(batches):
            bodies = [np.array([n], np.int64).tobytes() + b for n, b in zip(batch.column("n").to_pylist(), batch.column("body").to_pylist())]
            yield batch.set_column(2, "body", pa.array(bodies, pa.binary()))

    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add n_tokens, n_known, base_score and score to every row: a narrow map over memory-mapped arrays."""
    spark = docs.sparkSession
    small_batches(spark, 200)
    base = docs.drop("n_tokens", "n_known", "base_score", "score")
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        arrays.close_others(m.folder)
        for batch in batches:
            data, offs = raw_text(batch.column(text))
            cols = [m.score_chunk(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in chunks(offs, SCORE_BYTES)]
            own = [np.concatenate(c) for c in zip(*cols)] if cols else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in own]], names=[*batch.schema.names, "n_tokens", "n_known", "base_score", "score"])

    return base.mapInArrow(run, extend(base.schema, "n_tokens long, n_known long, base_score double, score double"))
