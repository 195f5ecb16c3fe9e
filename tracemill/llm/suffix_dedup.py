"""Exact substring deduplication: a suffix sort over the places that can repeat.

Every byte that a ``window``-byte string covers which also starts earlier (smaller id, or same text and
earlier start) is removed. Matches do not cross texts and are judged on the input.

1. Anchors. Each window of a text has a minimizer: its gram of ``gram`` bytes with the least hash, the
   leftmost of equals. Equal windows have equal minimizers at equal offsets, so only windows that share a minimizer can be
   equal. Consecutive windows with the same minimizer form a run, known by its gram's hash and a hash of its whole stretch of text.
2. Runs meet by their gram. Of runs with the same stretch only the first can be new: the bytes of the others are
   compared with its bytes (in the map task, or where the texts meet), and those equal are removed whole. Where a gram begins in different
   stretches, the first run of each stretch is a candidate.
3. Suffix sort. The candidates' texts meet by gram. The suffixes at their windows are sorted among those that hold the gram at the same place,
   by their bytes, eight a round; only suffixes that still agree with another enter the next round. In a class that agrees on a whole
   window all but the first are removed.
4. The removed stretches return to their texts.

So every removal has been verified on bytes. Should the hashes of two unlike stretches ever agree, all is done again with another hash.

Hot grams: equal runs collapse in each map task already; grams that hold a large share of all runs (found on a sample;
the list is bounded by the number of partitions) are dealt by gram and stretch instead; the runs of a gram with many stretches are cut
into up to four pieces by the gram's place in the window and dealt by a hash of the stretch that a piece's windows share; and of a stretch
with many copies each block is compared with the first by itself. What crosses a shuffle are arrays of records, cut into a row for each
target without work for each; texts go to buckets of about ``bucket_bytes``, a task for each.

Ids are cast to long; a null id comes before all others. Rows with the same id are ordered by a hash of their text; equal rows are one
document and have the same result. A null text is empty; a very long text is scanned in pieces and makes a bucket of its own; an empty
table gives no rows; other columns, of whatever names, are not used.
"""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, extend, materialize, mix, raw_text, release_memory, small_batches

WINDOW, GRAM = 100, 20
#: Bytes of text whose runs a map task collects before it hands them on, and at most in one scan.
FLUSH_BYTES, SEGMENT = 6 << 20, 1 << 19
#: Stretches of one gram beyond which its runs are cut into pieces, and copies of one stretch that are compared in one block.
BLOCK_RUNS = 2000
#: Suffixes that a task sorts at a time (or those of one gram at one place, if more).
BLOCK_SUFFIXES = 1 << 17
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_tables: dict = {}


def _power_pair(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    up, down = _tables.get(int(base), (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    if len(up) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(int(base), -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        _tables[int(base)] = up, down
    return up[:n], down[:n]


class PrefixHashes:
    """Polynomial prefix hashes of a byte array: the hash of any stretch in constant time."""

    def __init__(self, data: np.ndarray, base: np.uint64 = _BASES[0]):
        n = len(data)
        up, down = _power_pair(base, n + 1)
        self.h = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[1:], out=self.h[1:])
        self.h *= up
        self.base = base

    def of(self, at: np.ndarray, length) -> np.ndarray:
        top = int(np.max(length, initial=0)) + 1
        pw = _power_pair(self.base, max(top, 2))[0]
        return self.h[at + length] - self.h[at] * pw[length]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs_of(data: np.ndarray, offs: np.ndarray, window: int, gram: int):
    """Runs of windows with one minimizer, over rows at ``offs``: row, start in the row, number of windows, gram hash, stretch hash, the gram's place in the run."""
    empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)]
    if len(data) < window:
        return empty
    width = window - gram + 1
    one, two = PrefixHashes(data), PrefixHashes(data, _BASES[1])
    hashes = mix(one.of(np.arange(len(data) - gram + 1), gram))
    low = np.uint64((1 << 21) - 1)
    # position in the low bits: of equal hashes the leftmost is least, in every copy of the window
    least = sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), width)
    inside = np.zeros(len(least) + 1, bool)
    size = np.diff(offs)
    for a, n in zip(offs[:-1][size >= window].tolist(), size[size >= window].tolist()):
        inside[a : a + n - window + 1] = True
    inside = inside[: len(least)]
    change = np.r_[True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])]
    change[offs[:-1][(offs[:-1] < len(least)) & (size > 0)]] = True
    first = np.flatnonzero(change)
    count = np.diff(np.r_[first, len(least)])
    keep = inside[first]
    first, count = first[keep], count[keep]
    row = np.searchsorted(offs, first, "right") - 1
    gram_at = (least[first] & low).astype(np.int64)
    grams = hashes[gram_at]
    stretch = mix(two.of(first, count + window - 1) + count.astype(np.uint64))
    return [row, first - offs[row], count, grams, stretch, gram_at - first]


def segments(offs: np.ndarray, window: int):
    """Rows cut to pieces of at most SEGMENT windows, each window in one piece: row, first byte, end byte."""
    row, a, b = [], [], []
    for r, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        at = lo
        while True:
            row.append(r), a.append(at), b.append(min(hi, at + SEGMENT + window - 1))
            at += SEGMENT
            if at + window > hi:
                break
    return np.array(row, np.int64), np.array(a, np.int64), np.array(b, np.int64)


def text_runs(data: np.ndarray, offs: np.ndarray, window: int, gram: int):
    """``runs_of`` over texts of any length, a bounded number of bytes at a time."""
    row, a, b = segments(offs, window)
    out, i = [], 0
    while i < len(row):
        j = i + 1
        while j < len(row) and b[j] - a[i] <= 2 * SEGMENT and a[j] >= b[j - 1]:
            j += 1
        # pieces i..j-1 are back to back
        rel = np.r_[a[i:j], b[j - 1]] - a[i]
        r, s, n, g, h, o = runs_of(data[a[i] : b[j - 1]], rel, window, gram)
        out.append([row[i + r], s + a[i + r] - offs[row[i + r]], n, g, h, o])
        i = j
    return [np.concatenate(c) for c in zip(*out)] if out else runs_of(data[:0], offs[:1], window, gram)


# What crosses a shuffle: one row for each kind and target, its records back to back, and the stretches of text they stand for. Rows are
# cut from sorted arrays without work for each, as their number is quadratic in that of the tasks.

_DOC = [("id", "<i8"), ("h", "<u8")]
RUNS = np.dtype([*_DOC, ("g", "<u8"), ("s", "<u8"), ("start", "<u4"), ("n", "<u4"), ("off", "<u4")])
GONE = np.dtype([*_DOC, ("start", "<u4"), ("n", "<u4")])
LOOK = np.dtype([*_DOC, ("g", "<u8"), ("start", "<u4"), ("n", "<u4"), ("off", "<u4"), ("many", "u1")])
SAME = np.dtype([*_DOC, ("g", "<u8"), ("start", "<u4"), ("n", "<u4"), ("lead", "u1")])
#: Bytes of text in one Arrow batch, about; a row is never cut.
BATCH_BYTES = 1 << 27


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that end at the given bytes of an array."""
    offs = np.r_[0, ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def stretches(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``size`` bytes at ``at``, back to back."""
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    i = 0
    while i < len(at):
        begin = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, begin + (1 << 20), "right")))
        n = size[i:j]
        out[begin : ends[j - 1]] = data[np.repeat(at[i:j] - (ends[i:j] - n - begin), n) + np.arange(int(ends[j - 1]) - begin)]
        i = j
    return out


def pack(kind: str, part: np.ndarray, dtype: np.dtype, cols: dict[str, np.ndarray], text: tuple | None = None):
    """Batches with a row for each part: the records that go there. ``text``: a byte array and each record's place and size in it."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    p = part[order]
    x = np.empty(len(order), dtype)
    for name in dtype.names:
        x[name] = cols[name][order]
    edge = np.flatnonzero(np.r_[True, p[1:] != p[:-1], True]) if len(p) else np.zeros(1, np.int64)
    weight = np.cumsum(text[2][order] + dtype.itemsize) if text else np.arange(1, len(p) + 1) * dtype.itemsize
    heavy, i = np.r_[0, weight][edge], 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(heavy, heavy[i] + BATCH_BYTES, "right")) - 1)
        a, b = int(edge[i]), int(edge[j])
        cols_ = [pa.array([kind] * (j - i), pa.string()), pa.array(p[edge[i:j]], pa.int32()), _binary(x[a:b], (edge[i + 1 : j + 1] - a) * dtype.itemsize)]
        if text:
            data, at, size = text
            size = size[order[a:b]]
            cols_.append(_binary(stretches(data, at[order[a:b]], size), np.cumsum(size)[edge[i + 1 : j + 1] - a - 1]))
        yield pa.RecordBatch.from_arrays(cols_, names=["kind", "key", "body", "text"][: len(cols_)])
        i = j


def _bytes(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8)
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8, int(offs[-1] - offs[0]), int(offs[0]))


def unpack(batches, **kinds: np.dtype) -> list[dict[str, np.ndarray]]:
    """The records of each kind as contiguous columns, with the bytes of their text (where there is any) as ``text``."""
    held = {kind: ([], []) for kind in kinds}
    for batch in batches:
        for kind, (records, texts) in held.items():
            some = batch.filter(pc.equal(batch.column("kind"), kind))
            if some.num_rows:
                records.append(_bytes(some.column("body")).view(kinds[kind]))
                if "text" in some.schema.names:
                    texts.append(_bytes(some.column("text")))
    out = []
    for kind, (records, texts) in held.items():
        cols = {k: np.concatenate([r[k] for r in records]) if records else np.zeros(0, kinds[kind][k]) for k in kinds[kind].names}
        records.clear()
        out.append(cols | {"text": np.concatenate(texts) if texts else np.zeros(0, np.uint8)})
        texts.clear()
    return out


def _bucket(ids: np.ndarray, hs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) * _BASES[1] + hs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _first_of_group(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins, along an order."""
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return new


def sort_suffixes(text: np.ndarray, at: np.ndarray, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Radix sort of the suffixes at ``at`` inside each group by their first ``window`` bytes, eight bytes a round.

    Only suffixes that still agree with another of their group enter the next round. Returns the order, and for each place in it
    whether the suffix agrees with the one before on the whole window.
    """
    width = min(8, window)
    if width < 8:
        text = np.r_[text, np.zeros(8, np.uint8)]
    words = np.ndarray((max(len(text) - 7, 0),), ">u8", np.ascontiguousarray(text), strides=(1,))
    order = np.argsort(group, kind="stable")
    same = np.zeros(len(order), bool)
    g = group[order]
    place, new = np.arange(len(order)), np.r_[True, g[1:] != g[:-1]][: len(order)]
    for depth in [*range(0, window - width, width), window - width]:
        # places of classes with more than one member, and the class of each
        tied = ~new | ~np.r_[new[1:], True][: len(new)]
        cls = np.cumsum(new[tied]) - 1
        place = place[tied]
        if len(place) == 0:
            return order, same
        cls = cls.astype(np.uint16) if cls[-1] < 1 << 16 else cls
        own = order[place]
        word = words[at[own] + depth].astype(np.uint64) >> np.uint64(64 - 8 * width)
        by = np.argsort(word)
        by = by[np.argsort(cls[by], kind="stable")]
        order[place] = own[by]
        word = word[by]
        # classes keep their places, so that cls itself is unchanged by the sort
        new = np.r_[True, (cls[1:] != cls[:-1]) | (word[1:] != word[:-1])]
    same[place] = ~new
    return order, same


def repeated(text: np.ndarray, at: np.ndarray, group: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """Whether an equal window of lesser rank exists in its group, for each window start."""
    order, same = sort_suffixes(text, at, group, window)
    out = np.zeros(len(order), bool)
    first = np.flatnonzero(~same)
    if len(first) < len(order):
        r = rank[order]
        out[order] = r != np.repeat(np.minimum.reduceat(r, first), np.diff(np.r_[first, len(order)]))
    return out


def pieces(data: np.ndarray, at: np.ndarray, n: np.ndarray, off: np.ndarray, g: np.ndarray, window: int, gram: int):
    """Runs cut by the place of their gram in the window: the run, its first window and number of windows, and a key that equal windows share.

    All windows of a piece hold the stretch that is common to such places, and the key is a hash of it. So runs of a
    gram part by most of a window's text, at about the cost in bytes of as many runs as there are pieces.
    """
    width = max(1, (window - gram + 1) // 3)
    low = (off - n + 1) // width
    many = off // width - low + 1
    own = np.repeat(np.arange(len(at)), many)
    k = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    first = off[own] - np.minimum(k * width + width - 1, off[own])
    count_ = off[own] - first - np.maximum(k * width, off[own] - n[own] + 1) + 1
    size = window - width + 1
    begin, power, hashes = at[own] + off[own] - k * width, _power_pair(_BASES[0], size)[0], np.zeros(len(own), np.uint64)
    for a in range(0, len(own), 1 << 14):
        common = data[begin[a : a + (1 << 14)][:, None] + np.arange(size)]
        hashes[a : a + (1 << 14)] = ((common.astype(np.uint64) + np.uint64(1)) * power).sum(1)
    return own, first, count_, mix(mix(g[own] + k.astype(np.uint64) * _BASES[1] + np.uint64(1)) + hashes)


def differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of ``size`` bytes at a and at b are unlike, byte by byte."""
    out = np.zeros(len(a), bool)
    ends = np.cumsum(size)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 22), "right")))
        n = size[i:j]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        out[i:j] = np.logical_or.reduceat(data[np.repeat(a[i:j], n) + step] != data[np.repeat(b[i:j], n) + step], first)
        i = j
    return out


def strong_hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of a cryptographic digest of each stretch: for texts made to defeat the polynomial hashes."""
    raw, key = data.tobytes(), seed.to_bytes(8, "little")
    return np.array([int.from_bytes(hashlib.blake2b(raw[i : i + n], digest_size=8, key=key).digest(), "little") for i, n in zip(at.tolist(), size.tolist())], np.uint64)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_bytes: int = 4 << 20, text: str = "text", id_col: str = "doc_id", digest: bool = False, stretch_bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, and the kept text or its digest) of every row.

    The kept bytes may split characters: ``kept`` is binary. ``stretch_bits`` weakens the first try's stretch hashes, for tests.
    """
    spark = docs.sparkSession
    small_batches(spark, 200)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("h"), body.alias("t"))
    size = rows.agg(F.sum(F.octet_length("t")).alias("b"), F.count("*").alias("n")).first()
    total = int(size["b"] or 0)
    buckets = max(8, -(-total // bucket_bytes))
    # by bytes too: an input of few large partitions
    parts = max(8, 2 * rows.rdd.getNumPartitions(), buckets // 4)
    heavy = _heavy_grams(rows, window, gram, parts)

    ddl = "kind string, key int, body binary"
    text_schema = pa.schema([("kind", pa.string()), ("key", pa.int32()), ("body", pa.binary()), ("text", pa.binary())])

    def collect(batches, seed):
        held, ids, hs, texts, n_docs, n_bytes = [], [], [], [], 0, 0

        def flush():
            doc, start, n, g, s, off = [np.concatenate(c) for c in zip(*held)]
            own, hash_ = np.concatenate(ids), np.concatenate(hs)
            data = np.concatenate([d for d, _ in texts])
            base = np.cumsum([0] + [len(d) for d, _ in texts[:-1]])
            at = np.concatenate([o[:-1] + b for (_, o), b in zip(texts, base)])[doc] + start
            if seed:
                s = strong_hashes(data, at, n + window - 1, seed)
            elif stretch_bits < 64:
                s = s & np.uint64((1 << stretch_bits) - 1)
            order = np.lexsort((start, hash_[doc], own[doc], s, g))
            order = order[_first_of_group(order, g, s, own[doc], hash_[doc], start)]  # equal rows are one document
            new = _first_of_group(order, g, s)
            # copies are verified on their bytes; one that only seems equal stays a run of its own
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
            same = ~new & (n[order] == n[lead])
            check = np.flatnonzero(same)
            same[check] = ~differ(data, at[order[check]], at[lead[check]], n[order[check]] + window - 1)
            # in the order of the texts
            first, copies = np.sort(order[~same]), np.sort(order[same])
            part = np.where(np.isin(g[first], heavy[0]), mix(g[first] ^ s[first]), g[first]) % np.uint64(parts)
            d = doc[first]
            yield from pack("runs", part, RUNS, {"id": own[d], "h": hash_[d], "g": g[first], "s": s[first], "start": start[first], "n": n[first], "off": off[first]})
            d = doc[copies]
            yield from pack("gone", _bucket(own[d], hash_[d], parts), GONE, {"id": own[d], "h": hash_[d], "start": start[copies], "n": n[copies]})
            release_memory()

        for batch in batches:
            data, offs = raw_text(batch.column("t"))
            r, s, n, g, h, o = text_runs(data, offs, window, gram)
            held.append([r + n_docs, s, n, g, h, o])
            ids.append(_ids(batch.column("doc_id")))
            hs.append(batch.column("h").to_numpy().view(np.uint64))
            texts.append((data, offs))
            n_docs, n_bytes = n_docs + batch.num_rows, n_bytes + len(data)
            if n_bytes >= FLUSH_BYTES:
                yield from flush()
                held, ids, hs, texts, n_docs, n_bytes = [], [], [], [], 0, 0
        if held:
            yield from flush()

    def meet(batches):
        x, gone = unpack(batches, runs=RUNS, gone=GONE)
        order = np.lexsort((x["start"], x["h"], x["id"], x["s"], x["g"]))
        order = order[_first_of_group(order, x["g"], x["s"], x["id"], x["h"], x["start"])]
        new = _first_of_group(order, x["g"], x["s"])
        first = order[new]
        # classes of one stretch: the copies in blocks, the first with each block
        members = np.diff(np.r_[np.flatnonzero(new), len(order)])
        blocks = -(-(members - 1) // BLOCK_RUNS)
        copies = order[~new]
        cls = (np.cumsum(new) - 1)[~new]
        in_block = (mix(x["id"][copies].astype(np.uint64) * _BASES[1] + x["h"][copies] + x["start"][copies]) % np.maximum(blocks[cls], 1).astype(np.uint64)).astype(np.uint64)
        leads = np.repeat(first, blocks)
        of_lead = np.arange(len(leads)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        who = np.r_[leads, copies]
        sub = np.r_[of_lead.astype(np.uint64), in_block]
        meeting = mix(mix(x["s"][who] + x["g"][who] * _BASES[1]) + sub)
        is_lead = np.r_[np.ones(len(leads), np.uint8), np.zeros(len(copies), np.uint8)]
        fresh = _first_of_group(first, x["g"])
        stretches = np.diff(np.r_[np.flatnonzero(fresh), len(first)])
        of_run = np.repeat(stretches, stretches)
        # a heavy gram's stretches are spread over all parts; its share of the sample stands for their number
        at = np.minimum(np.searchsorted(heavy[0], x["g"][first]), len(heavy[0]) - 1)
        of_run = np.where(heavy[0][at] == x["g"][first], heavy[1][at], of_run) if len(heavy[0]) else of_run
        cand = first[of_run > 1]
        many = of_run[of_run > 1] > BLOCK_RUNS
        yield from pack("gone", _bucket(gone["id"], gone["h"], buckets), GONE, gone)
        y = {k: x[k][cand] for k in ("id", "h", "g", "start", "n", "off")}
        yield from pack("look", _bucket(y["id"], y["h"], buckets), LOOK, y | {"many": many})
        y = {k: x[k][who] for k in ("id", "h", "start", "n")}
        yield from pack("same", _bucket(y["id"], y["h"], buckets), SAME, y | {"g": meeting, "lead": is_lead})

    def place(batches):
        for batch in batches:
            key = _bucket(_ids(batch.column("doc_id")), batch.column("h").to_numpy().view(np.uint64), buckets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.astype(np.int32))], names=[*batch.schema.names, "key"])

    placed = rows.mapInArrow(place, extend(rows.schema, "key int")).repartition(buckets, "key")

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        """The texts of candidate runs, dealt to blocks by gram (for a gram of many stretches in pieces), and of copies, by stretch."""
        x, y = unpack(right.to_batches(), look=LOOK, same=SAME)
        where, data, offs = _locate(left, y)
        at, size = offs[where] + y["start"].astype(np.int64), y["n"].astype(np.int64) + window - 1
        out = list(pack("same", (mix(y["g"]) % np.uint64(buckets)).astype(np.int64), SAME, y, (data, at, size)))
        where, data, offs = _locate(left, x)
        a, n, off = offs[where] + x["start"].astype(np.int64), x["n"].astype(np.int64), x["off"].astype(np.int64)
        one, many = np.flatnonzero(x["many"] == 0), np.flatnonzero(x["many"])
        own, first, count_, key = pieces(data, a[many], n[many], off[many], x["g"][many], window, gram)
        owner, first = np.r_[one, many[own]], np.r_[np.zeros(len(one), np.int64), first]
        count_, key = np.r_[n[one], count_], np.r_[x["g"][one], key]
        cols = {"id": x["id"][owner], "h": x["h"][owner], "g": key, "start": x["start"][owner] + first, "n": count_, "off": off[owner] - first, "many": x["many"][owner]}
        out += pack("look", (mix(key) % np.uint64(buckets)).astype(np.int64), LOOK, cols, (data, a[owner] + first, count_ + window - 1))
        return pa.Table.from_batches(out, text_schema)

    def removed(x, own, start, n):
        yield from pack("gone", _bucket(x["id"][own], x["h"][own], buckets), GONE, {"id": x["id"][own], "h": x["h"][own], "start": start, "n": n})

    def sort(batches):
        x, y = unpack(batches, look=LOOK, same=SAME)
        yield from compare(y, y.pop("text"))
        y.clear()
        yield from sort_blocks(x, x.pop("text"))

    def compare(x, data):
        """Copies against the first of their stretch, on the bytes."""
        n = x["n"].astype(np.int64)
        size = n + window - 1
        at = np.cumsum(size) - size
        order = np.lexsort((1 - x["lead"].astype(np.int8), x["g"]))
        new = _first_of_group(order, x["g"])
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        copy, lead = order[~new], lead[~new]
        clash = n[copy] != n[lead]
        fine = np.flatnonzero(~clash)
        clash[fine] = differ(data, at[copy[fine]], at[lead[fine]], size[copy[fine]])
        own = copy[~clash].astype(np.int64)
        yield from removed(x, own, x["start"][own], n[own])
        if clash.any():
            yield from pack("clash", np.zeros(1, np.int64), GONE, dict.fromkeys(GONE.names, np.zeros(1, np.int64)))

    def sort_blocks(x, data):
        n = x["n"].astype(np.int64)
        size = n + window - 1
        lo = np.cumsum(size) - size
        off = x["off"].astype(np.int64)
        order = np.lexsort((x["h"], x["id"]))
        doc = np.empty(len(order), np.int64)
        doc[order] = np.cumsum(_first_of_group(order, x["id"], x["h"]))
        by_gram = np.argsort(x["g"], kind="stable")
        cum, i = np.cumsum(n[by_gram]), 0
        edge = np.flatnonzero(np.r_[_first_of_group(by_gram, x["g"]), True])
        # blocks of whole grams, so that a task sorts a bounded number of suffixes at a time
        while i < len(by_gram):
            reach = np.searchsorted(cum, (cum[i - 1] if i else 0) + BLOCK_SUFFIXES)
            j = int(edge[max(np.searchsorted(edge, reach, "right") - 1, np.searchsorted(edge, i, "right"))])
            span = by_gram[i:j]
            # equal windows hold their gram at the same place: a gram too large for a block is sorted some places at a time
            step = window if cum[j - 1] - (cum[i - 1] if i else 0) <= BLOCK_SUFFIXES else max(1, BLOCK_SUFFIXES // len(span))
            group = _dense(x["g"][span]) * window
            for least in range(0, window, step):
                first = np.maximum(off[span] - (least + step - 1), 0)
                some = np.maximum(np.minimum(n[span] - 1, off[span] - least) - first + 1, 0)
                own = np.repeat(span, some)
                w = np.arange(len(own)) - np.repeat(np.cumsum(some) - some - first, some)
                start = x["start"][own] + w
                gone = repeated(data, lo[own] + w, np.repeat(group, some) + off[own] - w, doc[own] << 32 | start, window)
                yield from removed(x, own[gone], start[gone], np.ones(int(gone.sum()), np.uint32))
            i = j
        release_memory()

    for seed in count():
        runs = rows.mapInArrow(partial(collect, seed=seed), ddl)
        met = materialize(runs.repartition(parts, "key").mapInArrow(meet, ddl), "suffix-runs")
        blocks = placed.groupBy("key").cogroup(met.where("kind <> 'gone'").groupBy("key")).applyInArrow(fetch, ddl + ", text binary")
        late = materialize(blocks.repartition(buckets, "key").mapInArrow(sort, ddl), "suffix-late")
        if late.where("kind = 'clash'").isEmpty():
            break
        drop_scratch(met, late)
    gone = met.where("kind = 'gone'").select("kind", "key", "body").unionByName(late.select("kind", "key", "body"))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        (x,) = unpack(right.to_batches(), gone=GONE)
        where, data, offs = _locate(left, x)
        a = offs[where] + x["start"].astype(np.int64)
        cover = np.zeros(len(data) + 1, np.int32)
        np.add.at(cover, a, 1)
        np.add.at(cover, a + x["n"].astype(np.int64) + window - 1, -1)
        keep = np.cumsum(cover[:-1]) <= 0
        # equal rows are one document: what was found for one holds for the others
        twin = _twins(left)
        n, cut, spans, kept = np.diff(offs), [], [], []
        raw = data.tobytes()
        for r in range(left.num_rows):
            lo, hi = int(offs[twin[r]]), int(offs[twin[r] + 1])
            k = keep[lo:hi]
            gone_n = int(len(k) - k.sum())
            cut.append(gone_n)
            spans.append(int((~k & np.r_[True, k[:-1]]).sum()) if gone_n else 0)
            rest = data[lo:hi][k].tobytes() if gone_n else raw[lo:hi]
            kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
        cols = [left.column("doc_id").combine_chunks(), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())]
        return pa.Table.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept " + ("string" if digest else "binary")
    return placed.groupBy("key").cogroup(gone.groupBy("key")).applyInArrow(finish, out)


def _ids(column) -> np.ndarray:
    return column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64) if not isinstance(column, pa.ChunkedArray) else _ids(column.combine_chunks())


def _twins(left: pa.Table) -> np.ndarray:
    """For each row of a bucket the first row equal to it."""
    ids, hs = _ids(left.column("doc_id")), left.column("h").to_numpy()
    order = np.lexsort((np.arange(len(ids)), hs, ids))
    new = _first_of_group(order, ids, hs)
    out = np.empty(len(ids), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))] if len(ids) else order
    return out


def _locate(left: pa.Table, x: dict):
    """The row of a bucket's table that each packed entry refers to, and the bucket's bytes."""
    data, offs = raw_text(left.column("t"))
    ids, hs = _ids(left.column("doc_id")), left.column("h").to_numpy().view(np.uint64)
    if len(x["id"]) == 0:
        return np.zeros(0, np.int64), data, offs
    keys, mine = (mix(i.astype(np.uint64) * _BASES[1] + h) for i, h in ((ids, hs), (x["id"], x["h"])))
    order = np.argsort(keys, kind="stable")
    at = order[np.searchsorted(keys[order], mine)]
    for i in np.flatnonzero((ids[at] != x["id"]) | (hs[at] != x["h"])).tolist():  # keys of other rows collide
        at[i] = np.flatnonzero((ids == x["id"][i]) & (hs == x["h"][i]))[0]
    return at, data, offs


def _dense(g: np.ndarray) -> np.ndarray:
    """Group numbers of an array whose equals are adjacent."""
    return np.cumsum(np.r_[False, g[1:] != g[:-1]])


def _heavy_grams(rows: DataFrame, window: int, gram: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams (sorted) that seem to hold over a quarter of a part's share of all runs, from one document in 32, and their runs.

    At most 4 * parts of them. The list decides only how runs are dealt out; results do not depend on it.
    """

    def count(batches):
        held = []
        for batch in batches:
            data, offs = raw_text(batch.column("t"))
            _, _, _, g, _, _ = text_runs(data, offs, window, gram)
            held.append(g)
        if held:
            g, n = np.unique(np.concatenate(held), return_counts=True)
            some = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[g[some], np.uint64(0)].view(np.int64)), pa.array(np.r_[n[some], n.sum()]), pa.array(np.r_[np.zeros(int(some.sum()), bool), True])], names=["g", "n", "total"])

    sample = rows.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(32)) == 0).select("t")
    counts = sample.mapInArrow(count, "g long, n long, total boolean").groupBy("g", "total").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "suffix-heavy")
    total = counts.where("total").agg(F.sum("n")).first()[0] or 0
    least = max(8, total // (4 * parts))
    top = counts.where(~F.col("total") & (F.col("n") > least)).select("g", "n").orderBy(F.desc("n"), "g").limit(4 * parts).collect()
    g, n = np.array([r["g"] for r in top], np.int64).view(np.uint64), np.array([32 * r["n"] for r in top], np.int64)
    order = np.argsort(g)
    return g[order], n[order]
