"""Best-fit packing of tokenised documents into fixed-length sequences, by hierarchical residual packing.

Each task tokenises its documents, cuts longer ones into pieces of ``capacity`` tokens and packs its own
pieces by best fit, longest first; only (id, lengths, checksum) leave the task, never the tokens. Bins that are nearly full
are final. The underfull ones are items of the next level: neighbouring tasks' bins are united in groups of
``fan_in`` and packed by best fit again, and so on up the tree, until one group is left. Best fit leaves a group at most one
bin that is half full or less, and only such a bin can still move into another. So a level moves at most ``fan_in`` bins a group, and
of the fuller ones the ``HOSTS`` with the most room go on as hosts: more than all levels together can fill. So no bin that
fits into another is left alone, and yet no task sees more than ``fan_in * (HOSTS + 1)`` bins, however many documents there are.

Defined cases: a null or empty text is one piece holding just the end token; a very long text is cut into full pieces; repeated rows
are packed once each, rows that share an id are told apart by ``text_hash``; a null id is kept; an empty table gives no rows; input
columns other than the id and the text are not used.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .simhash import text_hash

#: Distinct words whose ids a worker keeps; beyond it the memory starts anew (the results are the same).
CACHE_WORDS = 900_000
#: Bins over half full that a group hands on; ``fan_in`` for each of 64 levels would do.
HOSTS = 512

_MARKS = b"!\"#$%&'()*+,-./:;=?@[]^_{}~"
_BYTE_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_tokenizers: dict = {}


class WordIds(dict):
    """The ids, as little-endian 32-bit bytes, of each white-space-delimited stretch of text.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its stretches in
    order. Nor does it join an ASCII letter with the marks behind it: a stretch's last run of marks is kept apart.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism; threads would only spin
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: bytes) -> bytes:
        stem = stem_of(word)
        if len(stem) < len(word):
            out = self[stem] + self[word[len(stem) :]]
        else:
            out = _bytes(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        self[word] = out
        return out

    def learn(self, words: set) -> None:
        """Tokenise the words not known yet in one call."""
        if len(self) > CACHE_WORDS:
            self.clear()
        stems = {stem_of(w) for w in words if w not in self}
        new = [w for w in stems if w not in self]
        for w, e in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
            self[w] = _bytes(e.ids)


def stem_of(word: bytes) -> bytes:
    """The word without its last run of marks where an ASCII letter stands before it; bars and angles may be special tokens'."""
    stem = word.rstrip(_MARKS)
    return stem if stem and 97 <= stem[-1] <= 122 else word


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def split_words(text: str | None) -> list[bytes]:
    """White-space-delimited stretches, ASCII letters lowered where that cannot change the ids.

    Combining marks (first bytes CC and CD) and special-token brackets keep their letters' case.
    """
    raw = (text or "").encode()
    if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
        raw = raw.translate(_BYTE_LOWER)
    return raw.split()


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, longest first, each into the fullest bin that has room; the number of bins."""
    bins, offsets, n = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where some bin has exactly r places left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, n


_PIECES = "doc_id {id}, text_hash long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, part int"


def tokenize_and_pack(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text: str) -> DataFrame:
    """One row per piece, with its place in a bin of its own task."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(text).alias("h"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        cache, ids, parts = word_ids(tokenizer_path), [], []
        for batch in batches:
            split = [split_words(t) for t in batch.column("text").to_pylist()]
            cache.learn(set().union(*split))
            ids.append(batch.select(["doc_id", "h"]))
            for words in split:
                tokens = b"".join(map(cache.__getitem__, words)) + end
                parts.append([(len(tokens[a : a + 4 * capacity]) // 4, zlib.crc32(tokens[a : a + 4 * capacity])) for a in range(0, len(tokens), 4 * capacity)])
        if not parts:
            return
        counts = np.array([len(p) for p in parts])
        row = np.repeat(np.arange(len(parts)), counts)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        length = np.array([x[0] for p in parts for x in p], np.int64)
        crc = np.array([x[1] for p in parts for x in p], np.int64)
        bins, offset, n = best_fit(length, capacity)
        fill = np.bincount(bins, length, n).astype(np.int64)
        part = TaskContext.get().partitionId()
        keys = pa.Table.from_batches(ids).combine_chunks().take(pa.array(row)).combine_chunks()
        cols = [*(c.combine_chunks() for c in keys.columns), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crc), pa.array(bins + (part << 32)), pa.array(offset), pa.array(fill[bins]), pa.array(np.full(len(row), part, np.int32))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill", "part"])

    return rows.mapInArrow(run, _PIECES.format(id=kind))


def _merge_level(bins: DataFrame, fan_in: int, capacity: int, slack: int) -> DataFrame:
    """Best fit over the bins of ``fan_in`` neighbouring groups: (bin, root, shift, root's fill, group, whether it goes on)."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        fill = table.column("fill").to_numpy()
        names = table.column("bin").to_numpy()
        b, off, n = best_fit(fill, capacity)
        root = np.empty(n, np.int64)
        root[b[off == 0]] = names[off == 0]  # the bin that lies first gives its name and stays where it is
        total = np.bincount(b, fill, n).astype(np.int64)
        hosts = np.flatnonzero(total > capacity // 2)
        on = (total <= capacity // 2) & (total < capacity - slack)
        on[hosts[np.argsort(total[hosts], kind="stable")[:HOSTS]]] = True
        on &= total < capacity - slack
        return pa.table({"bin": names, "root": root[b], "shift": off, "fill": total[b], "part": table.column("part").to_numpy(), "on": on[b]})

    grouped = bins.withColumn("part", F.expr(f"part div {fan_in}").cast("long")).groupBy("part")
    return grouped.applyInArrow(merge, "bin long, root long, shift long, fill long, part long, on boolean")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, slack: int = 8, fan_in: int = 8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, text_hash, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(tokenize_and_pack(docs, tokenizer_path, capacity, end_id, id_col, text), "pack-pieces")
    top = pieces.agg(F.max("part")).first()[0] or 0
    bins = pieces.where((F.col("offset") == 0) & (F.col("fill") < capacity - slack)).select("bin", "fill", F.col("part").cast("long").alias("part"))
    moved = None
    while True:
        level = materialize(_merge_level(bins, fan_in, capacity, slack), "pack-level")
        step = level.where(F.col("bin") != F.col("root")).select("bin", "root", "shift")
        if moved is None:
            moved = step
        else:
            later = level.select(F.col("bin").alias("b2"), F.col("root").alias("r2"), F.col("shift").alias("s2"))
            carried = moved.join(later, F.col("root") == F.col("b2"), "left").select("bin", F.coalesce("r2", "root").alias("root"), (F.col("shift") + F.coalesce("s2", F.lit(0))).alias("shift"))
            moved = carried.unionByName(step)
        top //= fan_in
        if top == 0:
            break
        bins = level.where((F.col("bin") == F.col("root")) & F.col("on")).select("bin", "fill", "part")
    moved = moved.select(F.col("bin").alias("from_bin"), "root", "shift")
    placed = pieces.join(moved, F.col("bin") == F.col("from_bin"), "left")
    return placed.select("doc_id", "text_hash", "piece", "start", "length", "ids_crc32", F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed training sequences themselves: sequence_id and its token ids. Each group is one sequence, so bounded.

    A piece is known by its document's id and text, so rows that share an id keep their own tokens.
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(text).alias("text_hash"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        cache = word_ids(tokenizer_path)
        for batch in batches:
            out = ([], [], [], [])
            for doc, h, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))):
                words = split_words(t)
                cache.learn(set(words))
                tokens = np.frombuffer(b"".join(map(cache.__getitem__, words)) + end, "<u4").astype(np.int32)
                for k, a in enumerate(range(0, len(tokens), capacity)):
                    for column, value in zip(out, (doc, h, k, tokens[a : a + capacity])):
                        column.append(value)
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["d2", "h2", "p2", "ids"])

    pieces = rows.dropDuplicates(["doc_id", "text_hash"]).mapInArrow(cut, f"d2 {kind}, h2 long, p2 int, ids array<int>")
    joined = packed.join(pieces, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_hash") == F.col("h2")) & (F.col("piece") == F.col("p2")))
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
