"""Exact top-k inner products by norm-bucketed retrieval.

The candidates of the whole table are grouped by length: classes of a factor of 2^(1/8), longest first, cut or united to blocks
of bounded size. Queries meet the blocks in rounds: the longest block, then the next ones, each round several times as many. What a query has
found is its score to beat from then on: it only meets blocks long enough to hold a better product, and its local cosine
threshold for a block follows from the block's length. Where that threshold is high, a candidate is dropped if its coordinate along the
query's largest one lies outside the range the threshold allows (coordinate pruning); otherwise candidates too short to reach it
are dropped (length pruning). Exact products are computed for the pairs that are left, and only those.

Components are taken as floor(scale * x) in double precision. Pruning compares upper bounds with a margin for rounding and only drops
what is strictly below the k-th score, so ties are kept and broken by the smaller id.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; vectors of
other lengths count as padded with zeros; rows with a null id take no part; a repeated candidate row counts
each time, a repeated query id once (its largest vector in array order); scores beyond 64 bits saturate; an empty table, or one
without queries, gives no rows; other columns, of whatever names, are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_scratch, materialize

#: Cosine above which coordinate pruning is tried.
COORDINATE_FROM = 0.3


def integer_vectors(table: DataFrame, id_col: str, vec: str, scale: float) -> DataFrame:
    """(id, v) of the vectors that take part, components as whole doubles."""
    v = F.transform(F.col(vec), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    fine = F.col(id_col).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor() of a double is a long in Spark; beyond its range the plain product is whole already
    wide = F.transform(F.col(vec), lambda x: x.cast("double") * F.lit(float(scale)))
    big = F.exists(wide, lambda x: F.abs(x) >= F.lit(9e15))
    return table.where(fine).select(F.col(id_col).alias("id"), F.when(big, wide).otherwise(v).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column, padded with zeros to the longest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(column.offsets.to_numpy())
    width = int(size.max()) if len(size) else 0
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole products; doubles hold them exactly while no partial sum passes 2^53."""
    if len(q) == 0 or len(c) == 0 or np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(q).dot(whole(c).T), -(2**63), 2**63 - 1).astype(np.int64)


def block_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, bucket: int = 512, least: np.ndarray | None = None, counted: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k candidates of a block for each query, those below ``least`` (a score to beat for each query) left out:
    (query index, candidate id, score). ``counted`` gets the number of products computed."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, c))
    c_len, q_len = np.sqrt((c * c).sum(1)), np.sqrt((q * q).sum(1))
    order = np.lexsort((c_ids, -c_len))
    c, c_ids, c_len = c[order], c_ids[order], c_len[order]
    unit = c / np.maximum(c_len, 1e-300)[:, None]
    q_unit = q / np.maximum(q_len, 1e-300)[:, None]
    focus = np.abs(q_unit).argmax(1)
    lowest, none = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    least = np.full(len(q), -np.inf) if least is None else least
    top_s, top_i = np.full((len(q), k), lowest), np.full((len(q), k), none)
    slack, products = 1e-9, 0
    for a in range(0, len(c), bucket):
        b = min(a + bucket, len(c))
        longest = c_len[a]
        own = top_s[:, -1]
        need = np.maximum(least, np.where(own > lowest, own.astype(np.float64), -np.inf))  # a score below it cannot enter
        live = np.flatnonzero(need <= q_len * longest * (1 + slack) + slack)
        if len(live) == 0:
            if (need >= 0).all():
                break  # later buckets are shorter still
            continue
        keep = np.ones((len(live), b - a), bool)
        pruned = need[live] > 0
        cosine = np.clip(need[live] / np.maximum(q_len[live] * longest, 1e-300), -1, 1)
        by_coord = pruned & (cosine >= COORDINATE_FROM)
        for i in np.flatnonzero(by_coord):
            x = q_unit[live[i], focus[live[i]]]
            t = cosine[i] * (1 - slack)
            spread = np.sqrt(max(0.0, 1 - x * x) * max(0.0, 1 - t * t))
            at = unit[a:b, focus[live[i]]]
            # a focus beyond the threshold leaves that end of the range open
            high = 1.0 if x > t else x * t + spread
            low = -1.0 if x < -t else x * t - spread
            keep[i] = (at <= high + 1e-9) & (at >= low - 1e-9)
        for i in np.flatnonzero(pruned & ~by_coord):
            short = need[live[i]] / max(q_len[live[i]], 1e-300) * (1 - slack) - slack
            keep[i, np.searchsorted(-c_len[a:b], -short, "right") :] = False
        scores = np.full(keep.shape, lowest)
        whole = np.flatnonzero(keep.all(1))
        if len(whole):
            scores[whole] = _exact(q[live[whole]], c[a:b])
        for i in np.flatnonzero(~keep.all(1) & keep.any(1)):
            cols = np.flatnonzero(keep[i])
            scores[i, cols] = _exact(q[live[i] : live[i] + 1], c[a:b][cols])[0]
        products += int(keep.sum())
        ids = np.broadcast_to(c_ids[a:b], scores.shape)
        off = ~keep | (ids == q_ids[live][:, None]) | (scores < least[live][:, None])
        s = np.concatenate([top_s[live], np.where(off, lowest, scores)], 1)
        i = np.concatenate([top_i[live], np.where(off, none, ids)], 1)
        best = np.lexsort((i, ~s), axis=1)[:, :k]  # ~s sorts from the largest without overflow
        top_s[live], top_i[live] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
    if counted is not None:
        counted.append(products)
    row, rank = np.nonzero(top_i != none)
    return row, top_i[row, rank], top_s[row, rank]


#: Length classes a factor of two apart, and the class of a vector of zeros.
FINE, ZERO = 8, -(1 << 20)


def length_class(length) -> Column:
    """The number of a length's class; 16 thousand classes cover all doubles."""
    return F.when(length > 0, F.floor(F.log2(length) * FINE)).otherwise(F.lit(ZERO)).cast("int")


def length_blocks(counts: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """(class, its first block, its number of blocks), longest first; classes share a block while it has room."""
    out, block, filled = [], 0, 0
    for cls, n in sorted(counts, reverse=True):
        if filled and filled + n > most:
            block, filled = block + 1, 0
        parts = max(1, -(-n // most))
        out.append((cls, block, parts))
        if parts > 1:
            block, filled = block + parts, 0
        else:
            filled += n
    return out


def top_k(table: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec: str = "embedding", query_block: int = 2048, candidate_block: int = 16384, growth: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query row, over all rows.

    A round's queries are dealt to blocks of bounded size by a hash; a block of queries and one of candidates meet once, in one task. The
    driver holds two numbers for each length class.
    """
    spark = table.sparkSession
    rows = integer_vectors(table, id_col, vec, scale).withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    rows = rows.select(F.col("id").cast("long").alias("id"), "v", "len", length_class(F.col("len")).alias("cls"))
    counts = [(r["cls"], r["n"]) for r in rows.groupBy("cls").agg(F.count("*").alias("n")).collect()]
    dealt = length_blocks(counts, candidate_block)
    n_blocks = max((first + parts for _, first, parts in dealt), default=0)
    classes = spark.createDataFrame(dealt, "b_cls int, first int, parts int")  # at most one row for each class
    cand = rows.join(F.broadcast(classes), F.col("cls") == F.col("b_cls")).select("id", "v", (F.col("first") + F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts"))).cast("int").alias("cb"))
    queries = materialize(rows.where(is_query(F.col("id"))).groupBy("id").agg(F.max(F.struct("v", "len")).alias("x")).select("id", "x.v", "x.len"), "topk-queries")
    # how many blocks a class of lengths and all longer ones take: what a query must meet that needs at least this length
    longest, shortest = max((c for c, _ in counts), default=0), min((c for c, _ in counts if c > ZERO), default=0)
    ends = {cls: first + parts for cls, first, parts in dealt}
    reach, at = [], 0  # for each class from the longest down, one entry a class; two powers of two are 16 of them
    for cls in range(longest, shortest - 1, -1):
        at = max(at, ends.get(cls, 0))
        reach.append(at)

    def upto(cls: Column) -> Column:
        place = F.lit(longest) - cls + 1
        return F.when(place < 1, 0).when(place > len(reach), n_blocks).otherwise(F.element_at(F.lit(reach or [0]), F.greatest(F.least(place, F.lit(max(1, len(reach)))), F.lit(1))))


    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            none = np.zeros(0, np.int64)
            return pa.table({"query_id": none, "vec_id": none, "score": none})
        q_ids = left.column("id").to_numpy()
        least = left.column("least").to_numpy(zero_copy_only=False)
        r, i, s = block_top(q_ids, _matrix(left.column("v")), right.column("id").to_numpy(), _matrix(right.column("v")), k, least=least)
        return pa.table({"query_id": q_ids[r], "vec_id": i, "score": s})

    kinds = "query_id long, vec_id long, score long"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    tops = spark.createDataFrame([], kinds + ", rank int")
    lo, hi = 0, min(1, n_blocks)
    while lo < n_blocks:
        beat = tops.where(F.col("rank") == k).select(F.col("query_id").alias("b_id"), F.col("score").alias("beat"))
        asked = queries.join(beat, F.col("id") == F.col("b_id"), "left").withColumn("least", F.coalesce(F.col("beat").cast("double") * (1 - 1e-12) - 1e-6, F.lit(float("-inf"))))
        # a length below which no product reaches the score, and its class; one class of margin for rounding
        needed = F.when((F.col("least") > 0) & (F.col("len") > 0), length_class(F.col("least") / F.col("len")) - 1).when(F.col("least") > 0, F.lit(longest + 1)).otherwise(F.lit(ZERO))
        asked = asked.withColumn("upto", upto(needed)).where(F.col("upto") > lo)
        live = materialize(asked.select("id", "v", "least", "upto"), "topk-live")
        blocks = max(1, -(-live.count() // query_block))
        if not live.isEmpty():
            q = live.withColumn("cb", F.explode(F.sequence(F.lit(lo), F.least(F.col("upto"), F.lit(hi)) - 1))).withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
            c = cand.where((F.col("cb") >= lo) & (F.col("cb") < hi)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            found = q.select("qb", "cb", "id", "v", "least").groupBy("qb", "cb").cogroup(c.select("qb", "cb", "id", "v").groupBy("qb", "cb")).applyInArrow(best, kinds)
            old, merged = tops, tops.drop("rank").unionByName(found).withColumn("rank", rank).where(F.col("rank") <= k)
            tops = materialize(merged, "topk-found") if hi < n_blocks else merged
            if hi < n_blocks:
                drop_scratch(old, live)
        lo, hi = hi, min(n_blocks, max(hi * growth, hi + 1))
    return tops.select("query_id", "rank", "vec_id", "score")
