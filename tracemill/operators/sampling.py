"""Level-balanced samples, shards, resuming and merging."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filtering import LEVELS

#: Rows of input order that are ranked together.
CHUNK = 1 << 20
#: Parts of a level that are ranked by themselves.
SALTS = 64


def picks(counts: dict[str, int], num_per_level: int, seed: int) -> list[tuple[str, int, int]]:
    """(level, rank in input order, place in the output) of a reproducible sample: at most num_per_level of each level.

    Drawing and shuffling depend on the counts alone, so positions stand for records. A level that is not
    larger than asked for is taken whole and draws nothing.
    """
    rng, chosen = random.Random(seed), []
    for level in LEVELS:
        n = counts.get(level, 0)
        chosen += [(level, r) for r in (range(n) if n <= num_per_level else rng.sample(range(n), num_per_level))]
    rng.shuffle(chosen)
    return [(level, rank, place) for place, (level, rank) in enumerate(chosen)]


def sample_by_level(df: DataFrame, num_per_level: int = 500, seed: int = 42, order: str = "idx", chunk: int = CHUNK, choose=None) -> DataFrame:
    """The sample with column ``out_pos``, its place. The driver holds at most 5 * num_per_level picks.

    ``choose`` maps the counts of the levels to other picks: (level, rank, place), each record once.

    Ranks come from counts of (level, chunk of the input order): only chunks that hold a pick are
    ranked, each by itself, so no level goes through one task.
    """
    part = F.floor(F.col(order) / chunk).cast("long")
    rows = df.where(F.col("level").isin(LEVELS)).withColumn("__chunk", part)
    counts = rows.groupBy(F.col("level").alias("__l"), F.col("__chunk").alias("__c")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__l").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    totals = {r["__l"]: r["n"] for r in counts.groupBy("__l").agg(F.sum("__n").alias("n")).collect()}
    chosen = df.sparkSession.createDataFrame(choose(totals) if choose else picks(totals, num_per_level, seed), "__pl string, __rank long, out_pos long")
    held = chosen.join(counts, (F.col("__pl") == F.col("__l")) & (F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__n")))
    held = held.select("__pl", F.col("__c").alias("__pc"), (F.col("__rank") - F.col("__before")).alias("__in"), "out_pos")
    ranked = rows.join(F.broadcast(held.select(F.col("__pl").alias("__kl"), F.col("__pc").alias("__kc")).distinct()), (F.col("level") == F.col("__kl")) & (F.col("__chunk") == F.col("__kc")), "left_semi")
    ranked = ranked.withColumn("__at", F.row_number().over(Window.partitionBy("level", "__chunk").orderBy(order)) - 1)
    hit = ranked.join(F.broadcast(held), (F.col("level") == F.col("__pl")) & (F.col("__chunk") == F.col("__pc")) & (F.col("__at") == F.col("__in")))
    return hit.select(*df.columns, "out_pos").orderBy("out_pos")


def sample_by_hash(df: DataFrame, num_per_level: int, seed: int, key: Column) -> DataFrame:
    """A seeded sample without draws on the driver: the records of each level with the least hash of key and seed.

    Each level is first cut down in SALTS parts, so no task ranks a whole level.
    """
    order = [F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), key]
    rows = df.where(F.col("level").isin(LEVELS)).withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    rows = rows.withColumn("level_rank", F.row_number().over(Window.partitionBy("level", "__salt").orderBy(*order))).where(F.col("level_rank") <= num_per_level)
    return rows.withColumn("level_rank", F.row_number().over(Window.partitionBy("level").orderBy(*order))).where(F.col("level_rank") <= num_per_level).drop("__salt")


def with_shard(df: DataFrame, num_shards: int, order: str = "idx", total: int | None = None) -> DataFrame:
    """Add shard_id: contiguous stretches of ceil(n / shards) rows of a dense 0-based order. Trailing shards may be empty."""
    total = df.count() if total is None else total
    size = max(1, -(-total // num_shards))
    return df.withColumn("shard_id", F.floor(F.col(order) / size).cast("int"))


def shard(df: DataFrame, shard_id: int, num_shards: int, order: str = "idx") -> DataFrame:
    return with_shard(df, num_shards, order).where(F.col("shard_id") == shard_id).drop("shard_id")


def not_done(df: DataFrame, done: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows whose key is not among those done; a null key is a key like any other."""
    ids = done.select(F.col(key).alias("__done")).distinct()
    return df.join(ids, F.col(key).eqNullSafe(F.col("__done")), "left_anti")


def merge_shards(shards: DataFrame, key: Column | None = None) -> DataFrame:
    """All shard rows by sample id (missing counts as 0), then file, then line."""
    key = F.coalesce(F.col("m")["sample_id"].try_cast("long"), F.lit(0)) if key is None else F.coalesce(key, F.lit(0))
    return shards.orderBy(key, "file", "idx")
