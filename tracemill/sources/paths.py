"""Which file a path means. All checks go through Hadoop's file systems, so any store that Spark reads will do."""

from __future__ import annotations

import posixpath

from pyspark.sql import SparkSession

# File names that the stages write and look for.
DEFAULT_PARQUET = "train-00000-of-00001.parquet"
TRACE_PATTERNS = ["_cot.jsonl", ".jsonl"]
SHARD_GLOB = "greedy_compressed_shard*.jsonl"
COMPRESSED_NAME = "greedy_compressed.jsonl"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.jvm = jvm
        self.fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def is_file(self, p: str) -> bool:
        return self.exists(p) and self.fs.getFileStatus(self.path(p)).isFile()

    def is_dir(self, p: str) -> bool:
        return self.exists(p) and self.fs.getFileStatus(self.path(p)).isDirectory()

    def files(self, p: str, recursive: bool) -> list[str]:
        if not self.is_dir(p):
            return []
        it, out = self.fs.listFiles(self.path(p), recursive), []
        while it.hasNext():
            out.append(it.next().getPath().toString())
        return sorted(out)

    def delete(self, p: str) -> bool:
        return self.fs.delete(self.path(p), True)

    def rename(self, p: str, to: str) -> None:
        if not self.fs.rename(self.path(p), self.path(to)):
            raise OSError(f"cannot rename {p} to {to}")

    def join_files(self, parts: list[str], to: str, head: bytes = b"", tail: bytes = b"", cut: int = 0) -> None:
        """One file of the parts in their order, less the last ``cut`` bytes: streamed, so memory does not grow with them."""
        sizes = [(p, n) for p in parts if (n := self.fs.getFileStatus(self.path(p)).getLen())]
        out = self.fs.create(self.path(to), True)
        try:
            out.write(bytearray(head))
            for k, (p, n) in enumerate(sizes, 1):
                source = self.fs.open(self.path(p))
                try:
                    self.jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, n - cut if k == len(sizes) else n)
                finally:
                    source.close()
            out.write(bytearray(tail))
        finally:
            out.close()


def resolve_parquet(spark: SparkSession, path: str) -> str:
    """The file itself, the default file of its data folder, or the only Parquet file there."""
    store = Store(spark, path)
    if store.is_file(path):
        return path
    folder = posixpath.join(path, "data")
    usual = posixpath.join(folder, DEFAULT_PARQUET)
    if store.exists(usual):
        return usual
    found = [f for f in store.files(folder, False) if f.endswith(".parquet")]
    if not found:
        raise FileNotFoundError(f"no Parquet file under {folder}")
    if len(found) > 1:
        raise ValueError(f"several Parquet files under {folder}; name one")
    return found[0]


def resolve_traces(spark: SparkSession, path: str) -> str:
    """The file itself, or the only one of the folder tree that fits the first pattern with a hit. A folder of parts named like a file counts as one."""
    store = Store(spark, path)
    if store.is_file(path) or (store.is_dir(path) and path.rstrip("/").endswith(TRACE_PATTERNS[-1])):
        return path
    if not store.is_dir(path):
        raise FileNotFoundError(f"no such path: {path}")
    files = sorted({posixpath.dirname(f) if posixpath.dirname(f).endswith(TRACE_PATTERNS[-1]) else f for f in store.files(path, True)})
    for suffix in TRACE_PATTERNS:
        found = [f for f in files if f.endswith(suffix)]
        if len(found) == 1:
            return found[0]
        if found:
            raise ValueError(f"several candidate files under {path}; name one, such as {', '.join(found[:3])}")
    raise FileNotFoundError(f"no JSONL file under {path}")


def has_shards(spark: SparkSession, folder: str) -> bool:
    store = Store(spark, folder)
    return bool(store.fs.globStatus(store.path(posixpath.join(folder, SHARD_GLOB))))


def prepared_path(output: str, source: str) -> str:
    """Where prepared traces go: the output if it names a JSONL file, else a file in it named after the source."""
    if output.lower().endswith(".jsonl"):
        return output
    return posixpath.join(output, posixpath.splitext(posixpath.basename(source))[0] + "_prepared.jsonl")


def traces_path(base: str, model: str, dataset: str) -> str:
    return posixpath.join(base, model, f"{dataset}_cot.jsonl")


def demo_traces(model: str, small: str, large: str) -> str:
    """The bundled sample of a model by the size in its name."""
    if "1.5B" in model:
        return small
    if "7B" in model:
        return large
    raise ValueError(f"no sample for model {model!r}; name a data path")


def remove_stale_figures(spark: SparkSession, folder: str, confirm: bool = False) -> list[str]:
    """Figures of earlier runs in a folder; deleted only when confirmed."""
    store = Store(spark, folder)
    stale = [f for f in store.files(folder, False) if posixpath.basename(f) == "positions.json" or (posixpath.basename(f).startswith("region_stats_layer") and f.endswith(".png"))]
    if confirm:
        for f in stale:
            store.delete(f)
    return stale
