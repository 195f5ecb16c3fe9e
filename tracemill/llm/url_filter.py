"""URL allow and block rules: a trie over reversed host labels and path segments, broadcast to the executors.

A rule ``(host, path)`` fits its host and every subdomain when the url's path starts with the rule's path.
Among fitting rules the one with most host labels wins, then the one with the longest path; of two equal
rules that disagree, ``block`` wins. Urls that no rule fits get the default verdict.

Defined cases: a null url, or one without ``://``, has an empty host and path, so only a rule with an empty
host can fit it. Very long urls are matched segment by segment as any other; an empty table gives no rows, an empty rule list the
default verdict everywhere. Repeated rows keep their multiplicity; other columns of the input pass through; a column
of the input named like an output (host, path, rule, verdict) is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extend

#: The trie is broadcast only up to this many bytes of rules; larger lists are joined by key instead.
MAX_TRIE_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class _Node:
    labels: dict = field(default_factory=dict)
    root: "_Path | None" = None


@dataclass
class _Path:
    segments: dict = field(default_factory=dict)
    #: tails of rules that end inside a segment, by their length, longest first
    tails: dict = field(default_factory=dict)


class UrlTrie:
    """Longest-match lookup of (host, path)."""

    def __init__(self, rules: list[Rule]):
        self.top = _Node()
        for rule in rules:
            node = self.top
            for label in reversed(rule.host.lower().split(".")) if rule.host else ():
                node = node.labels.setdefault(label, _Node())
            node.root = at = node.root or _Path()
            *whole, tail = rule.path.split("/")
            for segment in whole:
                at = at.segments.setdefault(segment, _Path())
            old = at.tails.get(tail)
            if old is None or old.verdict != "block":
                at.tails[tail] = rule
        self._sort(self.top)

    def _sort(self, node: _Node) -> None:
        hosts = [node]
        while hosts:
            node = hosts.pop()
            hosts += node.labels.values()
            paths = [node.root] if node.root else []
            while paths:
                p = paths.pop()
                p.tails = dict(sorted(p.tails.items(), key=lambda x: -len(x[0])))
                paths += p.segments.values()

    @staticmethod
    def _in_path(root: _Path, parts: list[str]) -> Rule | None:
        best, at, i = None, root, 0
        while at is not None:
            # what is left of the path begins with the next segment, then whatever follows it
            rest = parts[i] if i < len(parts) else None
            for tail, rule in at.tails.items():
                if rest is not None and rest.startswith(tail):
                    best = rule
                    break
            at = at.segments.get(rest) if rest is not None and i + 1 < len(parts) else None
            i += 1
        return best

    def match(self, host: str, path: str) -> Rule | None:
        parts, best, node = path.split("/"), None, self.top
        if node.root:
            best = self._in_path(node.root, parts)
        for label in reversed(host.split(".")) if host else ():
            node = node.labels.get(label)
            if node is None:
                break
            if node.root:
                best = self._in_path(node.root, parts) or best
        return best


def split_url(url: str = "url"):
    """Columns (host, path) of a url column."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.regexp_extract(u, r"(?s)\A.*?://(.*)\z", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url", max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """Add host, path, rule and verdict to each row; a narrow map, without a shuffle.

    The trie is broadcast when the rules' text is at most ``max_trie_bytes``; beyond it the rule list is a
    table, joined by key with the url's host suffixes and path prefixes.
    """
    spark = pages.sparkSession
    host, path = split_url(url)
    base = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    if sum(len(r.text) + 64 for r in rules) > max_trie_bytes:
        return _by_join(base, rules, default)
    shared = spark.sparkContext.broadcast(UrlTrie(rules))

    schema = extend(base.schema, "rule string, verdict string")

    def judge(batches):
        trie = shared.value
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            rule, verdict = [], []
            for h, p in zip(hosts, paths):
                hit = trie.match(h, p)
                rule.append(hit.text if hit else None)
                verdict.append(hit.verdict if hit else default)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return base.mapInArrow(judge, schema)


def _by_join(base: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same verdicts by equi-joins, for rule lists too large to broadcast."""
    spark = base.sparkSession
    table = spark.createDataFrame([(r.host.lower(), r.path, r.verdict, r.text) for r in rules] or [("", "\0", "", "")], "r_host string, r_path string, r_verdict string, r_rule string")
    lengths = sorted({len(r.path) for r in rules})
    keyed = base.withColumn("__row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.array_append(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")), F.lit(""))
    cand = keyed.select("__row", "path", F.explode(F.array_distinct(suffixes)).alias("r_host"))
    cand = cand.select("__row", "r_host", F.explode(F.array(*[F.lit(n) for n in lengths or [0]])).alias("n"), "path").where(F.length("path") >= F.col("n")).select("__row", "r_host", F.expr("substring(path, 1, n)").alias("r_path"))
    hits = cand.join(table, ["r_host", "r_path"])
    depth = F.when(F.col("r_host") == "", 0).otherwise(F.size(F.split("r_host", r"\.")))
    best = hits.groupBy("__row").agg(F.max_by(F.struct("r_rule", "r_verdict"), F.struct(depth, F.length("r_path"), F.col("r_verdict"))).alias("b"))
    return keyed.join(best, "__row", "left").select(*base.columns, F.col("b.r_rule").alias("rule"), F.coalesce(F.col("b.r_verdict"), F.lit(default)).alias("verdict"))
