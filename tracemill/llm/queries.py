"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_model, pii
from . import secrets as secret_scan
from . import spans as S
from .common import id_text, read_table
from .decontaminate import match_benchmark
from .packing import pack
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .topk import top_k
from .toxicity import Settings, classify, fit, remainder
from .url_filter import Rule, filter_urls

URL_RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(id_text()) % 10 == 0
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = language_model.train(docs.where(~held_out))
    scored = language_model.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(read_table(spark, sf_dir, "documents"))
    base = F.filter("marks", lambda x: x["k"] < len(pii.KINDS))
    count = lambda k: F.size(F.filter("marks", lambda x: x["k"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
        F.sha2(S.digest_text(base, pii.NAMES, by_start=False), 256).alias("base_sha256"),
        S.digest_text(F.col("marks"), pii.NAMES, by_start=False).alias("spans"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    scored = classify(docs, fit(docs, read_table(spark, sf_dir, "labels"), remainder() != 2))
    predicted = (F.col("score") >= Settings().threshold).cast("int")
    return scored.select("doc_id", (remainder() == 2).alias("held_out"), "score", predicted.alias("predicted"), F.col("toxic").cast("int").alias("predicted_by_language"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_file()).drop("text_hash")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read_table(spark, sf_dir, "documents"))
    names = [r.kind for r in secret_scan.RULES]
    base = F.filter("marks", lambda x: x["k"] < len(secret_scan.BASE))
    count = lambda k: F.size(F.filter("marks", lambda x: x["k"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(secret_scan.BASE)],
        F.sha2(S.digest_text(base, names, by_start=True), 256).alias("base_sha256"),
        S.digest_text(F.col("marks"), names, by_start=True).alias("spans"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = match_benchmark(docs, read_table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op4_url_filter": op4_url_filter,
    "op1_suffix": op1_suffix,
    "op2_lm": op2_lm,
    "op3_pii": op3_pii,
    "op5_simhash": op5_simhash,
    "op6_topk": op6_topk,
    "op7_toxicity": op7_toxicity,
    "op8_pack": op8_pack,
    "op9_secrets": op9_secrets,
    "op10_decontaminate": op10_decontaminate,
}


# The contract's rules for SQL, spelled out by themselves: kind, regex, group and length that a match must have. Then the method's further rules.
_ANY_CASE = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_SECRET_KINDS = [
    ("assign", _ANY_CASE + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("google", "AIza[0-9A-Za-z_-]{35}", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
    ("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
]


def _secrets_sql() -> str:
    """Each kind's matches are put between two marks; the pieces between the first marks tell where they stand."""
    parts = []
    for k, (_, pattern, group, least) in enumerate(_SECRET_KINDS):
        p = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {k} AS k, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM (
  SELECT doc_id, split_part(p[i], chr(2), 1) AS m, list_sum(list_transform(p[:i - 1], lambda x: length(x))) - (i - 2) AS s
  FROM (SELECT doc_id, p, unnest(range(2, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(t, '{p}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS p FROM d)))
  WHERE length(regexp_extract(m, '{p}', {group})) >= {least}""")
    names = "[" + ", ".join(f"'{kind}'" for kind, *_ in _SECRET_KINDS) + "]"
    union = "\nUNION ALL\n".join(parts)
    counted = ("assign", "access", "hex")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({union}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, kind in enumerate(counted))},
  string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM m GROUP BY doc_id)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{kind}, 0) AS BIGINT) AS n_{kind}" for kind in counted)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)"""


SQL = {
    "op9_secrets": _secrets_sql(),
    "op4_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM m
""",
    "op6_topk": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op10_decontaminate": r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM iw),
win AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, ms WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, m, item_id FROM win JOIN iw USING (m, g)),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
""",
}
