"""Personal data: format rules, and information-theoretic sanitisation of what reveals it, in Spark's own functions.

The format rules find the protected entities (addresses, cards, phones). The other words of the texts that hold an entity are
weighed by what the corpus shows: with N documents, and df the number of them that hold something,

    IC(e) = log2(N / df(e)),   PMI(e, t) = log2(N * df(e, t) / (df(e) * df(t))),

a term t discloses the share PMI / IC of what identifies e. A term that does so beyond ``threshold`` is a disclosing term, unless chance
explains it: were t independent of e, that many of its documents would hold e with a probability of at most
exp(-df(t) * KL(df(e,t)/df(t) || df(e)/N)) (Chernoff's bound), which must be ``significance`` or less. So a word found only beside a
rare entity counts, one that a common entity's documents hold by the way does not. In documents with that entity the term is
a span of its own (kind ``term``), and ``sanitize`` generalises it to its kind.

All counts run over all documents and whole texts; there is no window and no least support. Only words of documents with an entity are
paired, with every class of entities that stand in the same documents, and only up to the df that the threshold allows at
all: df(t) <= N^(1-threshold) * df(e)^threshold, an exact bound. Texts never move: rows are hashes of entities, terms and texts, aggregated
before and after the shuffle, so a hot entity or term is a few rows.

Defined cases: a null text is empty; a very long text is one document like any other; ties at the threshold disclose; rows with null or
repeated ids are told apart by a hash of their text, equal rows count each, have equal results and keep their number; an empty table
gives no rows; columns other than id and text, of whatever names, pass through ``sanitize`` and are not used otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import drop_scratch, materialize

# The base kinds and their formats. A start inside a run that has already failed cannot succeed, so runs are
# entered at their first character only (or where the last match ended) and never given back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
NAMES = [*KINDS, "term"]
_IP_OK = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
MARKS = "array<struct<s:int,k:int,e:int>>"
TERM = r"[\p{L}]{3,}"
_TERMS = "array<struct<t:bigint,s:int,e:int>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check sum holds; every second digit from the right counts double."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: _doubled(d.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _doubled(d: Column, i: Column) -> Column:
    twice = d * 2
    return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))


def base_spans(text: Column) -> list[Column]:
    """Spans (s, e, m) of each base kind."""
    digit = text.rlike("[0-9]")
    email = S.find_all(text, EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(S.find_all(text, IP, digit), lambda x: x["m"].rlike(_IP_OK))
    card = F.filter(S.find_all(text, CARD, digit), lambda x: F.length(_digits(x["m"])).between(16, 19) & _luhn(_digits(x["m"])))
    phone = F.filter(S.find_all(text, PHONE, F.contains(text, F.lit("+"))), lambda x: F.length(_digits(x["m"])).between(8, 15))
    return [email, ip, card, phone]


def _marks(spans: list[Column]) -> Column:
    def one(k):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))

    return F.concat(*[F.transform(c, one(k)) for k, c in enumerate(spans)])


def _named(kind: str):
    return lambda x: F.xxhash64(F.concat(F.lit(f"{kind}:"), F.lower(x["m"])))


def _terms(text: str) -> Column:
    """The hashes of the distinct words of a text."""
    words = F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: F.length(w) >= 3)
    return F.transform(words, lambda w: F.xxhash64(w))


def _placed_terms(text: str, marks: Column) -> Column:
    """(hash, s, e) of every word of a text but those that begin inside an entity."""
    found = F.transform(S.find_all(F.col(text), TERM), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
    return F.transform(S.outside(found, marks), lambda x: F.struct(F.xxhash64(F.lower(x["m"])).alias("t"), x["s"].alias("s"), x["e"].alias("e")))


def disclosure(total: int, both: Column, entity: Column, term: Column) -> Column:
    """The share of the entity's information that the term discloses, PMI / IC."""
    n = F.lit(float(total))
    return F.log2(n * both / (entity * term)) / F.log2(n / entity)


def chance(total: int, both: Column, entity: Column, term: Column) -> Column:
    """A bound on the probability that an independent term is found with the entity so often."""
    a, p = both / term, entity / F.lit(float(total))
    rest = F.when(a < 1, (1 - a) * F.log((1 - a) / (1 - p))).otherwise(F.lit(0.0))
    return F.exp(-term * (a * F.log(a / p) + rest))


def find_personal(docs: DataFrame, threshold: float = 0.9, significance: float = 0.01, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, h, marks) of every row; marks holds (start, index in NAMES, end), terms included."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    spans = rows.select("id", F.xxhash64("t").alias("h"), "t", *[c.alias(k) for k, c in zip(KINDS, base_spans(F.col("t")))])
    named = F.concat(*[F.transform(k, _named(k)) for k in KINDS])
    marked = spans.select("id", "h", "t", _marks([F.col(k) for k in KINDS]).alias("marks"), F.array_distinct(named).alias("entities"))
    some = F.size("marks") > 0
    words = F.when(some, _placed_terms("t", F.col("marks"))).otherwise(F.array().cast(_TERMS))
    base = materialize(marked.select("id", "h", "marks", "entities", words.alias("words")), "pii-base")
    out = base.select("id", "h", "marks")

    held = base.where(F.size("marks") > 0).groupBy("h").agg(F.count("*").alias("m"), F.first("entities").alias("entities"), F.first("words").alias("words"))
    held = materialize(held, "pii-held")
    total = base.count()
    entity = held.select("h", "m", F.explode("entities").alias("entity")).groupBy("entity")
    # entities that stand in the same texts are one class: what a term tells of one it tells of all
    entity = entity.agg(F.sum("m").alias("n_e"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("h", F.lit(2))).alias("y")).where(F.col("n_e") < total)
    entity = entity.select("entity", "n_e", F.xxhash64("n_e", "x", "y").alias("c"))
    classes = held.select("h", "m", F.explode("entities").alias("entity")).join(entity, "entity").groupBy("h", "c").agg(F.first("m").alias("m"), F.first("n_e").alias("n_e"))
    classes = materialize(classes, "pii-classes")
    if classes.isEmpty():
        return out
    terms = held.select("h", F.explode(F.array_distinct(F.transform("words", lambda x: x["t"]))).alias("t"))
    # a term is in at least as many documents as those with an entity that hold it: common words fall to that bound before they are paired
    most = F.pow(F.lit(float(total)), F.lit(1 - threshold)) * F.pow(F.col("n_e"), F.lit(threshold)) * (1 + 1e-9)
    top = classes.agg(F.max(most)).first()[0]
    wanted = terms.join(held.select("h", "m"), "h").groupBy("t").agg(F.sum("m").alias("n_b")).where(F.col("n_b") <= top).select("t")
    counts = rows.select(F.explode(_terms("t")).alias("w")).groupBy("w").agg(F.count("*").alias("n_t")).where(F.col("n_t") <= top)
    known = materialize(wanted.join(counts, F.col("t") == F.col("w")).select("t", "n_t"), "pii-terms")
    placed = terms.join(known, "t").select(F.col("h").alias("h2"), "t", "n_t")
    pairs = classes.join(placed, (F.col("h") == F.col("h2")) & (F.col("n_t") <= most)).select("h", "m", "c", "n_e", "t", "n_t")
    pairs = materialize(pairs, "pii-pairs")
    both = pairs.groupBy("c", "t").agg(F.sum("m").alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    n = [F.col(k).cast("double") for k in ("n_et", "n_e", "n_t")]
    telling = both.where((disclosure(total, *n) >= threshold * (1 - 1e-12)) & (chance(total, *n) <= significance)).select("c", "t")
    found = materialize(pairs.join(telling, ["c", "t"], "left_semi").select("h", "t").distinct(), "pii-telling")
    k = len(KINDS)
    extra = held.select("h", F.explode("words").alias("x")).select("h", "x.*").join(found, ["h", "t"], "left_semi")
    extra = extra.groupBy(F.col("h").alias("xh")).agg(F.sort_array(F.collect_list(F.struct("s", F.lit(k).alias("k"), "e"))).alias("terms"))
    extra = materialize(extra, "pii-marks")
    drop_scratch(held, classes, known, pairs, found)
    return out.join(extra, F.col("h") == F.col("xh"), "left").select("id", "h", F.concat("marks", F.coalesce("terms", F.array().cast(MARKS))).alias("marks"))


def sanitize(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The documents with personal data and disclosing terms generalised to their kind in brackets; same columns and rows."""
    found = find_personal(docs, text=text, id_col=id_col, **options).where(F.size("marks") > 0)
    found = found.groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.max("marks").alias("__marks"))
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__h")), "left")
    return joined.withColumn(text, S.replace_spans(F.col(text), F.coalesce("__marks", F.array().cast(MARKS)), NAMES)).select(*docs.columns)
