"""Secret scanning with a trigram inverted index, in Spark's own functions.

From each rule's regex a Boolean query of mandatory trigrams is derived. Postings say which documents contain the trigrams that
some rule asks for; a rule's candidates come from intersecting and uniting postings, and only their texts are verified
with the regex. Rules without mandatory trigrams scan every text. Postings are over lowered text, so a query never misses a match.

``build_index`` writes postings (gram, id). A scan builds them itself, by a hash of id and text, so that rows that share an id, or have none,
have postings of their own; an index table, for corpora that are scanned again with other rules, is given to ``scan`` or ``redact``. Postings
meet by document, never by trigram, so a frequent trigram is no hot key; the candidates are then joined to the texts, and a rule does not look
at the texts of the others.

Defined cases: a null text is empty and has no secrets; a very long text is searched whole, in time that its length and matches take, not
their squares; matches of several rules at one place are all marked, in the rules' order; rows that share an id, or a null id, are each
verified on their own text (with an index table, on the rules that any of them may match); an empty table gives no rows; other columns,
of whatever names, pass through ``redact``, which keeps the documents' columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S

try:
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # older Python
    import sre_constants as C
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """``least``: characters that group ``group`` of a match must have; shorter matches are dropped, not retried.
    ``rest``: what of the secret follows the place that the scan marks; ``redact`` takes it too, and it may be empty."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    rest: str = ""


def either_case(words: str) -> str:
    return re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


# The base rules. Runs of a class shorter than asked for cannot hold a longer one, so the
# lengths of the last two stand in the patterns themselves.
BASE = [
    Rule("assign", "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
# The body of a key: up to its END line, or without one the base64 lines that follow; header lines may stand before them.
_GAP = r"(?:\s|\\[nr]){1,8}"
_HEAD = r"(?:" + _GAP + r"[A-Za-z][A-Za-z-]{2,30}:[^\r\n\\]{0,200}){0,8}"
KEY_BODY = f"{_HEAD}(?:[^-]*+-----END [A-Z ]{{0,40}}PRIVATE KEY-----|(?:{_GAP}[A-Za-z0-9+/]{{20,}}={{0,2}}){{0,1000}}(?:{_GAP}[A-Za-z0-9+/]+={{1,2}})?)"
FURTHER = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", rest=KEY_BODY),
]
RULES = BASE + FURTHER

_MANY = 64


def trigram_query(pattern: str):
    """True (no mandatory trigram), a trigram, or ("and" | "or", [queries]) that every match's lowered text satisfies."""
    exact, query = _walk(parser.parse(pattern))
    return _and(query, _of_strings(exact)) if exact is not None else query


def _of_strings(strings: frozenset):
    return _or(*[_and(*sorted({s[i : i + 3] for i in range(len(s) - 2)})) if len(s) > 2 else True for s in sorted(strings)])


def _and(*queries):
    flat = []
    for q in queries:
        flat += [x for x in (q[1] if isinstance(q, tuple) and q[0] == "and" else [q]) if x is not True and x not in flat]
    return True if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _or(*queries):
    if not queries or any(q is True for q in queries):
        return True
    terms = [set(q[1]) if isinstance(q, tuple) and q[0] == "and" and all(isinstance(x, str) for x in q[1]) else {q} if isinstance(q, str) else None for q in queries]
    # a conjunction that asks for more than another one adds nothing
    kept = [q for i, q in enumerate(queries) if terms[i] is None or not any(t is not None and (t < terms[i] or t == terms[i] and j < i) for j, t in enumerate(terms) if j != i)]
    return kept[0] if len(kept) == 1 else ("or", kept)


def _walk(tree):
    """(set of all lowered strings a parsed regex can match, or None if many; query that every match satisfies)."""
    run, query, whole = frozenset([""]), True, True
    for op, arg in tree:
        exact, own = _node(op, arg)
        query = _and(query, own)
        if exact is not None and len(exact) * len(run) <= _MANY:
            run = frozenset(a + b for a in run for b in exact)
        else:
            query, whole = _and(query, _of_strings(run)), False
            run = frozenset([""]) if exact is None else exact
    return (run, query) if whole else (None, _and(query, _of_strings(run)))


def _node(op, arg):
    if op is C.LITERAL:
        return frozenset([chr(arg).lower()]), True
    if op is C.IN:
        chars = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                chars.add(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (frozenset(chars), True) if len(chars) <= 8 else (None, True)
    if op is C.SUBPATTERN:
        return _walk(arg[-1])
    if op is C.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= _MANY:
            return frozenset().union(*[e for e, _ in parts]), True
        return None, _or(*[_and(q, _of_strings(e)) if e is not None else q for e, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, getattr(C, "POSSESSIVE_REPEAT", None)):
        low, high, sub = arg
        exact, own = _walk(sub)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, True
        if low == high and exact is not None and len(exact) ** low <= _MANY:
            out = frozenset([""])
            for _ in range(low):
                out = frozenset(a + b for a in out for b in exact)
            return out, True
        return (None, True) if low == 0 else (None, _and(own, _of_strings(exact)) if exact is not None else own)
    if op is C.AT:
        return frozenset([""]), True
    return None, True


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*[trigrams(q) for q in query[1]])


def build_index(docs: DataFrame, grams: list[str], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Postings (gram, id): one row for each asked-for trigram that a document's lowered text contains."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("__low"), F.lit(g)), F.lit(g)) for g in grams]))
    return docs.select(F.col(id_col).alias("id"), low.alias("__low")).select("id", F.explode(found).alias("gram"))


def holds(query, posted) -> Column:
    """A Boolean query, given whether a trigram is posted; conditions behind the deciding one are not looked at."""
    if isinstance(query, str):
        return posted(query)
    parts = [holds(x, posted) for x in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if query[0] == "and" else (out | p)
    return out


def candidates(index: DataFrame, queries: dict) -> DataFrame:
    """(id, kinds): the rules whose Boolean query a document's postings satisfy."""

    kinds = F.array_compact(F.array(*[F.when(holds(q, lambda g: F.array_contains("grams", g)), F.lit(k)) for k, q in queries.items()]))
    return index.groupBy("id").agg(F.collect_set("gram").alias("grams")).select("id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _matches(text: Column, rule: Rule, wanted: Column | None = None) -> Column:
    found = S.find_all(text, rule.pattern, wanted)
    if rule.group or rule.least > 1:
        found = F.filter(found, lambda x: F.length(F.regexp_extract(x["m"], rule.pattern, rule.group)) >= rule.least)
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def marked(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", id_col: str = "doc_id", index: DataFrame | None = None) -> DataFrame:
    """The documents with ``__marks``, (start, index of the rule, end) of every match."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    rows = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    key = id_col
    if indexed and index is None:
        key = "__key"
        rows = rows.withColumn(key, F.xxhash64(id_col, "__t"))
        index = build_index(rows, sorted(set().union(*map(trigrams, indexed.values()))), "__t", key)
    if indexed:
        cand = candidates(index, indexed).select(F.col("id").alias("__cid"), F.col("kinds").alias("__kinds"))
        rows = rows.join(cand, F.col(key).eqNullSafe(F.col("__cid")), "left")
    wanted = lambda r: F.coalesce(F.array_contains("__kinds", r.kind), F.lit(False)) if r.kind in indexed else None
    found = [F.transform(_matches(F.col("__t"), r, wanted(r)), _marker(k)) for k, r in enumerate(rules)]
    return rows.withColumn("__marks", F.concat(*found) if found else F.array().cast(MARKS)).select(*docs.columns, "__marks")


def scan(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", id_col: str = "doc_id", index: DataFrame | None = None) -> DataFrame:
    """(id, marks) of every row."""
    return marked(docs.select(id_col, text), rules, text, id_col, index).select(F.col(id_col).alias("id"), F.col("__marks").alias("marks"))


MARKS = "array<struct<s:int,k:int,e:int>>"


def _marker(k: int):
    # a second parameter of a transform's function would be the index, so k is bound here
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))


def redact(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", id_col: str = "doc_id", index: DataFrame | None = None) -> DataFrame:
    """The documents with every secret replaced by its rule's name in brackets; same columns, same rows."""
    rules = [replace(r, pattern=r.pattern + r.rest) for r in rules]
    fixed = S.replace_spans(F.col(text), F.col("__marks"), [r.kind for r in rules])
    return marked(docs, rules, text, id_col, index).withColumn(text, fixed).select(*docs.columns)
