"""Places of regex matches in a text column, with Spark's own functions only.

Positions are code points, ends exclusive. A span is a struct (s, e, m): start, end, matched text.

Running sums and maxima over the matches of a text are taken in blocks of ``BLOCK`` matches: an array grows by appending
inside its block only, and a text is cut into the stretches of its blocks before single matches are cut out. So a
text with many thousands of matches takes time in proportion to its length and matches, not to their squares.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<s:int,e:int,m:string>>"
#: Matches that are handled together.
BLOCK = 128


def let(value: Column, body) -> Column:
    """Bind a column once for an expression that uses it several times."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def none() -> Column:
    return F.array().cast(SPANS)


def _blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK entries; none for an empty one."""
    at = F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))
    return F.when(F.size(items) > 0, F.transform(at, lambda i: F.slice(items, i, F.lit(BLOCK)))).otherwise(F.slice(F.array(items), 1, 0))


def _running(totals: Column, start: Column, combine) -> Column:
    """What stands before each entry: ``start`` combined with all entries that precede it."""
    return F.transform(totals, lambda t, i: F.aggregate(F.slice(totals, F.lit(1), i), start, combine))


def find_all(text: Column, pattern: str, wanted: Column | None = None) -> Column:
    """All leftmost non-overlapping matches. The stretches between matches (split) give the places of those
    (extract) without a second look at the text. ``wanted`` is a cheap test that spares the search."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.zip_with(let(F.struct(gaps.alias("g"), hits.alias("h")), lambda x: F.slice(x["g"], F.lit(1), F.size(x["h"]))), hits, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m")))

    def places(block: Column, at: Column) -> Column:
        init = F.struct(at.alias("at"), none().alias("found"))

        def step(acc, x):
            s = acc["at"] + x["g"]
            return F.struct((s + x["n"]).alias("at"), F.array_append(acc["found"], F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["m"].alias("m"))).alias("found"))

        return F.aggregate(block, init, step, lambda acc: acc["found"])

    def all_of(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["g"] + x["n"]))
        starts = let(totals, lambda t: _running(t, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: places(b, at)))

    # most texts have no match: look once before finding the places
    some = text.rlike(pattern) if wanted is None else wanted & text.rlike(pattern)
    return F.when(some, let(let(sized, _blocks), all_of)).otherwise(none())


def digest_text(marks: Column, names: list[str], by_start: bool) -> Column:
    """kind:start:end, comma-joined; by start then kind, or by kind then start."""
    if by_start:
        ordered = F.array_sort(marks)
    else:
        ordered = F.transform(F.array_sort(F.transform(marks, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    name = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(ordered, lambda x: F.concat(F.element_at(name, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def outside(words: Column, marks: Column) -> Column:
    """The spans (s, e, m) that do not begin inside a mark (s, k, e)."""
    item = lambda s, k, e, m: F.struct(s.alias("s"), F.lit(k).alias("k"), e.alias("e"), m.alias("m"))
    items = F.array_sort(F.concat(F.transform(marks, lambda x: item(x["s"], 0, x["e"], F.lit(""))), F.transform(words, lambda x: item(x["s"], 1, x["e"], x["m"]))))

    def scan(block: Column, reached: Column) -> Column:
        init = F.struct(reached.alias("at"), none().alias("out"))

        def step(acc, x):
            free = (x["k"] == 1) & (x["s"] >= acc["at"])
            one = F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))
            return F.struct(F.when(x["k"] == 0, F.greatest(acc["at"], x["e"])).otherwise(acc["at"]).alias("at"), F.when(free, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, init, step, lambda acc: acc["out"])

    def all_of(blocks: Column) -> Column:
        furthest = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda x: F.when(x["k"] == 0, x["e"]).otherwise(0))))
        starts = let(furthest, lambda t: _running(t, F.lit(0), lambda a, x: F.greatest(a, x)))
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: scan(b, at)))

    return let(let(items, _blocks), all_of)


_STRETCHES = "array<struct<s:int,k:int,e:int,at:int>>"


def _stretches(marks: Column) -> Column:
    """Marks in order with ``at``, the furthest end of those before; the ones that begin inside an earlier mark are left out."""

    def scan(block: Column, reached: Column) -> Column:
        init = F.struct(reached.alias("at"), F.array().cast(_STRETCHES).alias("out"))

        def step(acc, x):
            one = F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), acc["at"].alias("at"))
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, init, step, lambda acc: acc["out"])

    def all_of(blocks: Column) -> Column:
        furthest = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda x: x["e"])))
        starts = let(furthest, lambda t: _running(t, F.lit(0), lambda a, x: F.greatest(a, x)))
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: scan(b, at)))

    return let(_blocks(marks), all_of)


def replace_spans(text: Column, marks: Column, names: list[str]) -> Column:
    """The text with each marked stretch replaced by its name in brackets; overlapping marks are one stretch, under the first one's name."""
    name = F.array(*[F.lit(f"[{n.upper()}]") for n in names])

    def cut(block: Column) -> Column:
        # the block's own stretch of text first: places in it are found from its start
        begin = F.element_at(block, 1)["at"]
        piece = F.substr(text, begin + 1, F.element_at(block, -1)["s"] - begin)
        return let(piece, lambda p: F.array_join(F.transform(block, lambda x: F.concat(F.substr(p, x["at"] - begin + 1, x["s"] - x["at"]), F.element_at(name, x["k"] + 1))), ""))

    def whole(ordered: Column) -> Column:
        end = F.array_max(F.transform(ordered, lambda x: x["e"]))
        heads = let(let(_stretches(ordered), _blocks), lambda blocks: F.array_join(F.transform(blocks, cut), ""))
        return F.concat(heads, F.substr(text, end + 1, F.length(text)))

    return F.when(F.size(marks) > 0, let(F.array_sort(marks), whole)).otherwise(text)
