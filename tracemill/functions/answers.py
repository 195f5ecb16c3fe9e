"""Final answers in free text: extraction, normal form and verification, as Spark column expressions.

Each stage of the normal form is bound once (``let``), so an expression stays linear in the number of rules.
Patterns are Unicode-aware and treat only ``\\n`` as a line end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import after_first, after_last, before_first, let, py_strip, word_count

# Rewrites of the normal form, in their order. A pair is a literal and what replaces it. The percent sign's stands twice: behind
# two backslashes it bites twice.
_SAME_FRACTION = [("tfrac", "frac"), ("dfrac", "frac"), ("cfrac", "frac"), ("\\left", ""), ("\\right", "")]
_DEGREES = ["^{\\circ}", "^\\circ"]
_UNITS = [(r"\{(?:c|m)?m\}(?:\^(?:2|3))?", ""), (r"p\.m\.$", ""), (r"(\d)[\s\x1c-\x1f]*t$", "$1")]
_SIGNS = [("\\$", ""), ("$", ""), ("x\\in", ""), ("\\%", "%"), ("\\%", "%"), (" .", " 0."), ("{.", "{0."), ("\\cdot", ""), ("infinity", "\\infty")]
_FONTS = [("+\\inity", "\\infty"), ("\\mathbf", ""), ("\\mathrm", "")]
_QUOTES = [("'", ""), ('"', "")]
_SOLUTION_WORDS = ["boxed", "final answer", "answer is"]

_CANONICAL_INT = r"\A(?:0|-?[1-9][0-9]{0,4298})\z"
_FLOAT = r"(?i)\A[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+(?:_[0-9]+)*)?\z"


#: A number without trailing zeros is its own normal form; it spares the rewrites.
_PLAIN = r"\A-?[0-9]+(?:\.[0-9]*[1-9])?\z"


def _literals(c: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def _regex(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, "(?Ud)" + pattern, to)


def fix_fracs(c: Column) -> Column:
    """Braces around both parts of every ``\\frac``; unchanged where a part is missing."""

    def part(p: Column) -> Column:
        head, second = F.substr(p, F.lit(1), F.lit(1)), F.substr(p, F.lit(2), F.lit(1))
        bare = F.concat(F.lit("{"), head, F.when(second == "{", F.lit("}{")).otherwise(F.concat(F.lit("}{"), second, F.lit("}"))), F.substr(p, F.lit(3), F.length(p)))
        return F.concat(F.lit("\\frac"), F.when(F.startswith(p, F.lit("{")), p).otherwise(bare))

    def build(pieces: Column) -> Column:
        rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        short = F.exists(rest, lambda p: ~F.startswith(p, F.lit("{")) & (F.length(p) < 2))
        fixed = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(rest, lambda p: part(p)), ""))
        return F.when(short, c).otherwise(fixed)

    return let(F.split(c, r"\\frac", -1), build)


def fix_a_slash_b(c: Column) -> Column:
    """``a/b`` of whole numbers or roots as a ``\\frac``."""

    def build(p: Column) -> Column:
        fine = lambda x: F.contains(x, F.lit("sqrt")) | x.rlike(_CANONICAL_INT)
        a, b = F.element_at(p, 1), F.try_element_at(p, F.lit(2))
        return F.when((F.size(p) == 2) & fine(a) & fine(b), F.concat(F.lit("\\frac{"), a, F.lit("}{"), b, F.lit("}"))).otherwise(c)

    return let(F.split(c, "/", -1), build)


def _braced(c: Column, name: str) -> Column:
    c = F.regexp_replace(c, rf"\\{name}(-?[0-9.a-zA-Z]+)", rf"\\{name}{{$1}}")
    return F.regexp_replace(c, rf"(?Ud)\\{name}[\s\x1c-\x1f]+([\p{{L}}\p{{N}}_]+)$", rf"\\{name}{{$1}}")


def fix_sqrt(c: Column) -> Column:
    return _braced(c, "sqrt")


def fix_tan(c: Column) -> Column:
    return _braced(c, "tan")


def strip_string(c: Column) -> Column:
    """The normal form of an answer. Applying it twice can change it again; callers keep count."""
    return let(c, lambda s: F.when(s.rlike(_PLAIN), s).otherwise(_normal_form(s)))


def _normal_form(c: Column) -> Column:
    first = F.replace(F.rtrim(F.replace(py_strip(c), F.lit("\n"), F.lit("")), F.lit(".")), F.lit("\\!"), F.lit(""))

    def unwrap(s):
        wrapped = F.startswith(s, F.lit("\\text{")) & F.endswith(s, F.lit("}"))
        return F.when(wrapped, F.substr(s, F.lit(7), F.greatest(F.length(s) - 7, F.lit(0)))).otherwise(s)

    def units(s):
        without = py_strip(_regex(s, r"\\text\{.*?\}$", ""))
        s = let(without, lambda w: F.when(w != "", w).otherwise(s))
        for mark in _DEGREES:
            s = py_strip(F.replace(s, F.lit(mark), F.lit("")))
        for pattern, to in _UNITS:
            s = py_strip(_regex(s, pattern, to))
        return _literals(s, _SIGNS)

    def infinity(s):
        s = F.when(F.contains(s, F.lit("\\infty")), s).otherwise(F.replace(s, F.lit("inf"), F.lit("\\infty")))
        return _literals(_regex(_literals(s, _FONTS), r"\\mbox\{.*?\}", ""), _QUOTES)

    def imaginary(s):
        s = F.when(F.contains(s, F.lit("j")) & ~F.contains(s, F.lit("i")), F.replace(s, F.lit("j"), F.lit("i"))).otherwise(s)
        return _regex(_regex(s, r"(\d+)\.0+([^\d])", "$1$2"), r"(\d+)\.0+$", "$1")

    def finish(s):
        s = F.when(F.startswith(s, F.lit(".")), F.concat(F.lit("0"), s)).otherwise(s)
        s = F.replace(fix_tan(fix_sqrt(s)), F.lit(" "), F.lit(""))
        return F.rtrim(let(let(s, fix_fracs), fix_a_slash_b), F.lit("\\,."))

    out = let(_literals(let(first, unwrap), _SAME_FRACTION), units)
    out = let(let(out, infinity), imaginary)
    return let(out, lambda s: F.when(s == "", s).otherwise(finish(s)))


def extract_boxed(c: Column) -> Column:
    """Contents of every balanced ``boxed{...}``; of nested ones only the inner. A percent sign behind keeps the brace."""

    def content(piece: Column) -> Column:
        segments = F.split(piece, r"\}", -1)
        # segment k ends at closing brace k; it is unmatched where the opening braces so far number exactly k
        opened = lambda s: F.length(s) - F.length(F.replace(s, F.lit("{"), F.lit("")))
        init = F.struct(F.lit(0).alias("n"), F.lit(0).alias("open"), F.lit(-1).alias("found"))

        def step(acc, s):
            now = acc["open"] + opened(s)
            hit = (acc["found"] < 0) & (now == acc["n"])
            return F.struct((acc["n"] + 1).alias("n"), now.alias("open"), F.when(hit, acc["n"]).otherwise(acc["found"]).alias("found"))

        def take(segs):
            at = F.aggregate(F.slice(segs, 1, F.size(segs) - 1), init, step, lambda a: a["found"])
            return let(at, lambda k: F.when(k >= 0, F.concat(F.array_join(F.slice(segs, F.lit(1), k + 1), "}"), F.when(F.startswith(F.element_at(segs, k + 2), F.lit("%")), F.lit("}")).otherwise(F.lit("")))))

        return let(segments, take)

    pieces = F.split(c, r"boxed\{", -1)
    return let(pieces, lambda p: F.array_compact(F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda x: content(x))))


def extract_program_output(c: Column) -> Column:
    """The last output block, stripped; empty where there is none."""
    block = before_first(after_last(c, "```output"), "```")
    return F.when(F.contains(c, F.lit("```output")), py_strip(block)).otherwise(F.lit(""))


def extract_answers(c: Column) -> Column:
    """All answers a text gives, in normal form."""

    def find(t: Column) -> Column:
        final = F.contains(t, F.lit("final answer is $")) & F.contains(t, F.lit("$. I hope"))
        numbers = F.regexp_extract_all(F.replace(t, F.lit(","), F.lit("")), F.lit(r"(?U)-?\d*\.?\d+"), F.lit(0))
        last = F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.lit(""))
        shown = let(extract_program_output(t), lambda o: F.array(F.when(o != "", o).otherwise(last)))
        return (
            F.when(final, F.array(py_strip(before_first(after_first(t, "final answer is $"), "$. I hope"))))
            .when(F.contains(t, F.lit("boxed")), extract_boxed(t))
            .when(F.contains(t, F.lit("he answer is")), F.array(py_strip(after_last(t, "he answer is"))))
            .otherwise(shown)
        )

    def clean(a: Column) -> Column:
        line = before_first(py_strip(a), "\n")
        return strip_string(F.rtrim(F.rtrim(F.ltrim(line, F.lit(":")), F.lit(".")), F.lit("/")))

    return F.transform(let(F.coalesce(c, F.lit("")), find), lambda a: clean(a))


def extract_answer(c: Column) -> Column:
    """The last answer of a text, or empty."""
    return F.coalesce(F.try_element_at(extract_answers(c), F.lit(-1)), F.lit(""))


def extract_math_answers(question: Column, reasoning: Column) -> Column:
    """Answers split at commas where the question asks for a list, else at an ``and``."""
    pattern = r"(?U)\\text\{[\s\x1c-\x1f]*and[\s\x1c-\x1f]*\}"

    def pieces(a: Column) -> Column:
        listed = F.contains(question, F.lit("separated by commas")) & ~a.rlike(r"[()\[\]]")
        parts = F.when(listed, F.split(a, ",", -1)).when(a.rlike(pattern), F.split(F.regexp_replace(a, pattern, "[SEP]"), r"\[SEP\]", -1)).otherwise(F.array(a))
        return F.transform(parts, lambda x: py_strip(x))

    return F.flatten(F.transform(extract_answers(reasoning), lambda a: pieces(a)))


def ground_truth_candidates(c: Column) -> Column:
    """Accepted normal forms of a ground truth: its own, and of its last answer where it reads like a solution. Sorted."""

    def build(t: Column) -> Column:
        low = F.lower(t)
        solution = F.contains(t, F.lit("\n")) | F.contains(t, F.lit("####")) | (word_count(t) > 8)
        for word in _SOLUTION_WORDS:
            solution = solution | F.contains(low, F.lit(word))
        found = F.array(strip_string(t), F.when(solution, strip_string(extract_answer(t))))
        return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != ""))))

    return let(F.coalesce(c, F.lit("")), build)


def _number(c: Column) -> Column:
    """The value of a text that Python's float() takes for a finite number, else null."""
    plain = py_strip(F.replace(c, F.lit(","), F.lit("")))
    return let(plain, lambda p: F.when(p.rlike(_FLOAT), F.replace(p, F.lit("_"), F.lit("")).try_cast("double")))


def numerically_equal(a: Column, b: Column) -> Column:
    gap = F.abs(_number(a) - _number(b))
    return F.coalesce(~F.isnan(gap) & (gap < F.lit(1e-6)), F.lit(False))


def verify_answer(generated: Column, ground_truth: Column) -> Column:
    """The normal form of a generated answer equals a candidate, as text or as a number."""
    return let(
        strip_string(F.coalesce(generated, F.lit(""))),
        lambda g: (g != "") & F.exists(ground_truth_candidates(ground_truth), lambda x: (x == g) | numerically_equal(g, x)),
    )
