"""Text functions: Python-like stripping, think blocks, steps and prompts, as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompts, tags and separators that other tools of the data rely on.
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
THINK_BREAK = "\n</think>\n\n"
STEP_SEPARATOR = "\n\n"
DEFAULT_EOS = "<｜end▁of▁sentence｜>"
COMPRESSED_MARK = "<｜compressed｜>"
REASON_PROMPT = "Please reason step by step, and put your final answer within \\boxed{}."
REFINE_SYSTEM = (
    "You are an expert mathematical editor. Your task is to refine a rough reasoning draft. "
    "Restore logical continuity and mathematical accuracy. "
    "Match the Original CoT's exact tone, formatting, and style. "
)
REFINE_TEMPLATE = (
    "### Question\n{question}\n\n"
    "### Original CoT (ONLY for Reference)\n{original}\n\n"
    "### Rough Draft (To Refine)\n{draft}\n\n"
    "### Instruction\n"
    "Refine the Rough Draft to ensure mathematical coherence and logical flow.\n"
    "1. Fill in missing algebraic manipulations and arithmetic calculations.\n"
    "2. Match the style and formatting of the Original CoT.\n"
    "3. Output ONLY the refined reasoning text.\n"
    "4. Ensure the calculations lead correctly to the final answer.\n"
    "### Refined Rough Solution:\n"
)
REWRITE_SYSTEM = """You are an expert at condensing reasoning steps. Your task is to rewrite the given reasoning step to be more concise while preserving all essential information and logical flow. 

Rules:
1. Keep all key facts, numbers, and logical connections
2. Remove redundant phrases and verbose expressions
3. Maintain the mathematical or logical correctness
4. Output ONLY the condensed step, no explanations"""
REWRITE_TEMPLATE = "Compress this reasoning step as short as possible:\n\n{step}\n\nCompressed:"
FUSE_SYSTEM = """You are an expert at merging reasoning steps. Your task is to combine two consecutive reasoning steps into a single, coherent step while preserving all essential information.

Rules:
1. Preserve all key facts, numbers, and calculations
2. Maintain logical flow and correctness
3. Remove redundant information that appears in both steps
4. The merged step should be shorter than the sum of both steps
5. Output ONLY the merged step, no explanations"""
FUSE_TEMPLATE = "Merge these two steps into one step as short as possible:\n\nStep 1: {first}\n\nStep 2: {second}\n\nMerged:"

_SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, body) -> Column:
    """Bind a column once for an expression that uses it several times."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


# The characters that count as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def py_strip(c: Column) -> Column:
    """Strip all Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def nonblank(c: Column) -> Column:
    """Some character that is not white space; null counts as blank."""
    return F.coalesce(py_strip(c) != "", F.lit(False))


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0)))


def before_first(c: Column, mark: str) -> Column:
    """All up to the first mark; the whole text where there is none."""
    return F.substring_index(c, mark, 1)


def after_first(c: Column, mark: str) -> Column:
    """All behind the first mark; empty where there is none."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substr(c, at + F.lit(len(mark)), F.length(c))).otherwise(F.lit(""))


def after_last(c: Column, mark: str) -> Column:
    """All behind the last mark; the whole text where there is none."""
    return F.substring_index(c, mark, -1)


def split_think(c: Column, mark: str = THINK_BREAK) -> Column:
    """struct(before, after) of the first closing tag on a line of its own; both empty where it is missing."""
    c = F.coalesce(c, F.lit(""))
    found = F.instr(c, mark) > 0
    return F.struct(F.when(found, before_first(c, mark)).otherwise("").alias("before"), after_first(c, mark).alias("after"))


def split_steps(c: Column, separator: str = STEP_SEPARATOR) -> Column:
    """The non-blank stretches between separators, untrimmed."""
    return F.filter(F.split(c, _quote(separator), -1), nonblank)


def _quote(s: str) -> str:
    return r"\Q" + s + r"\E"


def rebuild_think(steps: Column, separator: str = STEP_SEPARATOR) -> Column:
    """Steps joined again and closed; the answer after the block is not part of it."""
    return F.concat(F.array_join(steps, separator), F.lit(THINK_BREAK))


def ensure_think_block(c: Column) -> Column:
    """A text as one think block: cut behind the first closing tag, opened if need be, two line breaks behind; empty stays empty."""

    def fixed(s: Column) -> Column:
        head = F.concat(before_first(s, THINK_CLOSE), F.lit(THINK_CLOSE))
        opened = F.when(F.startswith(head, F.lit(THINK_OPEN)), head).otherwise(F.concat(F.lit(THINK_OPEN + "\n"), head))
        wrapped = F.concat(F.lit(THINK_OPEN + "\n"), s, F.lit("\n" + THINK_CLOSE + "\n\n"))
        return F.when(F.contains(s, F.lit(THINK_CLOSE)), F.concat(opened, F.lit("\n\n"))).otherwise(wrapped)

    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(let(py_strip(c), fixed))


_HELD = r"[\x01<\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def as_prose(c: Column) -> Column:
    """A text to be taken as prose alone: tags in it are no tags, white space beyond ASCII's is none, and an empty text is one. ``from_prose`` takes it back."""
    return F.when(c == "", F.lit("\x01\x01")).otherwise(F.regexp_replace(c, _HELD, "\x01$0\x01"))


def from_prose(c: Column) -> Column:
    """What holds texts from ``as_prose``, with the texts as they were."""
    return let(c, lambda x: F.when(F.contains(x, F.lit("\x01")), F.regexp_replace(x, r"(?s)\x01(?:(.)\x01|\x01)", "$1")).otherwise(x))


def compression_suffix(eos: str = DEFAULT_EOS) -> Column:
    return F.lit(f"{eos}{COMPRESSED_MARK}{eos}")


def user_prompt(question: Column) -> Column:
    return F.concat(question, F.lit("\n" + REASON_PROMPT))


def fill(template: str, **columns: Column) -> Column:
    """A template with each {name} replaced by a column."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), columns[name]]
    return F.concat(*parts, F.lit(rest))


def refine_prompt(question: Column, draft: Column, original: Column) -> Column:
    return fill(REFINE_TEMPLATE, question=question, draft=draft, original=original)


def rewrite_prompt(step: Column) -> Column:
    return fill(REWRITE_TEMPLATE, step=step)


def fuse_prompt(first: Column, second: Column) -> Column:
    return fill(FUSE_TEMPLATE, first=first, second=second)


def model_name(path: str) -> str:
    """Last part of a model path."""
    return path.rstrip("/").split("/")[-1]


def token_positions(text: Column, separator: str = STEP_SEPARATOR) -> Column:
    """Character places of the think block and its steps: struct(think_start, think_end, steps array of (s, e)).

    Each stripped step is searched from where the one before it ended; one that is not found is left out.
    A token count of the text up to a place turns it into a token position (see ``steps.positions_in_tokens``).
    """

    def build(t: Column) -> Column:
        start = F.nullif(F.instr(t, THINK_OPEN), F.lit(0)) - 1
        close = F.nullif(F.instr(t, THINK_CLOSE), F.lit(0)) - 1
        end = close + len(THINK_CLOSE)
        body_at = F.coalesce(start + len(THINK_OPEN), F.lit(0))
        body = F.when(start.isNotNull() & close.isNotNull() & (close >= body_at), F.substr(t, body_at + 1, close - body_at)).otherwise(F.lit(""))
        init = F.struct(body_at.cast("int").alias("cur"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

        def step(acc, s):
            at = F.call_function("locate", s, t, acc["cur"] + 1)
            hit = F.struct((at - 1 + F.length(s)).alias("cur"), F.array_append(acc["out"], F.struct((at - 1).alias("s"), (at - 1 + F.length(s)).alias("e"))).alias("out"))
            return F.when(at > 0, hit).otherwise(acc)

        spans = F.aggregate(F.transform(split_steps(body, separator), py_strip), init, step, lambda a: a["out"])
        return F.struct(start.cast("int").alias("think_start"), end.cast("int").alias("think_end"), spans.alias("steps"))

    return let(F.coalesce(text, F.lit("")), build)
