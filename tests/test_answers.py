import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions import answers as A
from tracemill.functions import text as T

#: Worked by hand, a few for each rule: text, normal form.
NORMAL = [
    ("", ""), (" ", ""), ("42", "42"), ("42.", "42"), ("line\nbreak", "linebreak"), ("5\\!0", "50"),
    ("\\text{abc}", "abc"), ("\\text{}", ""), ("\\text{\\text{x}}", "\\text{x}"), ("5\\text{ cm}", "5"),
    ("\\dfrac{1}{2}", "\\frac{1}{2}"), ("\\tfrac{1}{2}", "\\frac{1}{2}"), ("\\cfrac{1}{2}", "\\frac{1}{2}"), ("\\left(1,2\\right)", "(1,2)"),
    ("\\frac12", "\\frac{1}{2}"), ("\\frac1{72}", "\\frac{1}{72}"), ("\\frac{1}2", "\\frac{1}2"), ("\\frac", "\\frac"), ("\\frac1", "\\frac1"), ("x\\frac12y\\frac34", "x\\frac{1}{2}y\\frac{3}{4}"), ("\\frac123", "\\frac{1}{2}3"),
    ("1/2", "\\frac{1}{2}"), ("-1/2", "\\frac{-1}{2}"), ("01/2", "01/2"), ("+1/2", "+1/2"), ("-0/3", "-0/3"), ("1/2/3", "1/2/3"), ("\\sqrt3/2", "\\frac{\\sqrt{3}}{2}"), ("\uff12/\uff13", "\uff12/\uff13"),
    ("\\sqrt3", "\\sqrt{3}"), ("\\sqrt x", "\\sqrt{x}"), ("\\sqrt\tab", "\\sqrt{ab}"), ("\\tan 30", "\\tan{30}"), ("\\tan45", "\\tan{45}"),
    ("3.000", "3"), ("3.00x", "3x"), ("3.050", "3.050"), (".5", "0.5"), ("{.5}", "{0.5}"), ("a .5", "a0.5"),
    ("50\\%", "50%"), ("\\\\%", "%"), ("\\$5", "5"), ("$5$", "5"), ("x\\in[1,2]", "[1,2]"), ("90^\\circ", "90"), ("90^{\\circ}", "90"),
    ("5{cm}^2", "5"), ("5{m}", "5"), ("5{mm}^3", "5"), ("3 p.m.", "3p.m"), ("3p.m..", "3p.m"), ("12 t", "12"), ("12t", "12"), ("3\u2028t", "3"), ("a\u2028t", "a\u2028t"),
    ("infinity", "\\infty"), ("inf", "\\infty"), ("\\infty", "\\infty"), ("+\\inity", "\\infty"), ("\\cdots", "s"), ("2\\cdot3", "23"),
    ("3j", "3i"), ("ij", "ij"), ("\\mbox{ab}7", "7"), ("\\mbox{m}7", "\\mbox7"), ("'a\"", "a"), ("\\mathbf{x}", "{x}"), ("\\mathrm{e}\\,", "{e}"), ("1,000", "1,000"), ("7,", "7"),
    ("\u00e9\u00a0", "\u00e9"), ("\x1c7\x1f", "7"), ("\\boxed{1}", "\\boxed{1}"),
]
#: Text, its answers.
ANSWERS = [
    ("", [""]), ("no number", [""]), ("so 3 and then -4.5", ["-4.5"]), ("1,234", ["1234"]), ("-.5", ["-.5"]), ("5.", ["5"]), ("\u0661\u0662\u0663", ["\u0661\u0662\u0663"]), ("#### 15", ["15"]),
    ("The final answer is $\\frac12$. I hope it is correct.", ["\\frac{1}{2}"]), ("x $. I hope final answer is $7", ["7"]),
    ("\\boxed{15}", ["15"]), ("boxed", []), ("boxed{3", []), ("boxed{50}%", ["50}"]), ("boxed{boxed{3}}", ["3"]), ("\\boxed{\\frac{1}{2}} or \\boxed{2}", ["\\frac{1}{2}", "2"]), ("boxed{a{b}c}d} boxed{}", ["a{b}c", ""]), ("boxed{{}", []), ("Answer IS boxed{1}", ["1"]),
    ("the answer is: 5.", ["5"]), ("The answer is 4/", ["4"]), ("he answer is 1 he answer is 2\nrest", ["2"]),
    ("```output\n 8 \n```", ["8"]), ("```output\n```", [""]), ("a ```output 1``` b ```output 2", ["2"]), ("9 ```output\n```", ["9"]),
]
#: Ground truth, its accepted forms.
CANDIDATES = [
    (None, []), (" ", []), ("42", ["42"]), ("#### 15", ["####15", "15"]), ("worked\nsolution\n#### 15", ["15", "workedsolution####15"]), ("\\boxed{7}", ["7", "\\boxed{7}"]), ("Final Answer 3", ["3", "FinalAnswer3"]),
    ("one two three four five six seven eight", ["onetwothreefourfivesixseveneight"]), ("one two three four five six seven eight 9", ["9", "onetwothreefourfivesixseveneight9"]),
]
#: Generated answer, ground truth, whether they agree.
VERDICTS = [
    ("0.5", "1/2", False), ("1/2", "1/2", True), (".5", "0.5", True), ("5e-1", "0.5", True), ("1,000", "1000", True), ("1_000", "1000", True), ("1000.0000001", "1000", True), ("1000.00001", "1000", False),
    ("nan", "nan", True), ("nan", "1", False), ("inf", "infinity", True), ("1d", "1", False), ("0x1p3", "8", False), ("", "", False), ("", "7", False), ("7", "", False), (" 7 ", "7.0", True), ("7", "#### 7", True), ("7", "\\boxed{7}", True), ("8", "7", False), ("\uff17", "7", False),
]


def evaluate(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select(*[c.alias(k) for k, c in columns.items()]).collect()


def test_normal_forms(spark):
    got = evaluate(spark, NORMAL, "s string, want string", s=F.col("s"), want=F.col("want"), once=A.strip_string(F.col("s")))
    assert [(r["s"], r["once"]) for r in got] == NORMAL


def test_answers_and_candidates(spark):
    got = evaluate(spark, ANSWERS, "t string, want array<string>", t=F.col("t"), a=A.extract_answers(F.col("t")), last=A.extract_answer(F.col("t")))
    assert [(r["t"], r["a"]) for r in got] == ANSWERS
    assert [r["last"] for r in got] == [a[-1] if a else "" for _, a in ANSWERS]
    got = evaluate(spark, CANDIDATES, "t string, want array<string>", t=F.col("t"), c=A.ground_truth_candidates(F.col("t")))
    assert [(r["t"], r["c"]) for r in got] == CANDIDATES


def test_verdicts(spark):
    got = evaluate(spark, VERDICTS, "a string, b string, want boolean", a=F.col("a"), b=F.col("b"), v=A.verify_answer(F.col("a"), F.col("b")))
    assert [(r["a"], r["b"], r["v"]) for r in got] == VERDICTS


def balanced(rng, depth):
    return "".join(rng.choice(["a", "1", " ", "\\frac", "{" + balanced(rng, depth - 1) + "}" if depth else "x"]) for _ in range(rng.randint(0, 4)))


def test_boxes_are_found_as_they_were_built(spark):
    rng, rows = random.Random(5), []
    for _ in range(300):
        parts = [balanced(rng, 3) for _ in range(rng.randint(0, 3))]
        rows.append(("start " + " then ".join("\\boxed{" + p + "}" for p in parts) + " end", parts))
    rows = [r for r in rows if "boxed" not in "".join(r[1])]
    got = evaluate(spark, rows, "t string, want array<string>", want=F.col("want"), b=A.extract_boxed(F.col("t")))
    assert all(r["b"] == r["want"] for r in got)


def test_properties_of_the_normal_form(spark):
    rng = random.Random(6)
    bits = ["\\frac", "{", "}", "1", "23", "/", "\\sqrt", "\\text{", " ", ".", ",", "%", "j", "-", "0", "\n", "x", "^\\circ", "t", "$", "\\tan"]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 14))), rng.randint(-999, 999)) for _ in range(500)]
    got = evaluate(spark, rows, "s string, n int", s=F.col("s"), n=A.strip_string(F.col("s")), whole=A.strip_string(F.concat(F.lit(" $"), F.col("n"), F.lit(".00$ "))), plain=F.col("n").cast("string"), same=A.verify_answer(F.col("s"), F.col("s")))
    for r in got:
        assert " " not in r["n"] and "\n" not in r["n"] and "$" not in r["n"] and not r["n"].endswith((",", ".", "\\")), r["s"]
        assert r["whole"] == r["plain"]


def test_math_answers(spark):
    rows = [("separated by commas", "\\boxed{1, 2,3}"), ("separated by commas", "\\boxed{(1, 2)}"), ("x", "\\boxed{1\\text{ and }2}"), ("x", "\\boxed{5}")]
    got = evaluate(spark, rows, "q string, r string", a=A.extract_math_answers(F.col("q"), F.col("r")))
    assert [r["a"] for r in got] == [["1", "2", "3"], ["(1,2)"], ["1", "2"], ["5"]]


@pytest.mark.parametrize(
    "text,want",
    [(None, ""), ("", ""), (" a ", "<think>\na\n</think>\n\n"), ("a</think>b</think>", "<think>\na</think>\n\n"), ("<think>\na\n</think>\nb", "<think>\na\n</think>\n\n"), ("x<think>a</think>", "<think>\nx<think>a</think>\n\n")],
)
def test_think_block(spark, text, want):
    assert evaluate(spark, [(text,)], "t string", x=T.ensure_think_block(F.col("t")))[0]["x"] == want


def test_think_and_steps(spark):
    text = "one\n\n \n\ntwo \n</think>\n\nanswer\n</think>\n\nmore"
    r = evaluate(spark, [(text,)], "t string", x=T.split_think(F.col("t")), s=T.split_steps(T.split_think(F.col("t"))["before"]), b=T.rebuild_think(F.array(F.lit("a"), F.lit("b"))))[0]
    assert tuple(r["x"]) == ("one\n\n \n\ntwo ", "answer\n</think>\n\nmore")
    assert r["s"] == ["one", "two "] and r["b"] == "a\n\nb\n</think>\n\n"
    assert tuple(evaluate(spark, [("none",)], "t string", x=T.split_think(F.col("t")))[0]["x"]) == ("", "")
    full = "p<think>\nab\n\n cd \n\nab</think>x"
    r = evaluate(spark, [(full,)], "t string", x=T.token_positions(F.col("t")))[0]["x"]
    assert (r["think_start"], r["think_end"]) == (1, full.index("</think>") + 8)
    assert [full[a:b] for a, b in r["steps"]] == ["ab", "cd", "ab"]
