"""Text rules against golden cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagelens.functions import editdist, text

GOLDEN = [
    # One published case for each rule that no other can stand for.
    ("cocна", "handwritten", "сосна"),
    ("~~старе~~{нове} слово", "handwritten", "нове слово"),
    ("(1; -1)", "formula", "1\n-1"),
    ("| 3 2 | | -1 1 |", "formula", "3 2\n-1 1"),
    (r"\overrightarrow{AB}", "formula", "→АВ"),
    (r"\begin{array}{cc} 1 & 2 \\ 3 & 4 \end{array}", "table", "1|2\n3|4"),
    # Cases of our own.
    ("Вечір у селі", "printed", "Вечір у селі"),
    ("хліб–сіль ― так", "handwritten", "хліб-сіль - так"),
    ("був ~~дуб~~ ліс", "annotation", "був дуб ліс"),
    ("~~а~~{б} ~~в~~{г}", "handwritten", "б г"),
    ("q_{7} - z^{4}", "formula", "q_7 - z^4"),
    ("Рік || Сума |", "table", "Рік||Сума"),
    ("|Рік|\n\n|Сума|", "table", "Рік\nСума"),
    ("v₀⁻³", "formula", "v_0^-^3"),
    ("„Так“ і ‘ні’", "handwritten", "\"Так\" і 'ні'"),
    ("(  ліс )  далі", "printed", "(ліс) далі"),
    ("підпис ------ дата", "handwritten", "підпис ___ дата"),
    ("5 ∗ 8 ⋅ 2", "formula", "5 · 8 · 2"),
    ("5 * 8", "printed", "5 * 8"),
    (r"\frac{7}{\frac{n}{9}}", "formula", "7/n/9"),
    (r"\frac{\frac{\frac{1}{2}}{3}}{4}", "formula", "1/2/3/4"),
    (r"\sqrt{k} \leq \beta", "formula", "√k ≤ β"),
    (r"\hat{n} + \dot{z}", "formula", "n + z"),
    ("n̂", "formula", "n"),
    (r"\vec{v} \to \overleftarrow{u}", "formula", "→v → ←u"),
    (r"\text{ліс}\quad 3", "formula", "ліс 3"),
    (r"\left( 5 \right)", "formula", "(5)"),
    (r"\nequal", "formula", "≠uаl"),
    ("дім (кут)", "handwritten", "дім (кут)"),
    ("$z = 5n$  ", "handwritten", "$z = 5n$"),
    (None, "table", ""),
    ("", "formula", ""),
    ("   \u3000 ", "handwritten", ""),
]
SECOND = [
    (r"\cos\beta", "formula", "соs β"),
    (r"\ln(z)", "formula", "ln(z)"),
    (r"\sup K", "formula", "suр К"),
    (r"\mathbf{\mathcal{n}}", "formula", "n"),
    (r"\underset{n}{z}", "formula", "z"),
    (r"\xleftarrow[n]{z} 5", "formula", "← 5"),
    (r"M \wedge N", "formula", "М ∧ N"),
    (r"\backslash", "formula", "\\"),
    ("дім (кут)", "handwritten", "дім(кут)"),
    ("(5 6 \\n 7 8)", "formula", "5 6\n7 8"),
    (r"\cline{1-2} 5 & 6", "table", "5|6"),
]


@pytest.mark.parametrize("dialect,cases", [("v1", GOLDEN), ("v2", SECOND)])
def test_normalize(spark, dialect, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, kind string, want string")
    got = df.select("i", text.normalize(F.col("t"), F.col("kind"), dialect).alias("got")).collect()
    assert {r["i"]: r["got"] for r in got} == {i: c[2] for i, c in enumerate(cases)}


@pytest.mark.parametrize("dialect", ["v1", "v2"])
def test_long_matrices(spark, dialect):
    """Matrices and determinants of any number of rows, as short ones are."""
    for n in (2, 501, 502, 5_000):
        cells = [str(i) for i in range(n)]
        df = spark.createDataFrame([("(" + "; ".join(cells) + ")",), ("|" + "| |".join(cells) + "|",)], "t string")
        assert [r["x"] for r in df.select(text.normalize(F.col("t"), F.lit("formula"), dialect).alias("x")).collect()] == ["\n".join(cells)] * 2, n


def test_unknown_dialect():
    with pytest.raises(ValueError):
        text.normalize(F.lit("a") if False else None, None, "v3")


def _one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_small_rules(spark):
    lit = F.lit
    assert _one(spark, text.truncate(lit("а" * 200), 10)) == "а" * 7 + "..."
    assert _one(spark, text.slug(lit("Formula near-correct!"))) == "formula_near_correct"
    assert _one(spark, text.basename(lit("a\\b/c.jpg"))) == "c.jpg"
    assert _one(spark, text.base_image(lit("images/x_aug_light_aug001.jpg"))) == "x.jpg"
    assert _one(spark, text.base_image(lit("images/x_aug_light_aug001.jpg"), literal=True)) == "x_aug_light.jpg"
    assert _one(spark, text.four_digits(lit(None).cast("double"))) == ""
    assert _one(spark, text.repair(lit("слово".encode().decode("latin-1")))) == "слово"
    assert _one(spark, text.repair(lit("Ñandú"))) == "Ñandú"
    assert _one(spark, text.sane(lit("а" * 11))) is False
    assert _one(spark, text.sane(lit("а" * 10))) is True
    assert _one(spark, text.sane(lit(None).cast("string"))) is False


def test_clean_output(spark):
    cases = {"```text\nабв\n```": "абв", 'Text: "абв"': "абв", '{"text": "абв"}': "абв", "[1, 2]": "", "{": "", "": "", "абв" * 300: ("абв" * 300)[:500]}
    for given, want in cases.items():
        assert _one(spark, text.clean_output(F.lit(given))) == want, given


def test_invalid_reason(spark):
    cases = [("", "formula", "x", "empty"), ("a ``` b", "formula", "x", "markdown_fence"), ("{x}", "formula", "x", "json_or_list_wrapper"), ("Answer: 3", "formula", "x", "prefixed_label"),
             ("this is x", "formula", "x", "explanation_or_solution_like"), ("a b", "table", "a|b", "missing_table_separator"), ("a|b\nc", "table", "a|b", "malformed_table_rows"), ("a|b", "table", "a|b", "")]
    for given, kind, gt, want in cases:
        assert _one(spark, text.invalid_reason(F.lit(given), F.lit(kind), F.lit(gt))) == want


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_distance(spark):
    pairs = [("а б в", "а в"), ("", "а"), ("", ""), ("один два три", "один  три два"), ("x " * 40, "y " * 30)]
    for a, b in pairs:
        want = _levenshtein(a.split(), b.split())
        assert _one(spark, editdist.words(F.lit(a), F.lit(b))) == want
    many = [f"с{i}" for i in range(7_000)]  # more words than the basic plane has private characters
    assert _one(spark, editdist.words(F.lit(" ".join(many)), F.lit(" ".join(["х", *many[1:-1]])))) == 2
    assert _one(spark, editdist.cer(F.lit("🙂а"), F.lit("а"))) == 1.0


def test_line_distance(spark):
    r = random.Random(2)
    for _ in range(60):
        a = [r.choice(["так", "ні", "т", "ліс"]) for _ in range(r.randrange(0, 6))]
        b = a[: r.randrange(0, 6)] + [r.choice(["так", "ні"]) for _ in range(r.randrange(0, 3))] + a[r.randrange(0, 6) :]
        lit = lambda x: F.lit(x).cast("array<string>")
        assert _one(spark, editdist.lines(lit(a), lit(b))) == _levenshtein("\n".join(a), "\n".join(b)), (a, b)


def test_no_python_in_word_distances(spark):
    df = spark.createDataFrame([("а б", "а")], "a string, b string").select(editdist.wer(F.col("a"), F.col("b")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
