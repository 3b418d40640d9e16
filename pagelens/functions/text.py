"""Text normalization and other text expressions, all built in.

``normalize`` prepares transcriptions for error rates, in two dialects.  Formulas
and tables have a long chain of rules of their own; other types pay nothing for it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import REGION_TYPES, STRUCTURED_TYPES, TEXT_TYPES, VISUAL_TYPES

# ---------------------------------------------------------------- fixed values
# Commands of formulas and the symbols they stand for.
SYMBOLS = {
    r"\alpha": "α", r"\beta": "β", r"\gamma": "γ", r"\delta": "δ", r"\epsilon": "ε", r"\varepsilon": "ε",
    r"\zeta": "ζ", r"\eta": "η", r"\theta": "θ", r"\vartheta": "ϑ", r"\iota": "ι", r"\kappa": "κ",
    r"\lambda": "λ", r"\mu": "μ", r"\nu": "ν", r"\xi": "ξ", r"\pi": "π", r"\rho": "ρ", r"\sigma": "σ",
    r"\tau": "τ", r"\upsilon": "υ", r"\phi": "φ", r"\varphi": "φ", r"\chi": "χ", r"\psi": "ψ", r"\omega": "ω",
    r"\Gamma": "Γ", r"\Delta": "Δ", r"\Theta": "Θ", r"\Lambda": "Λ", r"\Xi": "Ξ", r"\Pi": "Π",
    r"\Sigma": "Σ", r"\Phi": "Φ", r"\Psi": "Ψ", r"\Omega": "Ω",
    r"\cdot": "·", r"\times": "×", r"\div": "÷", r"\pm": "±", r"\mp": "∓", r"\circ": "∘", r"\bullet": "•",
    r"\star": "⋆", r"\leq": "≤", r"\le": "≤", r"\geq": "≥", r"\ge": "≥", r"\neq": "≠", r"\ne": "≠",
    r"\approx": "≈", r"\equiv": "≡", r"\sim": "∼", r"\propto": "∝",
    r"\rightarrow": "→", r"\to": "→", r"\leftarrow": "←", r"\leftrightarrow": "↔", r"\Rightarrow": "⇒",
    r"\Leftarrow": "⇐", r"\Leftrightarrow": "⇔", r"\implies": "⇒", r"\iff": "⇔",
    r"\cap": "∩", r"\cup": "∪", r"\subset": "⊂", r"\supset": "⊃", r"\subseteq": "⊆", r"\supseteq": "⊇",
    r"\in": "∈", r"\notin": "∉", r"\emptyset": "∅", r"\varnothing": "∅", r"\oplus": "⊕", r"\otimes": "⊗",
    r"\infty": "∞", r"\partial": "∂", r"\nabla": "∇", r"\forall": "∀", r"\exists": "∃", r"\neg": "¬",
    r"\sqrt": "√", r"\sum": "∑", r"\prod": "∏", r"\int": "∫", r"\ldots": "…", r"\dots": "…", r"\cdots": "⋯",
    r"\therefore": "∴", r"\because": "∵", r"\perp": "⊥", r"\angle": "∠", r"\parallel": "∥",
    r"\square": "□", r"\Box": "□", r"\triangle": "△",
}
# What the second dialect adds.
SYMBOLS_V2 = {
    r"\uparrow": "↑", r"\downarrow": "↓", r"\Uparrow": "⇑", r"\Downarrow": "⇓", r"\vee": "∨", r"\wedge": "∧",
    r"\lor": "∨", r"\land": "∧", r"\setminus": "∖", r"\backslash": "\\", r"\mid": "|", r"\lvert": "|",
    r"\rvert": "|", r"\Vert": "‖", r"\lfloor": "⌊", r"\rfloor": "⌋", r"\lceil": "⌈", r"\rceil": "⌉",
    r"\male": "♂", r"\female": "♀",
}
FUNCTIONS_V2 = (
    "arcsin|arccos|arctan|arcctg|arccot|arcsec|arccsc|sinh|cosh|tanh|coth|sin|cos|tan|cot|sec|csc|ctg|"
    "liminf|limsup|log|ln|lg|exp|lim|sup|inf|min|max|det|dim|gcd|lcm|mod|arg|deg|hom|ker"
)
STYLES_V2 = "mathrm|mathbf|mathit|mathbb|mathcal|mathfrak|mathsf|mathtt|operatorname|boldsymbol|pmb"
TABLES = {
    "v1": "array|tabular|matrix|pmatrix|bmatrix|vmatrix",
    "v2": "array|tabular|matrix|pmatrix|bmatrix|vmatrix|Vmatrix|smallmatrix|aligned|align|alignat|gathered|cases|split",
}
LATIN, CYRILLIC = "aceiopxyABCEHKMOPTX", "асеіорхуАВСЕНКМОРТХ"
SUPER, SUPER_TO = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ", "0123456789+-=()n"
SUB, SUB_TO = "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎", "0123456789+-=()"
DASHES = "[\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\uff0d]"
DOUBLE_QUOTES, SINGLE_QUOTES = '["\u201c\u201d\u201e\u00ab\u00bb\u2033]', "['\u2018\u2019\u02bc\u2032]"
SPACES = "[ \t\u00a0\u2000-\u200b\u3000]+"
COMBINING = "[\u0300-\u036f\u20d0-\u20ff]"
# Phrases of answers that explain instead of transcribing, and labels put before an answer.
EXPLAINING = r"(?i)\b(?:i can see|the image|this is|the answer|solution|solve|simplif)"
LABELS = "text|transcription|answer"
LABELS_OF_INVALID = "text|transcription|answer|output"
# Reasons why an answer is invalid, in the order in which they are looked for.
INVALID = {
    "empty": "empty", "fence": "markdown_fence", "wrapper": "json_or_list_wrapper", "label": "prefixed_label",
    "explains": "explanation_or_solution_like", "bars": "missing_table_separator", "rows": "malformed_table_rows",
}
# Pipelines whose names augmentation puts into a copy's file name, after "_" or "_aug_".
PIPELINES = "light|dense|rare|heavy|mix"
# ------------------------------------------------------------------------------

#: A text without any of these is left as it is by the rules of formulas and tables.
_TOUCHED = rf"[\\&*∗⋅{{}};|{SUPER}{SUB}\u0300-\u036f\u20d0-\u20ff]"

#: Texts of these characters alone, without double spaces, only need lookalikes turned and the ends bared.
_PLAIN = r"^[\u0400-\u04ffa-zA-Z0-9 .,:;!?'\"#%+=/$№]*+$"

#: White space as Python sees it.
WS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_HOLD = "\ue000"  # stands for a literal backslash until all commands are done
_LEFT, _RIGHT = "\ue001", "\ue002"  # around a match that is rewritten in steps

Step = Callable[[Column], Column]


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def strip(c: Column) -> Column:
    return sub(c, f"^{WS}+|{WS}+$")


def bound(c: Column, *steps: Step) -> Column:
    """Steps one after another; the array keeps the planner from copying what precedes them."""
    return reduce(lambda x, f: F.element_at(F.transform(F.array(x), f), 1), steps, c)


def _all_levels(pattern: str, to: str, mark: str) -> Step:
    """Replace until nothing changes: each round removes a ``mark``, so their number bounds it."""
    return lambda c: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(c, F.lit(mark)))), c, lambda acc, _: sub(acc, pattern, to))


def _symbols(dialect: str) -> Step:
    table = SYMBOLS | (SYMBOLS_V2 if dialect == "v2" else {})
    names = sorted(table, key=len, reverse=True)  # no name holds another's backslash: order by length is enough

    def step(c: Column) -> Column:
        for name in names:
            c = F.replace(c, F.lit(name), F.lit(_HOLD if table[name] == "\\" else table[name]))
        return F.replace(c, F.lit(_HOLD), F.lit("\\"))

    return lambda c: F.when(F.instr(c, "\\") > 0, step(c)).otherwise(c)


def _rows_of(pattern: str, separator: str) -> Step:
    """Parenthesised rows become lines: the match is fenced, its separators turned, the fence dropped."""

    def step(c: Column) -> Column:
        c = sub(c, pattern, f"{_LEFT}$1{_RIGHT}")
        c = sub(c, rf"{WS}*{separator}{WS}*(?=[^{_LEFT}]*{_RIGHT})", "\n")
        return sub(c, f"{_LEFT}{WS}*|{WS}*{_RIGHT}")

    return step


def _determinant(c: Column) -> Column:
    # possessive: the JVM's patterns would use a stack frame a cell
    c = sub(c, rf"(\|{WS}*[^|\n]+?{WS}*\|(?:{WS}*\|{WS}*[^|\n]+?{WS}*\|)++)", f"{_LEFT}$1{_RIGHT}")
    c = sub(c, rf"{WS}*\|{WS}*\|{WS}*(?=[^{_LEFT}]*{_RIGHT})", "\n")
    return sub(c, rf"{_LEFT}\|{WS}*|{WS}*\|{_RIGHT}")


def _structured(dialect: str) -> list[Step]:
    """Rules of formulas and tables, in their order."""
    two, env = dialect == "v2", TABLES[dialect]
    star = r"\*?" if two else ""
    r: Callable[..., Step] = lambda pattern, to="": lambda c: sub(c, pattern, to)
    steps = [
        r(rf"\\begin\{{(?:{env}){star}\}}(?:\{{[^}}]*\}})?{WS}*"),
        r(rf"{WS}*\\end\{{(?:{env}){star}\}}"),
        r(rf"{WS}*\\\\{WS}*", "\n"),
        r(rf"{WS}*&{WS}*", "|"),
    ]
    if two:
        steps += [r(rf"\\hline\b|\\cline{WS}*\{{[^{{}}]*\}}"), r(rf"\\phantom{WS}*\{{[^{{}}]*\}}"), r(rf"\\underline{WS}*\{{([^{{}}]*)\}}", "$1")]
    steps += [r(r"\\text\{([^}]*)\}", "$1"), r(rf"\\(?:left|right){WS}*([()|\[\]{{}}.])", "$1")]
    if two:
        steps += [
            r(r"\\(?:big|Big|bigg|Bigg)[lr]?\b"),
            _all_levels(rf"\\(?:{STYLES_V2}){WS}*\{{([^{{}}]*)\}}", "$1", rf"\\(?:{STYLES_V2})"),
            r(rf"\\xrightarrow{WS}*(?:\[[^\]]*\])?{WS}*\{{[^{{}}]*\}}", "→"),
            r(rf"\\xleftarrow{WS}*(?:\[[^\]]*\])?{WS}*\{{[^{{}}]*\}}", "←"),
            _all_levels(rf"\\cancel{WS}*\{{([^{{}}]*)\}}|\\(?:overset|underset){WS}*\{{[^{{}}]*\}}{WS}*\{{([^{{}}]*)\}}", "$1$2", r"\\(?:cancel|overset|underset)"),
        ]
    steps += [
        r(r"\\[,;:!]|\\quad|\\qquad|\\hspace\{[^}]*\}", " "),
        _all_levels(rf"\\frac{WS}*\{{([^{{}}]*)\}}{WS}*\{{([^{{}}]*)\}}", "$1/$2", r"\\frac"),
        r(rf"\\(?:overrightarrow|vec){WS}*\{{([^{{}}]*)\}}", "→$1"),
        r(rf"\\overleftarrow{WS}*\{{([^{{}}]*)\}}", "←$1"),
        r(rf"\\(?:bar|hat|overline|widetilde|widehat|dot|ddot){WS}*\{{([^{{}}]*)\}}", "$1"),
    ]
    if two:
        steps.append(r(rf"\\({FUNCTIONS_V2})(?![A-Za-z])", "$1 "))
    steps += [
        _symbols(dialect),
        r(rf"√{WS}*\{{([^{{}}]*)\}}", "√$1"),
        r(COMBINING),
        r("[*∗⋅]", "·"),
        lambda c: F.translate(sub(c, f"[{SUPER}]", "^$0"), SUPER, SUPER_TO),
        lambda c: F.translate(sub(c, f"[{SUB}]", "_$0"), SUB, SUB_TO),
        r(r"([_^])\{([^}]+)\}", "$1$2"),
        _rows_of(rf"\(([^();]+(?:{WS}*;{WS}*[^();]+)++)\)", ";"),
    ]
    if two:
        steps.append(_rows_of(r"\(([^()]*\\n[^()]*)\)", r"\\n"))
    return [*steps, _determinant]


def _table(c: Column) -> Column:
    """Bars tightened, outer bars and blank lines dropped."""
    lines = F.transform(F.split(sub(c, rf"{WS}*\|{WS}*", "|"), "\n"), lambda x: strip(sub(x, r"^\|+|\|+$")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalize(text: Column, region_type: Column, dialect: str = "v1") -> Column:
    """Transcription as error rates compare it; null as empty text."""
    if dialect not in TABLES:
        raise ValueError(dialect)
    marks: list[Step] = [lambda c: sub(c, r"(?d)~~.*?~~\{(.*?)\}", "$1"), lambda c: sub(c, r"(?d)~~(.*?)~~", "$1")]
    common: list[Step] = [
        lambda c: F.translate(c, LATIN, CYRILLIC),
        lambda c: sub(c, DASHES, "-"),
        lambda c: sub(c, r"[_\-]{3,}", "___"),
        lambda c: sub(sub(c, DOUBLE_QUOTES, '"'), SINGLE_QUOTES, "'"),
        lambda c: sub(c, SPACES, " "),
        lambda c: sub(sub(c, rf"\({WS}+", "("), rf"{WS}+\)", ")"),
    ]
    if dialect == "v2":
        common.append(lambda c: sub(sub(c, r" +\(", "("), " +([_^])", "$1"))
    structured = region_type.isin(*STRUCTURED_TYPES)

    def full(t: Column) -> Column:
        return bound(
            t,
            *marks,
            lambda t: F.when(structured & t.rlike(_TOUCHED), bound(t, *_structured(dialect))).otherwise(t),
            *common,
            lambda t: strip(F.when(region_type == "table", bound(t, _table)).otherwise(t)),
        )

    plain = lambda t: F.translate(F.trim(t), LATIN, CYRILLIC)
    return bound(F.coalesce(text, F.lit("")), lambda t: F.when(t.rlike(_PLAIN) & ~t.contains("  "), plain(t)).otherwise(full(t)))


# ------------------------------------------------------------------ small rules
def basename(path: Column) -> Column:
    """Last part of a path with either slash."""
    return F.regexp_extract(F.translate(path, "\\", "/"), "([^/]+)/*$", 1)


def base_image(path: Column, literal: bool = False) -> Column:
    """Name of the page an augmented copy was made from.

    ``literal`` removes the number alone, which leaves the pipeline in the name.
    """
    name = basename(path)
    return sub(name, r"_aug\d+") if literal else sub(name, rf"(?:_(?:aug_)?(?:{PIPELINES}))?_aug\d+")


def normal_type(c: Column) -> Column:
    """Type without case and white space; empty and unknown ones count as handwritten."""
    t = F.lower(strip(c))
    return F.when(t.isin(*REGION_TYPES), t).otherwise("handwritten")


def first_of(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in cols))


def route(region_type: Column) -> Column:
    """Branch a type is read by."""
    return F.when(region_type.isin(*TEXT_TYPES), "text").when(region_type.isin(*STRUCTURED_TYPES), "structured").when(
        region_type.isin(*VISUAL_TYPES), "empty"
    ).otherwise("unknown")


def scorable(region_type: Column, language: Column, legibility: Column) -> Column:
    """Whether a region counts in error rates; missing language and legibility do no harm."""
    return (
        ~F.coalesce(region_type.isin(*VISUAL_TYPES), F.lit(False))
        & ~F.coalesce(language == "other", F.lit(False))
        & ~F.coalesce(legibility == "illegible", F.lit(False))
    )


def sane(text: Column, most: int = 260) -> Column:
    """Not blank, not too long, no character eleven times on end, none unreadable."""
    t = F.coalesce(text, F.lit(""))
    return (strip(t) != "") & (F.char_length(t) <= most) & ~t.rlike(r"(?s)(.)\1{10,}") & ~t.contains("\ufffd")


def training_text(text: Column, collapse: bool = False) -> Column:
    t = strip(F.translate(F.coalesce(text, F.lit("")), "\u00a0", " "))
    return sub(t, f"{WS}+", " ") if collapse else t


def cyrillic_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\u0400-\u04ff]"))


#: Characters of the Windows code page that the Latin one lacks, and their bytes (fixed values).
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_CP1252_AT = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"


def repair(text: Column) -> Column:
    """Undo reading UTF-8 as the Windows code page, if that gains Cyrillic letters."""

    def again(t: Column) -> Column:
        plain = F.translate(t, _CP1252, _CP1252_AT)
        return F.try_validate_utf8(F.encode(F.when(plain.rlike(r"^[\x00-\xFF]*$"), plain), "ISO-8859-1").cast("string"))

    def better(t: Column) -> Column:
        return bound(again(t), lambda x: F.when(x.isNotNull() & (cyrillic_count(x) > cyrillic_count(t)), x).otherwise(t))

    return bound(text, lambda t: F.when(t.rlike("[ÃÐÑÂ]"), better(t)).otherwise(t))


def clean(text: Column) -> Column:
    """Repaired, white space collapsed, stripped; null as empty."""
    return sub(strip(repair(F.coalesce(text, F.lit("")))), f"{WS}+", " ")


def truncate(text: Column, limit: int = 150) -> Column:
    cut = lambda t: F.concat(sub(F.left(t, F.lit(max(0, limit - 3))), f"{WS}+$"), F.lit("..."))
    return bound(clean(text), lambda t: F.when(F.char_length(t) <= limit, t).otherwise(cut(t)))


def slug(text: Column) -> Column:
    """Lower-case letters and digits, other runs as one underscore."""
    return sub(sub(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$")


def four_digits(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.4f", x)).otherwise("")


def clean_output(text: Column, most: int = 500) -> Column:
    """A model's answer: fence, label, quotation marks and JSON wrapper removed, cut to ``most``."""

    def unfence(c: Column) -> Column:
        body = strip(sub(strip(sub(c, "^```[a-zA-Z]*")), "```$"))
        return F.when(c.startswith("```"), body).otherwise(c)

    def unquote(c: Column) -> Column:
        quoted = (F.char_length(c) >= 2) & c.rlike("(?s)^(?:'.*'|\".*\")$")
        return F.when(quoted, strip(F.substring(c, F.lit(2), F.char_length(c) - 2))).otherwise(c)

    def unwrap(c: Column) -> Column:
        parsed = F.try_parse_json(c)
        inner = F.coalesce(F.try_variant_get(parsed, "$.text", "string"), F.lit(""))
        return F.when(c.rlike(r"^[\[{]"), F.when(c.startswith("{"), inner).otherwise("")).otherwise(c)

    label = lambda c: strip(sub(c, rf"(?i)^(?:{LABELS}){WS}*:{WS}*"))
    return F.left(bound(strip(F.coalesce(text, F.lit(""))), unfence, label, unquote, unwrap), F.lit(most))


def invalid_reason(text: Column, region_type: Column, gt_text: Column) -> Column:
    """Why a structured answer is invalid, the first reason that holds; empty if it is valid."""
    t = strip(F.coalesce(text, F.lit("")))
    sep = lambda c: F.coalesce(c, F.lit("")).rlike(r"[|\n]")
    lines = F.filter(F.split(t, r"\r\n|[\n\r]"), lambda x: strip(x) != "")
    return (
        F.when(t == "", INVALID["empty"])
        .when(t.contains("```"), INVALID["fence"])
        .when(t.rlike(r"^[\[{]"), INVALID["wrapper"])
        .when(t.rlike(rf"(?i)^(?:{LABELS_OF_INVALID}){WS}*:"), INVALID["label"])
        .when(t.rlike(EXPLAINING), INVALID["explains"])
        .when((region_type == "table") & sep(gt_text) & ~sep(t), INVALID["bars"])
        .when((region_type == "table") & (F.size(lines) > 1) & F.exists(lines, lambda x: ~x.contains("|")), INVALID["rows"])
        .otherwise("")
    )


def markdown_cell(c: Column) -> Column:
    return F.coalesce(F.replace(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")), F.lit(""))
