"""Sentence units of texts in any language and script, in SQL expressions only.

Marks that do not end a sentence (decimals, URLs, list numbers, initials,
abbreviations, everything inside quotations and brackets) are masked one for one
with private-use characters, so that offsets stay true; what is left is cut with
the terminators of each script; the units are then taken from the text itself.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dealt

#: White space: Java's ``\s`` lacks the no-break and other Unicode spaces.
WS = r"[\s\x1C-\x1F\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
HWS = r"[\t\x0B\f \u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"
#: The same characters one by one.
_BLANKS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BREAK = r"(?>\r\n|\n|\r|\u2028|\u2029|\x85)"

#: Private-use placeholders; those of a text itself are first made NEUTRAL.
MASK, OPEN, CLOSE, CUT, NEUTRAL = "\ue001", "\ue002", "\ue003", "\ue0ff", "\uf8ff"

#: Terminators: of spaced scripts, and those that need no space after them.
ENDS = ".!?…؟۔"
OWN = "。！？｡।॥။។៕։።፧፨"
LETTER_BEFORE = r"(?<![\p{L}\p{M}\p{N}])"

# Abbreviations after which a sentence goes on.
#: Before a name or any other word.
TITLES = (
    "вул|буд|ім|гр|проф|доц|викл|ред|упоряд|зв|обл|пров|просп|пл|акад|інж|див|напр|тис|"
    "св|бул|смт|канд|заст|нар|Mr|Mrs|Ms|Messrs|Dr|Prof|St|Rev|Gen|Sen|Gov|Capt|Lt|Col|Sgt|"
    "Hon|Mt|vs|cf|M|MM|Mme|Mlle|Hr|bzw|evtl|ggf|inkl|vgl|Sr|Sra|Srta|Dra|Dña|Ud|Uds|Gral|"
    "Lic|Ing|ul|tzw|np|mgr|inż|ks|św|al|im|tj|tzn|κ|κα|κος|δρ|д-р|п-н|"
    "د|أ|डॉ|श्री|प्रो|मो|ბ-ნი|ქ-ნი"
)
#: Before a name, unless a number stands before them (then they are units).
UNITS = "м|с|п|т|ст|р|о"
#: Before a number.
NUMBERED = (
    "рис|табл|розд|гл|стор|буд|кв|п|пп|с|ст|т|№|No|no|Nos|p|pp|Fig|Figs|fig|vol|Vol|ch|Ch|ed|"
    "Nr|nr|ca|Abb|S|Bd|Kap|núm|pág|págs|ok|str|godz|poz|approx|σελ|αρ|κεφ|εκ|"
    "ص|ج|पृ|सं|გვ|თ"
)
#: A unit before the next smaller one: "175 тис. крб. 14 коп."
COUNTED = {"крб|грн|руб": "коп", "год": "хв", "хв": "с(?:ек)?"}
#: Nouns after German ordinals.
ORDINAL = (
    "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|"
    "Mal|Klasse|Jahrhundert|Stock|Platz|Tag|Woche|Monat|Jahr|Stunde|Kapitel|Auflage|Teil|Reihe"
)
#: Second halves of abbreviations in two parts: "z. B.", "u. U.", "d. h.".
TWO_PART = "(?:B|U|T|Ä|A|R|Hd|Zt|a|h|e|g|m|n|d)"
#: Scripts with marks of their own: one period there is no sentence mark.
OTHER_MARKS = r"[\u0530-֏ऀ-ॿ\u0e00-\u0e7fက-႟ሀ-\u139fក-\u17ff]"
GREEK = r"[Ͱ-Ͽἀ-\u1fff]"
THAI = r"[\u0e00-๏๚-\u0e7f]"
CJK = r"[々-ヿ㐀-鿿豈-\ufaff]"
#: Lower case goes on with the sentence; these begin one all the same.
LOWER = r"(?![Ⴀ-ჿᲐ-Ჿ]|[a-zа-яіїєґ]\s?=|\p{Ll}\p{Lu})\p{Ll}"

# Quotation marks and brackets, opening and closing.
PAIRS = [("«", "»"), ("„", "“”"), ("“", "”"), ('"', '"'), ("「", "」"), ("『", "』"), ("‹", "›"),
         ("《", "》"), ("〈", "〉"), ("【", "】"), ("(", ")"), ("[", "]"), ("（", "）"), ("［", "］"), ("‚", "‘’")]


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]()\\^-" else c for c in chars) + "]"


def _not(chars: str) -> str:
    return "[^" + _class(chars)[1:]


def _all_but(chars: str) -> str:
    """Class of all other characters, as ranges: those that hold most letters are tried first."""
    points = [0, *(x for c in sorted(set(chars)) for x in (ord(c), ord(c) + 1)), 0x110000]
    spans = [(a, b - 1) for a, b in zip(points[::2], points[1::2]) if a < b]
    low = sorted((x for x in spans if x[1] < 0x10000), key=lambda x: (x[0] >= 0x2000, x[0] - x[1]))
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in [*low, *(x for x in spans if x not in low)]) + "]"


def _spelled(group: str) -> str:
    """All characters of a class of ranges."""
    c = re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), group[1:-1])
    return "".join(chr(x) for a, b in re.findall("(.)-(.)|.", c) if a for x in range(ord(a), ord(b) + 1)) + "".join(re.sub("(.)-(.)", "", c))


_OPENERS = "".join(o for o, _ in PAIRS)
#: A whole quotation or bracket without another of its kind inside, or what lies between.
_SPANS = _all_but(_OPENERS) + "++|" + "|".join(
    _class(o) + _not("".join(dict.fromkeys(o + c))) + "*+" + _class(c) for o, c in PAIRS
) + "|(?s:.)"
_NO_OPENER = "^" + _all_but(_OPENERS) + "*+$"
_TAIL = ENDS + OWN + CLOSE + " \t\n\x0b\f\r\u00a0\u202f"


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def _inside(s: Column) -> Column:
    """Mask everything in a quotation or bracket that would end a unit."""
    s = F.translate(s, ENDS + OWN + OPEN + CLOSE, MASK * len(ENDS + OWN + OPEN + CLOSE))
    return _sub(s, f"{HWS}(?<={THAI}{HWS})(?={HWS}*(?!{WS})(?s:.))", MASK)


def _span(s: Column) -> Column:
    n = F.char_length(s)
    inner = F.substring(s, F.lit(2), n - 2)
    body = F.rtrim(inner, F.lit(_TAIL))
    tail = F.substring(inner, F.char_length(body) + 1, n)
    whole = (n > 1) & F.substring(s, 1, 1).rlike(_class(_OPENERS))
    return F.when(whole, F.concat(F.lit(OPEN), _inside(body), tail, F.lit(CLOSE))).otherwise(s)


def _spans(p: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(p, F.lit(_SPANS), F.lit(0)), _span), "")


def _nests(p: Column) -> Column:
    """Spans until no pair is left: a pass closes one at least, so the opening marks bound them."""

    def step(acc: Column, _: Column) -> Column:
        after = F.element_at(F.transform(F.array(_spans(acc["p"])), lambda q: F.struct(q.alias("p"), (q != acc["p"]).alias("more"))), 1)
        return F.when(acc["more"], after).otherwise(acc)

    levels = F.sequence(F.lit(1), F.regexp_count(p, F.lit(_class(_OPENERS))))
    return F.aggregate(levels, F.struct(p.alias("p"), F.lit(True).alias("more")), step, lambda acc: acc["p"])


def _urls(p: Column) -> Column:
    """Mask the marks inside addresses, whatever their length; the last character may end a sentence."""
    inner = lambda x: F.concat(F.translate(F.substring(x, F.lit(1), F.char_length(x) - 1), ".!?", MASK * 3), F.right(x, F.lit(1)))
    pieces = F.regexp_extract_all(p, F.lit(r"(?:://|www)\S*+|[^:w]++|(?s:.)"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike("^(?:://|www)"), inner(x)).otherwise(x)), "")


def _dot(before: str, after: str = "") -> str:
    """What stands before and after a period that ends no sentence; the search begins at the periods, which are few."""
    return rf"(?<={before}\.){after}"


#: A number at the beginning of a line, not after a number sign.
_LIST_NUMBER = rf"(?m:^)(?<!№{WS}{{1,3}})({HWS}*+\p{{Nd}}{{1,3}})\.(?={WS}+\S)"
#: Periods inside numbers and after abbreviations, all in one search.
_PERIODS = r"\.(?:" + "|".join([
    _dot(r"\p{Nd}", r"(?=\p{Nd})"),
    _dot(OTHER_MARKS, r"(?!\.)"),
    _dot(r"(?<![\p{N}.,])\p{Nd}{1,2}", rf"(?={WS}+(?:{ORDINAL})(?!\p{{L}}))"),
    _dot(rf"{LETTER_BEFORE}(?iu:{TITLES})", r"(?!\.)"),
    _dot(rf"{LETTER_BEFORE}[a-z]", rf"(?={WS}*{TWO_PART}\.)"),
    _dot(rf"{LETTER_BEFORE}(?<!\p{{Nd}}{WS}{{1,2}})(?iu:{UNITS})", rf"(?={WS}*\p{{L}})"),
    _dot(rf"{LETTER_BEFORE}(?:{NUMBERED})", rf"(?={WS}*\p{{Nd}})"),
    *(
        _dot(rf"{LETTER_BEFORE}(?:{unit})", rf"(?={WS}*\p{{Nd}}+{WS}*(?:(?:{smaller})(?!\p{{L}})|\p{{Ll}}{{0,2}}$))")
        for unit, smaller in COUNTED.items()
    ),
]) + ")"
#: Periods after initials; sees those masked before it.
_INITIALS = r"\." + _dot(rf"{LETTER_BEFORE}\p{{Lu}}", rf"(?={WS}*\p{{Lu}}(?:[\p{{Ll}}.'’ʼ\u00ad\u200b{MASK}]|$))")


def _mask(p: Column) -> Column:
    """Mask what ends no sentence; every replacement has the length of what it replaces."""
    return _one_by_one(
        p,
        lambda c: F.when(c.contains("://") | c.contains("www."), _urls(c)).otherwise(c),
        lambda c: F.when(c.contains(";") | c.contains("\u037e"), _sub(c, rf"[;\u037e](?<={GREEK}[;\u037e])", "?")).otherwise(c),
        lambda c: F.when(c.contains("."), _sub(_sub(_sub(c, _LIST_NUMBER, "$1" + MASK), _PERIODS, MASK), _INITIALS, MASK)).otherwise(c),
    )


def _cut_patterns() -> str:
    """Ends of units in spaced scripts, before white space, before a capital letter, before a number; one search."""
    noise = rf"(?:(?:</?[^<>\s]++>|{OPEN}[\p{{Lu}}_]++{CLOSE}|�+){WS}*)?"  # tags and special tokens
    begin = rf"{noise}(?:[—–−-]{WS}*)?[{OPEN}\"“„«(\[¿¡…{WS[1:-1]}]*"
    goes_on = rf"(?!{begin}(?:{LOWER}|$))(?![,;:=+*/^_%&|>)\]}}»”{CLOSE}{ENDS}{OWN}])"
    end = rf"[{ENDS}]+[\ufe0f\p{{M}}]*(?:{WS}*+{CLOSE}|[»”)\]])*+"  # possessive: no stack frame for each
    upper = rf"(?:\p{{Lu}}[\p{{Ll}}\s\u00a0'’]|[a-zа-яіїєґ]{WS}?=|\p{{Ll}}\p{{Lu}})"
    spaced = rf"{end}(?={WS}+\S)(?={WS}+{goes_on})"
    joined = rf"(?:\.(?<=[\p{{Ll}}\p{{M}}\p{{Nd}}}}$\]){CLOSE}]\.)|[!?…]|\.\.){CLOSE}*+(?=(?:[—–]{WS}*)?{OPEN}*{upper})"
    numbered = rf"(?:\.(?<=\p{{L}}{{5}}\.)|[!?…]|\.\.)(?=\p{{Nd}}+[.)]?{WS}+\p{{L}})"
    return f"(?=[{ENDS}])(?:{spaced}|{joined}|{numbered})"  # the first look rules out most places


_CUTS = _cut_patterns()
_NO_SCRIPT = "^" + _all_but(_spelled(CJK) + _spelled(THAI) + OWN) + "*+$"
_ELLIPSES = rf"((?<={CJK})(?:…|\.{{3}})+)(?={CJK})"
_OWN_BARE = rf"([{OWN}]+)(?!{WS}*[{OWN}{ENDS}{CLOSE}»”)\]」』])(?={WS}*\S)"
_OWN_CLOSED = rf"([{OWN}]+(?:{WS}*+{CLOSE})++)(?!{WS}*(?:[とっ、，,;:—–{OWN}{ENDS}{CLOSE}]|\p{{Ll}}))(?={WS}*\S)"
_THAI_SPACE = rf"(?<={THAI}){HWS}+(?![\p{{Nd}}{WS[1:-1]}])(?=\S)"


def _cuts(p: Column) -> Column:
    """Put a CUT after every unit of a masked paragraph."""
    scripts = lambda c: F.when(
        ~c.rlike(_NO_SCRIPT), _sub(_sub(_sub(_sub(c, _ELLIPSES, "$1" + CUT), _OWN_BARE, "$1" + CUT), _OWN_CLOSED, "$1" + CUT), _THAI_SPACE, "$0" + CUT)
    ).otherwise(c)
    return _one_by_one(_sub(p, _CUTS, "$0" + CUT), scripts)


_OPENER = r"(?=[«„「『《【（(\[\"“])(?:[^\"“]|(?<![^\s\u00a0(—-])[\"“](?=\S))"


def _open_end(p: Column) -> Column:
    """What an unclosed quotation or bracket holds, up to the end of its paragraph."""

    def rest(before: Column) -> Column:
        at = F.char_length(before)
        held = F.concat(before, _inside(F.substring(p, at + 1, F.char_length(p))))
        return F.when((at > 0) | p.rlike("^" + _OPENER), held).otherwise(p)

    return F.element_at(F.transform(F.array(F.regexp_extract(p, rf"(?s)^(.*?){_OPENER}", 1)), rest), 1)


def _held(p: Column) -> Column:
    """Mask what quotations and brackets hold: closed ones first, most of them in one pass."""
    rest = lambda c: F.when(c.rlike(_NO_OPENER), c).otherwise(_one_by_one(c, _nests, _open_end))
    return F.when(p.rlike(_NO_OPENER), p).otherwise(_one_by_one(p, _spans, rest))


def _one_by_one(c: Column, *steps) -> Column:
    """Each step on its own: as one expression, conditions would repeat the text before them."""
    return reduce(lambda x, f: F.element_at(F.transform(F.array(x), f), 1), steps, c)


def paragraphs(text: Column) -> Column:
    """Blank lines part them; joined again they are the text."""
    neutral = _sub(text, f"[\ue000-\ue0ff]", NEUTRAL)
    return F.split(_sub(neutral, rf"{BREAK}{HWS}*{BREAK}{WS}*", "$0" + CUT), CUT, -1)


def pieces(text: Column) -> Column:
    """Array of masked units with the white space around them; their lengths are true."""
    cut = lambda p: _one_by_one(p, _mask, _held, _cuts)
    return F.split(F.array_join(F.transform(paragraphs(text), cut), CUT), CUT, -1)


BLOCK = 256  # units placed at once: running sums over arrays copy them


def units(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, sent_start, sent_end)``: every sentence unit of every row's whole text.

    Offsets are code points from 0, the end exclusive.  Null, empty and blank texts
    have no unit; repeated rows have theirs each; other columns are not read.  No
    Python, no shuffle but that of a table too small to be split.
    """
    length = lambda xs: F.char_length(F.array_join(xs, ""))
    rows = dealt(df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")))
    rows = rows.select("key", pieces(F.col("text")).alias("p"))
    rows = rows.select(
        "key",
        F.transform(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / BLOCK).cast("int")), lambda i: F.slice("p", i * BLOCK + 1, BLOCK)).alias("blocks"),
    )
    starts = F.aggregate(
        "blocks", F.array(F.lit(0)),
        lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + length(b)),
    )
    rows = rows.select("key", F.explode(F.arrays_zip(F.col("blocks").alias("b"), F.slice(starts, 1, F.size("blocks")).alias("at"))).alias("x"))
    left = lambda p: F.char_length(p) - F.char_length(F.ltrim(p, F.lit(_BLANKS)))
    bare = lambda p: F.char_length(F.btrim(p, F.lit(_BLANKS)))
    none = F.expr("array()").cast("array<struct<a:int,n:int>>")
    placed = F.aggregate(
        F.col("x.b"),
        F.struct(F.col("x.at").alias("at"), none.alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p)).alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + left(p)).alias("a"), bare(p).alias("n"))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return (
        rows.select("key", F.inline(placed))
        .where("n > 0")
        .select(F.col("key").alias(key), F.col("a").cast("int").alias("sent_start"), (F.col("a") + F.col("n")).cast("int").alias("sent_end"))
    )


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`units` with their text and number: the unmasked text restored by its offsets.

    The text rides along per document as an array taken apart, not joined again.
    """
    whole = df.where(F.col(text).isNotNull()).select(F.struct(F.col(key).alias("k"), F.col(text).alias("t")).alias("row"), F.col(text).alias("text"))
    cut = units(whole, "row", "text")
    return cut.select(
        F.col("row.k").alias(key), "sent_start", "sent_end",
        F.substring(F.col("row.t"), F.col("sent_start") + 1, F.col("sent_end") - F.col("sent_start")).alias("sentence"),
    )
