"""Edit distances and error rates as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, bound

DISTINCT_WORDS = 2**20  # characters beyond the basic plane


def chars(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points; equal texts are not compared."""
    return F.when(a == b, 0).otherwise(F.levenshtein(a, b))


def lines(a: Column, b: Column) -> Column:
    """:func:`chars` of two texts given as arrays of lines; lines equal at both ends are not compared.

    One line at least is kept of each, so that the line breaks stay right.
    """

    def differing(r: Column) -> Column:
        most = F.least(F.size(r["a"]), F.size(r["b"])) - 1
        alike = lambda n: F.coalesce(F.nullif(F.array_position(F.zip_with(r["a"], r["b"], lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)), F.lit(0)) - 1, n)
        k = F.greatest(F.lit(0), F.least(alike(most), most)).cast("int")
        return F.struct(*(F.reverse(F.slice(r[c], k + 1, F.size(r[c]))).alias(c) for c in ("a", "b")))

    joined = lambda r: chars(F.array_join(r["a"], "\n"), F.array_join(r["b"], "\n"))
    return F.when(a == b, 0).otherwise(bound(F.struct(a.alias("a"), b.alias("b")), differing, differing, joined))  # turned over twice


def cer(pred: Column, gt: Column) -> Column:
    """Distance over the length of the truth, which counts at least 1; not bounded above."""
    return chars(pred, gt) / F.greatest(F.char_length(gt), F.lit(1))


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def words(a: Column, b: Column) -> Column:
    """Levenshtein distance in words: each distinct word of the pair becomes one character.

    The k-th distinct word is spelled as the k-th character beyond the basic plane, a
    pair of surrogates; a million distinct words in one pair would take 10^12 steps anyway.
    """
    known = F.array_distinct(F.concat(words_of(a), words_of(b)))

    def distance(r: Column) -> Column:
        def letter(w: Column) -> Column:
            k = F.array_position(r["k"], w) - 1
            pair = F.lit(0xD800DC00) + F.shiftright(k, 10) * F.lit(0x10000) + k.bitwiseAND(F.lit(1023))
            return F.decode(F.unhex(F.hex(pair)), "UTF-16BE")

        spell = lambda ws: F.array_join(F.transform(ws, letter), "")
        return F.levenshtein(spell(r["x"]), spell(r["y"]))

    apart = bound(F.struct(words_of(a).alias("x"), words_of(b).alias("y"), known.alias("k")), distance)
    return F.when(a == b, 0).otherwise(apart)


def wer(pred: Column, gt: Column) -> Column:
    return words(pred, gt) / F.greatest(F.size(words_of(gt)), F.lit(1))
