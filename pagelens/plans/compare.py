"""SQL of edit distances in code points and in words, for checking.

The checking engine counts bytes, so the distinct characters (or words) of a pair are
first numbered and spelled as single bytes; a pair may have 127 of them.
"""

from __future__ import annotations

BLANK = r"[\s\x{000b}\x{00a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x{1680}\x{001c}-\x{001f}]"


def _spelled(items: str, known: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x: chr(CAST(list_position({known}, x) AS INT))), '')"


def chars(a: str, b: str) -> str:
    of = lambda x: f"regexp_extract_all({x}, '(?s).')"
    known = f"list_distinct(list_concat({of(a)}, {of(b)}))"
    return f"CASE WHEN {a} = {b} THEN 0 ELSE levenshtein({_spelled(of(a), known)}, {_spelled(of(b), known)}) END"


def words_of(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{BLANK}+'), lambda w: w <> '')"


def words(a: str, b: str) -> str:
    known = f"list_distinct(list_concat({words_of(a)}, {words_of(b)}))"
    return f"CASE WHEN {a} = {b} THEN 0 ELSE levenshtein({_spelled(words_of(a), known)}, {_spelled(words_of(b), known)}) END"


def wer(pred: str, gt: str) -> str:
    return f"({words(pred, gt)}) / CAST(greatest(len({words_of(gt)}), 1) AS DOUBLE)"
