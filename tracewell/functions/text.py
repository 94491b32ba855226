"""Trimming and word search on text columns."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

WORD = r"\p{L}\p{N}\p{M}"


def trim_blank(text: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


@lru_cache(maxsize=1)
def _letter_variants() -> dict[str, str]:
    """Base character -> every letter that folds to it (case and accents)."""
    out: dict[str, set[str]] = {}
    for code in range(0x80, 0x2000):
        char = chr(code)
        if unicodedata.category(char)[0] == "L":
            out.setdefault(fold(char), set()).add(char)
    return {base: "".join(sorted(chars)) for base, chars in out.items() if len(base) == 1}


def fold(word: str) -> str:
    """Lower case without accents."""
    parts = unicodedata.normalize("NFD", word.lower())
    return "".join(c for c in parts if unicodedata.category(c) != "Mn")


def words_of(text: str) -> list[str]:
    """Search words of a user's text: runs of letters and digits, folded."""
    return [fold(w) for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFC", text))]


def _word_pattern(word: str) -> str:
    out = []
    for char in word:
        variants = {char, char.upper(), *_letter_variants().get(char, "")}
        single = "".join(sorted(v for v in variants if len(v) == 1))
        out.append(f"[{single}]" + r"\p{M}*" if char.isalpha() else re.escape(char))
    return "".join(out)


def word_regex(words: list[str], prefix: bool = False) -> str:
    """Regex for one word, or several in a row, as whole words.

    Case and accents are ignored; anything that is neither letter nor digit
    separates words. ``prefix`` lets the last word go on.
    """
    gap = rf"[^{WORD}]+"
    body = gap.join(_word_pattern(w) for w in words)
    tail = "" if prefix else rf"(?![{WORD}])"
    return rf"(?<![{WORD}]){body}{tail}"


def highlight(text: Column, words: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """Wrap every occurrence of the given words."""
    return F.regexp_replace(text, "(" + "|".join(word_regex([w]) for w in words) + ")", f"{before}$1{after}")


def matches_of(text: Column, words: list[str]) -> Column:
    """Array of the matched snippets, in order of appearance."""
    pattern = "(" + "|".join(word_regex([w]) for w in words) + ")"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def fold_column(text: Column) -> Column:
    """Lower case without accents, as :func:`fold` does for words."""
    pairs = [(v, base) for base, variants in _letter_variants().items() for v in variants if len(v) == 1]
    plain = F.translate(F.lower(text), "".join(v for v, _ in pairs), "".join(b for _, b in pairs))
    return F.regexp_replace(plain, r"\p{M}+", "")
