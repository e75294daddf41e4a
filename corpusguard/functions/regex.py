"""RE2 patterns expressed for Spark's Java regex engine."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusguard.fixed_values import PAGE_PATTERNS, PATTERNS

_ASCII_SPACE = r"\t\n\f\r "
_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
# Letters outside ASCII that fold into an ASCII letter: long s and the Kelvin sign.
# Java's Unicode folding also takes the Turkish i's, so its flag cannot be used.
_FOLDED = {"s": r"\u017F", "k": r"\u212A"}
_TOKEN = re.compile(r"\\.|\[(?:\\.|\[:\w+:\]|[^\]\\])*\]|.", re.S)
_CLASS_ITEM = re.compile(r"\\.|\[:\w+:\]|([A-Za-z])-([A-Za-z])|[A-Za-z]", re.S)


def _both_cases(first: str, last: str) -> str:
    """Class body with both cases of a letter range and what folds into it."""
    low, high = first.lower(), last.lower()
    ends = low if low == high else f"{low}-{high}"
    return ends + ends.upper() + "".join(c for letter, c in _FOLDED.items() if low <= letter <= high)


def _any_case(pattern: str) -> str:
    """Spell out case folding: every letter becomes a class, every class holds both cases."""

    def item(m: re.Match) -> str:
        if m[1]:
            return _both_cases(m[1], m[2])
        return _both_cases(m[0], m[0]) if len(m[0]) == 1 else m[0]

    def token(m: re.Match) -> str:
        if len(m[0]) > 1 and m[0][0] == "[":
            return _CLASS_ITEM.sub(item, m[0])
        if m[0].isascii() and m[0].isalpha():
            return f"[{_both_cases(m[0], m[0])}]"
        return m[0]

    return _TOKEN.sub(token, pattern)


@lru_cache(maxsize=None)
def java_pattern(re2: str) -> str:
    """Rewrite the places where the two dialects differ.

    RE2 classes are ASCII, its case folding is Unicode's simple one and its ``$``
    matches only at the very end; Java's defaults differ in all three.
    """
    p = re2
    if p.startswith("(?i)"):
        p = _any_case(p[4:])
    elif p.startswith("(?is)"):
        p = "(?s)" + _any_case(p[5:])
    p = p.replace(r"[^\s", f"[^{_ASCII_SPACE}")
    p = p.replace(r"\b", _BOUNDARY)
    p = p.replace(r"\s", f"[{_ASCII_SPACE}]").replace(r"\S", f"[^{_ASCII_SPACE}]")
    return p.replace("[:space:]", r"\s").replace("$", r"\z")


# Java backtracks where RE2 does not: tried from every bracket, tag or word of a very long
# text, these patterns take quadratic time.  The forms below find the same but give back no
# blanks, and start once per stretch that can hold a match:
# - a scheme from the start of its run of scheme characters,
# - a bracket pair from its first bracket after the previous "]" or match.
# Where an attempt has read far ahead in vain, two of them end as a match of nothing that
# passes over what can't start a match any more (see _SKIPPING):
# - all the rest, if the closing ")" or "</h1>" or ">" is not in the text any more,
# - a link target up to its last "]", if what ends the target rules out every link into it.
_RUN = r"[a-zA-Z0-9+.\-\u017F\u212A]"
_STRETCH = r"(?:\G|(?<=\]))"
_TARGET = rf"[^{_ASCII_SPACE})>]"
_LINEAR = {
    "credential_url": rf"(?<!{_RUN})(?={_RUN}*+://)(?>{_RUN}*?{_BOUNDARY}[a-zA-Z\u017F\u212A]){_RUN}*+"
    r"://[^/\s:@]+:[^/\s@]{4,}@",
    "wiki_link": rf"{_STRETCH}(?>[^\]]*?\[\[)[^\]]++\]\]",
    "markdown_link": rf"{_STRETCH}(?>[^\[\]]*?(!?)\[)[^\]]*+\]\([{_ASCII_SPACE}]*+(?:"
    + rf"(?:<(?={_TARGET}))?+({_TARGET}++)>?(?:[{_ASCII_SPACE}]++[^)]*+)?\)"
    + rf"|{_TARGET}++>?+[{_ASCII_SPACE}]++[^)]*+\z"
    + rf"|(?:{_TARGET}*\])?+)",
    "html_tag": java_pattern(PATTERNS["html_tag"]).replace(
        rf"<[{_ASCII_SPACE}]*/?[{_ASCII_SPACE}]*", rf"<[{_ASCII_SPACE}]*+(?:/[{_ASCII_SPACE}]*+)?"
    ),
    # The first group ends with the closing tag, so that it is not empty.
    "heading": java_pattern(r"(?is)<h1\b") + r"[^>]*+(?:>(?:(.*?" + java_pattern("(?i)</h1>") + r")|.*+)|\z)",
}
# Matches in which this group is empty are none.
_SKIPPING = {"markdown_link": 2, "heading": 1}


def line_pattern(name: str) -> str:
    return _LINEAR.get(name) or java_pattern(PATTERNS[name])


def matches(value: Column, name: str) -> Column:
    """True if the named line pattern is found in ``value``."""
    if name in _SKIPPING:
        return F.exists(extract_all(value, name, _SKIPPING[name]), lambda x: x != "")
    return F.rlike(value, F.lit(line_pattern(name)))


def matches_re2(value: Column, re2: str) -> Column:
    return F.rlike(value, F.lit(java_pattern(re2)))


def extract_all(value: Column, name: str, group: int) -> Column:
    """A group of every match; of a pattern that skips, matches of nothing are still among them."""
    pattern = line_pattern(name) if name in PATTERNS or name in _LINEAR else java_pattern(PAGE_PATTERNS[name])
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(group))
