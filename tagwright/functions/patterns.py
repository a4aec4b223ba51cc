"""Wildcard patterns: predicates on a tag, and the n-gram forms of tags and patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_wildcard(pattern: str) -> bool:
    return "*" in pattern


def kind(pattern: str) -> tuple[str, str]:
    """What a pattern asks of a tag, and the text it asks for: ``*x*`` contains, ``x*`` begins, ``*x`` ends with x, where x is the pattern without any star; a star only inside asks for what no tag has; without a star, the tag equals it."""
    raw = pattern.replace("*", "")
    if not is_wildcard(pattern):
        return "equals", pattern
    first, last = pattern.startswith("*"), pattern.endswith("*")
    return {(True, True): "contains", (False, True): "begins", (True, False): "ends"}.get((first, last), "none"), raw


def matches(tag: Column, pattern: str) -> Column:
    what, text = kind(pattern)
    test = {"equals": lambda t, x: t == x, "contains": F.contains, "begins": F.startswith, "ends": F.endswith}.get(what)
    return test(tag, F.lit(text)) if test else F.lit(False)


def regex(pattern: str) -> str:
    """Stars anywhere stand for any text, everything else for itself."""
    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def like_regex(pattern: str) -> str:
    """Basic's Like, in either case: ``*`` any text, ``?`` a character, ``#`` a digit, ``[ab]`` and ``[!ab]`` lists."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 1) if c == "[" else -1
        if end > 0:
            body = pattern[k + 1 : end]
            inside = re.sub(r"([\\^\[\]])", r"\\\1", body[1:] if body.startswith("!") else body)
            out.append(f"[{'^' if body.startswith('!') else ''}{inside}]" if inside else "")
            k = end
        else:
            out.append({"*": ".*", "?": ".", "#": "[0-9]"}.get(c) or re.escape(c))
        k += 1
    return "(?is)^" + "".join(out) + "$"


def matches_regex(tag: Column, pattern: str) -> Column:
    return tag.rlike(regex(pattern)) if is_wildcard(pattern) else tag == F.lit(pattern)


def matches_like(tag: Column, pattern: str) -> Column:
    return tag.rlike(like_regex(pattern)) if is_wildcard(pattern) else tag == F.lit(pattern)


def matches_trie(tag: Column, pattern: str) -> Column:
    """As a trie of forward and reversed tags answers it: a suffix is a prefix of the reversed tag."""
    if is_wildcard(pattern) and pattern.startswith("*") and not pattern.endswith("*"):
        return F.startswith(F.reverse(tag), F.lit(pattern.replace("*", "")[::-1]))
    return matches(tag, pattern)


def index_grams(tag: Column) -> Column:
    """Two-letter grams of a tag between two anchors ``^``."""
    s = F.concat(F.lit("^"), tag, F.lit("^"))
    return F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))


def search_grams(text: str) -> list[str]:
    """Two-letter grams of a text without anchors; of a single letter, that letter; of none, none."""
    return [text] if len(text) == 1 else [text[k : k + 2] for k in range(len(text) - 1)]


def searches(pattern: str) -> list[str]:
    """The grams that a match must have; none for a pattern with a star only inside."""
    raw, first, last = pattern.replace("*", ""), pattern.startswith("*"), pattern.endswith("*")
    if not raw or not (first or last):
        return []
    grams = search_grams(raw)
    if first and last:
        return grams
    return [*grams, "^" + raw[0]] if last else [*grams, raw[-1] + "^"]
