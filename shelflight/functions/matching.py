"""Ordered rule lists as one column expression each."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when any of the words is a substring of the text."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def first_contained(text: Column, rules: Iterable[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first pattern, in list order, that the text contains.

    A pattern that contains an earlier pattern can never be the first hit, and neither can
    a repeated one, so such rules are left out of the expression.
    """
    live: list[tuple[str, str]] = []
    for pattern, value in rules:
        if not any(earlier in pattern for earlier, _ in live):
            live.append((pattern, value))
    hits = [F.when(F.contains(text, F.lit(p)), F.lit(v)) for p, v in live]
    return F.coalesce(*hits, F.lit(default))


def mentions(text: Column, tokens: Column, keywords: Sequence[str]) -> Column:
    """A single word must equal a token; a phrase may appear anywhere in the text."""
    phrases = [k for k in keywords if " " in k]
    found = F.arrays_overlap(tokens, strings(k for k in keywords if " " not in k))
    return found | contains_any(text, phrases) if phrases else found


def null_like(text: Column, words: Sequence[str]) -> Column:
    return F.lower(F.trim(text)).isin(*words)
