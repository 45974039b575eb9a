"""Title cleaning and the eligibility rules for embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelflight.functions import rules
from shelflight.functions.matching import contains_any, mentions, strings

# Word characters and blanks in the Unicode sense, spelt out so that every regex engine agrees.
_NOT_WORD = r"[^\p{L}\p{N}_\s\x{85}\p{Z}-]"
_BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"


def squeeze(text: Column) -> Column:
    """Runs of blanks become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def light_clean(title: Column) -> Column:
    """Lower case, symbols to blanks, blanks squeezed."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), _NOT_WORD, " "))


def tokens_of(text: Column) -> Column:
    """Tokens of a squeezed text; none for an empty one."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def clean_title(title: Column, demographic: str = "exact") -> Column:
    """Title without long numbers, measures, marketing and audience words, or repeats.

    ``demographic="substring"`` drops a token that contains an audience word or is
    contained in one; ``"exact"`` drops only the audience words themselves.
    """
    noise = rules.MEASUREMENT_TOKENS + rules.MARKETING_TOKENS
    audience = [w for w in rules.DEMOGRAPHIC_TOKENS if " " not in w]
    if demographic == "substring":
        # A token has no blanks: it holds an audience word, or is a piece of a word of some phrase.
        words = {word for phrase in rules.DEMOGRAPHIC_TOKENS for word in phrase.split(" ")}
        pieces = sorted({w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)})

        def addressed(t):
            return t.rlike("|".join(audience)) | t.isin(*pieces)
    elif demographic == "exact":
        def addressed(t):
            return t.isin(*audience)
    else:
        raise ValueError(f"unknown demographic mode: {demographic}")
    kept = F.filter(
        tokens_of(light_clean(title)),
        lambda t: ~t.rlike(r"^\p{Nd}{3,}$") & ~t.isin(*noise) & ~addressed(t),
    )
    return F.array_join(F.slice(F.array_distinct(kept), 1, rules.MAX_TITLE_TOKENS), " ")


def eligibility_checks(title: Column) -> dict[str, Column]:
    """Each rule on a cleaned title as its own boolean column."""
    text = F.lower(F.coalesce(title, F.lit("")))
    tokens = tokens_of(squeeze(text))
    semantic = mentions(text, tokens, rules.EMBED_KEYWORDS)

    hair_named = F.array_contains(tokens, "hair")
    hair_specific = contains_any(text, rules.SPECIFIC_HAIR_OBJECTS)
    makeup_named = F.array_contains(tokens, "makeup") | F.contains(text, F.lit("make up"))
    makeup_specific = contains_any(text, rules.SPECIFIC_MAKEUP_OBJECTS)
    generic_named = F.arrays_overlap(tokens, strings(rules.GENERIC_WORDS))
    return {
        "negative": mentions(text, tokens, rules.NEGATIVE_KEYWORDS),
        "bare_face": F.contains(text, F.lit("face")) & ~mentions(text, tokens, rules.FACE_CONTEXT_KEYWORDS),
        "enough_tokens": F.size(tokens) >= rules.MIN_TITLE_TOKENS,
        "semantic": semantic,
        "specific": (~hair_named | hair_specific)
        & (~makeup_named | makeup_specific)
        & (~generic_named | semantic),
    }


def checked(title: Column) -> Column:
    """All rules and the token count of a cleaned title as one struct, to be computed once per row."""
    count = F.size(tokens_of(squeeze(F.coalesce(title, F.lit("")))))
    return F.struct(*[c.alias(n) for n, c in eligibility_checks(title).items()], count.alias("tokens"))


def is_eligible(checks: Column) -> Column:
    c = checks
    return ~c["negative"] & ~c["bare_face"] & c["enough_tokens"] & c["semantic"] & c["specific"]


def rejection_reasons(checks: Column) -> Column:
    """Why a title is not eligible, in the order of the report; null for eligible titles."""
    c = checks
    reasons = F.array_compact(
        F.array(
            F.when(~c["enough_tokens"], F.concat(F.lit("< 3 tokens ("), c["tokens"].cast("string"), F.lit(")"))),
            F.when(~c["semantic"], F.lit("no semantic keyword")),
            F.when(~c["specific"], F.lit("no specific object")),
        )
    )
    listed = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("unknown")))
    return F.when(~is_eligible(c), listed)
