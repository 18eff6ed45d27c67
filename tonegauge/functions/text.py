"""Text, token and keyword expressions. All of them are built-in column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonegauge import constants as K


# all characters that count as white space at the ends of a text
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def no_strings() -> Column:
    return F.array().cast("array<string>")


def token_estimate(text: Column) -> Column:
    """Four code points per token, rounded down."""
    return F.shiftright(F.length(text), 2).cast("bigint")


def escaped_length(text: Column) -> Column:
    """Length of ``text`` inside a JSON string with every non-ASCII character escaped, quotes excluded.

    Spark's own JSON writer gives the length with quotes, backslashes and controls escaped. What it
    leaves alone (DEL and all beyond) is six characters each, twelve in the astral planes, where one
    code point makes two UTF-16 units. Two byte counts tell which rows need that second part.
    """
    written = F.length(F.to_json(F.struct(text.alias("t")))) - len('{"t":""}')
    left_alone = F.length(F.regexp_replace(text, r"[\x00-\x7e]+", ""))
    astral = F.shiftright(F.octet_length(F.encode(text, "UTF-16BE")), 1) - F.length(text)
    plain = (F.octet_length(text) == F.length(text)) & ~F.contains(text, F.lit("\x7f"))
    beyond = F.when(plain, F.lit(0)).otherwise(5 * left_alone + 6 * astral)
    return F.when(text.isNotNull(), (written + beyond).cast("bigint"))


def clip_to_limit(text: Column, max_tokens: int = K.MAX_TEXT_TOKENS, note: str = K.TRUNCATION_NOTE) -> Column:
    """Cut texts above the model limit and say so; shorter texts stay whole."""
    kept = max_tokens * K.CHARS_PER_TOKEN
    return F.when(token_estimate(text) > max_tokens, F.concat(F.substring(text, 1, kept), F.lit(note))).otherwise(text)


def shorten(text: Column, max_length: int = 100, suffix: str = "...") -> Column:
    """Display form whose total length never exceeds ``max_length``."""
    kept = max_length - len(suffix)
    return F.when(F.length(text) > max_length, F.concat(F.substring(text, 1, kept), F.lit(suffix))).otherwise(text)


def excerpt(text: Column, characters: int = 500) -> Column:
    return F.concat(F.substring(text, 1, characters), F.lit("..."))


def text_after_marker(content: Column, marker: str = K.TEXT_MARKER) -> Column:
    """All lines after the first line that holds ``marker``; NULL where there are none."""
    return F.nullif(F.regexp_extract(content, rf"(?s)\Q{marker}\E[^\n]*\n(.*)", 1), F.lit(""))


def until_marker(text: Column, marker: str = K.TASK_MARKER) -> Column:
    """The part before ``marker``, stripped of blanks; the whole text, unstripped, without it."""
    return F.when(F.contains(text, F.lit(marker)), F.btrim(F.substring_index(text, marker, 1), F.lit(BLANKS))).otherwise(text)


def matched_terms(text: Column, terms: Sequence[str], word_boundary: bool = False) -> Column:
    """Terms present in the lower-cased text, in list order: substrings, or whole words on request."""
    lowered = F.lower(text)

    def present(term: str) -> Column:
        return lowered.rlike(rf"\b{re.escape(term)}\b") if word_boundary else lowered.contains(term)

    return F.concat(*[F.when(present(term), F.array(F.lit(term))).otherwise(no_strings()) for term in terms])


def score_verdict(score: Column, hawkish: Column, dovish: Column) -> Column:
    """Does the score agree with the number of distinct terms found on either side?"""

    def pick(stance: str, agrees: Column) -> Column:
        return F.when(agrees, F.lit(K.VERDICTS[stance, True])).otherwise(F.lit(K.VERDICTS[stance, False]))

    return (
        F.when(score > 20, pick("hawkish", hawkish > dovish))
        .when(score < -20, pick("dovish", dovish > hawkish))
        .otherwise(pick("neutral", F.abs(hawkish - dovish) <= 2))
    )
