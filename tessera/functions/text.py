"""Scalar text functions (Column -> Column), all JVM-side except NFC.

Every function mirrors a Python string idiom of the reference exactly:
``str.split()`` / ``str.strip()`` use Python's whitespace set, which is Java's
``(?U)\\s`` plus U+001C..U+001F.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Python's str.isspace() set, as a Java character class.
WS_CLASS = "[\\s\\x1c-\\x1f]"
WS_RUN = f"(?U){WS_CLASS}+"
_STRIP = f"(?U)^{WS_CLASS}+|{WS_CLASS}+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(col) -> Column:
    """``str.strip()``: removes all whitespace at both ends (Spark ``trim`` only removes spaces)."""
    return F.regexp_replace(_c(col), _STRIP, "")


def py_rstrip(col) -> Column:
    return F.regexp_replace(_c(col), f"(?U){WS_CLASS}+$", "")


def py_split(col) -> Column:
    """``str.split()``: split on whitespace runs, no empty tokens."""
    return F.array_remove(F.split(_c(col), WS_RUN), "")


def collapse_ws(col) -> Column:
    """``' '.join(s.split())``."""
    return py_strip(F.regexp_replace(_c(col), WS_RUN, " "))


# ---------------------------------------------------------------------------
# Scripts. Fixed values of the reference (Tibetan marks and the block range):
#   syllable mark U+0F0B '་'; sentence marks U+0F0D '།' and U+0F0E '༎';
#   script block U+0F00..U+0FFF.
# ---------------------------------------------------------------------------
TSHEG = "་"
SHAD = "།"
NYIS_SHAD = "༎"


@dataclass(frozen=True)
class Script:
    """How a language is tokenised and joined, and which code points mark it."""

    name: str
    kind: str  # "marks": split on mark characters, case kept; "words": lower + whitespace split
    mark: str = TSHEG
    ends: tuple[str, ...] = (SHAD, NYIS_SHAD)
    joiner: str = " "
    lo: int = 0x0F00
    hi: int = 0x0FFF

    def tokens(self, col) -> Column:
        if self.kind == "marks":
            return syllables(col, self.mark, self.ends)
        return words_lower(col)


TIBETAN = Script("bo", "marks", joiner="")
ENGLISH = Script("en", "words", joiner=" ")
# Stand-in for the driver tables, which hold no Tibetan: marks are the space and
# the full stop, the "script" is Latin-1 letters U+00C0..U+00FF. Joined with its
# mark (a space), so that a translation into it can be tokenised again.
LATIN_MARKS = Script("xx", "marks", mark=" ", ends=(".", "\n"), joiner=" ", lo=0x00C0, hi=0x00FF)


def syllables(col, mark: str = TSHEG, ends: tuple[str, ...] = (SHAD, NYIS_SHAD)) -> Column:
    """Sentence marks count as syllable marks; split; drop empty strings.

    Spaces are neither separators nor stripped (the reference keeps ``" ང"``).
    """
    cls = "[" + "".join(re.escape(ch) if ch != "\n" else "\\n" for ch in (mark, *ends)) + "]"
    return F.array_remove(F.split(_c(col), cls), "")


words = syllables  # P2 is an alias of P1 in the reference


def words_lower(col) -> Column:
    """``text.lower().split()``; punctuation stays attached."""
    return py_split(F.lower(_c(col)))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC (Spark has no normalise function); Arrow-batched."""
    return s.str.normalize("NFC")


def normalise_script(col, end_mark: str = SHAD) -> Column:
    """P5: NFC, a space after every sentence mark, whitespace runs collapsed, stripped."""
    c = _c(col)
    x = F.coalesce(nfc(F.when(c.rlike("[^\\x00-\\x7F]"), c)), c)  # NFC leaves ASCII as it is: such texts stay in the JVM
    x = F.replace(x, F.lit(end_mark), F.lit(end_mark + " "))
    return collapse_ws(x)


def normalise_if(col, lang_col, lang: str = "bo", end_mark: str = SHAD) -> Column:
    """P5 only when the source language is ``lang``."""
    chosen = _c(lang_col) == lang
    return F.when(chosen, normalise_script(F.when(chosen, _c(col)), end_mark)).otherwise(_c(col))


# P7, pinned intent of the reference's pattern ``^[a-zA-Z\s\p{P}0-9]+$``.
LATIN_ONLY = "\\A[a-zA-Z\\s\\p{P}0-9]+\\z"


def latin_only(col) -> Column:
    """Latin letters, digits, whitespace and punctuation only; empty is false."""
    return F.coalesce(_c(col).rlike(LATIN_ONLY), F.lit(False))


def script_class(lo: int = 0x0F00, hi: int = 0x0FFF) -> str:
    return f"[\\x{{{lo:04X}}}-\\x{{{hi:04X}}}]"


def contains_script(col, lo: int = 0x0F00, hi: int = 0x0FFF) -> Column:
    """Any code point in [lo, hi] (inclusive)."""
    return F.coalesce(_c(col).rlike(script_class(lo, hi)), F.lit(False))


def length_ratio(trans, orig) -> Column:
    """P10: ``len(trans) / max(1, len(orig))`` in code points."""
    return F.length(_c(trans)) / F.greatest(F.lit(1), F.length(_c(orig)))


def char_length(col) -> Column:
    """P11."""
    return F.length(_c(col))


def word_count(col) -> Column:
    """``len(x.split())``."""
    return F.size(py_split(col))


BUCKET_SHORT = "short (1-5 words)"
BUCKET_MEDIUM = "medium (6-15 words)"
BUCKET_LONG = "long (16+ words)"


def length_bucket(n_words) -> Column:
    """<=5 short, <=15 medium, else long (0 words is short)."""
    n = _c(n_words)
    return F.when(n <= 5, F.lit(BUCKET_SHORT)).when(n <= 15, F.lit(BUCKET_MEDIUM)).otherwise(F.lit(BUCKET_LONG))


def missing_marker(tok) -> Column:
    """``"[" + token + "]"``."""
    return F.concat(F.lit("["), _c(tok), F.lit("]"))


def percentage(n, total) -> Column:
    """N / total * 100; NULL on an empty input."""
    return F.try_divide(_c(n).cast("double"), _c(total).cast("double")) * F.lit(100.0)
