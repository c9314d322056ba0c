"""String expressions of the whole engine, all inside Catalyst."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind: Unicode's, and the control characters that also part words.
_SPACE = "[\\s\\x1c-\\x1f]"


def _wide() -> tuple[str, str]:
    """Full-width and half-width letters and digits with the characters they stand for, by the compatibility rule of Unicode."""
    pairs = [(chr(c), n) for c in range(0xFF01, 0xFFEF) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isalnum()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


WIDE, NARROW = _wide()


def bare(c: Column) -> Column:
    """Letters and digits only; case, white space, punctuation and full or half width are ignored. Null stays null.

    Nearly all text has no wide letter or digit, so the costly ``translate`` is behind a test.
    """
    narrow = F.when(c.rlike("[０-９Ａ-Ｚａ-ｚｦ-ￜ]"), F.translate(c, WIDE, NARROW)).otherwise(c)
    return F.regexp_replace(F.lower(narrow), "[^\\p{L}\\p{N}]+", "")


def strip_all(c: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` keeps the ideographic and the no-break space)."""
    return F.regexp_replace(c, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Without white space anywhere."""
    return F.regexp_replace(c, f"(?U){_SPACE}+", "")


def occurrences(text: Column, word: Column) -> Column:
    """Number of non-overlapping occurrences; 0 for an empty word."""
    n = F.length(word)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / n).cast("long")).otherwise(F.lit(0).cast("long"))
