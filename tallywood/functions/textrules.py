"""Regular expressions and text rules that must hold alike in the JVM and in Python.

Word borders, digits and word characters are ASCII here and white space is the set that
ECMAScript names, so patterns spell these out instead of using \\b, \\d, \\w or \\s.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as the inside of a character class.
SPACE = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
WORD = "A-Za-z0-9_"
#: A border between a word character and another, ASCII only.
EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def expand(pattern: str) -> str:
    """Replaces <edge>, <space> (a class), <s> (inside a class) and <digit> in a pattern."""
    return pattern.replace("<edge>", EDGE).replace("<space>", f"[{SPACE}]").replace("<s>", SPACE).replace("<digit>", "[0-9]")


def js_trim(col: Column) -> Column:
    """Strips the whole white-space set at both ends."""
    return F.regexp_replace(F.regexp_replace(col, f"^[{SPACE}]+", ""), f"[{SPACE}]+\\z", "")


def collapse(col: Column) -> Column:
    return js_trim(F.regexp_replace(col, f"[{SPACE}]+", " "))


def has_non_latin(col: Column) -> Column:
    """Whether there is a letter of another script than Latin."""
    return col.rlike("[\\p{L}&&[^\\p{IsLatin}]]")


def cut_points(col: Column, most: int) -> Column:
    """The first `most` code points; a longer text loses its end and trailing blanks to an ellipsis."""
    cut = F.regexp_replace(F.substring(col, 1, most - 1), f"[{SPACE}]+\\z", "")
    return F.when(F.length(col) <= most, col).otherwise(F.concat(cut, F.lit("…")))
