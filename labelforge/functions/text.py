"""Tokenisation equal to Python's ``text.lower().split()``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.split() treats as whitespace, as one
# regex class that Java regex and RE2 both read the same way.
WHITESPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


# Fixed value: the same characters, one by one.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def tokenize(text: Column | str) -> Column:
    """Lower-case, split on Unicode whitespace runs, drop empty tokens.

    No stop words and no punctuation handling: ``"Paris."`` stays one token.
    Every white-space character becomes a space first, so the split is on one
    plain character.
    """
    c = F.col(text) if isinstance(text, str) else text
    spaced = F.translate(F.lower(c), WHITESPACE_CHARS, " " * len(WHITESPACE_CHARS))
    return F.array_remove(F.split(spaced, " "), "")
