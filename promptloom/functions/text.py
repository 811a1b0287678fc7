"""Small text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: everything that counts as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` knows only spaces)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def unescape_code(text: Column) -> Column:
    r"""Turn ``\_`` into ``_`` inside fenced blocks, if the fences pair up."""
    blocks = F.split(text, "\n```", -1)
    fixed = F.transform(
        blocks,
        lambda b, i: F.when(i % 2 == 1, F.replace(b, F.lit("\\_"), F.lit("_"))).otherwise(b),
    )
    return F.when(
        (F.size(blocks) > 1) & (F.size(blocks) % 2 == 1), F.array_join(fixed, "\n```")
    ).otherwise(text)


def truncate_stop(text: Column, stop: str) -> Column:
    """Text before the last occurrence of ``stop``; unchanged without one."""
    if not stop:
        raise ValueError("empty stop string")
    back = F.instr(F.reverse(text), stop[::-1])
    return F.when(
        back > 0, F.substring(text, F.lit(1), F.length(text) - (back - 1) - len(stop))
    ).otherwise(text)


def count_words(text: Column) -> Column:
    """Default token counter: runs of non-space characters."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
