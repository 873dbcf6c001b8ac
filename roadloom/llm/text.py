"""Native text expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITESPACE = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """The runs of characters other than :data:`WHITESPACE`, as an array."""
    return F.array_remove(F.split(F.translate(text, WHITESPACE[1:], " " * 5), " "), "")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def fresh(df, *names: str) -> list[str]:
    """For each name, one that clashes with no column of ``df`` (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and all other letters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
