"""Text expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the corpus contracts: \x20 and \x09 to \x0D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.  Pure ASCII texts take lower(), which is faster and the same there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def n_words(text: Column) -> Column:
    """Number of maximal runs without white space; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(text, f"{SPACE_CLASS}+", -1))
    edge = lambda one: F.when(one.rlike(SPACE_CLASS), 1).otherwise(0)
    return F.when(text == "", 0).otherwise(pieces - edge(F.substring(text, 1, 1)) - edge(F.substring(text, -1, 1))).cast("long")


def free_name(taken: list[str], wish: str) -> str:
    """`wish`, with underscores added until no column of `taken` has that name in any case."""
    names = {x.lower() for x in taken}
    while wish.lower() in names:
        wish += "_"
    return wish
