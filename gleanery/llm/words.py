"""The words, lines and sizes on which the operators of this package agree, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space is the six ASCII characters that bytes.split() takes; everything else is in words.
WHITE = r"[\x20\x09-\x0D]"
INK = r"[^\x20\x09-\x0D]"


def whole(text: Column | str) -> Column:
    """The text, a missing one as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def single_spaced(text: Column) -> Column:
    """Every run of white space as one blank; only runs that are not one already are matched."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def ink_only(text: Column) -> Column:
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def word_count(text: Column) -> Column:
    """Number of words, as a long, without building them."""
    return F.regexp_count(text, F.lit(INK + "+")).cast("long")


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
