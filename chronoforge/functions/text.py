"""Row functions on texts: MACB flags, tags, highlighting, cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a time's description that set a flag, for JSON lines and for all other sources.
MACB_JSON = {"M": "modification|modified|written", "A": "access|visited", "C": "change|entry|metadata", "B": "creation|birth|created"}
MACB_OTHER = {"M": "modification|modified|written", "A": "access", "C": "change|metadata|entry|mft", "B": "creation|birth|created"}


def macb(c: Column, words: dict[str, str], none: str = "....") -> Column:
    """Four flags from a description; none: what stands for no flag at all."""
    flags = F.concat(*[F.when(F.lower(c).rlike(w), flag).otherwise(".") for flag, w in words.items()])
    return F.when(flags == "....", none).otherwise(flags)


def strip_nul(c: Column) -> Column:
    return F.translate(c, "\0", "")


def append_tag(old: Column, new: str) -> Column:
    """The tag list with one more tag, unless it holds it in any case."""
    old = F.coalesce(old, F.lit(""))
    has = F.exists(F.split(old, ","), lambda t: F.lower(F.trim(t)) == F.lower(F.lit(new)))
    return F.when(old == "", new).when(has, old).otherwise(F.concat(old, F.lit(f",{new}")))


def highlight(c: Column, keyword: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """All places of a keyword, in any case, marked."""
    if not keyword:
        return c
    literal = re.sub(r"([^\w\s])", r"\\\1", keyword)
    return F.regexp_replace(c, F.lit(f"(?i)({literal})"), F.lit(f"{before}$1{after}"))
