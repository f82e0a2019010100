"""How two token sequences agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_rate(a: Column, b: Column) -> Column:
    """Equal positions over the longer length; two empty sequences agree fully."""
    longest = F.greatest(F.size(a), F.size(b))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda s: F.coalesce(s, F.lit(False))))
    return F.when(longest == 0, F.lit(1.0)).otherwise(same / longest)


def divergence(a: Column, b: Column) -> Column:
    """First position, from 0, where the sequences differ; null if equal."""
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differs, F.lit(True))
    return F.when(at > 0, at - 1)


#: First of the characters that stand for tokens, in a range of letters without combining forms.
_FIRST = 20_000


def token_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions and replacements that turn one array of tokens into the other.

    Each distinct token of the pair becomes one character (a pair may have some
    20,000), and the strings' edit distance is the arrays'.
    """
    known = F.array_distinct(F.concat(a, b))
    return F.get(F.transform(F.array(known), lambda k: F.levenshtein(_letters(a, k), _letters(b, k))), 0)


def _letters(x: Column, known: Column) -> Column:
    """Tokens as characters: UTF-16 units of their places in known."""
    return F.decode(F.unhex(F.array_join(F.transform(x, lambda t: F.lpad(F.hex(F.array_position(known, t) + _FIRST), 4, "0")), "")), "UTF-16BE")
