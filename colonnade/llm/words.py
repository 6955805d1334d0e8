"""Words as the contracts of this subpackage define them: runs of anything but space and U+0009 to U+000D."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BREAKS = "\t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(word_array(text)), F.lit(0)).cast("long")


def word_array(text: Column) -> Column:
    """The words in order; null for null."""
    spaced = F.translate(text, BREAKS, " " * len(BREAKS))
    return F.array_remove(F.split(spaced, " "), "")
