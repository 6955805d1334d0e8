"""Repository names: owner and name split, joined and transformed, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_name(name: Column, missing: str = "owner") -> tuple[Column, Column]:
    """(owner, rest) at the first slash; without one the name is the owner (missing="owner") or the rest (missing="rest")."""
    at = F.instr(name, "/")
    owner = F.when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise(name if missing == "owner" else F.lit(""))
    rest = F.when(at > 0, F.substring(name, at + 1, F.length(name))).otherwise(F.lit("") if missing == "owner" else name)
    return owner, rest


def join_name(owner: Column, rest: Column, missing: str | None = None) -> Column:
    """owner/rest; an empty rest (missing="owner") or an empty owner (missing="rest") leaves the other part alone."""
    both = F.concat(owner, F.lit("/"), rest)
    if missing == "owner":
        return F.when(rest == "", owner).otherwise(both)
    if missing == "rest":
        return F.when(owner == "", rest).otherwise(both)
    return both


def rest_code(owner: Column, rest: Column) -> Column:
    """How a name follows its owner: 1 the same, 2 the owner and one of -_. and more, 0 anything else."""
    next_char = F.substring(rest, F.length(owner) + 1, F.lit(1))
    return F.when(rest == owner, 1).when(F.startswith(rest, owner) & (owner != "") & next_char.isin("-", "_", "."), 2).otherwise(0)


def rest_kept(owner: Column, rest: Column) -> Column:
    """What of the name must be stored, given rest_code."""
    code = rest_code(owner, rest)
    return F.when(code == 1, F.lit("")).when(code == 2, F.substring(rest, F.length(owner) + 1, F.length(rest))).otherwise(rest)


def rest_from(owner: Column, code: Column, kept: Column) -> Column:
    return F.when(code == 1, owner).when(code == 2, F.concat(owner, kept)).otherwise(kept)


def owner_marked(owner: Column, rest: Column) -> Column:
    """The owner's occurrences in the name as @; a name that is nothing else is empty, owner.github.io is @ alone."""
    marked = F.replace(rest, owner, F.lit("@"))
    return F.when(owner == "", rest).when(marked == "@", F.lit("")).when(marked == "@.github.io", F.lit("@")).otherwise(marked)


def owner_unmarked(owner: Column, marked: Column) -> Column:
    full = F.when(marked == "", F.lit("@")).when(marked == "@", F.lit("@.github.io")).otherwise(marked)
    return F.when(owner == "", marked).otherwise(F.replace(full, F.lit("@"), owner))


def folded(text: Column) -> Column:
    """ASCII upper case as marks before lower case: $ before a run of two or more that no lower-case letter follows, ^ before every other."""
    single = F.regexp_replace(text, r"([A-Z](?=[A-Z]*[a-z])|(?<![A-Z])[A-Z](?![A-Z]))", "^$1")
    runs = F.regexp_replace(single, r"(?<![\^A-Z])([A-Z]{2,})", r"\$$1")
    return F.translate(runs, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unfolded(text: Column) -> Column:
    """The inverse of folded for text without ^ and $ of its own: upper case is put back piece by piece."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\$[a-z]+|\^.|[^$^]+)"), F.lit(1))
    upper = F.transform(pieces, lambda p: F.when(F.substring(p, 1, 1).isin("$", "^"), F.upper(F.substring(p, F.lit(2), F.length(p)))).otherwise(p))
    return F.array_join(upper, "")


def prefix_bytes(a: Column, b: Column) -> Column:
    """Bytes (of UTF-8) that two strings begin with alike, 0 if one is null; found by halving, a few comparisons whatever the length."""
    x, y = F.encode(a, "UTF-8"), F.encode(b, "UTF-8")
    n = F.least(F.octet_length(a), F.octet_length(b))

    def longer(found: Column, bit: Column) -> Column:
        more = found + F.pow(F.lit(2), bit).cast("int")
        same = F.substring(x, F.lit(1), more) == F.substring(y, F.lit(1), more)
        return F.when((more <= n) & same, more).otherwise(found)

    bits = F.sequence(F.length(F.bin(n)) - 1, F.lit(0), F.lit(-1))
    return F.when(a.isNull() | b.isNull(), F.lit(0)).otherwise(F.aggregate(bits, F.lit(0), longer))
