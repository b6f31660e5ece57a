"""Column expressions over words: runs of anything but space and \\x09-\\x0D."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that separate words.
BLANKS = "\t\n\x0b\x0c\r "
SPLIT = "[\\x20\\x09-\\x0D]+"


#: Marks that lower a quality weight.
SYMBOLS_RATIO_CHARS = "#*$%&|<>!"


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each led by as many underscores as keep it apart from ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, op) -> Column:
    """Running results of ``op`` over an array, by doubling: no array is copied once for each of its entries."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1.0)).cast("int"))

    def fold(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda x, i: op(x, F.get(acc, i - F.pow(F.lit(2), k).cast("int"))))

    return F.aggregate(rounds, values, fold)


def member(ordered: Column, value: Column) -> Column:
    """Whether a sorted array holds ``value``, by binary search."""
    steps = F.sequence(F.ceil(F.log2(F.size(ordered) + 1.0)).cast("int"), F.lit(0), F.lit(-1))

    def step(at: Column, k: Column) -> Column:
        there = at + F.pow(F.lit(2), k).cast("int")
        return F.when(F.coalesce(F.get(ordered, there) <= value, F.lit(False)), there).otherwise(at)

    return F.coalesce(F.get(ordered, F.aggregate(steps, F.lit(-1), step)) == value, F.lit(False))


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPLIT))


def word_count(text: Column) -> Column:
    """Number of words as a long; zero for null."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, SPLIT))).cast("long")


def without(text: Column, chars: str) -> Column:
    """``text`` with every character of ``chars`` removed."""
    return F.translate(text, chars, "")
