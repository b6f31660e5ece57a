"""Data contracts as tables of violations, with a strict form that raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A contract has violations."""


def padded_or_null(df: DataFrame, col: str) -> DataFrame:
    """Rows whose key is null, blank or padded with blanks."""
    c = F.col(col)
    return df.filter(c.isNull() | (F.trim(c) == "") | (F.trim(c) != c))


def not_in_vocabulary(df: DataFrame, col: str, words: Sequence[str]) -> DataFrame:
    return df.filter(~F.col(col).isin(*words))


def orphans(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the other table lacks."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def require(violations: DataFrame, what: str) -> None:
    """Raises if there is any violation, naming the first few."""
    found = violations.limit(5).collect()
    if found:
        raise ContractError(f"{what}: {[r.asDict() for r in found]}")
