"""Table functions."""

from __future__ import annotations

from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import LongType, StructField, StructType


@udtf(returnType=StructType([StructField("piece", LongType())]))
class pieces:  # noqa: N801
    """One row for each piece number below ``n``."""

    def eval(self, key: int, n: int):
        for i in range(n):
            yield (i,)


class Records:
    """Rows of an ordered partition whose value exceeds all before it, with the record they break.

    Called over ``TABLE ... PARTITION BY ... ORDER BY``: rows of a partition come one
    after another, and only the last record is held.  ``analyze`` takes the type of the
    value column from the table that is given.
    """

    def __init__(self):
        self.top = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        if value.value not in rows.dataType.fieldNames():
            raise ValueError(f"the table has no column {value.value}")
        kind = rows.dataType[value.value].dataType
        return AnalyzeResult(StructType([*rows.dataType.fields, StructField("record", kind), StructField("before", kind)]))

    def eval(self, row, value: str):
        got = row[value]
        if got is not None and (self.top is None or got > self.top):
            yield (*row, got, self.top)
            self.top = got


records = udtf(Records)
