"""State that outlives a batch: spells of active days with timers, and running a stream over what is there now."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from varve.session import shared_folder
from varve.streaming.exposure import windowed_sums

DAY = 86_400_000
#: state of keyed processors lives in this store
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Spells(StatefulProcessor):
    """Runs of consecutive days of at least ``least``; a run leaves when the watermark has passed the day after its last.

    Days may come in any order.  A day waits in a map until its timer, set to its
    end, fires; timers fire in order, so runs grow day by day.  Where the watermark has
    already passed the day after, a run is closed at once, as a timer set now would
    wait for another batch.  State is the open days
    of the watermark's delay and one run, whatever the length of the stream.
    """

    def __init__(self, least: float):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "total double")
        self.run = handle.getValueState("run", "first long, last long, total double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for row in rows:
            before = self.days.getValue((row.day,))
            self.days.updateValue((row.day,), ((before[0] if before else 0.0) + row.total,))
            self.handle.registerTimer((row.day + 1) * DAY)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY - 1
        total = self.days.getValue((day,))
        if total:
            self.days.removeKey((day,))
        run = self.run.get() if self.run.exists() else None
        if total and total[0] >= self.least:
            if run and run[1] == day - 1:
                run = (run[0], day, run[2] + total[0])
            else:
                if run:
                    yield self._left(key, run)
                run = (day, day, total[0])
            self.run.update(run)
            after = (day + 2) * DAY
            if timerValues.getCurrentWatermarkInMs() < after:
                self.handle.registerTimer(after)
                return
            if self.days.containsKey((day + 1,)):
                return  # its own timer comes next
            day += 1  # nothing can come for the next day any more
        if run and run[1] < day:
            self.run.clear()
            yield self._left(key, run)

    def _left(self, key, run: tuple) -> Row:
        return Row(key=key[0], first=run[0], last=run[1], total=run[2])

    def close(self) -> None:
        pass


def spells(events: DataFrame, key: str, time: str, value: str, least: float, late: str = "2 days") -> DataFrame:
    """(key, first, last, length, total) of runs of days whose sum is at least ``least``, as a stream; rows later than ``late`` are dropped.

    Days are summed first, beside the source, so a hot key sends the state one row a
    day.  Set the session's ``spark.sql.streaming.stateStore.providerClass`` to PROVIDER.
    """
    daily = windowed_sums(events, key, time, value, "1 day", None, late)
    daily = daily.select(F.col(key).alias("key"), F.unix_date(F.to_date("start")).cast("long").alias("day"), F.col("total").cast("double").alias("total"))
    kind = dict((f.name, f.dataType) for f in events.schema.fields)[key]
    fields = [StructField("key", kind), StructField("first", LongType()), StructField("last", LongType()), StructField("total", DoubleType())]
    out = daily.groupBy("key").transformWithState(Spells(least), StructType(fields), "Append", "EventTime")
    date = lambda c: F.date_from_unix_date(F.col(c).cast("int"))
    return out.select(F.col("key").alias(key), date("first").alias("first"), date("last").alias("last"), (F.col("last") - F.col("first") + 1).alias("length"), "total")


def deduplicated(events: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark; state holds the keys of the delay only."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, folder: str | None = None) -> tuple[DataFrame, int]:
    """Runs an appending stream over all that its source holds now; the rows that left it, and how many came too late.

    Output and checkpoint lie in the folder that executors share, so a run that
    was broken off goes on from its last batch.
    """
    spark: SparkSession = stream.sparkSession
    home = f"{folder or shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, PROVIDER)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{home}/state").start(f"{home}/rows")
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    late = sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(f"{home}/rows"), late
