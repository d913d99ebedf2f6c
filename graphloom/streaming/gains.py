"""Reinforcement as state: a stream of accesses becomes gains of links, appended and never rewritten.

Each link's weight is state, and an access adds a step to it until it is
full; a full link gives no more rows, however often it is met. A link that is
not met for a while leaves the state: its weight is in the table. As reading
adds up gains and stops at 1, state that was lost can only add rows, never
weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.store import TableStore

STEP_MILLI = 50
FULL = 1000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GAINS = "from_note_id long, to_note_id long, gain_milli long"


class LinkState(StatefulProcessor):
    """The weight of a link; a timer of the last access forgets it."""

    def __init__(self, step: int, idle_ms: int):
        self.step, self.idle_ms = step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.weight = handle.getValueState("weight", StructType([StructField("milli", LongType())]))

    def _wait(self, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.idle_ms)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        self.weight.update((int(initialState["weight_milli"].iloc[0]),))
        self._wait(timerValues.getCurrentProcessingTimeInMs())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.weight.get()[0] if self.weight.exists() else 0
        gain = min(FULL - before, self.step * sum(len(r) for r in rows))
        self._wait(timerValues.getCurrentProcessingTimeInMs())
        if gain > 0:
            self.weight.update((before + gain,))
            yield pd.DataFrame({"from_note_id": [key[0]], "to_note_id": [key[1]], "gain_milli": [gain]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.weight.clear()
        return iter(())

    def close(self) -> None:
        pass


def gains(accesses: DataFrame, links: DataFrame | None = None, step: int = STEP_MILLI, idle_ms: int = 3_600_000) -> DataFrame:
    """(from_note_id, to_note_id, gain_milli) a link and batch, of a stream of (from_note_id, to_note_id); ``links``: (from_note_id, to_note_id, weight_milli) to begin with, one row a link. Needs the RocksDB state store (``_settings``)."""
    keys = ["from_note_id", "to_note_id"]
    first = links.select(*keys, F.col("weight_milli").cast("long").alias("weight_milli")).groupBy(*keys) if links is not None else None
    return accesses.select(*keys).groupBy(*keys).transformWithStateInPandas(LinkState(step, idle_ms), GAINS, "Append", "ProcessingTime", first)


def reinforce_as_state(accesses: DataFrame, store: TableStore, checkpoint: str, step: int = STEP_MILLI, name: str = "accesses", idle_ms: int = 3_600_000) -> StreamingQuery:
    """Appends the gains of a stream of accesses to ``link_gains``. A batch that runs again adds nothing: the table says which one it holds."""
    links = weights(store).where("link_type = 'auto'").select("from_note_id", "to_note_id", F.least(F.lit(FULL), F.round(F.col("weight") * 1000)).alias("weight_milli"))

    def keep(batch: DataFrame, number: int) -> None:
        if store.marks("link_gains").get(name, -1) < number:
            store.write("link_gains", batch.withColumns({"stream": F.lit(name), "batch": F.lit(number).cast("long")}), marks={name: number}, append=True)
        else:  # the state still has to go on
            batch.write.format("noop").mode("overwrite").save()

    with _settings(accesses.sparkSession):
        out = gains(accesses, links, step, idle_ms)
        return out.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """What a query of state takes over when it starts: its store, and no batches without data, which timers of the clock would ask for without end."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def weights(store: TableStore) -> DataFrame:
    """``note_links`` with the gains that are not in it yet; automatic links grow, at most to 1."""
    links, settled = store.read("note_links"), store.marks("note_links")
    rows = store.read("link_gains")
    for name, number in settled.items():
        rows = rows.where((F.col("stream") != name) | (F.col("batch") > number))
    summed = rows.groupBy("from_note_id", "to_note_id").agg(F.sum("gain_milli").alias("_gain"))
    grown = F.least(F.lit(float(FULL)), F.round(F.col("weight") * 1000) + F.col("_gain")) / 1000
    fits = (F.col("link_type") == "auto") & F.col("_gain").isNotNull()
    return links.join(summed, ["from_note_id", "to_note_id"], "left").withColumn("weight", F.when(fits, grown).otherwise(F.col("weight"))).select(*links.columns)


def settle(store: TableStore) -> None:
    """Puts the gains into ``note_links``, whose version then says how far each stream is in it, and empties the list of gains."""
    marks = store.marks("link_gains")
    if not marks:
        return
    store.write("note_links", weights(store), marks=marks)
    store.write("link_gains", store.read("link_gains").where(F.lit(False)))
