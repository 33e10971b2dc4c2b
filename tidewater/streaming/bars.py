"""Streaming twins of the intraday bins, and the decision-time scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater.functions.core import in_session, minute_of_day
from tidewater.operators.intraday import bin_measures

DELAY = "10 minutes"
#: Minutes of the day: the official decision, and bins that a provisional one needs.
DECISION_MINUTE = 945
MIN_BINS = 4


def binned(stream: DataFrame, candidates: DataFrame | None = None, delay: str = DELAY) -> DataFrame:
    """30-minute tumbling bins of (ticker, ts_et, price, event_id) in event time.

    Candidates (one row per ticker to watch) are joined before the aggregation, which
    keeps the state to their tickers.
    """
    df = stream.withColumn("min_of_day", minute_of_day("ts_et")).filter(in_session("min_of_day"))
    if candidates is not None:
        df = df.join(candidates, "ticker", "left_semi")
    df = df.withWatermark("ts_et", delay)
    return df.groupBy("ticker", F.window("ts_et", "30 minutes").alias("w")).agg(*bin_measures()).select("ticker", F.col("w.start").alias("bin_start"), F.col("w.end").alias("bin_end"), "b_open", "b_close", "b_high", "b_low", "b_volume", "b_n")


def upsert(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler for update mode: each batch's changed bins go to a directory of their own, so a replayed batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest(bins: DataFrame) -> DataFrame:
    """The last version of every bin among the batches written by `upsert`."""
    return bins.groupBy("ticker", "bin_start").agg(F.max_by(F.struct("b_open", "b_close", "b_high", "b_low", "b_volume", "b_n"), "batch_id").alias("b")).select("ticker", "bin_start", "b.*")


SIGNAL = "ticker string, day date, n_bins int, sess_open double, sess_close double, sess_ret double, official boolean"


class DecisionProcessor(StatefulProcessor):
    """Per ticker and day: keeps a day's bins, emits provisional rows once enough bins are in, and one official row when event time reaches the decision.

    The state lives in Spark's store, so a restart loses nothing; after the official row nothing more is emitted for the day.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bins = handle.getMapState("bins", "bin int", "first long, open double, last long, close double")
        self.done = handle.getValueState("done", "official boolean")

    def _row(self, key, official: bool) -> pd.DataFrame:
        held = sorted((k[0], v) for k, v in self.bins.iterator())
        first, last = held[0][1][1], held[-1][1][3]
        return pd.DataFrame({"ticker": [key[0]], "day": [key[1]], "n_bins": [len(held)], "sess_open": [first], "sess_close": [last], "sess_ret": [last / first - 1 if first else None], "official": [official]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return
        for part in rows:
            for r in part.sort_values("ts_ms").itertuples():
                slot = (int(r.bin),)
                old = self.bins.getValue(slot) if self.bins.containsKey(slot) else None
                first = (r.ts_ms, r.price) if old is None or r.ts_ms < old[0] else (old[0], old[1])
                last = (r.ts_ms, r.price) if old is None or r.ts_ms >= old[2] else (old[2], old[3])
                self.bins.updateValue(slot, (*first, *last))
                due = int(r.due_ms)
        if due > timerValues.getCurrentWatermarkInMs() and not list(self.handle.listTimers()):
            self.handle.registerTimer(due)
        if sum(1 for _ in self.bins.keys()) >= MIN_BINS:
            yield self._row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.done.exists():
            self.done.update((True,))
            yield self._row(key, True)
            self.bins.clear()

    def close(self) -> None:
        pass


def decisions(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Signals of a stream (ticker, ts_et, price); a last row beyond the decision and the delay is needed for the last day."""
    df = stream.withColumn("min_of_day", minute_of_day("ts_et")).filter(in_session("min_of_day")).withWatermark("ts_et", delay)
    df = df.withColumns({
        "day": F.to_date("ts_et"),
        "bin": F.least(F.floor((F.col("min_of_day") - 570) / 30), F.lit(12)).cast("int"),
        "ts_ms": F.unix_millis("ts_et"),
        "due_ms": F.unix_millis(F.date_trunc("day", "ts_et")) + DECISION_MINUTE * 60_000,
    })
    return df.groupBy("ticker", "day").transformWithStateInPandas(DecisionProcessor(), SIGNAL, outputMode="Append", timeMode="EventTime")
