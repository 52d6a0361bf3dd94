"""Operators with state per key: debounced alerts and trailing features on a live stream.

A key is handled by one task per micro-batch, in bounded Arrow batches. Where one key may own much of
the stream, use `pipeline.Intake`, which spreads a key over tasks.
"""

from __future__ import annotations

import sys
from collections import deque

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import ENTER_STREAK, EXIT_STREAK

# The process that sets up the state does not see shipped files, so the processors travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AlertProcessor(StatefulProcessor):
    """Streak counters, alert state and high-water mark per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", "above int, below int, alerting boolean, mark long")

    def handleInputRows(self, key, rows, timerValues):
        above, below, alerting, mark = self.state.get() if self.state.exists() else (0, 0, False, None)
        top = mark
        for pdf in _in_time_order(rows):
            states, late = [], []
            for at, high in zip(pdf["time_us"].to_numpy(), pdf["above"].to_numpy()):
                old = mark is not None and at < mark
                if not old:
                    above, below = (above + 1, 0) if high else (0, below + 1)
                    if above >= ENTER_STREAK:
                        alerting = True
                    elif below >= EXIT_STREAK:
                        alerting = False
                    top = at if top is None else max(top, at)
                late.append(old)
                states.append("alerting" if alerting else "normal")
            yield pd.DataFrame({"event_id": pdf["event_id"], "site": pdf["site"], "time_us": pdf["time_us"],
                                "alert_state": states, "out_of_order": late})
        self.state.update((int(above), int(below), bool(alerting), None if top is None else int(top)))

    def close(self) -> None:
        pass


class TrailingProcessor(StatefulProcessor):
    """Distance from the median of the previous readings of the key."""

    rows, least = 60, 30

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "value array<double>")

    def handleInputRows(self, key, rows, timerValues):
        last = deque(self.state.get()[0] if self.state.exists() else [], maxlen=self.rows)
        for pdf in _in_time_order(rows):
            out = []
            for value in pdf["value"].to_numpy():
                out.append(value - float(np.median(last)) if len(last) >= self.least else None)
                last.append(float(value))
            yield pd.DataFrame({"event_id": pdf["event_id"], "deviation": pd.array(out, dtype="Float64").to_numpy(
                dtype=float, na_value=np.nan)})
        self.state.update(([float(v) for v in last],))

    def close(self) -> None:
        pass


def _in_time_order(rows):
    """Batches of one key and micro-batch, by time."""
    parts = list(rows)
    if parts:
        yield pd.concat(parts).sort_values("time_us", ignore_index=True)


def alert_states(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Alert state of every reading; the key may be a site or a (recording, replay session) pair."""
    keyed = stream.select(*(keys or ["site"]), *[c for c in ("event_id", "site", "time_us", "above") if c not in (keys or ["site"])])
    return keyed.groupBy(*(keys or ["site"])).transformWithStateInPandas(
        AlertProcessor(), "event_id long, site long, time_us long, alert_state string, out_of_order boolean",
        outputMode="Append", timeMode="None")


def trailing_deviation(stream: DataFrame) -> DataFrame:
    out = stream.select("site", "event_id", "time_us", "value").groupBy("site").transformWithStateInPandas(
        TrailingProcessor(), "event_id long, deviation double", outputMode="Append", timeMode="None")
    return out.withColumn("deviation", F.when(~F.isnan("deviation"), F.col("deviation")))
