"""Back-off of hosts over a stream of responses, with a timer that forgets hosts which went silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from precioscope.functions.policy import next_wait

WAITS = "host string, ordinal long, wait_ms long"


class HostWaits(StatefulProcessor):
    """The gap of one host and when it is forgotten.  A host without a gap has no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gap = handle.getValueState("gap", "wait_ms long, until_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        wait, until = (tuple(self.gap.get()) if self.gap.exists() else (0, 0))
        frame, out = pd.concat(list(rows)).sort_values("ordinal"), []
        for status, retry, at in frame[["status", "retry_after", "at_ms"]].itertuples(index=False):
            wait, until = next_wait(wait, until, status, retry, at)
            out.append(wait)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if wait:
            self.gap.update((int(wait), int(until)))
            self.handle.registerTimer(max(int(until), timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.gap.clear()
        yield pd.DataFrame({"host": key[0], "ordinal": frame["ordinal"].to_numpy(), "wait_ms": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.gap.clear()
        yield pd.DataFrame({"host": pd.Series(dtype=str), "ordinal": pd.Series(dtype="int64"), "wait_ms": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def live_backoff(responses: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """(host, ordinal, wait_ms) of a stream of ``responses`` (host, ordinal, status, retry_after, at_ms): what each
    response leaves as its host's gap, as ``policy.backoff`` tells it over a table.

    Responses of a host are taken by ordinal within a micro-batch; those behind the watermark of at_ms are
    left out.  When the watermark passes the time at which a gap is forgotten, the host's state goes.
    """
    rows = responses.select("host", "ordinal", "status", F.col("retry_after").cast("double").alias("retry_after"), F.col("at_ms").cast("long").alias("at_ms"), F.timestamp_millis("at_ms").alias("at"))
    return rows.withWatermark("at", lateness).groupBy("host").transformWithStateInPandas(HostWaits(), WAITS, "append", "EventTime")
