"""Admitting requests under a sliding limit and a daily cap, with refunds, as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY = 86_400_000

OUT = "client string, id long, ts timestamp, outcome string, wait_s long"
STATE = "times array<long>, day long, today long"


class Limits:
    """At most ``most`` admissions in ``window_ms`` and ``daily`` a day of one client."""

    def __init__(self, most: int = 5, window_ms: int = 600_000, daily: int = 20):
        self.most, self.window_ms, self.daily = most, window_ms, daily

    def step(self, times: list[int], day: int, today: int, now: int, refund: bool):
        """The state after a request at ``now`` (milliseconds), its outcome and the seconds to wait.

        A refund takes back the client's latest admission: it no longer counts, neither in the window nor in the day.
        """
        if now // DAY != day:
            day, today = now // DAY, 0
        times = [t for t in times if now - t <= self.window_ms]
        if refund:
            return times[:-1], day, max(0, today - 1), "refunded", 0
        if len(times) >= self.most:
            return times, day, today, "limit", (self.window_ms - (now - times[0])) // 1000 + 1
        if today >= self.daily:
            return times, day, today, "limit_day", ((day + 1) * DAY - now) // 1000 + 1
        return [*times, now], day, today + 1, "admitted", 0


def admissions(requests: DataFrame, limits: Limits, lateness: str = "10 minutes") -> DataFrame:
    """What becomes of each request: client, id, ts, outcome (admitted, refunded, limit, limit_day), wait_s.

    ``requests``: a stream of client, id, ts, refund (boolean). A client's requests of one micro-batch count in the
    order of (ts, id); one that is late counts as if it came with the latest seen before it. The state holds at most
    ``limits.most`` times and the day's count, and is dropped once the watermark has passed the client's window and day.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, day, today = state.get if state.exists else ([], -1, 0)
        times = list(times)
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        latest = times[-1] if times else 0
        out = []
        for row in rows.itertuples():
            latest = max(latest, int(row.ts.timestamp() * 1000))
            times, day, today, outcome, wait = limits.step(times, day, today, latest, bool(row.refund))
            out.append((key[0], row.id, row.ts, outcome, wait))
        state.update((times, day, today))
        gone = max(latest + limits.window_ms, (day + 1) * DAY) + 1
        state.setTimeoutTimestamp(max(gone, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["client", "id", "ts", "outcome", "wait_s"])

    marked = requests.select(F.col("client").cast("string").alias("client"), "id", "ts", "refund").withWatermark("ts", lateness)
    return marked.groupBy("client").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
