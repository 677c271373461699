"""Requests under a budget: each waits until what its provider was granted within a sliding window leaves room for it.

Requests are granted one provider at a time, in the order of their times (ties by id), each at the earliest time that isn't before its own or the last granted one's and at which it and all granted within the window before
sum up to the budget at most. One that is larger than the budget is granted alone. The windows are half open: what was granted `window` seconds ago doesn't count any more.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame

GRANTS = "provider string, id long, at double, tokens long, granted double, wait double"


class Granter:
    """What one provider was granted within the last window: times and tokens, oldest first."""

    def __init__(self, budget: int, window: float, held=(), last: float = float("-inf")):
        self.budget, self.window, self.held, self.last = budget, window, deque(held), last
        self.used = sum(n for _, n in self.held)

    def grant(self, at: float, tokens: int) -> float:
        now = max(at, self.last)
        self._forget(now)
        while self.held and self.used + tokens > self.budget:
            now = self.held[0][0] + self.window
            self._forget(now)
        self.held.append((now, tokens))
        self.used += tokens
        self.last = now
        return now

    def _forget(self, now: float) -> None:
        while self.held and self.held[0][0] + self.window <= now:
            self.used -= self.held.popleft()[1]


def _usable(row) -> bool:
    return row.provider is not None and row.at is not None and row.tokens is not None and row.tokens >= 0


def grants(requests: DataFrame, budget: int, window: float = 60.0) -> DataFrame:
    """GRANTS of all requests (provider, id, at in seconds, tokens) of a batch. Requests without a provider, a time or tokens are left out; equal rows are requests of their own.

    A provider's requests are a sequence by nature: they are sorted by Spark and read as a stream by one task, which holds one window of them.
    """
    import pyarrow as pa

    names = [c.split()[0] for c in GRANTS.split(", ")]

    def run(batches):
        provider, granter = None, None
        for batch in batches:
            out = []
            for r in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if r[0] != provider or granter is None:
                    provider, granter = r[0], Granter(budget, window)
                granted = granter.grant(r[2], r[3])
                out.append((*r, granted, granted - r[2]))
            yield pa.record_batch([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()))], names)

    rows = requests.selectExpr("cast(provider as string) provider", "cast(id as long) id", "cast(at as double) at", "cast(tokens as long) tokens").where("provider is not null and at is not null and tokens >= 0")
    return rows.repartition("provider").sortWithinPartitions("provider", "at", "id", "tokens").mapInArrow(run, GRANTS)


def grant_stream(requests: DataFrame, budget: int, window: float = 60.0, idle: float = 600.0) -> DataFrame:
    """GRANTS of a stream of requests (provider, id, time, tokens) with a watermark on time.

    Rows wait in their provider's state until the watermark has passed their time, so what is granted depends on the requests alone, not on how they come in batches; one that is later than the watermark is dropped by Spark.
    A timer wakes a provider when its earliest waiting row is due, and, `idle` seconds after the last one, when its state can go.
    State is kept by the stream's checkpoint, so a restart goes on where the last finished batch ended. Needs the RocksDB state store.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Budgeted(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "at double, id long, tokens long")
            self.held = handle.getListState("held", "at double, tokens long")
            self.last = handle.getValueState("last", "at double")

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            come = [(r.at, r.id, r.tokens) for r in rows if _usable(r)]
            if come:
                self.waiting.appendList(come)
            yield from self._due(key[0], timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            yield from self._due(key[0], timerValues.getCurrentWatermarkInMs())

        def _due(self, provider, watermark: int) -> Iterator:
            from pyspark.sql import Row

            due, later = [], []
            for x in self.waiting.get():
                (due if x[0] * 1000 <= watermark else later).append(tuple(x))
            if due:
                granter = Granter(budget, window, [tuple(x) for x in self.held.get()], self.last.get()[0] if self.last.exists() else float("-inf"))
                for at, id_, tokens in sorted(due):
                    granted = granter.grant(at, tokens)
                    yield Row(provider=provider, id=id_, at=at, tokens=tokens, granted=granted, wait=granted - at)
                self.last.update((granter.last,))
                self.held.put(list(granter.held))
                self.waiting.put(later) if later else self.waiting.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if later:
                self.handle.registerTimer(max(int(min(x[0] for x in later) * 1000), watermark) + 1)
            elif self.last.exists():
                end = int((self.last.get()[0] + window + idle) * 1000)
                if end <= watermark:
                    self.held.clear()
                    self.last.clear()
                else:
                    self.handle.registerTimer(end)

        def close(self) -> None:
            pass

    rows = requests.selectExpr("cast(provider as string) provider", "cast(id as long) id", "time", "cast(unix_micros(cast(time as timestamp)) as double) / 1e6 as at", "cast(tokens as long) tokens")
    return rows.groupBy("provider").transformWithState(statefulProcessor=Budgeted(), outputStructType=GRANTS, outputMode="Append", timeMode="EventTime")
