"""Stateful operators with event-time timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .sealed import SHIFT


class NotifyEpochs(StatefulProcessor):
    """Keyed by epoch: keeps an epoch's values until it is sealed, then gives f(epoch, values) once.

    For transformWithStateInPandas(NotifyEpochs(f, "x"), schema, "Append", "eventTime") over sealed(frame) grouped
    by epoch.  Epochs without rows are not called for: see NotifyAt.
    """

    def __init__(self, f: Callable[[int, list], pd.DataFrame], value: str, time: str = "epoch"):
        self.f, self.value, self.time = f, value, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "v long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803, ARG002
        new = False
        for pdf in rows:
            own = pdf[~pdf["marker"].astype(bool)]
            if len(own):
                self.kept.appendList([(int(v),) for v in own[self.value]])
                new = True
        if new:
            self.handle.registerTimer((int(key[0]) + SHIFT + 1) * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803, ARG002
        values = [v[0] for v in self.kept.get()]
        self.kept.clear()
        if values:
            yield self.f(int(key[0]), values)

    def close(self) -> None:
        pass


class NotifyAt(StatefulProcessor):
    """For each key, over all its epochs: f(key, epoch, values) once for each epoch that has rows, and for each of the
    epochs asked for, with no values if there are none, when the epoch is sealed.

    For transformWithStateInPandas(NotifyAt(f, "x", epochs), schema, "Append", "eventTime") over sealed(frame) grouped
    by a key.  Requests are made with the first rows of a key.
    """

    def __init__(self, f: Callable[[Any, int, list], pd.DataFrame], value: str, epochs: Sequence[int], time: str = "epoch"):
        self.f, self.value, self.epochs, self.time = f, value, list(epochs), time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "e long", "vs array<long>")

    def _put(self, epoch: int, values: list[int]) -> None:
        before = self.kept.getValue((epoch,))[0] if self.kept.containsKey((epoch,)) else None
        if before is None:
            self.handle.registerTimer((epoch + SHIFT + 1) * 1000)
        self.kept.updateValue((epoch,), ([*(before or []), *values],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803, ARG002
        if not self.kept.exists():
            for e in self.epochs:
                self._put(int(e), [])
        for pdf in rows:
            for epoch, own in pdf[~pdf["marker"].astype(bool)].groupby(self.time):
                self._put(int(epoch), [int(v) for v in own[self.value]])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803, ARG002
        epoch = expiredTimerInfo.getExpiryTimeInMs() // 1000 - SHIFT - 1
        if self.kept.containsKey((epoch,)):
            values = list(self.kept.getValue((epoch,))[0])
            self.kept.removeKey((epoch,))
            yield self.f(key[0], int(epoch), values)

    def close(self) -> None:
        pass


class RunningSum(StatefulProcessor):
    """Keyed: for each row the sum of its key so far, in arrival order (update mode, no time)."""

    def __init__(self, value: str, name: str):
        self.value, self.name = value, name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "v long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803, ARG002
        total = self.total.get()[0] if self.total.exists() else 0
        for pdf in rows:
            sums = total + pdf[self.value].cumsum()
            if len(sums):
                total = int(sums.iloc[-1])
                yield pd.DataFrame({self.name: [key[0]] * len(sums), "running": sums.astype("int64")})
        self.total.update((total,))

    def close(self) -> None:
        pass
