"""Running flows: in the background, cancellable, with metrics and a picture of the plan."""

from __future__ import annotations

import asyncio
import enum
import json
import queue
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.util import InheritableThread

from .errors import Cancelled, ConfigError, DuplicateName, located
from .progress import Probe
from .timed import TimedFrame


class Reason(str, enum.Enum):
    """Why a run was cancelled."""

    USER = "user"
    SHUTDOWN = "shutdown"
    NETWORK = "network"
    WORKER_FAILED = "worker_failed"
    HANDLE_DROPPED = "handle_dropped"
    OPERATOR = "operator"
    PEER_CANCELLED = "peer_cancelled"
    PEER_DOWN = "peer_down"
    INTERNAL = "internal"


@dataclass
class SpawnOptions:
    """priority: the FAIR pool; weight: its turn in a Scheduler; drain_on_cancel: seconds that a stream may finish its
    rows in when it is cancelled; error_policy: "stop", or "ignore" to end quietly."""

    priority: str | None = None
    weight: float = 0.0
    drain_on_cancel: float | None = None
    error_policy: str = "stop"


class CancellationToken:
    """Cancels what was made from it, too."""

    def __init__(self, parent: CancellationToken | None = None):
        self._event, self.reason, self._children, self._calls = threading.Event(), None, [], []
        if parent:
            parent._children.append(self)
            if parent.is_cancelled():
                self.cancel(parent.reason)

    def child(self) -> CancellationToken:
        return CancellationToken(self)

    def on_cancel(self, f: Callable[[], None]) -> None:
        self._calls.append(f)
        if self.is_cancelled():
            f()

    def cancel(self, reason: str = "user") -> None:
        if not self._event.is_set():
            self.reason = reason
            self._event.set()
            for f in self._calls:
                f()
            for c in self._children:
                c.cancel(reason)

    def is_cancelled(self) -> bool:
        return self._event.is_set()


@dataclass
class Metrics:
    """Seconds of each run, spans for a trace, and rows by operator."""

    spans: list[tuple[str, float, float]] = field(default_factory=list)
    watched: list[tuple[str, Observation]] = field(default_factory=list)

    def add(self, name: str, begin: float, end: float) -> None:
        self.spans.append((name, begin, end))

    def seconds(self) -> dict[str, float]:
        out: dict[str, float] = {}
        for n, a, b in self.spans:
            out[n] = out.get(n, 0.0) + b - a
        return out

    def watch(self, frame: TimedFrame, operator: str) -> TimedFrame:
        """frame, whose rows are counted at this operator; rows() tells them once a run over it has ended."""
        out, seen = frame.inspect(F.count(F.lit(1)).alias("rows"), name=f"{operator}-{uuid.uuid4().hex}")
        self.watched.append((operator, seen))
        return out

    def rows(self) -> dict[str, int]:
        """Operator -> rows, of operators whose run has ended."""
        out: dict[str, int] = {}
        end = time.monotonic() + (2.0 if self.spans else 0.0)  # counts come a little after a run has ended
        for name, seen in self.watched:
            if seen._jo is None:
                continue
            while not (done := seen._jo.future().isCompleted()) and time.monotonic() < end:
                time.sleep(0.02)
            if done:
                out[name] = out.get(name, 0) + seen.get["rows"]
        return out

    def chrome_trace(self) -> str:
        events = [{"name": n, "ph": "X", "ts": a * 1e6, "dur": (b - a) * 1e6, "pid": 1, "tid": 1} for n, a, b in self.spans]
        return json.dumps({"traceEvents": [*events, *({"name": n, "ph": "C", "ts": 0, "pid": 1, "args": {"rows": c}} for n, c in self.rows().items())]})


class OutputReceiver:
    """The receiving end of a flow's output: rows come in partitions' order while the flow runs; capacity of them are
    held at a time, and the driver never holds more than those and one partition."""

    _END = object()

    def __init__(self, frame: TimedFrame | DataFrame, capacity: int | None = None):
        df = frame.df if isinstance(frame, TimedFrame) else frame
        own = frame.capacity if isinstance(frame, TimedFrame) else None
        self._rows, self._error, self._ended, self._stop = queue.Queue(capacity or own or 256), None, False, threading.Event()

        def run():
            try:
                for row in df.toLocalIterator(prefetchPartitions=False):
                    while not self._stop.is_set():
                        try:
                            self._rows.put(row, timeout=0.1)
                            break
                        except queue.Full:
                            continue
                    if self._stop.is_set():
                        return
            except Exception as e:  # handed over by recv
                self._error = e
            while not self._stop.is_set():
                try:
                    return self._rows.put(self._END, timeout=0.1)
                except queue.Full:
                    continue

        InheritableThread(target=run, daemon=True).start()

    def _got(self, row):
        if row is self._END:
            self._ended = True
            if self._error:
                raise located("output", self._error) from self._error
            return None
        return row

    def recv(self):
        """The next row, or None at the end."""
        return None if self._ended else self._got(self._rows.get())

    def recv_timeout(self, seconds: float):
        """The next row, or None at the end; TimeoutError if there is none in time."""
        try:
            return None if self._ended else self._got(self._rows.get(timeout=seconds))
        except queue.Empty:
            raise TimeoutError("no row in time") from None

    def try_recv(self):
        """The next row if there is one by now, else None."""
        try:
            return None if self._ended else self._got(self._rows.get_nowait())
        except queue.Empty:
            return None

    def is_done(self) -> bool:
        return self._ended

    def collect_data(self) -> list:
        return list(self)

    async def recv_async(self):
        return await asyncio.to_thread(self.recv)

    def __iter__(self):
        while (row := self.recv()) is not None:
            yield row

    def close(self) -> None:
        """Stops the reading thread; rows not received are dropped."""
        self._stop.set()
        self._ended = True


class Spawned:
    """A running batch flow."""

    def __init__(self, engine: Engine, name: str, action: Callable[[], Any], options: SpawnOptions, token: CancellationToken):
        self.name, self.options, self.token, self.probe = name, options, token, Probe()
        self._tag, self._result, self._error, self._sc = f"flow-{uuid.uuid4().hex}", None, None, engine.spark.sparkContext
        self._session = engine.spark

        def run():
            begin = time.time()
            self._sc.addJobTag(self._tag)
            if options.priority:
                self._sc.setLocalProperty("spark.scheduler.pool", options.priority)
            try:
                if not token.is_cancelled():
                    self._result = action()
            except Exception as e:  # handed over by join
                self._error = e
            finally:
                engine.metrics.add(name, begin, time.time())
                self.probe.finish()

        token.on_cancel(lambda: self._sc.cancelJobsWithTag(self._tag))
        self._thread = InheritableThread(target=run, daemon=True)
        self._thread.start()

    def cancel(self, reason: str = "user") -> None:
        self.token.cancel(reason)

    def join(self, timeout: float | None = None) -> Any:
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError(f"{self.name} still runs")
        if self.token.is_cancelled() and (self._error or self._result is None):
            raise Cancelled(self.token.reason)
        if self._error:
            if self.options.error_policy == "ignore":
                return None
            raise located(self.name, self._error) from self._error
        return self._result

    async def join_async(self, timeout: float | None = None) -> Any:
        return await asyncio.to_thread(self.join, timeout)


class SpawnedStream:
    """A running streaming flow; cancelling it drains it first if its options allow time for that."""

    def __init__(self, name: str, query, options: SpawnOptions, token: CancellationToken):
        self.name, self.query, self.options, self.token, self.probe, self.drained = name, query, options, token, Probe(query), None
        token.on_cancel(self._end)

    def _end(self) -> None:
        if self.options.drain_on_cancel:
            self.drained = Engine.drain(self.query, self.options.drain_on_cancel)
        else:
            self.query.stop()
        self.probe.finish()

    def cancel(self, reason: str = Reason.USER) -> None:
        self.token.cancel(reason)

    def join(self, timeout: float | None = None) -> bool:
        """True once the stream has ended."""
        try:
            return bool(self.query.awaitTermination(timeout)) if timeout else self.query.awaitTermination() is None
        except Exception as e:
            if self.options.error_policy == "ignore":
                return True
            raise located(self.name, e) from e


class Engine:
    """Spawns flows over one Spark session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.metrics, self.token = spark, Metrics(), CancellationToken()

    def spawn(self, name: str, flow: TimedFrame | DataFrame | Callable[[], Any], options: SpawnOptions | None = None, action: Callable[[DataFrame], Any] | None = None) -> Spawned:
        """Runs an action on a flow, or a function, in the background.  By default rows are computed and go nowhere;
        DataFrame.collect brings them to the driver, receive() brings them one by one."""
        if callable(flow):
            run = flow
        else:
            df = flow.df if isinstance(flow, TimedFrame) else flow
            run = lambda: (action or _compute)(df)
        return Spawned(self, name, run, options or SpawnOptions(), self.token.child())

    def spawn_stream(self, name: str, writer, options: SpawnOptions | None = None) -> SpawnedStream:
        """writer: a DataStreamWriter."""
        return SpawnedStream(name, writer.queryName(name).start(), options or SpawnOptions(), self.token.child())

    def spawn_workers(self, name: str, n: int, build: Callable[[SparkSession], TimedFrame | DataFrame], options: SpawnOptions | None = None, action: Callable[[DataFrame], Any] | None = None) -> Spawned:
        """One flow whose exchanges have n tasks; build makes it in a session of its own."""
        if n < 1:
            raise ConfigError("a flow has one worker at least")
        own = self.spark.newSession()
        for key, value in (("spark.sql.shuffle.partitions", str(n)), ("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.session.timeZone", self.spark.conf.get("spark.sql.session.timeZone"))):
            own.conf.set(key, value)
        return self.spawn(name, build(own), options, action)

    def receive(self, frame: TimedFrame | DataFrame, capacity: int | None = None) -> OutputReceiver:
        return OutputReceiver(frame, capacity)

    def spawn_many(self, flows: dict[str, Any], options: SpawnOptions | None = None) -> dict[str, Spawned]:
        return {n: self.spawn(n, f, options) for n, f in flows.items()}

    def shutdown(self) -> None:
        self.token.cancel("shutdown")

    @staticmethod
    def drain(query, timeout: float = 60.0) -> bool:
        """Lets a streaming query take all that is there, then stops it; True if it did so in time."""
        worker = threading.Thread(target=lambda: query.processAllAvailable(), daemon=True)
        worker.start()
        worker.join(timeout)
        done = not worker.is_alive()
        query.stop()
        return done


def _compute(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


class Scheduler:
    """Runs flows, so many at a time; the next is the one of most weight, to which each second of waiting adds
    ageing, so that none waits for ever.  ageing 0: by weight alone; equal weights: in order of arrival."""

    def __init__(self, engine: Engine, slots: int = 2, ageing: float = 0.1, clock: Callable[[], float] = time.monotonic):
        if slots < 1:
            raise ConfigError("a scheduler has one slot at least")
        self.engine, self.slots, self.ageing, self.clock = engine, slots, ageing, clock
        self._waiting: list[tuple[float, float, int, Callable[[], Spawned]]] = []
        self._running: list[Spawned] = []
        self.started: list[str] = []
        self._n = 0

    def submit(self, name: str, flow, options: SpawnOptions | None = None, action=None) -> None:
        options = options or SpawnOptions()

        def start() -> Spawned:
            self.started.append(name)
            return self.engine.spawn(name, flow, options, action)

        self._waiting.append((options.weight, self.clock(), self._n, start))
        self._n += 1

    def _next(self) -> Callable[[], Spawned]:
        now = self.clock()
        best = max(range(len(self._waiting)), key=lambda k: (self._waiting[k][0] + self.ageing * (now - self._waiting[k][1]), -self._waiting[k][2]))
        return self._waiting.pop(best)[3]

    def run(self) -> list[Spawned]:
        """Runs all that was submitted, to the end; errors are raised by the flows' join."""
        done: list[Spawned] = []
        while self._waiting or self._running:
            while self._waiting and len(self._running) < self.slots:
                self._running.append(self._next()())
            ended = [r for r in self._running if r.probe.is_done()]
            if not ended:
                self._running[0].probe.wait_until_done(0.05)
            done += ended
            self._running = [r for r in self._running if r not in ended]
        return done


class Flow:
    """Inputs, outputs and shared settings of one flow, by name and by type; a name that is given twice is an error."""

    def __init__(self, spark: SparkSession, name: str = "flow"):
        self.spark, self.name = spark, name
        self.inputs: dict[str, TimedFrame] = {}
        self.outputs: dict[str, TimedFrame] = {}
        self._context: dict[type, Any] = {}

    def input(self, name: str, frame: TimedFrame | DataFrame) -> TimedFrame:
        if name in self.inputs:
            raise DuplicateName(f"input {name!r} exists")
        self.inputs[name] = frame if isinstance(frame, TimedFrame) else TimedFrame(frame)
        return self.inputs[name]

    def output(self, name: str, frame: TimedFrame) -> TimedFrame:
        if name in self.outputs:
            raise DuplicateName(f"output {name!r} exists")
        self.outputs[name] = frame
        return frame

    def with_context(self, value: Any) -> Flow:
        """Shares a value with the flow's operators; one of each type."""
        self._context[type(value)] = value
        return self

    def get_context(self, kind: type) -> Any:
        if kind not in self._context:
            raise ConfigError(f"no {kind.__name__} in the context")
        return self._context[kind]

    def run(self, engine: Engine, options: SpawnOptions | None = None, action: Callable[[DataFrame], Any] | None = None) -> dict[str, Spawned]:
        """All outputs, in the background."""
        return {n: engine.spawn(f"{self.name}.{n}", f, options, action) for n, f in self.outputs.items()}

    def take_output(self, name: str, capacity: int | None = None) -> OutputReceiver:
        return OutputReceiver(self.outputs[name], capacity)


def to_dot(df: DataFrame) -> str:
    """The optimized plan as a DOT graph."""
    lines, stack, edges, nodes = df._jdf.queryExecution().optimizedPlan().toString().splitlines(), [], [], []
    for k, line in enumerate(lines):
        body = line.lstrip(" :+-")
        depth = len(line) - len(body)
        while stack and stack[-1][0] >= depth:
            stack.pop()
        nodes.append(f"  n{k} [label={json.dumps(body[:80])}];")
        if stack:
            edges.append(f"  n{k} -> n{stack[-1][1]};")
        stack.append((depth, k))
    return "\n".join(["digraph flow {", *nodes, *edges, "}"])
