"""Live capture as keyed state: the bounded queue between a source and its consumer, throttled warnings, idle flushes.

A queue is a recursion over arrival and service times. The consumer takes a frame when the one before it is done, so the
frame's start is the later of its entry and that moment, and the queue's length at any time is the number of entered frames that start
later. A live source drops a frame that meets a full queue, a replay waits until the frame ``capacity`` places ahead
has started. When the consumer fails, the frames that wait are kept for levels and recording without being segmented, and
what comes later (or still waits to enter) is refused.

The batch forms fold the same transitions over recorded rows, one stream after another in order; the streaming forms keep them as
state of ``transformWithState``, with timers that give out frames once the watermark passes their start, forget
warnings after their pause and flush segments of streams that went quiet. These need the RocksDB state store, which they set
in the session. Rows of a stream must come in order over the micro-batches; within one they are sorted.

Edge cases: null arrival times, services below zero and null services count as an error of the source and end the job; a stream
without frames has no rows; failures after the first are ignored. Frames at the same time are taken by number, a
failure at that time after them. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, field
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessella.streaming.segments import SEGMENT, Rules, State, _rows, finish, fold

NEVER = float("-inf")
OUTCOME = "stream_id {0}, frame_no long, entered double, started double, depth int, outcome string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class QueueRules:
    capacity: int = 512
    live: bool = True


@dataclass
class Line:
    """The frames that wait (number, entered, started, depth), when the consumer is free, the last entry and the last row taken."""

    waiting: list[tuple[int, float, float, int]] = field(default_factory=list)
    free: float = NEVER
    entered: float = NEVER
    seen: float = NEVER
    failed: bool = False

    def read_until(self, at: float) -> list[tuple]:
        """Give out the frames that the consumer has taken by then."""
        n = sum(started <= at for _, _, started, _ in self.waiting)
        out, self.waiting = [(*w, "read") for w in self.waiting[:n]], self.waiting[n:]
        return out

    def take(self, rules: QueueRules, frame_no: int | None, at: float, service: float, failure: bool) -> list[tuple]:
        """Take one row; outcomes (number, entered, started, depth, outcome) that it settles."""
        if at < self.seen:
            raise ValueError(f"a row at {at} came after one at {self.seen}")
        self.seen = at
        if self.failed:
            return [] if failure else [(frame_no, None, None, None, "refused")]
        out = self.read_until(at)
        if failure:
            out += [(*w, "kept") if w[1] <= at else (w[0], None, None, None, "refused") for w in self.waiting]
            self.waiting, self.failed = [], True
            return [*out, (None, at, None, None, "failure")]
        entry = at if rules.live else max(at, self.entered)
        ahead = [s for _, _, s, _ in self.waiting if s > entry]
        if len(ahead) >= rules.capacity:
            if rules.live:
                return [*out, (frame_no, None, None, None, "dropped")]
            entry = ahead[-rules.capacity]
        started = max(entry, self.free)
        depth = sum(s > entry for s in ahead) + (started > entry)
        self.entered, self.free = entry, started + service
        self.waiting.append((frame_no, entry, started, depth))
        return out


def _in_order(frames: DataFrame) -> DataFrame:
    late = F.coalesce(F.col("failure"), F.lit(False))
    fit = F.col("at").isNotNull() & (late | (F.col("service") >= 0))
    at = F.when(fit, F.col("at")).otherwise(F.raise_error("a frame needs a time and a service of zero or more"))
    return frames.select("stream_id", F.col("frame_no").cast("long").alias("frame_no"), at.cast("double").alias("at"), F.coalesce(F.col("service").cast("double"), F.lit(0.0)).alias("service"), late.alias("failure"))


def queued(frames: DataFrame, rules: QueueRules = QueueRules()) -> DataFrame:
    """What becomes of recorded frames (stream_id, frame_no, at, service, failure), times in seconds.

    Outcomes: read, dropped, kept (waiting when the consumer failed), refused; a row ``failure`` for the failure itself.
    """
    kind, id_type = frames.schema["stream_id"].dataType.simpleString(), to_arrow_type(frames.schema["stream_id"].dataType)
    types = (id_type, pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.string())
    names = [c.split()[0] for c in OUTCOME.format(kind).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        stream, line, began = None, Line(), False
        for b in batches:
            found = []
            for key, rows in groupby(zip(*(c.to_pylist() for c in b.columns), strict=True), key=lambda r: r[0]):
                if began and key != stream:
                    found += [(stream, *x) for x in line.read_until(float("inf"))]
                    line = Line()
                stream, began = key, True
                found += [(key, *x) for r in rows for x in line.take(rules, *r[1:])]
            yield made(found)
        if began:
            yield made([(stream, *x) for x in line.read_until(float("inf"))])

    ordered = _in_order(frames).repartition("stream_id").sortWithinPartitions("stream_id", "at", "failure", "frame_no")
    return ordered.mapInArrow(run, OUTCOME.format(kind))


def queue_summary(outcomes: DataFrame) -> DataFrame:
    """Per stream: how many frames had which outcome, the deepest queue, and whether the run failed, as a drop alone makes it."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("read", "dropped", "kept", "refused")]
    failed = F.bool_or(F.col("outcome").isin("dropped", "failure"))
    return outcomes.groupBy("stream_id").agg(F.count_if(F.col("outcome") != "failure").alias("frames"), *counts, F.max("depth").alias("deepest"), failed.alias("failed"))


def recorded(frames: DataFrame, outcomes: DataFrame, segmented: bool = False) -> DataFrame:
    """The frames that levels and the recording hold: those read and those kept at a failure; only those read are ``segmented``."""
    held = outcomes.filter(F.col("outcome").isin("read", *([] if segmented else ["kept"]))).select("stream_id", "frame_no")
    return frames.join(held, ["stream_id", "frame_no"], "left_semi")


def _stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Queue(StatefulProcessor):
    def __init__(self, rules: QueueRules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "frame_no long, entered double, started double, depth int")
        self.line = handle.getValueState("line", "free double, entered double, seen double, failed boolean")

    def _load(self) -> Line:
        waiting = [(int(n), float(e), float(s), int(d)) for n, e, s, d in self.waiting.get()] if self.waiting.exists() else []
        return Line(waiting, *self.line.get()) if self.line.exists() else Line(waiting)

    def _store(self, line: Line) -> None:
        self.waiting.put(line.waiting) if line.waiting else self.waiting.clear()
        self.line.update((float(line.free), float(line.entered), float(line.seen), bool(line.failed)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if line.waiting:
            # All have started by then; a frame, a failure or this timer gives them out.
            self.handle.registerTimer(int(line.waiting[-1][2] * 1000) + 1)

    def _frame(self, key: tuple, found: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame(found, columns=["frame_no", "entered", "started", "depth", "outcome"])
        rows = rows.astype({"frame_no": "Int64", "entered": "Float64", "started": "Float64", "depth": "Int32"})
        rows.insert(0, "stream_id", key[0])
        return rows

    def handleInputRows(self, key, rows, timerValues):
        line = self._load()
        frame = pd.concat(list(rows)).sort_values(["at", "failure", "frame_no"])
        number = [None if pd.isna(n) else int(n) for n in frame["frame_no"]]
        found = [x for r in zip(number, frame["at"], frame["service"], frame["failure"], strict=True) for x in line.take(self.rules, *r)]
        self._store(line)
        yield self._frame(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        line = self._load()
        found = line.read_until(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self._store(line)
        yield self._frame(key, found)

    def close(self) -> None:
        pass


def queue_stream(frames: DataFrame, rules: QueueRules = QueueRules(), delay: str = "10 seconds") -> DataFrame:
    """``queued`` on a stream: frames are given out once a later row or the watermark shows that they were read."""
    _stateful(frames.sparkSession)
    kind = frames.schema["stream_id"].dataType.simpleString()
    timed = _in_order(frames).withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("ts", delay)
    return timed.groupBy("stream_id").transformWithStateInPandas(_Queue(rules), OUTCOME.format(kind), "Append", "EventTime")


class _Throttle(StatefulProcessor):
    def __init__(self, seconds: float) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "t double")

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else NEVER
        before, shown = last, []
        for t in sorted(t for frame in rows for t in frame["t"] if pd.notna(t)):
            if t - last >= self.seconds:
                shown.append(t)
                last = t
        if last != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((float(last),))
            self.handle.registerTimer(int((last + self.seconds) * 1000) + 1)
        yield pd.DataFrame({"stream_id": [key[0]] * len(shown), "t": shown})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # Whatever comes now is at least the pause later.
        self.last.clear()
        yield pd.DataFrame({"stream_id": [], "t": []})

    def close(self) -> None:
        pass


def throttle_stream(warnings: DataFrame, seconds: float = 5.0, delay: str = "10 seconds") -> DataFrame:
    """Per stream the warnings (stream_id, t) at least ``seconds`` after the last one shown; quiet streams keep no state."""
    _stateful(warnings.sparkSession)
    kind = warnings.schema["stream_id"].dataType.simpleString()
    timed = warnings.select("stream_id", F.col("t").cast("double").alias("t")).withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    timed = timed.withWatermark("ts", delay)
    return timed.groupBy("stream_id").transformWithStateInPandas(_Throttle(seconds), f"stream_id {kind}, t double", "Append", "EventTime")


class _Segments(StatefulProcessor):
    def __init__(self, rules: Rules, idle_ms: int) -> None:
        self.rules, self.idle_ms = rules, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("segment", "kept string, frames long, voiced long, silent long, first long, last long, seen long")

    def handleInputRows(self, key, rows, timerValues):
        state = State()
        if self.kept.exists():
            kept, *rest = self.kept.get()
            state = State(tuple(map(int, kept.split())), *map(int, rest))
        frame = pd.concat(list(rows)).sort_values("frame_no")
        if frame["frame_no"].iloc[0] <= state.seen:
            raise ValueError(f"frame {frame['frame_no'].iloc[0]} of stream {key[0]} came after frame {state.seen}")
        state.seen = int(frame["frame_no"].iloc[-1])
        found = fold(state, self.rules, zip(frame["frame_no"], frame["voiced"], frame["n_bytes"], strict=True), False)
        self._store(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _rows(key[0], found)

    def _store(self, state: State) -> None:
        kept, *rest = astuple(state)
        self.kept.update((" ".join(map(str, kept)), *map(int, rest)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        kept, *rest = self.kept.get()
        state = State(tuple(map(int, kept.split())), *map(int, rest))
        found = finish(state, state.voiced >= self.rules.min_voiced)
        self._store(state)
        yield _rows(key[0], [found] if found else [])

    def close(self) -> None:
        pass


def live_segments(frames: DataFrame, rules: Rules, idle_ms: int = 2000) -> DataFrame:
    """Segments of a stream (stream_id, frame_no, voiced, n_bytes) without markers: one that had no frame for ``idle_ms`` is at its
    end for the time being, so its open segment is flushed; frames that come later begin anew."""
    _stateful(frames.sparkSession)
    kind = frames.schema["stream_id"].dataType.simpleString()
    read = frames.select("stream_id", "frame_no", "voiced", "n_bytes")
    return read.groupBy("stream_id").transformWithStateInPandas(_Segments(rules, idle_ms), SEGMENT.format(kind), "Append", "ProcessingTime")
