"""Voice segments of frame streams: one transition rule, folded over a batch or kept as streaming state.

Rules: frames of the wrong size don't count, and numbers may be missing. While idle the last ``pre_roll`` frames are kept; a voiced frame opens a
segment that begins with them, itself included. A segment closes when it has ``min_voiced`` voiced frames and
``end_silence`` unvoiced ones since the last, or ``longest`` frames; with the silence but too few voiced frames
it's dropped. Trailing silence belongs to it. After a close nothing is kept. At the end of a stream an open segment with enough
voiced frames is given out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.running import running

SEGMENT = "stream_id {0}, first_frame long, last_frame long, frames long, voiced long"
STATE = "kept string, frames long, voiced long, silent long, first long, last long, seen long"


@dataclass(frozen=True)
class Rules:
    pre_roll: int = 16
    end_silence: int = 40
    min_voiced: int = 6
    longest: int = 400
    frame_bytes: int = 960

    @classmethod
    def of_times(cls, frame_ms: int = 30, padding: int = 500, silence: int = 1200, speech: int = 200, longest: int = 12_000, rate: int = 16_000) -> Rules:
        """Thresholds in whole frames, one at least."""
        whole = lambda ms: max(1, ms // frame_ms)
        return cls(whole(padding), whole(silence), whole(speech), whole(longest), rate * frame_ms // 1000 * 2)


@dataclass
class State:
    """Numbers of the frames kept while idle; frames, voiced ones and silence of the open segment; its first and last
    frame; the last frame taken."""

    kept: tuple[int, ...] = ()
    frames: int = 0
    voiced: int = 0
    silent: int = 0
    first: int = 0
    last: int = 0
    seen: int = -1


def step(state: State, rules: Rules, frame: int, voiced: bool, n_bytes: int) -> tuple[int, int, int, int] | None:
    """Take one frame; the segment that it closes (first, last, frames, voiced) or None."""
    if n_bytes != rules.frame_bytes:
        return None
    if not state.frames:
        state.kept = (*state.kept, frame)[-rules.pre_roll :]
        if voiced:
            state.frames, state.voiced, state.silent = len(state.kept), 1, 0
            state.first, state.last, state.kept = state.kept[0], frame, ()
        return None
    state.frames += 1
    state.voiced += voiced
    state.silent = 0 if voiced else state.silent + 1
    state.last = frame
    enough, quiet = state.voiced >= rules.min_voiced, state.silent >= rules.end_silence
    if state.frames >= rules.longest or quiet:
        return finish(state, enough or state.frames >= rules.longest)
    return None


def finish(state: State, give: bool) -> tuple[int, int, int, int] | None:
    out = (state.first, state.last, state.frames, state.voiced) if give and state.frames else None
    state.kept = ()
    state.frames = state.voiced = state.silent = state.first = state.last = 0
    return out


def fold(state: State, rules: Rules, frames: Iterable[tuple[int, bool, int]], end: bool) -> list[tuple[int, int, int, int]]:
    found = [s for f in frames if (s := step(state, rules, *f))]
    if end and (s := finish(state, state.voiced >= rules.min_voiced)):
        found.append(s)
    return found


def _rows(stream: object, found: list[tuple[int, int, int, int]]) -> pd.DataFrame:
    frame = pd.DataFrame(found, columns=["first_frame", "last_frame", "frames", "voiced"], dtype="int64")
    frame.insert(0, "stream_id", stream)
    return frame


def segments(frames: DataFrame, rules: Rules) -> DataFrame:
    """All segments of recorded streams (stream_id, frame_no, voiced, n_bytes); the state machine needs a stream's order.

    A stream is read in order within one partition, batch by batch with the state carried over, so it may be of any length.
    """
    kind = frames.schema["stream_id"].dataType.simpleString()
    id_type = to_arrow_type(frames.schema["stream_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SEGMENT.format(kind).split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], id_type if i == 0 else pa.int64()) for i in range(5)], names=names
        )
        stream, state, began = None, State(), False
        for b in batches:
            found = []
            for key, rows in groupby(zip(*(c.to_pylist() for c in b.columns), strict=True), key=lambda r: r[0]):
                if began and key != stream:
                    found += [(stream, *x) for x in fold(state, rules, (), True)]
                    state = State()
                stream, began = key, True
                found += [(key, *x) for x in fold(state, rules, (r[1:] for r in rows), False)]
            yield made(found)
        if began:
            yield made([(stream, *x) for x in fold(state, rules, (), True)])

    ordered = frames.select("stream_id", "frame_no", "voiced", "n_bytes").repartition("stream_id").sortWithinPartitions("stream_id", "frame_no")
    return ordered.mapInArrow(run, SEGMENT.format(kind))


def segment_stream(frames: DataFrame, rules: Rules) -> DataFrame:
    """The same on a stream (with ``end``, true on a marker row that ends a stream); state outlives the micro-batches.

    Within a batch frames are sorted; a frame that comes after a later one of an earlier batch is an error, since the
    segments around it have been given out.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = State()
        if group.exists:
            kept, *rest = group.get
            state = State(tuple(map(int, kept.split())), *rest)
        pdf = pd.concat(list(batches)).sort_values("frame_no")
        ended = pdf["end"].astype(bool)
        rows = pdf[~ended]
        if len(rows) and rows["frame_no"].iloc[0] <= state.seen:
            raise ValueError(f"frame {rows['frame_no'].iloc[0]} of stream {key[0]} came after frame {state.seen}")
        if len(rows):
            state.seen = int(rows["frame_no"].iloc[-1])
        found = fold(state, rules, zip(rows["frame_no"], rows["voiced"], rows["n_bytes"], strict=True), bool(ended.any()))
        kept, *rest = astuple(state)
        group.update((" ".join(map(str, kept)), *map(int, rest)))
        yield _rows(key[0], found)

    kind = frames.schema["stream_id"].dataType.simpleString()
    return frames.groupBy("stream_id").applyInPandasWithState(run, SEGMENT.format(kind), STATE, "append", GroupStateTimeout.NoTimeout)


def segment_statistics(found: DataFrame, frame_ms: int = 30) -> DataFrame:
    """One row a segment with its place in its stream and duration in seconds, three decimals. Recorded whether or not it
    is transcribed."""
    order = Window.partitionBy("stream_id").orderBy("first_frame")
    seconds = F.bround(F.col("frames") * frame_ms / 1000, 3)
    return found.select("stream_id", (F.row_number().over(order) - 1).alias("segment"), "first_frame", "last_frame", "frames", "voiced", seconds.alias("seconds"))


def taken_frames(frames: DataFrame, capacity: int = 512, live: bool = True) -> tuple[DataFrame, DataFrame]:
    """What a bounded queue takes of frames (stream_id, frame_no, queued), ``queued`` those waiting when a frame comes.

    Live frames beyond the capacity are dropped; the second result counts them by stream and says whether the run
    failed. A replay waits instead and drops none. Frames taken before a failure stay in levels and recording.
    """
    fits = F.col("queued") < capacity if live else F.lit(True)
    counts = frames.groupBy("stream_id").agg(F.count("*").alias("frames"), F.count_if(~fits).alias("dropped"))
    return frames.filter(fits), counts.withColumn("failed", F.col("dropped") > 0)


def rechunk_stream(chunks: DataFrame, size: int) -> DataFrame:
    """Byte chunks of a stream as frames of ``size`` bytes; the rest of a micro-batch is carried to the next one."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        rest, n = group.get if group.exists else (b"", 0)
        data = bytes(rest) + b"".join(map(bytes, pd.concat(list(batches)).sort_values("chunk_no")["data"]))
        whole = len(data) // size
        group.update((data[whole * size :], n + whole))
        yield pd.DataFrame({"stream_id": [key[0]] * whole, "frame_no": range(n, n + whole), "frame": [data[i * size : (i + 1) * size] for i in range(whole)]})

    kind = chunks.schema["stream_id"].dataType.simpleString()
    output = f"stream_id {kind}, frame_no long, frame binary"
    return chunks.groupBy("stream_id").applyInPandasWithState(run, output, "rest binary, frames long", "append", GroupStateTimeout.NoTimeout)


def rechunked(chunks: DataFrame, size: int) -> DataFrame:
    """Byte chunks (stream_id, chunk_no, data) as frames of ``size`` bytes; a frame takes its bytes from all chunks it spans.

    Running sums place every chunk on the stream's line of bytes; pieces then meet by frame. A short rest stays out.
    """
    n = F.length("data")
    placed = running(chunks.select("stream_id", "chunk_no", "data"), "stop", n.cast("long"), "stream_id", "chunk_no", size=4096)
    placed = placed.withColumn("start", F.col("stop") - n).filter(n > 0)
    first, last = F.expr(f"start div {size}"), F.expr(f"(stop - 1) div {size}")
    pieces = placed.select("stream_id", "start", "stop", "data", F.explode(F.sequence(first, last)).alias("frame_no"))
    a = F.greatest(F.col("frame_no") * size, F.col("start"))
    piece = F.substring("data", (a - F.col("start") + 1).cast("int"), (F.least((F.col("frame_no") + 1) * size, F.col("stop")) - a).cast("int"))
    parts = pieces.select("stream_id", "frame_no", F.struct(a.alias("a"), piece.alias("data")).alias("p"))
    whole = parts.groupBy("stream_id", "frame_no").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    joined = F.unhex(F.array_join(F.transform("ps", lambda p: F.hex(p["data"])), ""))
    return whole.select("stream_id", "frame_no", joined.alias("frame")).filter(F.length("frame") == size)


def level_stream(frames: DataFrame) -> DataFrame:
    """Running maxima of a stream (run in update mode)."""
    return frames.groupBy("stream_id").agg(F.max("peak").alias("peak"), F.max("rms").alias("rms"), F.count("*").alias("frames"))


def replay(spark, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Recorded frames as a stream, a few files a batch; the reader never drops what it can't keep up with."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
