"""Data sources of their own: WAV recordings by ranges of samples, members of zip archives, and a WAV writer.

Register them once a session with ``register``; then ``spark.read.format("wav").load(path)``, ``format("members")`` and
``df.write.format("wav")``. Paths are files, folders or patterns of the local system or of any store that pyarrow
reaches by its URI; the driver lists them and reads heads and archive directories alone.

* ``wav``: rows (path, sample_rate, start, samples), a row for every ``rowsamples`` samples (65,536), a partition for every
  ``partitionsamples`` (4,194,304), so one recording of any length spreads over tasks, each of which reads its own range of the file.
  A file that isn't mono of 16 bits is one row with an error.
* ``members``: rows (archive, member, size, content, error), partitions of about ``partitionbytes`` (64 MB) of members. All paths of an
  archive are checked before any member is read: one that leaves the archive makes it a row with an error and nothing else.
* writing ``wav``: rows (name, sample_rate, pcm). Tasks write beside their targets, the driver gives the files their names when all
  tasks are done and removes them if any failed. ``exclusive`` (true): a file that exists, or a name that comes twice, fails the
  whole write and leaves nothing behind; otherwise old files are replaced and the last of equal names counts.
"""

from __future__ import annotations

import glob
import os
import posixpath
import struct
import uuid
import wave
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

WAV = "path string, sample_rate int, start long, samples array<smallint>, error string"
MEMBERS = "archive string, member string, size long, content binary, error string"
PCM = "name string, sample_rate int, pcm binary"


def _local(path: str) -> str | None:
    """The local path of a path or file URI."""
    if "://" not in path:
        return path.removeprefix("file:")
    return path.removeprefix("file://") if path.startswith("file://") else None


def opened(path: str):
    """A seekable binary file."""
    if (own := _local(path)) is not None:
        return open(own, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def listed(path: str, suffix: str) -> list[str]:
    """The file, the files of a folder with the suffix, or those of a pattern, in order."""
    if (own := _local(path)) is not None:
        if os.path.isdir(own):
            return sorted(os.path.join(own, n) for n in os.listdir(own) if n.lower().endswith(suffix) and not n.startswith((".", "_")))
        found = sorted(glob.glob(own))
        if not found:
            raise FileNotFoundError(path)
        return found
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    head = path[: len(path) - len(inner)]
    if store.get_file_info(inner).type == fs.FileType.File:
        return [path]
    return sorted(head + f.path for f in store.get_file_info(fs.FileSelector(inner)) if f.path.lower().endswith(suffix))


@dataclass
class Samples(InputPartition):
    """Samples ``start`` to ``stop`` of a file whose data begin at byte ``data``; or the file's error."""

    path: str
    rate: int | None = None
    data: int = 0
    start: int = 0
    stop: int = 0
    error: str | None = None


def wav_head(f) -> tuple[int, int, int]:
    """Sample rate, first byte and number of the samples of a mono file of 16 bits."""
    if (head := f.read(12))[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    rate = None
    while len(chunk := f.read(8)) == 8:
        name, size = struct.unpack("<4sI", chunk)
        if name == b"fmt ":
            form = f.read(size + size % 2)
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
            if kind not in (1, 0xFFFE) or (channels, bits) != (1, 16):
                raise ValueError("not mono of 16 bits")
        elif name == b"data":
            if rate is None:
                raise ValueError("no format before the data")
            at = f.tell()
            f.seek(0, os.SEEK_END)
            return rate, at, min(size, f.tell() - at) // 2
        else:
            f.seek(size + size % 2, os.SEEK_CUR)
    raise ValueError("no data")


class WavReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.row, self.part = int(options.get("rowsamples", 1 << 16)), int(options.get("partitionsamples", 1 << 22))

    def partitions(self) -> list[Samples]:
        found = []
        for path in listed(self.path, ".wav"):
            try:
                with opened(path) as f:
                    rate, data, n = wav_head(f)
                found += [Samples(path, rate, data, a, min(a + self.part, n)) for a in range(0, n, self.part)] or [Samples(path, rate, data)]
            except (ValueError, struct.error) as e:
                found.append(Samples(path, error=str(e)))
        return found

    def read(self, partition: Samples) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("start", pa.int64()), ("samples", pa.list_(pa.int16())), ("error", pa.string())])

        def row(start: int | None, samples: pa.Array | None) -> pa.RecordBatch:
            kept = pa.array([None], pa.list_(pa.int16())) if samples is None else pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), samples)
            own = [pa.array([v], t) for v, t in ((partition.path, pa.string()), (partition.rate, pa.int32()), (start, pa.int64()))]
            return pa.RecordBatch.from_arrays([*own, kept, pa.array([partition.error], pa.string())], schema=schema)

        if partition.error is not None:
            yield row(None, None)
            return
        if partition.stop == 0:
            yield row(0, pa.array([], pa.int16()))
            return
        import numpy as np

        with opened(partition.path) as f:
            f.seek(partition.data + 2 * partition.start)
            for at in range(partition.start, partition.stop, self.row):
                n = min(self.row, partition.stop - at)
                yield row(at, pa.array(np.frombuffer(f.read(2 * n), "<i2")))


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (where they are, where they belong)."""

    files: list[tuple[str, str]]


class WavWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.root = _local(options["path"])
        if self.root is None:
            raise ValueError("WAV files are written to a folder that driver and executors share")
        self.exclusive = options.get("exclusive", "false").lower() == "true"
        if missing := {"name", "sample_rate", "pcm"} - set(schema.names):
            raise ValueError(f"missing columns: {', '.join(sorted(missing))}")

    def write(self, rows: Iterator[Row]) -> Written:
        files: list[tuple[str, str]] = []
        os.makedirs(self.root, exist_ok=True)
        try:
            for r in rows:
                if not r["name"] or posixpath.basename(r["name"]) != r["name"]:
                    raise ValueError(f"not a file name: {r['name']!r}")
                own = os.path.join(self.root, f".{uuid.uuid4().hex}.part")
                files.append((own, os.path.join(self.root, r["name"])))
                with open(own, "wb") as f, wave.open(f, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(r["sample_rate"])
                    w.writeframes(bytes(r["pcm"] or b""))
        except BaseException:
            _remove([own for own, _ in files])
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        placed: list[str] = []
        try:
            for own, target in files:
                if self.exclusive:
                    os.link(own, target)  # fails if the name is taken
                    placed.append(target)
                else:
                    os.replace(own, target)
        except OSError:
            _remove(placed)
            raise
        finally:
            _remove([own for own, _ in files])

    def abort(self, messages: list[Written | None]) -> None:
        _remove([own for m in messages if m for own, _ in m.files])


def _remove(paths: list[str]) -> None:
    for p in paths:
        if os.path.exists(p):
            os.unlink(p)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return WAV

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter(self.options, schema)


@dataclass
class Members(InputPartition):
    archive: str
    names: tuple[str, ...] = ()
    error: str | None = None


def inner_path(name: str) -> str:
    """A member's path within its archive, which it must not leave."""
    flat = posixpath.normpath(name.replace("\\", "/"))
    if flat.startswith(("/", "../")) or flat == ".." or flat[1:2] == ":":
        raise ValueError("a member's path leaves the archive")
    return flat


class MembersReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.part = options["path"], int(options.get("partitionbytes", 64 << 20))

    def partitions(self) -> list[Members]:
        found = []
        for path in listed(self.path, ".zip"):
            try:
                with opened(path) as f, zipfile.ZipFile(f) as z:
                    infos = [i for i in z.infolist() if not i.is_dir()]
                for i in infos:
                    inner_path(i.filename)
            except (ValueError, zipfile.BadZipFile) as e:
                found.append(Members(path, error=str(e)))
                continue
            names, size = [], 0
            for i in infos:
                names.append(i.filename)
                size += i.file_size
                if size >= self.part:
                    found.append(Members(path, tuple(names)))
                    names, size = [], 0
            if names:
                found.append(Members(path, tuple(names)))
        return found

    def read(self, partition: Members) -> Iterator[tuple]:
        if partition.error is not None:
            yield (partition.archive, None, 0, None, partition.error)
            return
        with opened(partition.archive) as f, zipfile.ZipFile(f) as z:
            for name in partition.names:
                try:
                    content, error = z.read(name), None
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:  # a damaged or locked member
                    content, error = None, str(e)
                yield (partition.archive, inner_path(name), z.getinfo(name).file_size, content, error)


class MembersSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> MembersReader:
        return MembersReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (WavSource, MembersSource):
        spark.dataSource.register(source)
