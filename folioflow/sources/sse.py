"""A data source of server-sent events: format("sse") reads and writes folders of `.sse` files, in batch and as a stream.

A file is a stream of frames that ends with a blank line each; a frame that isn't whole yet is left for later. A stream's offsets are, for each file, the
bytes and frames that were read, so files may grow. Rows: stream (the file), seq (the frame's number in it), event, data (its data
lines joined). Written rows (event, data) become a file a task, which appears when the whole write has succeeded.

Folders are local or of a file system that pyarrow knows by its URI; driver and executors must both reach them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "stream string, seq long, event string, data string"
BREAK = re.compile(rb"\r?\n\r?\n")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str) -> list[fs.FileInfo]:
    system, at = opened(path)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.path.endswith(".sse")), key=lambda f: f.path)


def whole_frames(raw: bytes) -> list[tuple[int, bytes]]:
    """(end, frame) of each frame that a blank line ends."""
    out, start = [], 0
    for m in BREAK.finditer(raw):
        out.append((m.end(), raw[start : m.start()]))
        start = m.end()
    return out


def fields(frame: bytes) -> tuple[str, str]:
    """(event, data) of a frame."""
    event, data = "message", []
    for line in frame.decode("utf-8", "replace").splitlines():
        name, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if name == "event":
            event = value
        elif name == "data":
            data.append(value)
    return event, "\n".join(data)


@dataclass
class Part(InputPartition):
    """Bytes start..end of a file, of which the first frame has the number seq."""

    path: str
    start: int
    end: int | None
    seq: int


def rows_of(path: str, part: Part) -> Iterator[tuple]:
    system, _ = opened(path)
    with system.open_input_file(part.path) as f:
        f.seek(part.start)
        raw = f.read() if part.end is None else f.read(part.end - part.start)
    # Of a batch the last frame counts if a blank line is all that it lacks.
    frames = [frame for _, frame in whole_frames(raw if part.end is not None else raw.rstrip(b"\r\n") + b"\n\n")]
    frames = [f for f in frames if f.strip()]
    for n, frame in enumerate(frames, part.seq):
        yield (part.path.rsplit("/", 1)[-1], n, *fields(frame))


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(f.path, 0, None, 0) for f in listed(self.path)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return rows_of(self.path, partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path, self.known = path, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Whole frames of each file; only what was added since the last look is read."""
        for f in listed(self.path):
            at, seq = self.known.get(f.path, (0, 0))
            if f.size > at:
                system, _ = opened(self.path)
                with system.open_input_file(f.path) as file:
                    file.seek(at)
                    frames = whole_frames(file.read(f.size - at))
                if frames:
                    self.known[f.path] = (at + frames[-1][0], seq + sum(bool(x.strip()) for _, x in frames))
        return {p: list(v) for p, v in self.known.items()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        # After a restart what was read before isn't looked at again.
        self.known = {p: tuple(v) for p, v in {**end, **{p: v for p, v in self.known.items() if v[0] >= end.get(p, [0])[0]}}.items()}
        first = lambda p: start.get(p, [0, 0])
        return [Part(p, first(p)[0], v[0], first(p)[1]) for p, v in end.items() if v[0] > first(p)[0]]

    def read(self, partition: Part) -> Iterator[tuple]:
        return rows_of(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Writer(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite, self.run = path, names, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        system, at = opened(self.path)
        system.create_dir(f"{at}/_{self.run}")
        name, some = f"{uuid.uuid4().hex}.sse", False
        with system.open_output_stream(f"{at}/_{self.run}/{name}") as out:
            for row in iterator:
                values, some = dict(zip(self.names, row)), True
                lines = "".join(f"data: {line}\n" for line in (values["data"] or "").split("\n"))
                out.write(f"event: {values['event'] or 'message'}\n{lines}\n".encode())
        return Written(name if some else None)

    def commit(self, messages: list[Written]) -> None:
        system, at = opened(self.path)
        if self.overwrite:
            for f in listed(self.path):
                system.delete_file(f.path)
        for m in messages:
            if m is not None and m.name:
                system.move(f"{at}/_{self.run}/{m.name}", f"{at}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        system, at = opened(self.path)
        if system.get_file_info(f"{at}/_{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{at}/_{self.run}")


class ServerSentEvents(DataSource):
    """spark.read.format("sse").load(folder), readStream likewise; rows (event, data) are written by write.format("sse")."""

    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        return self.options["path"].rstrip("/")

    def reader(self, schema) -> Reader:
        return Reader(self._path())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self._path())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self._path(), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ServerSentEvents)
