"""Growing log files as a streaming source: spark.readStream.format("log_tail").option("path", folder or glob).

Offsets are bytes read of each file. A batch admits `maxLines` lines and `maxBytes` bytes at the most (together, files in
turn by name), a single longer line whole; the limits bound what the driver looks at to find line ends, and the tasks read the lines, one
range a file. A file that has become shorter was truncated and is read again from its start; one that is gone is forgotten.
A line counts once its line end has been written. A restarted query goes on at its checkpoint's offsets.

Register it once a session: register(spark). Rows: file, at (byte where the line begins), line.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

MAX_LINES, MAX_BYTES = 100_000, 64 << 20
#: Bytes that are looked at at once for line ends.
_STEP = 1 << 20


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def sizes(path: str) -> dict[str, int]:
    """Bytes of the files at a path: a file, a folder, or a pattern in a folder."""
    fs, place = _at(path)
    folder, _, pattern = place.rpartition("/")
    info = fs.get_file_info(place)
    if info.type == pafs.FileType.File:
        return {place: info.size}
    if info.type == pafs.FileType.Directory:
        folder, pattern = place.rstrip("/"), "*"
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and fnmatch(f.base_name, pattern) and not f.base_name.startswith((".", "_"))}


def line_end(fs: pafs.FileSystem, file: str, low: int, size: int, lines: int, most: int) -> tuple[int, int]:
    """(byte after the last admitted line, lines) from byte `low` on: at most `lines` lines and `most` bytes, but one line at the least."""
    end, count, at = low, 0, low
    with fs.open_input_file(file) as f:
        while at < size and count < lines and (at - low < most or not count):
            f.seek(at)
            part = f.read(min(_STEP, size - at))
            if not part:
                break
            start = 0
            while count < lines and (stop := part.find(b"\n", start)) >= 0:
                if count and at + stop + 1 - low > most:
                    return end, count
                end, count, start = at + stop + 1, count + 1, stop + 1
            at += len(part)
    return end, count


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.lines, self.bytes = int(options.get("maxLines", MAX_LINES)), int(options.get("maxBytes", MAX_BYTES))
        self.now: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Each file's [bytes read, times that it was truncated], one batch further than before."""
        fs, _ = _at(self.path)
        then, lines, most = {}, self.lines, self.bytes
        for file, size in sizes(self.path).items():
            low, cut = self.now.get(file, [0, 0])
            if size < low:
                low, cut = 0, cut + 1
            end, count = line_end(fs, file, low, size, lines, most) if lines > 0 and most > 0 else (low, 0)
            then[file] = [end, cut]
            lines, most = lines - count, most - (end - low)
        self.now = then
        return then

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.now = end  # a restarted query asks for its last batch first
        ranges = ((file, start.get(file, [0, 0]), now) for file, now in end.items())
        return [InputPartition((file, 0 if now[1] > old[1] else old[0], now[0])) for file, old, now in ranges if now != old]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        file, low, high = partition.value
        fs, _ = _at(self.path)
        with fs.open_input_file(file) as f:
            f.seek(low)
            while low < high:
                part = f.read(min(_STEP, high - low))
                while part and not part.endswith(b"\n") and low + len(part) < high:  # to the end of a line
                    part += f.read(min(_STEP, high - low - len(part)))
                    cut = part.rfind(b"\n") + 1
                    if cut:
                        f.seek(low + cut)
                        part = part[:cut]
                if not part:
                    break
                rows = part.removesuffix(b"\n").split(b"\n")
                at = [low]
                for row in rows[:-1]:
                    at.append(at[-1] + len(row) + 1)
                texts = [r.removesuffix(b"\r").decode("utf-8", "replace") for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array(at, pa.int64()), pa.array(texts)], names=["file", "at", "line"])
                low += len(part)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
