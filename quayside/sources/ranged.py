"""Data sources of their own: raw recordings read in byte ranges, and recorded messages replayed at a pace.

Both read through Arrow's file systems, so a path may be local or on shared storage that Arrow knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from quayside.sources.signals import FIRST_SAMPLES, FULL_SCALE, SAMPLE_BYTES, SAMPLE_RATE

RANGE_BYTES = 32 << 20
#: Samples of a range that are decoded at a time.
PIECE_SAMPLES = 1 << 17
SIGNALS, REPLAY = "quayside_signals", "quayside_replay"


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The files of a folder in order of their names, or the one file; names that start with . or _ are hidden."""
    system, place = fs.FileSystem.from_uri(path)
    found = system.get_file_info(place)
    if found.type == fs.FileType.File:
        return system, [found]
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    listed = system.get_file_info(fs.FileSelector(place))
    return system, sorted((f for f in listed if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.base_name)


@dataclass
class SampleRange(InputPartition):
    """Samples ``first`` to ``last - 1`` of a file: those that start in one range of its bytes."""

    place: str
    file_id: str
    first: int
    last: int


def sample_ranges(place: str, file_id: str, size: int, samples: int | None, range_bytes: int) -> list[SampleRange]:
    """A file cut by bytes. A sample belongs to the range in which it starts; an incomplete one at the end to none."""
    whole = size // SAMPLE_BYTES
    wanted = whole if samples is None else min(whole, samples)
    # where the first sample of each range starts, whatever the range cuts through
    cuts = [min(wanted, -(-start // SAMPLE_BYTES)) for start in range(0, wanted * SAMPLE_BYTES, range_bytes)] + [wanted]
    return [SampleRange(place, file_id, a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


class SignalReader(DataSourceReader):
    def __init__(self, path: str, samples: int | None, range_bytes: int):
        if range_bytes < 1:
            raise ValueError("rangeBytes is at least 1")
        self.path, self.samples, self.range_bytes = path, samples, range_bytes

    def partitions(self) -> list[SampleRange]:
        _, files = _files(self.path)
        parts = [p for f in files for p in sample_ranges(f.path, f.base_name.split(".")[0], f.size, self.samples, self.range_bytes)]
        return parts or [SampleRange("", "", 0, 0)]

    def read(self, partition: SampleRange) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.place) as file:
            for first in range(partition.first, partition.last, PIECE_SAMPLES):
                count = min(PIECE_SAMPLES, partition.last - first)
                raw = np.frombuffer(file.read_at(count * SAMPLE_BYTES, first * SAMPLE_BYTES), "<i4", count)
                pos = np.arange(first, first + count, dtype=np.int64)
                yield pa.record_batch(
                    {
                        "file_id": pa.array([partition.file_id]).take(pa.array(np.zeros(count, np.int32))),
                        "pos": pos,
                        "second": (pos // SAMPLE_RATE).astype(np.int32),
                        "value": raw / FULL_SCALE,
                    }
                )


class SignalSource(DataSource):
    """Recordings as (file_id, pos, second, value). Options: path, samples (``all`` for whole files), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return SIGNALS

    def schema(self) -> str:
        return "file_id string, pos long, second int, value double"

    def reader(self, schema) -> SignalReader:
        samples = str(self.options.get("samples", FIRST_SAMPLES))
        size = int(self.options.get("rangeBytes", RANGE_BYTES))
        return SignalReader(self.options["path"], None if samples == "all" else int(samples), size)


class ReplayReader(SimpleDataSourceStreamReader):
    """Offsets are a file's name and a byte in it, so a stream goes on where it stopped, also with files added since.

    Lines end at a line feed; the last line of a file may lack one, as files are complete when they appear.
    Files are released in order of their names: a new file must come after those released before.
    """

    def __init__(self, path: str, lines: int):
        if lines < 1:
            raise ValueError("linesPerBatch is at least 1")
        self.path, self.lines = path, lines

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0}

    def _lines(self, start: dict) -> Iterator[tuple[tuple[str, str], dict]]:
        """Every line after an offset, with its file's name and the offset behind it."""
        system, files = _files(self.path)
        for info in files:
            if info.base_name < start["file"]:
                continue
            at = start["byte"] if info.base_name == start["file"] else 0
            with system.open_input_file(info.path) as raw:
                raw.seek(at)
                with pa.BufferedInputStream(raw, 1 << 16) as stream:
                    rest = b""
                    while block := stream.read(1 << 16):
                        *done, rest = (rest + block).split(b"\n")
                        for line in done:
                            at += len(line) + 1
                            yield (info.base_name, line.decode(errors="replace")), {"file": info.base_name, "byte": at}
                    if rest:
                        yield (info.base_name, rest.decode(errors="replace")), {"file": info.base_name, "byte": at + len(rest)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], start
        for row, end in self._lines(start):
            rows.append(row)
            if len(rows) == self.lines:
                break
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if start == end:
            return
        for row, after in self._lines(start):
            yield row
            if after == end:
                return


class ReplaySource(DataSource):
    """Recorded messages as (file, value), a number of lines a batch. Options: path, linesPerBatch."""

    @classmethod
    def name(cls) -> str:
        return REPLAY

    def schema(self) -> str:
        return "file string, value string"

    def simpleStreamReader(self, schema) -> ReplayReader:
        return ReplayReader(self.options["path"], int(self.options.get("linesPerBatch", 1)))


def read_signal_ranges(
    spark: SparkSession, path: str, samples: int | None = FIRST_SAMPLES, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Like ``read_signals``, but a file of any size is read by many tasks, a byte range each; None reads whole files."""
    spark.dataSource.register(SignalSource)
    options = {"samples": "all" if samples is None else samples, "rangeBytes": range_bytes}
    return spark.read.format(SIGNALS).options(**options).load(path)


def paced_replay(spark: SparkSession, path: str, lines_per_batch: int) -> DataFrame:
    """Recorded messages, one per line, ``lines_per_batch`` a trigger; the trigger interval sets the pace.

    Lines pass through the driver, one batch at a time; ``replay_stream`` reads whole files in tasks.
    """
    spark.dataSource.register(ReplaySource)
    return spark.readStream.format(REPLAY).option("linesPerBatch", lines_per_batch).load(path)
