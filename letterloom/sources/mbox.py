"""MBOX files as a Spark data source, read in parallel by byte ranges.

A message begins at an envelope line and belongs to the range that its envelope starts in; a range reads on past its
end until the next envelope. A range that starts inside a line drops the rest of that line, so a cut can't fake an
envelope. Paths with a scheme are opened through pyarrow's file systems.
"""

from __future__ import annotations

import fnmatch
import glob
import os
import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from letterloom.schemas import RAW_MESSAGES

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
_ZONE = re.compile(r"[+-]\d{4}$|[A-Za-z]{1,5}$")
SPLIT_BYTES = 64 << 20
#: Of messages that a range's reader hands on at a time (one longer message goes alone).
BATCH_BYTES, BATCH_ROWS = 4 << 20, 10_000


def envelope(line: bytes) -> tuple[int, int] | None:
    """(year, month) of a line that begins a message, or None."""
    if not line.startswith(b"From "):
        return None
    try:
        parts = line.decode("utf-8").split()
    except UnicodeDecodeError:
        return None
    if len(parts) not in (7, 8) or parts[2] not in _DAYS or parts[3] not in MONTHS:
        return None
    day, clock, year = parts[4], parts[5].split(":"), parts[-1]
    if not (day.isdigit() and 1 <= int(day) <= 31 and len(clock) == 3 and all(c.isdigit() for c in clock)):
        return None
    if int(clock[0]) > 23 or int(clock[1]) > 59 or int(clock[2]) > 59 or not re.fullmatch(r"\d{4}", year):
        return None
    if len(parts) == 8 and not _ZONE.match(parts[6]):
        return None
    return int(year), MONTHS.index(parts[3]) + 1


def _system(path: str):
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, a pattern, or the .mbox files of a folder, in order."""
    from pyarrow import fs

    system, inner = _system(path)
    if isinstance(system, fs.LocalFileSystem):
        if os.path.isdir(inner):
            found = [os.path.join(d, f) for d, _, names in os.walk(inner) for f in names if f.endswith(".mbox")]
        else:
            found = glob.glob(inner)
        return [(p, os.path.getsize(p)) for p in sorted(found)]
    scheme = path.split("://")[0]
    if "*" in inner:
        folder = inner.rpartition("/")[0]
        listed = system.get_file_info(fs.FileSelector(folder))
        return sorted((f"{scheme}://{i.path.lstrip('/')}", i.size) for i in listed if i.type == fs.FileType.File and fnmatch.fnmatch(i.path, f"*{inner.removeprefix(folder)}"))
    info = system.get_file_info(inner)
    rows = system.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
    return sorted((f"{scheme}://{i.path.lstrip('/')}", i.size) for i in rows if i.type == fs.FileType.File and (i.path.endswith(".mbox") or len(rows) == 1))


@dataclass
class Range(InputPartition):
    """Ranges of step bytes each that follow one another in a file, read by one task."""

    path: str
    start: int
    end: int
    step: int


def messages(stream, start: int, end: int) -> Iterator[tuple[int, bytes, tuple[int, int]]]:
    """(offset, raw, (year, month)) of the messages whose envelope starts in [start, end)."""
    at = start
    if start:
        stream.seek(start - 1)
        if stream.read(1) != b"\n":
            at += len(stream.readline())
    held, begin, when = [], at, None
    while line := stream.readline():
        found = envelope(line)
        if found:
            if when:
                yield begin, b"".join(held), when
            if at >= end:
                return
            held, begin, when = [], at, found
        elif not when and at >= end:
            return
        if when:
            held.append(line)
        at += len(line)
    if when:
        yield begin, b"".join(held), when


def _batch(rows: list[tuple]):
    """Rows of RAW_MESSAGES as one Arrow batch."""
    import pyarrow as pa

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.string())
    names = [field.split()[0] for field in RAW_MESSAGES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=names)


class MboxReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.start = int(options.get("startOffset", 0))
        self.tasks = int(options.get("tasks", 1 << 62))  # more than this many aren't needed; ranges beyond that share tasks

    def partitions(self) -> list[Range]:
        found = files_of(self.path)
        if not found:
            raise FileNotFoundError(self.path)
        out = []
        share = min(sum(size for _, size in found) // self.tasks, SPLIT_BYTES) // self.split * self.split or self.split
        for path, size in found:
            if self.start > size:
                raise ValueError(f"start offset {self.start} is beyond {path} of {size} bytes")
            out += [Range(path, at, min(at + share, size), self.split) for at in range(self.start, max(size, self.start + 1), share)]
        return out

    def read(self, part: Range):
        system, inner = _system(part.path)
        name = part.path.rsplit("/", 1)[-1]
        with system.open_input_file(inner) as raw:
            import io

            stream = io.BufferedReader(raw, 1 << 20)
            held, size = [], 0
            for start in range(part.start, max(part.end, part.start + 1), part.step):
                stream.seek(start)
                for offset, message, (year, month) in messages(stream, start, min(start + part.step, part.end)):
                    held.append((name, offset, len(message), message, year, month, f"{year:04d}-{month:02d}"))
                    size += len(message)
                    if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield _batch(held)
                        held, size = [], 0
            if held:
                yield _batch(held)


class MboxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self):
        return RAW_MESSAGES

    def reader(self, schema) -> MboxReader:
        return MboxReader(self.options)


def scratch_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset, in local mode alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="letterloom-")


def read_mbox(spark: SparkSession, path: str, start_offset: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """mbox_file, offset, length, raw (with the envelope), year, month and period of every message. Ranges of split_bytes are
    shared out among four tasks a core, or more where those would have over SPLIT_BYTES each: small ranges of a large mailbox
    are no tasks of their own."""
    spark.dataSource.register(MboxDataSource)
    options = {"startOffset": start_offset, "splitBytes": split_bytes, "tasks": 4 * spark.sparkContext.defaultParallelism}
    return spark.read.format("mbox").options(**options).load(path)


def read_message(split_dir: str, mbox_file: str, offset: int, length: int) -> bytes:
    """One message's bytes by seeking."""
    if length <= 0:
        raise ValueError("a message has at least one byte")
    path = mbox_file if mbox_file.startswith("/") or "://" in mbox_file else f"{split_dir}/{mbox_file}"
    system, inner = _system(path)
    with system.open_input_file(inner) as f:
        f.seek(offset)
        return f.read(length)
