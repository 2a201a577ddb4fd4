"""Clip protocols as a data source of Spark's Python API: ``format("clip_protocol")`` to read and to stream.

Options: ``path`` (a file or a folder, of any file system that pyarrow opens), ``dataset`` (a layout of
``protocols.LAYOUTS``), ``mode`` (FAILFAST, the default; PERMISSIVE, which keeps a line that does not
fit in the column ``error``; DROPMALFORMED), ``split_bytes``. Files are cut into ranges of bytes, a task
each; a line belongs to the range that it begins in. A compressed file has no such ranges and is one
task, which reads it block by block. A stream's offset is the length that has been read of each file,
so files may grow by whole lines and new files may come; a compressed file may not grow.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .protocols import FAKE, GENUINE, LAYOUTS

SCHEMA = "utt_id string, label int, attack string, speaker string, codec string, dataset string, attack_key string, error string"
MODES = ("FAILFAST", "PERMISSIVE", "DROPMALFORMED")
COMPRESSED = (".gz", ".bz2", ".zst")
#: The end of a range that goes on to the end of its file.
ENDLESS = 1 << 62


class Range(InputPartition):
    """Bytes from ``start`` to before ``end`` of a file."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def lengths(path: str) -> dict[str, int]:
    """The files of a path, hidden ones left out, and their lengths."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    files = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in files if f.is_file and not f.base_name.startswith(("_", "."))}


def cut(path: str, start: int, end: int, size: int) -> list[Range]:
    if path.endswith(COMPRESSED):
        if 0 < start < end:
            raise ValueError(f"a compressed file has grown: {path}")
        return [Range(path, 0, ENDLESS)] if start < end else []
    return [Range(path, a, min(a + size, end)) for a in range(start, end, size)]


def lines_of(system: fs.FileSystem, part: Range, block: int = 1 << 20) -> Iterator[list[str]]:
    """The lines that begin in a range, block by block. The one that its start is inside of belongs to the range before."""
    # a stream decompresses what the file's name calls compressed; it cannot seek, and has no need to
    with (system.open_input_stream if part.end == ENDLESS else system.open_input_file)(part.path) as file:
        at = max(0, part.start - 1)
        if at:
            file.seek(at)
        rest, first = b"", part.start > 0
        while True:
            data = file.read(block)
            if not data and not rest:
                return
            rest += data
            if first:  # up to and with the line end at or behind the byte before the range
                head, mark, rest = rest.partition(b"\n")
                at += len(head) + len(mark)
                if not mark and data:
                    rest = b""
                    continue
                first = False
            whole, mark, rest = rest.rpartition(b"\n") if data else (rest, b"", b"")
            out = []
            for line in whole.split(b"\n") if whole or mark else []:
                if at >= part.end:
                    break
                out.append(line.decode())
                at += len(line) + 1
            if out:
                yield out
            if at >= part.end or not data:
                return


def parsed(lines: list[str], dataset: str, mode: str) -> pa.RecordBatch:
    """Lines as rows; see the module about modes. Blank lines are no rows."""
    layout = LAYOUTS[dataset]
    text = pa.array(lines, pa.string())
    text = text.filter(pc.not_equal(pc.utf8_trim_whitespace(text), ""))
    fields = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(text))
    wide = pc.equal(pc.list_value_length(fields), layout.fields)
    # lines of another width get fields of the right number, to be blanked below
    blank = pa.scalar([""] * layout.fields, pa.list_(pa.string()))
    fields = pc.if_else(wide, fields, blank)
    at = lambda i: pc.list_element(fields, i)
    key = at(layout.key)
    known = pc.is_in(key, pa.array([FAKE, *GENUINE]))
    good = pc.and_(wide, known)
    message = pc.if_else(wide, pc.binary_join_element_wise(f"{dataset}: unknown label: ", text, ""), pc.binary_join_element_wise(f"{dataset}: expected {layout.fields} fields: ", text, ""))
    if mode == "FAILFAST" and len(text) and not pc.all(good).as_py():
        raise ValueError(message.filter(pc.invert(good))[0].as_py())
    fake = pc.equal(key, FAKE)
    attack = pc.if_else(fake, at(layout.attack), "-")
    codec = at(layout.codec) if layout.codec is not None else pa.array(["-"] * len(text), pa.string())
    shown = lambda x: pc.if_else(good, x, pa.scalar(None, x.type))
    columns = {
        "utt_id": at(layout.utt_id), "label": pc.cast(fake, pa.int32()), "attack": attack, "speaker": at(layout.speaker),
        "codec": pc.if_else(pc.equal(codec, "none"), "-", codec), "dataset": pa.array([dataset] * len(text), pa.string()),
        "attack_key": pc.binary_join_element_wise(dataset, attack, ":"),
    }
    batch = pa.record_batch({c: shown(x) for c, x in columns.items()} | {"error": pc.if_else(good, pa.scalar(None, pa.string()), message)})
    return batch.filter(good) if mode == "DROPMALFORMED" else batch


class _Options:
    def __init__(self, options: dict[str, str]):
        self.path, self.dataset = options["path"], options.get("dataset", "")
        self.mode = options.get("mode", "FAILFAST").upper()
        self.size = int(options.get("split_bytes", 64 << 20))
        if self.dataset not in LAYOUTS:
            raise ValueError(f"unknown dataset {self.dataset!r}; expected one of {sorted(LAYOUTS)}")
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}; expected one of {MODES}")

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        for lines in lines_of(system, part):
            yield parsed(lines, self.dataset, self.mode)


class ProtocolReader(_Options, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for path, size in sorted(lengths(self.path).items()) for r in cut(path, 0, size, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.path else iter(())


class ProtocolStreamReader(_Options, DataSourceStreamReader):
    """Offsets are JSON objects of the lengths read of each file, whole lines only."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps(lengths(self.path), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        return [r for path, size in sorted(now.items()) for r in cut(path, before.get(path, 0), size, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        pass


class ClipProtocol(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clip_protocol"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ProtocolReader:
        return ProtocolReader(dict(self.options))

    def streamReader(self, schema) -> ProtocolStreamReader:  # noqa: N802
        return ProtocolStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ClipProtocol)
