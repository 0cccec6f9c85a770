"""Labelled datasets as a Spark data source: ``spark.read.format("labelled_lines")``, its stream and its writer.

A dataset is a folder of files of JSON lines; a file's folder below it is its split.  Rows are (split, file, at, text,
label): at is the byte at which the line begins, so (file, at) names a row whatever the partitions.

Options: ``path``; ``text`` and ``label``, the fields to take them from, by commas, the first that a line has; ``drop``,
labels to leave out (a reject class), by commas; ``underscores``: true turns underscores of labels into spaces;
``partition_bytes``, bytes of a partition.

The batch reader cuts files into byte ranges and a range reads the lines that begin in it, so a partition that is retried
reads the same lines.  The stream takes files in the order of their names; the last one may still grow, and only whole
lines count, so the offset is one name and one place, whatever the number of files.  The writer's tasks write files of
their own, and the commit moves those of the attempts that won into place; files of other attempts go.

Defined results: blank lines are passed over; a line that isn't a JSON object, or has neither of the fields, raises with
its place; a null text or label is null; files and folders whose names begin with _ or . are no part of a dataset.
Paths may have any scheme that pyarrow's file systems know.
"""

from __future__ import annotations

import io
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage

from sluicegate.operators.joined import DataContractError
from sluicegate.operators.sizes import small

SCHEMA = "split string, file string, at long, text string, label string"
TEXT, LABEL = "text,sentence,query", "label,intent,category,class"
#: Bytes of a partition, and rows of an Arrow batch.
PARTITION_BYTES, BATCH_ROWS = 64 << 20, 4096


@dataclass
class Range(InputPartition):
    """The lines of file that begin at start or later and before end."""

    file: str
    start: int
    end: int


class Folder:
    """The files of a dataset on any file system."""

    def __init__(self, path: str):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:") :]
        self.fs, self.base = pf.FileSystem.from_uri(path) if "://" in path else (pf.LocalFileSystem(), path)
        self.base = self.base.rstrip("/")

    def files(self) -> list[tuple[str, int]]:
        """(name below the folder, bytes) in the order of the files' own names."""
        found = self.fs.get_file_info(pf.FileSelector(self.base, recursive=True, allow_not_found=True))
        names = [(f.path[len(self.base) + 1 :], f.size) for f in found if f.type == pf.FileType.File]
        shown = [(n, size) for n, size in names if not any(p.startswith(("_", ".")) for p in n.split("/"))]
        return sorted(shown, key=lambda x: order(x[0]))

    def open(self, name: str) -> io.BufferedReader:
        return io.BufferedReader(self.fs.open_input_file(f"{self.base}/{name}"), 1 << 20)

    def whole_lines(self, name: str, size: int) -> int:
        """Bytes of the file up to the end of its last whole line."""
        with self.open(name) as f:
            end = size
            while end:
                start = max(0, end - (1 << 16))
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0


def order(name: str) -> tuple[str, str]:
    return name.rsplit("/", 1)[-1], name


def split_of(name: str) -> str:
    return name.rsplit("/", 1)[0] if "/" in name else ""


def lines(folder: Folder, part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in the range."""
    with folder.open(part.file) as f:
        at = part.start
        if at:  # the line that holds the byte before belongs to the range before
            f.seek(at - 1)
            at += len(f.readline()) - 1
        while at < part.end and (line := f.readline()):
            yield at, line
            at += len(line)


class Rows:
    """Lines to Arrow batches of the source's rows, by its options."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.text, self.label = (options.get(k, v).split(",") for k, v in (("text", TEXT), ("label", LABEL)))
        self.drop = set(options["drop"].split(",")) if options.get("drop") else set()
        self.spaces = options.get("underscores", "false").lower() == "true"

    def _field(self, row: dict, names: list[str], where: str) -> str | None:
        name = next((n for n in names if n in row), None)
        if name is None:
            raise DataContractError(f"{where}: none of the fields {', '.join(names)}")
        return None if row[name] is None else str(row[name])

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a source without partitions
            return
        split, rows = split_of(part.file), []
        for at, line in lines(Folder(self.path), part):
            if not line.strip():
                continue
            where = f"{part.file} at byte {at}"
            try:
                row = json.loads(line)
            except ValueError as e:
                raise DataContractError(f"{where}: {e}") from e
            if not isinstance(row, dict):
                raise DataContractError(f"{where}: no JSON object")
            text, label = self._field(row, self.text, where), self._field(row, self.label, where)
            if label in self.drop:
                continue
            rows.append((split, part.file, at, text, label.replace("_", " ") if label and self.spaces else label))
            if len(rows) == BATCH_ROWS:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["split", "file", "at", "text", "label"])


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.rows, self.splits = Rows(options), None
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A condition on split leaves out the other splits' files; all others are Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and tuple(f.attribute) == ("split",):
                self.splits = {f.value} if self.splits is None else self.splits & {f.value}
            else:
                yield f

    def partitions(self) -> list[Range]:
        files = [(n, size) for n, size in Folder(self.rows.path).files() if self.splits is None or split_of(n) in self.splits]
        return [Range(n, at, min(at + self.bytes, size)) for n, size in files for at in range(0, size, self.bytes)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return self.rows.read(part)


class StreamReader(DataSourceStreamReader):
    """Offsets are {"file", "at"}: all files before file, and file up to at, have been read."""

    def __init__(self, options: dict[str, str]):
        self.rows = Rows(options)
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:
        return {"file": "", "at": 0}

    def latestOffset(self) -> dict:
        folder = Folder(self.rows.path)
        files = folder.files()
        if not files:
            return self.initialOffset()
        name, size = files[-1]
        return {"file": name, "at": folder.whole_lines(name, size)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, size in Folder(self.rows.path).files():
            if start["file"] and order(name) < order(start["file"]) or not end["file"] or order(name) > order(end["file"]):
                continue
            low = start["at"] if name == start["file"] else 0
            high = end["at"] if name == end["file"] else size
            out += [Range(name, at, min(at + self.bytes, high)) for at in range(low, high, self.bytes)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return self.rows.read(part)

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the query's checkpoint."""


@dataclass
class Written(WriterCommitMessage):
    """The files that an attempt wrote: (split, name)."""

    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    """Rows with the columns text and label, and split if there is one, as files of JSON lines."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        # names grow with time, as the stream wants them
        self.name = f"{time.time_ns() // 1_000_000:015d}-{uuid.uuid4().hex[:8]}"

    def write(self, rows: Iterator) -> Written:
        folder, open_, files = Folder(self.path), {}, []
        for row in rows:
            r = row.asDict()
            split = r.get("split") or ""
            if split not in open_:
                name = f"{uuid.uuid4().hex}.jsonl"
                folder.fs.create_dir(f"{folder.base}/_written/{self.name}", recursive=True)
                open_[split] = folder.fs.open_output_stream(f"{folder.base}/_written/{self.name}/{name}")
                files.append((split, name))
            line = json.dumps({"text": r["text"], "label": None if r["label"] is None else str(r["label"])}, ensure_ascii=False)
            open_[split].write(line.encode() + b"\n")
        for f in open_.values():
            f.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        folder = Folder(self.path)
        for i, m in enumerate(messages):
            for split, name in m.files if m else ():
                to = f"{folder.base}/{split}".rstrip("/")
                folder.fs.create_dir(to, recursive=True)
                folder.fs.move(f"{folder.base}/_written/{self.name}/{name}", f"{to}/{self.name}-{i:05d}.jsonl")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        folder = Folder(self.path)
        folder.fs.delete_dir_contents(f"{folder.base}/_written/{self.name}", missing_dir_ok=True)


class LabelledLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "labelled_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise DataContractError("labelled_lines appends only")
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and its conditions on split, which Spark hands down only if it is told to."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(LabelledLines)


def numbered(df: DataFrame, label: str = "label", name: str = "class") -> DataFrame:
    """df with the labels' numbers 0 to k - 1, in the order of the labels; rows without a label go."""
    found = df.select(label).where(F.col(label).isNotNull()).distinct()
    names = found.withColumn(name, (F.row_number().over(W.orderBy(label)) - 1).cast("int"))  # a row for each label
    return df.join(small(names), label)
