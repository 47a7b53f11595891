"""Data sources for spark.read.format: a run log that several drivers append to, and ground-truth lines. register() names them.

Files are opened through Arrow's file systems by the tasks and the driver, so paths may be local, shared or remote.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

# The fields of the run log.
RUN_LOG = "method string, K string, seed int, n_support int, fit_s double, acc double, macro_f1 double, params bigint, layers int, ab_train array<double>, key_cos_to_start double, best_epoch int, alpha double, beta double, val_macro_f1 double, a2 double, b2 double, variant string, epochs int, hardware string"
BOXES = "path string, label int, boxes array<array<double>>"
#: Rows of an Arrow batch; bytes of a file that one task reads.
ROWS, SPLIT = 4096, 64 << 20
#: Folders of a run log: files that tasks wrote, and the lists of those that count. Spark's own readers skip both names.
DATA, COMMITS = "_runs", "_commits"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def listed(fs: pafs.FileSystem, at: str) -> list[pafs.FileInfo]:
    """The files below a folder, or the file itself, by name; those that begin with _ or . are left out."""
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [info]
    files = [f for f in fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True)) if f.type == pafs.FileType.File]
    hidden = lambda f: any(p[:1] in "_." for p in f.path[len(at) :].split("/") if p)
    return sorted((f for f in files if not hidden(f)), key=lambda f: f.path)


class Pushed:
    """Filters on text and numbers that rows must pass; pushFilters takes those of some columns and gives back the others."""

    columns: tuple[str, ...] = ()

    def __init__(self) -> None:
        self.tests: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.columns and isinstance(f, EqualTo):
                self.tests.append((name, "in", [f.value]))
            elif name in self.columns and isinstance(f, In):
                self.tests.append((name, "in", list(f.value)))
            elif name in self.columns and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            else:
                yield f

    def passes(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            x = row.get(name)
            if x is None or (x not in value if kind == "in" else not x.startswith(value)):
                return False
        return True


def batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches; at most ROWS are held."""
    some: list[dict] = []
    for row in rows:
        some.append(row)
        if len(some) == ROWS:
            yield pa.RecordBatch.from_pylist(some, schema)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


@dataclass
class Part(InputPartition):
    """Bytes start to end of a file."""

    path: str
    start: int = 0
    end: int = 0


# ---- run log
class RunLog(DataSource):
    """format("run_log"): one row for each run of a log in a folder that any number of drivers append to at once.

    A task writes a file of JSON lines of its own below _runs; when all tasks of an append are done, its driver lists
    their files in one new file below _commits, put there by a rename, and moves them to the folder. Read are the files
    listed, wherever they are, and files of JSON lines that others put into the folder. So an append is there whole or not
    at all, no driver touches what another wrote, and attempts that were lost or repeated count for nothing. Missing
    fields are null, and a line that is no JSON is a row of nulls; equality, IN and beginnings of method, K, variant and
    seed are tested before a row is built. Each file is read by one task whole: a log is small.
    """

    @classmethod
    def name(cls) -> str:
        return "run_log"

    def schema(self) -> str:
        return RUN_LOG

    def reader(self, schema: StructType) -> DataSourceReader:
        return RunReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a run log is only appended to")
        return RunWriter(self.options["path"])


class RunReader(Pushed, DataSourceReader):
    columns = ("method", "K", "variant", "seed")

    def __init__(self, path: str, schema: StructType) -> None:
        super().__init__()
        self.path, self.fields = path, {f.name: f.dataType.simpleString() for f in schema.fields}

    def partitions(self) -> list[Part]:
        fs, at = filesystem(self.path)
        # files before lists: what is seen of an append is in a list that is seen, too, and so is the rest of it
        names = {f.path.rsplit("/", 1)[1] for f in listed(fs, at)}
        for f in fs.get_file_info(pafs.FileSelector(f"{at}/{COMMITS}", allow_not_found=True)):
            if f.path.endswith(".json"):
                with fs.open_input_stream(f.path) as stream:
                    names |= set(json.loads(stream.read()))
        return [Part(n) for n in sorted(names)] or [Part("")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
        schema = pa.schema([(c, kinds[k]) for c, k in self.fields.items()])
        if not part.path:
            return iter(())
        return batches(self.rows(part.path), schema)

    def rows(self, name: str) -> Iterator[dict]:
        text = {c for c, k in self.fields.items() if k == "string"}
        for line in self.content(name).splitlines():
            try:
                found = json.loads(line)
            except ValueError:
                found = {}
            row = {c: str(v) if c in text and v is not None else v for c, v in found.items() if c in self.fields}
            if self.passes(row):
                yield row

    def content(self, name: str) -> str:
        """The text of a file, which its driver may just be moving out of _runs."""
        fs, at = filesystem(self.path)
        for place in (at, f"{at}/{DATA}", at):
            try:
                with fs.open_input_stream(f"{place}/{name}") as stream:
                    return stream.read().decode()
            except FileNotFoundError:
                continue
        raise FileNotFoundError(f"{at}/{name}")


@dataclass
class Wrote(WriterCommitMessage):
    """The file a task wrote, or None where it had no rows."""

    name: str | None


class RunWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator) -> Wrote:
        fs, at = filesystem(self.path)
        name = None
        out = None
        for row in iterator:
            if out is None:
                fs.create_dir(f"{at}/{DATA}", recursive=True)
                name = f"{uuid.uuid4().hex}.json"
                out = fs.open_output_stream(f"{at}/{DATA}/{name}")
            values = {c: v for c, v in row.asDict(True).items() if v is not None}
            out.write((json.dumps(values, ensure_ascii=False, default=str) + "\n").encode())
        if out is not None:
            out.close()
        return Wrote(name)

    def commit(self, messages: list[Wrote | None]) -> None:
        names = [m.name for m in messages if m is not None and m.name]
        if not names:
            return
        fs, at = filesystem(self.path)
        fs.create_dir(f"{at}/{COMMITS}", recursive=True)
        file = f"{at}/{COMMITS}/{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{file}.tmp") as out:
            out.write(json.dumps(names).encode())
        fs.move(f"{file}.tmp", f"{file}.json")
        for n in names:  # from here on they count; out here, streams and plain readers see them too
            fs.move(f"{at}/{DATA}/{n}", f"{at}/{n}")

    def abort(self, messages: list[Wrote | None]) -> None:
        fs, at = filesystem(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{at}/{DATA}/{m.name}")


# ---- ground truth
class GroundTruth(DataSource):
    """format("ground_truth"): path, label, boxes of each line 'path label [x0 y0 x1 y1]...' of text files.

    Fields are separated by white space or commas; a line of fewer than two fields gives no row, a label or number that is
    none is null, and numbers that do not fill a box are left out. Files are read in ranges of bytes (option split), a
    line by the task in whose range it begins. Equality, IN and beginnings of path and label are tested on the fields.
    """

    @classmethod
    def name(cls) -> str:
        return "ground_truth"

    def schema(self) -> str:
        return BOXES

    def reader(self, schema: StructType) -> DataSourceReader:
        return LineReader(self.options["path"], int(self.options.get("split", SPLIT)))


def number(text: str, kind: type) -> Any:
    try:
        return kind(text)
    except ValueError:
        return None


class LineReader(Pushed, DataSourceReader):
    columns = ("path", "label")

    def __init__(self, path: str, split: int) -> None:
        super().__init__()
        self.path, self.split = path, split

    def partitions(self) -> list[Part]:
        fs, at = filesystem(self.path)
        files = listed(fs, at)
        return [Part(f.path, a, min(a + self.split, f.size)) for f in files for a in range(0, f.size, self.split)] or [Part("")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("label", pa.int32()), ("boxes", pa.list_(pa.list_(pa.float64())))])
        return batches(self.rows(part), schema) if part.path else iter(())

    def rows(self, part: Part) -> Iterator[dict]:
        for line in self.lines(part):
            fields = [f for f in re.split(r"[\s,]+", line) if f]
            row = {"path": fields[0], "label": number(fields[1], int)} if len(fields) > 1 else None
            if row and self.passes(row):
                values = [number(f, float) for f in fields[2:]]
                yield row | {"boxes": [values[i : i + 4] for i in range(0, len(values) - 3, 4)]}

    def lines(self, part: Part) -> Iterator[str]:
        """The lines that begin in the range; the first belongs to the range before unless it begins there."""
        fs, _ = filesystem(self.path)
        with fs.open_input_file(part.path) as raw:
            at = max(0, part.start - 1)
            raw.seek(at)
            rest, skip = b"", part.start > 0
            while at < part.end:
                block = raw.read(1 << 20)
                last = not block
                pieces = (rest + block).split(b"\n")
                rest = b"" if last else pieces.pop()
                for piece in pieces:
                    if skip:
                        skip = False
                    elif at < part.end:
                        yield piece.decode("utf-8", "replace")
                    else:
                        return
                    at += len(piece) + 1
                if last:
                    return


_registering = threading.Lock()


def register(spark: SparkSession) -> None:
    """run_log and ground_truth as formats of the session; their pushed filters are on, and the session is this thread's."""
    spark._jvm.SparkSession.setActiveSession(spark._jsparkSession)  # formats are looked up in the thread's session
    with _registering:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(RunLog)
        spark.dataSource.register(GroundTruth)


def append_runs(runs: DataFrame, path: str) -> None:
    """runs added to the log at path, whole or not at all, whoever else appends."""
    register(runs.sparkSession)
    runs.write.format("run_log").mode("append").save(path)
