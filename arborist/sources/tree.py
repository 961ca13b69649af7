"""A data source for element trees: `spark.read.format("element_tree")`, `df.write`, `spark.readStream`.

A tree is a folder per project, below it a folder per element, in which every
field is a file (`description.md`, `diagram.mmd`, ...).  Reading gives (project,
path, field, text), a task for each project and top element; the options
`projects` and `fields`, lists in JSON, name the folders and files that are opened
at all.  (They are options, since filters that Spark pushes to a Python source
stay with the loaded frame, and with its other queries.)  Writing
replaces the projects that are written: tasks write to a staging folder and
report what they wrote, and the commit moves whole projects into place and
numbers itself.  A stream reads the projects of the commits since its offset.

`file_tree` reads any tree of files whose first folder level is the project.
The driver lists only the upper folders; tasks list what is below them, and read it.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

from arborist.functions.rules import DIAGRAM_FILES, FIELD_FILES

NAME = "element_tree"
SCHEMA = "project STRING, path STRING, field STRING, text STRING"
FILE_OF = {field: name for name, field in FIELD_FILES.items()} | {"diagram": DIAGRAM_FILES[0][0]}
FIELD_OF = {name: field for field, name in FILE_OF.items()}
COMMITS = "_commits"


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of a path or URI."""
    if "://" in root or root.startswith("file:"):
        system, path = fs.FileSystem.from_uri(root)
        return system, path.rstrip("/")
    return fs.LocalFileSystem(), root.rstrip("/")


def folders(system: fs.FileSystem, path: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", ".")))


@dataclass
class Part(InputPartition):
    project: str
    top: str


@dataclass
class Wrote(WriterCommitMessage):
    projects: list[str]
    files: int


class _Tree:
    """What batch and stream readers share: partitions of projects, and the rows of one."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.projects, self.fields = (set(json.loads(options[k])) if k in options else None for k in ("projects", "fields"))

    def parts(self, projects: list[str]) -> list[Part]:
        system, root = open_root(self.root)
        return [Part(p, top) for p in projects for top in folders(system, f"{root}/{p}")]

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no partitions
            return
        system, root = open_root(self.root)
        base = f"{root}/{part.project}"
        waiting = [part.top]
        rows: list[tuple[str, str, str, bytes]] = []
        size = 0
        while waiting:
            at = waiting.pop()
            for info in system.get_file_info(fs.FileSelector(f"{base}/{at}")):
                if info.type == fs.FileType.Directory:
                    waiting.append(f"{at}/{info.base_name}")
                    continue
                field = FIELD_OF.get(info.base_name)
                if field is None or (self.fields is not None and field not in self.fields):
                    continue
                with system.open_input_stream(info.path, compression=None) as f:
                    text = f.read()
                rows.append((unquote(part.project), "/".join(map(unquote, at.split("/"))), field, text))
                size += len(text)
                if len(rows) == 1000 or size > 1 << 22:
                    yield self.batch(rows)
                    rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple[str, str, str, bytes]]) -> pa.RecordBatch:
        project, path, field, text = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(project, pa.string()), pa.array(path, pa.string()), pa.array(field, pa.string()), pa.array(text, pa.binary()).cast(pa.string())],
            names=["project", "path", "field", "text"],
        )


class TreeReader(_Tree, DataSourceReader):
    def partitions(self) -> list[Part]:
        system, root = open_root(self.root)
        if self.projects is None:
            return self.parts(folders(system, root))
        named = sorted(quote(p, safe="") for p in self.projects)
        return self.parts([p for p in named if system.get_file_info(f"{root}/{p}").type == fs.FileType.Directory])


class TreeStreamReader(_Tree, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        system, root = open_root(self.root)
        found = system.get_file_info(fs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
        return {"commit": max((int(f.base_name) for f in found), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        system, root = open_root(self.root)
        projects: set[str] = set()
        for number in range(start["commit"] + 1, end["commit"] + 1):
            with system.open_input_stream(f"{root}/{COMMITS}/{number:010d}", compression=None) as f:
                projects.update(json.loads(f.read()))
        if self.projects is not None:
            projects &= {quote(p, safe="") for p in self.projects}
        return self.parts(sorted(projects))

    def commit(self, end: dict) -> None:
        pass


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.stage = root, f"_stage-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Wrote:
        system, root = open_root(self.root)
        projects: set[str] = set()
        files = 0
        last = None
        for row in rows:
            if row.text is None or row.field not in FILE_OF:
                continue
            project = quote(row.project, safe="")
            folder = posixpath.join(root, self.stage, project, *(quote(p, safe="") for p in row.path.split("/")))
            if folder != last:
                system.create_dir(folder, recursive=True)
                last = folder
            with system.open_output_stream(f"{folder}/{FILE_OF[row.field]}", compression=None) as f:
                f.write(row.text.encode())
            projects.add(project)
            files += 1
        return Wrote(sorted(projects), files)

    def commit(self, messages: list[Wrote | None]) -> None:
        system, root = open_root(self.root)
        projects = sorted({p for m in messages if m is not None for p in m.projects})
        for p in projects:
            if system.get_file_info(f"{root}/{p}").type == fs.FileType.Directory:
                system.delete_dir(f"{root}/{p}")
            system.move(f"{root}/{self.stage}/{p}", f"{root}/{p}")
        self.abort(messages)
        system.create_dir(f"{root}/{COMMITS}", recursive=True)
        number = max((int(f.base_name) for f in system.get_file_info(fs.FileSelector(f"{root}/{COMMITS}"))), default=0) + 1
        with system.open_output_stream(f"{root}/{COMMITS}/{number:010d}", compression=None) as f:
            f.write(json.dumps(projects).encode())

    def abort(self, messages: list) -> None:
        system, root = open_root(self.root)
        if system.get_file_info(f"{root}/{self.stage}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.stage}")


class ElementTree(DataSource):
    """Rows (project, path, field, text); a null text and an unknown field have no file.  An element path has no empty parts."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"])


FILES = "file_tree"
FILES_SCHEMA = "project STRING, path STRING, content STRING, size LONG, mtime TIMESTAMP"
#: Folders that the driver divides a tree into, and the most folders in one that it still divides.
DIVIDE, DIVIDE_MOST = 256, 10_000


@dataclass
class Folder(InputPartition):
    path: str
    below: bool


def shown(info: fs.FileInfo) -> bool:
    """As Spark's file sources: no names that begin with a dot or an underscore."""
    name = info.base_name
    return not name.startswith(".") and (not name.startswith("_") or "=" in name) and not name.endswith("._COPYING_")


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.suffixes = tuple(json.loads(options["suffixes"])) if "suffixes" in options else None
        self.content = options.get("content", "true") == "true"

    def partitions(self) -> list[Folder]:
        """Upper folders alone and lower folders with all below them, some hundreds; further levels are the tasks' work."""
        system, root = open_root(self.root)
        wide = deque(f"{root}/{p}" for p in folders(system, root))
        alone: list[Folder] = []
        kept: list[Folder] = []
        while wide and len(wide) + len(kept) < DIVIDE:
            at = wide.popleft()
            found = [i for i in system.get_file_info(fs.FileSelector(at)) if shown(i)]
            inner = [i.path for i in found if i.type == fs.FileType.Directory]
            if len(inner) > DIVIDE_MOST:
                kept.append(Folder(at, True))
                continue
            if len(inner) < len(found):
                alone.append(Folder(at, False))
            wide.extend(inner)
        return alone + kept + [Folder(at, True) for at in wide]

    def read(self, part: Folder | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no partitions
            return
        system, root = open_root(self.root)
        waiting, rows, size = [part.path], [], 0
        while waiting:
            for info in filter(shown, system.get_file_info(fs.FileSelector(waiting.pop()))):
                if info.type == fs.FileType.Directory:
                    if part.below:
                        waiting.append(info.path)
                    continue
                if self.suffixes is not None and not info.base_name.endswith(self.suffixes):
                    continue
                text = None
                if self.content:
                    with system.open_input_stream(info.path, compression=None) as f:
                        text = f.read().decode("utf-8", "replace")
                    size += len(text)
                project, path = unquote(info.path.removeprefix(root).lstrip("/")).split("/", 1)
                rows.append((project, path, text, info.size, info.mtime_ns // 1000))
                if len(rows) == 1000 or size > 1 << 22:
                    yield self.batch(rows)
                    rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC")]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["project", "path", "content", "size", "mtime"]
        )


class FileTree(DataSource):
    """Rows (project, path, content, size, mtime) of the files below a root; option `suffixes`, a list in JSON, and `content`, false to read none."""

    @classmethod
    def name(cls) -> str:
        return FILES

    def schema(self) -> str:
        return FILES_SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the sources known to a session."""
    spark.dataSource.register(ElementTree)
    spark.dataSource.register(FileTree)
    return spark
