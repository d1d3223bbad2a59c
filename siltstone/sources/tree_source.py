"""Source trees as a data source: a partition for each repository folder, whose walk never lists what is skipped."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

from siltstone.sources.tree import MAX_BYTES, SKIP_DIRS, SKIP_NAMES

BATCH_BYTES = 8 << 20  #: of contents in a record batch
SCHEMA = "repo string, path string, length bigint, content string"


def folder(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return fs, path.rstrip("/")


class _Repository(InputPartition):
    def __init__(self, name: str, path: str):
        self.name, self.path = name, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base = options["path"]
        self.single = options.get("single", "false").lower() == "true"
        self.most = int(options.get("maxbytes", MAX_BYTES))
        self.contents = options.get("contents", "true").lower() == "true"
        self.repos: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Names of repositories leave their folders unlisted; lengths leave files unread. Both are applied whole."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("repo",):
                self.repos = {f.value} if self.repos is None else self.repos & {f.value}
            elif isinstance(f, In) and f.attribute == ("repo",):
                self.repos = set(f.value) if self.repos is None else self.repos & set(f.value)
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("length",):
                self.most = min(self.most, int(f.value))
            elif isinstance(f, LessThan) and f.attribute == ("length",):
                self.most = min(self.most, int(f.value) - 1)
            else:
                yield f

    def partitions(self) -> list[_Repository]:
        """The folders right below the path: names only, nothing below them is listed here."""
        fs, path = folder(self.base)
        if self.single:
            found = [_Repository(path.rpartition("/")[2], path)]
        else:
            listed = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
            found = [_Repository(f.base_name, f.path) for f in sorted(listed, key=lambda f: f.path) if f.type == pafs.FileType.Directory]
        wanted = [r for r in found if self.repos is None or r.name in self.repos]
        return wanted or [_Repository("", "")]

    def _files(self, fs: pafs.FileSystem, path: str) -> Iterator[pafs.FileInfo]:
        """The files that count, folder by folder."""
        todo = [path]
        while todo:
            for f in sorted(fs.get_file_info(pafs.FileSelector(todo.pop(), allow_not_found=True)), key=lambda f: f.path):
                if f.type == pafs.FileType.Directory and f.base_name not in SKIP_DIRS:
                    todo.append(f.path)
                elif f.type == pafs.FileType.File and f.size <= self.most and not any(s in f.base_name for s in SKIP_NAMES):
                    yield f

    def read(self, partition: _Repository) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, base = folder(self.base)
        names, types = ["repo", "path", "length", "content"], [pa.string(), pa.string(), pa.int64(), pa.string()]
        held, size = [], 0
        for f in self._files(fs, partition.path):
            body = fs.open_input_file(f.path).readall() if self.contents else None
            length, text = (f.size, None) if body is None else (len(body), body.decode("utf-8", "replace"))
            held.append((partition.name, f.path[len(base if not self.single else partition.path) + 1 :], length, text))
            size += 256 + (length if self.contents else 0)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


class TreeSource(DataSource):
    """Format source_tree: repo, path (below the path given), length and content of every file that counts, of the folders
    right below path, or with single of the one folder. maxBytes: longer files are left out. contents false: files are listed,
    not read, and their content is null."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in dict(self.options).items()})


def read_trees(spark: SparkSession, path: str, **options) -> DataFrame:
    """The files of all repositories below path; filters by repo and length reach the walk."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").options(**{k: str(v) for k, v in options.items()}).load(path)
