"""Hourly archives as a stream: the offset is the next hour, a trigger takes so many files, a failed batch is read again."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from siltstone.sources.http import RETRIES, get

HOUR = "%Y-%m-%d-%H"
SCHEMA = "file_id string, file_bytes bigint, value string, line_no bigint"
LINES = 8192  #: of a record batch


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def stored(base: str, hour: datetime, retries: int = RETRIES) -> list[bytes]:
    """The files of an hour as stored: one by HTTP; below a folder <date>-<hour>.json.gz, or all in file_id=<date>-<hour>."""
    name = f"{hour:%Y-%m-%d}-{hour.hour}.json.gz"
    if base.startswith(("http://", "https://")):
        body = get(f"{base.rstrip('/')}/{name}", retries)
        return [] if body is None else [body]
    fs, path = _folder(base)
    single, many = fs.get_file_info([f"{path.rstrip('/')}/{name}", f"{path.rstrip('/')}/file_id={hour:{HOUR}}"])
    found = [single] if single.type == pafs.FileType.File else sorted(fs.get_file_info(pafs.FileSelector(many.path)), key=lambda f: f.path) if many.type == pafs.FileType.Directory else []
    return [fs.open_input_file(f.path).readall() for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]


class _Hour(InputPartition):
    def __init__(self, hour: datetime):
        self.hour = hour


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.first, self.last = (datetime.strptime(options[k], HOUR) if k in options else None for k in ("first", "last"))
        self.files = int(options.get("filespertrigger", 0))
        self.at: int | None = None  #: up to where batches are planned, as far as this reader knows

    def _available(self) -> int:
        """Hours from first to last, or to the last one that has ended."""
        last = self.last or datetime.now(timezone.utc).replace(tzinfo=None) - timedelta(hours=1)
        return max(0, int((last - self.first).total_seconds() // 3600) + 1)

    def _planned(self) -> int:
        """The end of the last batch in the query's own log, which a restarted query goes on from."""
        fs, path = _folder(self.options["checkpoint"])
        listed = fs.get_file_info(pafs.FileSelector(f"{path.rstrip('/')}/offsets", allow_not_found=True))
        batches = [f for f in listed if f.base_name.isdigit()]
        if not batches:
            return 0
        lines = fs.open_input_file(max(batches, key=lambda f: int(f.base_name)).path).readall().decode().splitlines()
        return next((json.loads(x)["hour"] for x in reversed(lines) if '"hour"' in x), 0)

    def initialOffset(self) -> dict:
        self.at = 0
        return {"hour": 0}

    def latestOffset(self) -> dict:
        if not self.files:
            return {"hour": self._available()}
        if self.at is None:
            self.at = self._planned()
        return {"hour": max(self.at, min(self._available(), self.at + self.files))}

    def partitions(self, start: dict, end: dict) -> list[_Hour]:
        self.at = max(self.at or 0, end["hour"])
        return [_Hour(self.first + timedelta(hours=k)) for k in range(start["hour"], end["hour"])]

    def read(self, partition: _Hour) -> Iterator[pa.RecordBatch]:
        files = stored(self.options["base"], partition.hour, int(self.options.get("retries", RETRIES)))
        size, name, n = sum(map(len, files)), f"{partition.hour:{HOUR}}", 0
        names, types = zip(("file_id", pa.string()), ("file_bytes", pa.int64()), ("value", pa.string()), ("line_no", pa.int64()))
        held: list[tuple] = []
        for body in files:
            for line in gzip.decompress(body).split(b"\n"):
                if line.strip():
                    held.append((name, size, line.decode("utf-8", "replace"), n))
                n += 1
                if len(held) == LINES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], list(names))
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], list(names))


class ArchiveStream(DataSource):
    """spark.dataSource.register(ArchiveStream), then spark.readStream.format("hourly_archive_stream") with the options first
    (YYYY-MM-DD-HH), last (both included; else up to the last full hour), base (an address or a folder), retries,
    filesPerTrigger, and with it checkpoint, the query's checkpointLocation, where a restarted query finds how far it was.

    Every hour is a partition, so a lost task fetches its own file again; an hour without a file has no rows. A batch that
    failed is planned again from the query's log with the same hours.
    """

    @classmethod
    def name(cls) -> str:
        return "hourly_archive_stream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _StreamReader:
        options = {k.lower(): v for k, v in dict(self.options).items()}
        if "filespertrigger" in options and "checkpoint" not in options:
            raise ValueError("filesPerTrigger needs the option checkpoint")
        return _StreamReader(options)
