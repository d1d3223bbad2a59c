"""Fetching over HTTP: a patient GET, a rate-limited client, and hourly archives as a Spark data source."""

from __future__ import annotations

import gzip
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIES, MOST_WAIT = 5, 30.0
#: The client slows down below so many requests left, waits no longer than this for the limit to be lifted, and asks once more.
LOW_WATER, MOST_PAUSE = 100, 60.0


def _open(url: str, headers: dict[str, str], timeout: float) -> tuple[int, dict[str, str], bytes]:
    """(status, headers in lower case, body); an error status is an answer, not an exception."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as got:
            return got.status, {k.lower(): v for k, v in got.headers.items()}, got.read()
    except urllib.error.HTTPError as bad:
        return bad.code, {k.lower(): v for k, v in bad.headers.items()}, bad.read()


def get(url: str, retries: int = RETRIES, headers: dict[str, str] | None = None, timeout: float = 60.0, opened: Callable = _open, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """The body, or None if there is no such file. Server errors, broken connections and refusals for haste are tried again,
    after the pause asked for, else after twice the last one, at most MOST_WAIT seconds."""
    for turn in range(retries + 1):
        wait = min(2.0**turn, MOST_WAIT)
        try:
            status, answer, body = opened(url, headers or {}, timeout)
        except OSError as broken:
            if turn == retries:
                raise RuntimeError(f"{url}: {broken}") from broken
        else:
            if status < 300:
                return body
            if status == 404:
                return None
            if turn == retries or (status < 500 and status != 429):
                raise RuntimeError(f"{url}: status {status}")
            if status == 429 and answer.get("retry-after", "").isdigit():
                wait = float(answer["retry-after"])
        sleep(wait)
    raise AssertionError("not reached")


class Client:
    """JSON from an API that counts requests: it pauses when few are left, and asks once more when it was refused."""

    def __init__(self, base: str, token: str = "", user_agent: str = "siltstone", opened: Callable = _open, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time):
        self.base, self.opened, self.sleep, self.now = base.rstrip("/"), opened, sleep, now
        self.headers = {"User-Agent": user_agent, "Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})

    def _pause(self, answer: dict[str, str]) -> float:
        if answer.get("retry-after", "").isdigit():
            return min(float(answer["retry-after"]), MOST_PAUSE)
        try:
            return max(0.0, min(float(answer["x-ratelimit-reset"]) - self.now(), MOST_PAUSE))
        except (KeyError, ValueError):
            return 1.0

    def json(self, path: str, timeout: float = 30.0):
        """The answer, or None if there is none: no such thing, refused twice, or not JSON."""
        for turn in range(2):
            try:
                status, answer, body = self.opened(f"{self.base}/{path.lstrip('/')}", self.headers, timeout)
            except OSError:
                status, answer, body = 599, {}, b""
            refused = status == 429 or (status == 403 and answer.get("x-ratelimit-remaining") == "0") or status >= 500
            if refused and not turn:
                self.sleep(self._pause(answer))
                continue
            if status >= 300:
                return None
            left = answer.get("x-ratelimit-remaining", "")
            if left.isdigit() and int(left) < LOW_WATER:
                self.sleep(self._pause(answer))
            try:
                return json.loads(body)
            except ValueError:
                return None
        return None


class _Hour(InputPartition):
    def __init__(self, file_id: str, url: str):
        self.file_id, self.url = file_id, url


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[_Hour]:
        """One for each hourly file, so that a lost task fetches its own file again."""
        from datetime import datetime, timedelta

        at, end = (datetime.strptime(self.options[k], "%Y-%m-%d-%H") for k in ("first", "last"))
        if end < at:
            raise ValueError("last lies before first")
        base, out = self.options["base"].rstrip("/"), []
        while at <= end:
            out.append(_Hour(f"{at:%Y-%m-%d-%H}", f"{base}/{at:%Y-%m-%d}-{at.hour}.json.gz"))
            at += timedelta(hours=1)
        return out

    def read(self, part: _Hour) -> Iterator[tuple]:
        body = get(part.url, int(self.options.get("retries", RETRIES)))
        if body is not None:
            for n, line in enumerate(gzip.decompress(body).split(b"\n")):
                if line.strip():
                    yield part.file_id, len(body), line.decode("utf-8", "replace"), n


class ArchiveSource(DataSource):
    """spark.dataSource.register(ArchiveSource), then spark.read.format("hourly_archive") with the options first, last
    (YYYY-MM-DD-HH, both included), base and retries: rows like archive.read_lines. A file that is not there has no rows."""

    @classmethod
    def name(cls) -> str:
        return "hourly_archive"

    def schema(self) -> str:
        return "file_id string, file_bytes bigint, value string, line_no bigint"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))
