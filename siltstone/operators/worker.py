"""Work on repositories one by one: every outcome becomes a row, whatever goes wrong; and the tools' fan-out."""

from __future__ import annotations

import signal
import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame

DETAIL = 200  #: characters of an error's text that a reason keeps
OUTCOME = "id bigint, claimed_by string, ok boolean, reason string, result string, elapsed double"


class Skip(Exception):
    """A repository that is not to be analysed; the text says why."""


class GitError(Exception):
    """A version control step failed."""


class OutOfTime(BaseException):
    """Not an Exception, so that a step's own handlers do not swallow it."""


@contextmanager
def time_limit(seconds: float | None):
    """Raise OutOfTime in the block after so many seconds. Needs the process's main thread, as Python workers have it;
    elsewhere there is no limit."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(signum, frame):
        raise OutOfTime

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def attempt(step: Callable[[dict], str | None], row: dict, timeout: float | None, clean_up: Callable[[dict], None] | None = None) -> tuple[bool, str | None, str | None, float]:
    """(ok, reason, result, elapsed) of one row: never raises."""
    began, reason, result = time.monotonic(), None, None
    try:
        with time_limit(timeout):
            result = step(row)
    except OutOfTime:
        reason = "timeout"
    except Skip as why:
        reason = f"skip: {why}"
    except GitError as why:
        reason = f"git: {str(why)[:DETAIL]}"
    except Exception as why:  # noqa: BLE001  every failure is an outcome
        reason = f"{type(why).__name__}: {str(why)[:DETAIL]}"
    finally:
        if clean_up is not None:
            clean_up(row)
    return reason is None, reason, result, time.monotonic() - began


def process(rows: DataFrame, step: Callable[[dict], str | None], timeout: float | None = 600.0, clean_up: Callable[[dict], None] | None = None) -> DataFrame:
    """Outcomes (id, claimed_by, ok, reason, result, elapsed) of step over rows, which hold id and what step reads.

    A task works through its rows one after another; a lost executor's rows are worked on again, so a step must bear that.
    lifecycle.settle applies the outcomes where the claim still holds.
    """

    def run(batches: Iterable[pd.DataFrame]):
        for b in batches:
            out = [(r.get("id"), r.get("claimed_by"), *attempt(step, r, timeout, clean_up)) for r in b.to_dict("records")]
            frame = pd.DataFrame(out, columns=["id", "claimed_by", "ok", "reason", "result", "elapsed"])
            yield frame.astype({"claimed_by": object, "reason": object, "result": object}).where(frame.notna(), None)

    return rows.mapInPandas(run, OUTCOME)


def drain(claim: Callable[[], DataFrame], settle: Callable[[DataFrame], None], step: Callable[[dict], str | None], stop: threading.Event | None = None, **options) -> int:
    """Claim rows, work on them and settle the outcomes until claim gives none or stop is set; the number worked on."""
    done = 0
    while stop is None or not stop.is_set():
        rows = claim()
        n = rows.count()
        if not n:
            break
        settle(process(rows, step, **options))
        done += n
    return done


def run_all(tools: dict[str, Callable[[], object]], defaults: dict[str, object], workers: int = 4) -> dict[str, object]:
    """The result of every tool of one repository, run side by side; one that fails or is not listed gives its default."""

    def safely(name: str) -> object:
        try:
            return tools[name]()
        except Exception:  # noqa: BLE001  one tool's failure must not sink the others
            return defaults[name]

    with ThreadPoolExecutor(max_workers=workers) as pool:
        running = {name: pool.submit(safely, name) for name in defaults if name in tools}
        return {name: running[name].result() if name in running else default for name, default in defaults.items()}
