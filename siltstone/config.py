"""The settings of a run, from the environment: one frozen object that the entry points pass on."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from datetime import timedelta

from siltstone.functions.text import BOT_PATTERN
from siltstone.operators.sampling import Sampling

BINS = (20, 50, 200, 1000)  # fixed value


def flag(raw: str) -> bool:
    known = dict.fromkeys(("true", "1", "yes", "on"), True) | dict.fromkeys(("false", "0", "no", "off"), False)
    try:
        return known[raw.strip().lower()]
    except KeyError:
        raise ValueError(f"{raw!r} is neither yes nor no") from None


def bins(raw: str) -> tuple[int, ...]:
    """Ascending positive edges, comma-separated; nothing stands for the default."""
    words = [w.strip() for w in raw.split(",")]
    edges = tuple(int(w) for w in words if w) or BINS
    if edges[0] <= 0 or any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError(f"edges must be positive and ascend: {raw!r}")
    return edges


def seconds(raw: str) -> timedelta:
    return timedelta(seconds=int(raw))


def minutes(raw: str) -> timedelta:
    return timedelta(minutes=int(raw))


def any_case(raw: str) -> re.Pattern[str]:
    return re.compile(raw, re.IGNORECASE)


def _knob(name: str, default: str | None, read: Callable = str):
    """A setting: its variable, the default as text (None: required), and how the text is read. Nothing is given for an
    optional setting whose default is empty."""
    return field(metadata={"name": name, "default": default, "read": read})


@dataclass(frozen=True)
class Settings:
    store: str = _knob("STORE_URI", None)
    workers: int = _knob("WORKER_CONCURRENCY", "12", int)
    first_hour: str = _knob("GHA_START", "2020-06-01-00")
    last_hour: str = _knob("GHA_END", "2020-06-30-23")
    scratch: str = _knob("SCRATCH_DIR", "/scratch")
    bots: re.Pattern[str] = _knob("BOT_REGEX", BOT_PATTERN, any_case)
    max_repo_mb: int = _knob("MAX_REPO_SIZE_MB", "2048", int)
    repo_timeout: timedelta = _knob("PER_REPO_TIMEOUT_SEC", "600", seconds)
    claim_ttl: timedelta = _knob("STALE_CLAIM_TTL_MIN", "20", minutes)
    emoji_top: int = _knob("EMOJI_TOP_N", "20", int)
    samples: int = _knob("SAMPLE_PROFANE_N", "5", int)
    token: str = _knob("GITHUB_TOKEN", "")
    user_agent: str = _knob("GITHUB_USER_AGENT", "siltstone")
    git_timeout: timedelta = _knob("GIT_SUBPROCESS_TIMEOUT_SEC", "300", seconds)
    profane_cohort: int = _knob("PROFANE_COHORT_SIZE", "750", int)
    clean_cohort: int = _knob("CLEAN_COHORT_SIZE", "750", int)
    min_commits: int = _knob("SAMPLING_MIN_COMMITS", "20", int)
    commit_bins: tuple[int, ...] = _knob("SAMPLING_COMMIT_BINS", ",".join(map(str, BINS)), bins)
    clean_up: bool = _knob("CLEANUP_AFTER_REPO", "true", flag)
    eslint_config: str = _knob("ESLINT_CONFIG_PATH", "/opt/node-tools/eslint.config.mjs")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        given = {}
        for f in fields(cls):
            m = f.metadata
            raw = env.get(m["name"], m["default"])
            if not raw and m["default"] is None:
                raise ValueError(f"{m['name']} must be set")
            try:
                given[f.name] = m["read"](raw)
            except (ValueError, re.error) as bad:
                raise ValueError(f"{m['name']}: {bad}") from None
        return cls(**given)

    def sampling(self, seed: int = 42) -> Sampling:
        return Sampling(bins=self.commit_bins, min_commits=self.min_commits, seed=seed)
