"""Version control steps of a worker: a clone without file contents, the last commit before a cutoff, a checkout."""

from __future__ import annotations

import subprocess

from siltstone.operators.worker import DETAIL, GitError


def _git(args: list[str], timeout: float, folder: str | None = None) -> str:
    try:
        done = subprocess.run(["git", *args], cwd=folder, capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired) as why:
        raise GitError(str(why)) from why
    if done.returncode:
        raise GitError(done.stderr.strip()[:DETAIL])
    return done.stdout


def partial_clone(url: str, folder: str, timeout: float) -> None:
    """History and trees; contents come when they are checked out."""
    _git(["clone", "--quiet", "--filter=blob:none", "--no-checkout", url, folder], timeout)


def sha_before(folder: str, cutoff: str, timeout: float) -> str | None:
    """The last commit of the default branch before the cutoff (ISO time); None if there is none."""
    return _git(["rev-list", "-1", f"--before={cutoff}", "HEAD"], timeout, folder).strip() or None


def checkout(folder: str, sha: str, timeout: float) -> None:
    _git(["checkout", "--quiet", sha], timeout, folder)
