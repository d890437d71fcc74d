"""Repository trees and contents of a hosting service, as DataFrames.

The transport is a callable ``get(path) -> parsed JSON`` given by the caller, so
that the same code runs against the network, a cache, or a fixture.  Contents
are fetched in parallel by the executors, one small batch per task.
"""

from __future__ import annotations

from collections.abc import Callable
from time import sleep, time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewick.functions import values

TREE = "path string, type string, sha string, size long"
RATE_WAIT_MOST = 3600


class RateLimited(Exception):
    """Raised by a transport; ``reset`` is when calls are allowed again (seconds since the epoch)."""

    def __init__(self, reset: float):
        super().__init__(f"rate limited until {reset}")
        self.reset = reset


def patiently(get: Callable[[str], dict], path: str) -> dict:
    """Call once more after a rate limit that ends within an hour."""
    try:
        return get(path)
    except RateLimited as limit:
        wait = limit.reset - time()
        if wait >= RATE_WAIT_MOST:
            raise
        sleep(max(0.0, wait))
        return get(path)


class NoAccess(Exception):
    """The token is not valid, or the repository can't be read with it."""


def check_access(fetch: Callable[[str], tuple[int, dict, dict]], owner: str, repo: str, with_token: bool = False) -> dict:
    """What is known of a repository that can be read: {full_name, private, default_branch}.

    ``fetch(path)`` gives status, headers (lower-case names) and parsed JSON.  A
    token is checked first; a used-up rate limit raises ``RateLimited``.
    """
    body: dict = {}
    for path in (["/user"] if with_token else []) + [f"/repos/{owner}/{repo}"]:
        status, headers, body = fetch(path)
        if status == 401:
            raise NoAccess("the token is not valid")
        if status in (403, 429) and headers.get("x-ratelimit-remaining") == "0":
            raise RateLimited(float(headers.get("x-ratelimit-reset", 0)))
        if status == 404:
            raise NoAccess(f"{owner}/{repo} does not exist or is private")
        if status >= 400:
            raise NoAccess(f"{owner}/{repo}: status {status}")
    return {k: body.get(k) for k in ("full_name", "private", "default_branch")}


def repo_files(spark: SparkSession, get: Callable[[str], dict], owner: str, repo: str) -> DataFrame:
    """Paths of the repository's default branch that have a known extension."""
    branch = patiently(get, f"/repos/{owner}/{repo}")["default_branch"]
    tree = patiently(get, f"/repos/{owner}/{repo}/git/trees/{branch}?recursive=1")["tree"]
    rows = [(t["path"], t["type"], t.get("sha"), t.get("size")) for t in tree]
    return source_files(spark.createDataFrame(rows, TREE))


def source_files(tree: DataFrame) -> DataFrame:
    return tree.filter((F.col("type") == "blob") & F.col("path").rlike(values.REMOTE_EXTENSIONS))


def decoded(content):
    """Base64 content as UTF-8 text."""
    return F.decode(F.unbase64(F.regexp_replace(content, r"\s", "")), "UTF-8")


def repo_contents(files: DataFrame, get: Callable[[str], dict], owner: str, repo: str, per_task: int = 50) -> DataFrame:
    """(relative_path, content): fetched by executors; what cannot be fetched has a null content."""

    def fetch(batches):
        import pandas as pd

        for pdf in batches:
            found = []
            for path in pdf["path"]:
                try:
                    found.append(patiently(get, f"/repos/{owner}/{repo}/contents/{path}").get("content"))
                except RateLimited:
                    raise
                except Exception:  # one file's failure leaves the others
                    found.append(None)
            yield pd.DataFrame({"relative_path": pdf["path"], "encoded": found})

    tasks = max(1, -(-files.count() // per_task))
    return files.select("path").repartition(tasks).mapInPandas(fetch, "relative_path string, encoded string").select("relative_path", decoded(F.col("encoded")).alias("content"))
